"""Sources and sinks: CSV and typed CSV, Arrow, JSON lines, archives, files, and the text forms in which results are shown."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain, islice
from urllib.parse import quote
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: About how many bytes of entries go into an Arrow batch.
BATCH_BYTES = 1 << 22
#: Entries of an archive that is written; zipfile keeps the header of each until the archive is closed, and reads them all.
ARCHIVE_ENTRIES = 5_000


def csv(spark: SparkSession, path: str, header: bool = True, separator: str = ",") -> DataFrame:
    """A CSV file with every column as text; quoted line ends belong to their cell."""
    return spark.read.csv(path, header=header, sep=separator, multiLine=True, escape='"')


def typed_csv(spark: SparkSession, path: str, schema: str, header: bool = True, separator: str = ",") -> DataFrame:
    """A CSV file with typed columns; a cell that does not fit its type is null."""
    return spark.read.schema(schema).csv(path, header=header, sep=separator, mode="PERMISSIVE", escape='"')


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path: a URI's own, or the mounted one."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The files of a folder, or the file itself, as paths of its file system."""
    where, at = _place(path)
    found = where.get_file_info(at)
    if found.type != fs.FileType.Directory:
        return [at]
    return sorted(f.path for f in where.get_file_info(fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", ".")))


class _Part(InputPartition):
    def __init__(self, path: str, index: int):
        super().__init__((path, index))
        self.path, self.index = path, index


class _ArrowReader(DataSourceReader):
    """One partition for each record batch of an IPC file, or one for a stream."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        out = []
        where, _ = _place(self.path)
        for p in _files(self.path):
            with where.open_input_file(p) as f:
                try:
                    out += [_Part(p, i) for i in range(pa.ipc.open_file(f).num_record_batches)]
                except pa.ArrowInvalid:
                    out.append(_Part(p, -1))
        return out

    def read(self, part) -> Iterator[pa.RecordBatch]:
        where, _ = _place(self.path)
        with where.open_input_file(part.path) as f:
            if part.index < 0:
                yield from pa.ipc.open_stream(f)
            else:
                yield pa.ipc.open_file(f).get_batch(part.index)


class ArrowSource(DataSource):
    """spark.read.format("arrow_ipc").load(path): Arrow IPC files or streams, one or a folder of them, of any file system
    that pyarrow opens; a task reads the record batch that it is given."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        where, _ = _place(self.options["path"])
        with where.open_input_file(_files(self.options["path"])[0]) as f:
            try:
                found = pa.ipc.open_file(f).schema
            except pa.ArrowInvalid:
                f.seek(0)
                found = pa.ipc.open_stream(f).schema
        return from_arrow_schema(found)

    def reader(self, schema):
        return _ArrowReader(self.options["path"])


def arrow(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrowSource)
    return spark.read.format("arrow_ipc").option("path", path).load()


def _written(df: DataFrame, folder: str, suffix: str, save: Callable[[Iterator, pa.NativeFile], int], parts: Callable[[Iterator[pa.RecordBatch]], Iterable[Iterator]] = lambda batches: [batches]) -> int:
    """One file for each of the parts of each partition of df, under their numbers; the number of rows.

    Files are written under other names and moved when the last is whole, so a task that is run again replaces its files,
    never half of one.  The number of parts must follow from the number of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where, at = _place(folder)
        n, names = 0, []
        for part in parts(batches):
            names.append(f"part-{task.partitionId():06d}" + (f"-{len(names):06d}" if names else "") + suffix)
            with where.open_output_stream(f"{at}/_{names[-1]}.{task.taskAttemptId()}") as f:
                n += save(part, f)
        for name in names:
            where.move(f"{at}/_{name}.{task.taskAttemptId()}", f"{at}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    where, at = _place(folder)
    where.create_dir(at)
    return df.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_arrow(df: DataFrame, folder: str) -> int:
    """df as a folder of Arrow IPC files, one a partition; the number of rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.schema)

    def save(batches: Iterator[pa.RecordBatch], f: pa.NativeFile) -> int:
        n = 0
        with pa.ipc.new_file(f, schema) as w:
            for b in batches:
                w.write_batch(b.cast(schema))
                n += b.num_rows
        return n

    return _written(df, folder, ".arrow", save)


def write_archives(df: DataFrame, folder: str, kind: str = "zip") -> int:
    """(name, data) rows as entries of zip or tar archives, one archive for each ARCHIVE_ENTRIES rows of a partition at most;
    the number of entries.

    A null data is a directory.  Archives are built one entry at a time.
    """
    def save(rows: Iterator[tuple[str, bytes | None]], f: pa.NativeFile) -> int:
        n = 0
        out = zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) if kind == "zip" else tarfile.open(fileobj=f, mode="w|")
        with out:
            for name, data in rows:
                if kind == "zip":
                    out.writestr(name if data is not None else name.rstrip("/") + "/", data or b"")
                else:
                    info = tarfile.TarInfo(name)
                    info.type, info.size = (tarfile.DIRTYPE, 0) if data is None else (tarfile.REGTYPE, len(data))
                    out.addfile(info, io.BytesIO(data or b""))
                    out.members.clear()  # else every entry's header is kept
                n += 1
        return n

    return _written(df.select(F.col("name").cast("string"), F.col("data").cast("binary")), folder, f".{kind}", save, _archive_parts)


def _archive_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[str, bytes | None]]]:
    """The (name, data) rows of batches, ARCHIVE_ENTRIES at a time; no rows are one empty part."""
    rows = ((name.as_py(), data.as_py()) for b in batches for name, data in zip(b.column(0), b.column(1), strict=True))
    yield islice(rows, ARCHIVE_ENTRIES)
    for row in rows:
        yield chain([row], islice(rows, ARCHIVE_ENTRIES - 1))


def excel(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(path, row, cells) of a worksheet of the .xlsx files that a path or pattern names; cells are text, null where empty.

    A file is one row of binaryFile and is unpacked in its task; rows come out one by one.
    """
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(_sheet_rows(content, sheet, space))
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row long, cells array<string>")


def _sheet_rows(content: bytes, sheet: int, space: str) -> Iterator[tuple[int, list]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot().iter(f"{space}si")]
        number = 0
        for _, row in ElementTree.iterparse(z.open(f"xl/worksheets/sheet{sheet}.xml")):
            if row.tag != f"{space}row":
                continue
            number, cells = int(row.get("r", number + 1)), []
            for c in row.iter(f"{space}c"):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                column = reduce(lambda n, x: 26 * n + ord(x) - 64, letters, 0) - 1 if letters else len(cells)
                cells += [None] * (column - len(cells))
                v, inline = c.find(f"{space}v"), c.find(f"{space}is")
                text = "".join(t.text or "" for t in inline.iter(f"{space}t")) if inline is not None else v.text if v is not None else None
                cells.append(shared[int(text)] if c.get("t") == "s" and text is not None else text)
            yield number, cells
            row.clear()


class _Reader(io.BufferedReader):
    """zipfile looks for records before the start of a short archive, and expects an OSError."""

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            return super().seek(at, whence)
        except pa.ArrowInvalid as e:
            raise OSError(str(e)) from e


def _opened(uri: str) -> io.BufferedReader:
    """A file that Spark names, for reading at any place; only what is read is held."""
    if uri.startswith("file:"):
        where, at = fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    else:
        where, at = fs.FileSystem.from_uri(quote(uri, safe=":/@?=&"))
    return _Reader(where.open_input_file(at), 1 << 18)


def _entry_rows(file, kind: str) -> Iterator[tuple[str, int, bytes | None]]:
    """(name, size, data) of an archive's entries, one at a time; data is null for what is no file."""
    if kind == "zip":
        with zipfile.ZipFile(file) as z:
            for i in z.infolist():
                yield i.filename, i.file_size, None if i.is_dir() else z.read(i)
    else:
        with tarfile.open(fileobj=file, stream=True) as t:  # stream: the entries passed are not kept
            for i in t:
                yield i.name, i.size, t.extractfile(i).read() if i.isfile() else None


def _entries(kind: str, opened: Callable):
    """Arrow batches of about BATCH_BYTES, or one entry, from rows of (path, ...), whose last cell `opened` makes a file of."""

    def batch_of(path: str, rows: list) -> pa.RecordBatch:
        names, sizes, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(names), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["path", "name", "size", "data"])

    def run(batches):
        for b in batches:
            for path, at in zip(b.column(0), b.column(b.num_columns - 1), strict=True):
                path, rows, held = path.as_py(), [], 0
                with opened(at.as_py()) as file:
                    for r in _entry_rows(file, kind):
                        rows.append(r)
                        held += len(r[2] or b"") + 100
                        if held > BATCH_BYTES:
                            yield batch_of(path, rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(path, rows)

    return run


def _archive_entries(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """An archive is read entry by entry from its file system; only where pyarrow cannot open that does Spark hand over
    whole files, one row each, which then must fit in memory."""
    found = spark.read.format("binaryFile").load(path)
    one, columns, opened = found.select("path").first(), ["path"], _opened
    try:
        if one is not None:
            _opened(one["path"]).close()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        columns, opened = ["path", "content"], io.BytesIO
    return found.select(*columns).mapInArrow(_entries(kind, opened), "path string, name string, size long, data binary")


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, data) of every entry of the archives that a path or pattern names; a task holds few entries."""
    return _archive_entries(spark, path, "zip")


def tar_entries(spark: SparkSession, path: str) -> DataFrame:
    return _archive_entries(spark, path, "tar")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content."""
    return spark.read.format("binaryFile").load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Overwrite a folder; `by` lays rows out by key, rebalanced so that a hot key is split over files."""
    if by:
        df = df.hint("rebalance", *by)
    df.write.mode("overwrite").format(kind).partitionBy(*(by or [])).save(path)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """A table laid out for joins and groupings on keys without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def shown(df: DataFrame, mode: str = "list", limit: int = 1000) -> str:
    """Up to `limit` rows as list, csv, tabs, line, column, table, markdown or json."""
    rows, names = [tuple(r) for r in df.limit(limit).collect()], df.columns
    cell = lambda v: "" if v is None else str(v)
    if mode == "json":
        return json.dumps([dict(zip(names, r, strict=True)) for r in rows], default=str)
    if mode in ("list", "tabs"):
        return "\n".join(("|" if mode == "list" else "\t").join(map(cell, r)) for r in rows)
    if mode == "csv":
        import csv as c

        out = io.StringIO()
        c.writer(out, lineterminator="\n").writerows([names, *(map(cell, r) for r in rows)])
        return out.getvalue().rstrip("\n")
    if mode == "line":
        wide = max(map(len, names))
        return "\n\n".join("\n".join(f"{n:>{wide}} = {cell(v)}" for n, v in zip(names, r, strict=True)) for r in rows)
    widths = [max([len(n), *(len(cell(r[i])) for r in rows)]) for i, n in enumerate(names)]
    line = lambda r: [cell(v).ljust(w) for v, w in zip(r, widths, strict=True)]
    if mode == "markdown":
        return "\n".join("| " + " | ".join(r) + " |" for r in [line(names), ["-" * w for w in widths], *map(line, rows)])
    if mode == "table":
        rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
        return "\n".join([rule, "| " + " | ".join(line(names)) + " |", rule, *("| " + " | ".join(line(r)) + " |" for r in rows), rule])
    if mode == "column":
        return "\n".join("  ".join(r).rstrip() for r in [line(names), ["-" * w for w in widths], *map(line, rows)])
    raise ValueError(f"no mode {mode!r}")


def tables(spark: SparkSession, pattern: str = "*") -> DataFrame:
    return spark.sql(f"SHOW TABLES LIKE '{pattern}'").select("tableName")


def schema_sql(df: DataFrame, name: str) -> str:
    """A CREATE TABLE statement of df's columns."""
    return f"CREATE TABLE {name} (" + ", ".join(f"{n} {t.upper()}" for n, t in df.dtypes) + ")"


def profile(df: DataFrame) -> DataFrame:
    """column, rows, nulls, distinct (approximate), low, high of every column, from one aggregation."""
    found = df.agg(*(F.struct(F.count(F.lit(1)).alias("rows"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.approx_count_distinct(F.col(c).cast("string")).alias("distinct"), F.min(F.col(c).cast("string")).alias("low"), F.max(F.col(c).cast("string")).alias("high")).alias(c) for c in df.columns))
    return found.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in df.columns))).alias("e")).select("e.column", "e.v.*")
