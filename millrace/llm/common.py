"""What the operators of this subpackage share: reading, shared scratch tables, Arrow maps, bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64())}


SEED = 17
SLICE = 512
SLICE_BYTES = 1 << 23


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the cluster names one.

    Only where neither the session nor its context has one, and the session is local (a test), is a local folder set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df once as Parquet into the shared folder and read it back.

    Unlike checkpoint() this computes df once.  The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/millrace-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(rows: int, each: int = 200_000) -> int:
    """How many partitions of about `each` narrow rows a table of so many rows is written in."""
    return max(1, -(-rows // each))


def dropped(df: DataFrame) -> None:
    """Delete the files behind a table made by written() that no later plan reads."""
    spark = df.sparkSession
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def trim() -> None:
    """Give back to the system what earlier work of this worker process has freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of SLICE rows and SLICE_BYTES (or one row) at most, so that few are Python objects at once.

    Workers are used again by later tasks, so memory is given back before the first batch and after the last.
    """
    trim()
    for b in batches:
        todo = [b]
        while todo:
            b = todo.pop()
            n = b.num_rows
            if n > SLICE or n > 1 and b.nbytes > SLICE_BYTES:
                cut = SLICE if n > SLICE else n // 2
                todo += [b.slice(cut), b.slice(0, cut)]
            elif n:
                yield b
    trim()


def append_columns(df: DataFrame, outputs: dict[str, str], factory: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """df with further columns, computed from Arrow batches; all other columns pass through.

    outputs: name -> type (a key of ARROW).  factory runs once per task and returns the function that gives, for a
    batch, one list per output.  An input column that has an output's name is replaced.  Batches are worked on in
    slices of SLICE rows, so what is held as Python objects stays small.
    """
    keep = [c for c in df.columns if c not in outputs]
    src = df.select(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)))  # a name may hold a dot
    schema = T.StructType(src.schema.fields + [T.StructField(f"o{i}", T._parse_datatype_string(k)) for i, k in enumerate(outputs.values())])
    names, kinds = schema.names, [ARROW[k] for k in outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = factory()
        for b in slices(batches):
            made = compute(b)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=names)

    return src.mapInArrow(run, schema).toDF(*keep, *outputs)


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ..., and what each name became: nothing an operator adds can clash."""
    names = {n: f"c{i}" for i, n in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, under their names, of a frame made from renamed(like)."""
    return df.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(like.columns)))


def held_out(doc_id: Column) -> Column:
    """Rows that no label or statistic may be learned from; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def one_per_id(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """One row for each value of the column `key`: that of the least values, so that no layout of the table matters."""
    return rows.groupBy(key).agg(F.min(F.struct(*values)).alias("least")).select(key, *(F.col(f"least.{v}").alias(v) for v in values))


def near(key: Column, share: float | Column) -> Column:
    """True for about `share` of all values of the key, by a hash of it: the same on every run and in every layout."""
    return F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 40)) < F.lit(float(1 << 40)) * share


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n values of the column `key`, one row each, chosen by a hash: the same however df is partitioned.

    A hash threshold from the (approximate) number of different values leaves about 1.2 n of them before the ordered cut,
    so no task sorts more, and a value that is repeated neither starves the sample nor fills it.
    """
    total = df.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    if total > n:
        df = df.where(near(F.col(key), min(1.0, (1.2 * n + 200) / total)))
    return df.select(key).distinct().orderBy(F.xxhash64(key, F.lit(SEED)), key).limit(n)
