"""Queries on tables that are larger, or have larger keys, than the driver's small ones."""

from __future__ import annotations

import io
import os
import tarfile
import tracemalloc
import zipfile

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import queries as functions
from millrace.operators import aggregates as A
from millrace.operators import queries as operators
from millrace.operators import relational as R
from millrace.sources import formats
from tests import oracle


@pytest.fixture
def same_on(spark, tmp_path, monkeypatch):
    """Compares a query with its SQL on tables made by DuckDB from those of the test folder."""

    def run(module, name: str, **tables: str) -> None:
        db = duckdb.connect()
        for t, text in tables.items():
            db.execute(f"COPY ({text.replace('{folder}', oracle.FOLDER)}) TO '{tmp_path}/{t}.parquet'")
        monkeypatch.setattr(oracle, "FOLDER", str(tmp_path))
        oracle.same(spark, oracle.database(), module.queries()[name], module.oracle_sql()[name])

    return run


def test_top_items_beyond_a_thousand(same_on):
    same_on(operators, "agg_top_items", lineitem="SELECT * REPLACE (l_orderkey AS l_suppkey) FROM '{folder}/lineitem.parquet'")


def test_top_items_of_a_number(spark):
    t = spark.range(60).select(F.expr("CASE WHEN id % 10 < 3 THEN 7 WHEN id % 10 < 6 THEN 5 WHEN id % 10 < 8 THEN NULL ELSE id END").alias("x"))
    assert [tuple(r) for r in R.top_items(t, "x", 3).collect()] == [(5, 18), (7, 18), (None, 12)]
    exact = {tuple(r) for r in R.top_items(t, "x").collect()}
    assert {(r["item"], r["count"]) for r in t.agg(A.approx_top_k("x", 100).alias("t")).first()["t"]} == exact


def test_identifiers_of_large_keys(same_on):
    same_on(functions, "fn_identifier", customer="SELECT * REPLACE (k AS c_custkey, format('Customer#{:09d}', k) AS c_name) FROM (SELECT *, CAST(99990 + 104729 * c_custkey AS BIGINT) AS k FROM '{folder}/customer.parquet')")


def test_an_aba_number_counts_all_nine_digits(spark):
    from millrace.functions.registry import sql

    assert [r[0] for r in sql(spark, "SELECT aba_validate(s) FROM VALUES ('021000021'), ('121000021'), ('021100021') AS t(s)").collect()] == [1, 0, 0]


def test_sketches_are_not_made_for_each_value(same_on, spark, capsys):
    operators.queries()["agg_approx"](spark, oracle.FOLDER).explain()
    sketches = [line for line in capsys.readouterr().out.splitlines() if "Aggregate" in line and "hll_sketch_agg(" in line]
    assert sketches and not any("l_partkey#" in line.split("functions=")[0] for line in sketches)
    same_on(operators, "agg_approx", lineitem="SELECT * REPLACE (CASE WHEN l_linenumber > 1 THEN l_orderkey END AS l_partkey) FROM '{folder}/lineitem.parquet'")


def test_rows_wait_for_kernels_with_the_tables_columns(spark, capsys):
    functions.queries()["fn_math"](spark, oracle.FOLDER).explain()
    plan = capsys.readouterr().out.splitlines()
    at = next(i for i, line in enumerate(plan) if "ArrowEvalPython" in line)
    below = next(line for line in plan[at + 1 :] if "Project [" in line)
    assert below.count("#") <= 14  # the table's columns that are read, and the kernels' arguments


def peak_of_reading(path, kind: str, size: int) -> int:
    """The most bytes that Python holds while a task reads the entries of an archive, which must come whole and in order."""
    tracemalloc.start()
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([f"file:{path}"])], names=["path"])
        names = []
        for b in formats._entries(kind, formats._opened)([batch]):
            names += b.column("name").to_pylist()
            assert all(len(x.as_py()) == size for x in b.column("data"))
        assert names == [f"{i}.bin" for i in range(len(names))] and len(names) == 64
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def archive(path, kind: str, size: int) -> None:
    with zipfile.ZipFile(path, "w") if kind == "zip" else tarfile.open(path, "w") as out:
        for i in range(64):
            if kind == "zip":
                out.writestr(f"{i}.bin", os.urandom(size))
            else:
                info = tarfile.TarInfo(f"{i}.bin")
                info.size = size
                out.addfile(info, io.BytesIO(os.urandom(size)))


def test_a_tar_is_read_entry_by_entry(spark, tmp_path):
    archive(tmp_path / "a b%.tar", "tar", 1 << 20)
    assert peak_of_reading(tmp_path / "a b%.tar", "tar", 1 << 20) < 24 << 20  # of 64 MB
    found = formats.tar_entries(spark, f"{tmp_path}/a*.tar")
    assert [r[0] for r in found.groupBy("size").count().select("count").collect()] == [64]
    assert sorted(int(r["name"].removesuffix(".bin")) for r in found.select("name").collect()) == list(range(64))


def test_a_zip_is_read_entry_by_entry(tmp_path):
    archive(tmp_path / "a.zip", "zip", 1 << 20)
    assert peak_of_reading(tmp_path / "a.zip", "zip", 1 << 20) < 24 << 20


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_archives_of_a_large_partition_are_bounded(spark, tmp_path, kind):
    n = 2 * formats.ARCHIVE_ENTRIES + 7
    rows = spark.range(n).select(F.concat("id", F.lit(".txt")).alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("data")).coalesce(1)
    assert formats.write_archives(rows, str(tmp_path / "many"), kind) == n
    read = formats.zip_entries if kind == "zip" else formats.tar_entries
    found = read(spark, f"{tmp_path}/many/*.{kind}")
    assert sorted(r[0] for r in found.groupBy("path").count().select("count").collect()) == [7, formats.ARCHIVE_ENTRIES, formats.ARCHIVE_ENTRIES]
    assert found.where(F.concat(F.decode("data", "utf-8"), F.lit(".txt")) == F.col("name")).select("name").distinct().count() == n
    assert formats.write_archives(rows.where("name = 'none'"), str(tmp_path / "none"), kind) == 0
    assert read(spark, f"{tmp_path}/none/*.{kind}").count() == 0
