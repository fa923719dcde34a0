"""Sources and sinks by round trips: a table is written through the sink into the shared folder and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import commands
from millrace.plans.lineage import scratch_dir
from millrace.session import table
from millrace.sources import formats


def _at(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/source-{uuid.uuid4().hex}"


def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark)
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(at, header=True, escape='"')
    return formats.csv(spark, at)


def src_typed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").write.csv(at, header=True, escape='"')
    return formats.typed_csv(spark, at, "o_orderkey BIGINT, o_totalprice DOUBLE, o_orderpriority INT")


def src_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.json(at)
    return formats.json_lines(spark, at, "doc_id BIGINT, text STRING, lang STRING")


def src_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark)
    formats.write_arrow(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").repartition(4, "user_id"), at)
    return formats.arrow(spark, at)


def _archived(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = _at(spark)
        docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").repartition("doc_id")  # as many archives as the size asks for
        formats.write_archives(docs.select(F.concat("doc_id", F.lit(".txt")).alias("name"), F.encode("text", "utf-8").alias("data")), at, kind)
        read = formats.zip_entries if kind == "zip" else formats.tar_entries
        return read(spark, f"{at}/*.{kind}").select("name", "size", F.decode("data", "utf-8").alias("text"))

    return run


ARCHIVE_SQL = "SELECT doc_id || '.txt' AS name, strlen(text) AS size, text FROM documents WHERE text IS NOT NULL"


def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark)
    table(spark, sf_dir, "part").select("p_name").write.text(at)
    lines = formats.files(spark, f"{at}/*.txt").select(F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("p_name"))
    return lines.where("p_name <> ''")


def src_written_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark)
    formats.write(table(spark, sf_dir, "nation"), at, by=["n_regionkey"])
    return spark.read.parquet(at).where("n_regionkey = 2").select("n_nationkey", "n_name", "n_regionkey")


def cmd_dump_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark)
    table(spark, sf_dir, "region").createOrReplaceTempView("_dumped")
    commands.dump(spark, ["_dumped"], at)
    commands.restore(spark, ["_dumped"], at)
    return spark.table("_dumped")


def cmd_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark)
    table(spark, sf_dir, "region").write.csv(at, header=True)
    commands.import_csv(spark, at, "_imported")
    return spark.sql("SELECT CAST(r_regionkey AS INT) AS r_regionkey, r_name FROM _imported")


def cmd_define(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands.define(spark, "_discounted", "price DOUBLE, share DOUBLE", "DOUBLE", "round(price * (1 - share), 4)")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_lines")
    return spark.sql("SELECT l_orderkey, l_linenumber, _discounted(l_extendedprice, l_discount) AS v FROM _lines")


def cmd_define_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mergeable aggregate, and a whole-group one in a window."""
    commands.define_aggregate(spark, "_spread", "double", lambda x: float(x.max() - x.min()))
    table(spark, sf_dir, "events").createOrReplaceTempView("_events")
    return spark.sql("SELECT event_id, _spread(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS spread FROM _events")


def cmd_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers without a gap, in the order of the keys."""
    ordered = table(spark, sf_dir, "customer").select("c_custkey").orderBy("c_custkey")
    return commands.numbered(ordered, "n")


def cmd_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.profile(table(spark, sf_dir, "nation")).select("column", "rows", "nulls", "low", "high")


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "src_csv": (src_csv, "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer"),
    "src_typed_csv": (src_typed_csv, "SELECT o_orderkey, o_totalprice, CAST(NULL AS INTEGER) AS o_orderpriority FROM orders"),
    "src_json": (src_json, "SELECT doc_id, text, lang FROM documents"),
    "src_arrow": (src_arrow, "SELECT event_id, user_id, event_type, value FROM events"),
    "src_zip": (_archived("zip"), ARCHIVE_SQL),
    "src_tar": (_archived("tar"), ARCHIVE_SQL),
    "src_files": (src_files, "SELECT p_name FROM part"),
    "src_written_by_key": (src_written_by_key, "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2"),
    "cmd_dump_restore": (cmd_dump_restore, "SELECT * FROM region"),
    "cmd_import": (cmd_import, "SELECT * FROM region"),
    "cmd_define": (cmd_define, "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS v FROM lineitem"),
    "cmd_define_aggregate": (cmd_define_aggregate, "SELECT event_id, max(value) OVER w - min(value) OVER w AS spread FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"),
    "cmd_numbered": (cmd_numbered, "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer"),
    "cmd_profile": (cmd_profile, "SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS \"column\", count(*) AS rows, 0::HUGEINT AS nulls, unnest([min(n_nationkey::VARCHAR), min(n_name), min(n_regionkey::VARCHAR)]) AS low, unnest([max(n_nationkey::VARCHAR), max(n_name), max(n_regionkey::VARCHAR)]) AS high FROM nation"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: q for n, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: o for n, (_, o) in QUERIES.items() if o}
