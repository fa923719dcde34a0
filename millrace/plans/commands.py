"""Session commands: SQL-defined functions, evaluation to text, sequences, imports and exports."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def define(spark: SparkSession, name: str, parameters: str, returns: str, body: str) -> None:
    """A SQL function of the session, inlined where it is called: define(spark, "f", "x BIGINT", "BIGINT", "x + 1")."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"no name for a function: {name!r}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")


def define_drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


def define_list(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW USER FUNCTIONS")


def evaluate(spark: SparkSession, text: str, separator: str = "", limit: int = 10_000) -> str:
    """The cells of a query's first `limit` rows, joined; nulls are left out."""
    return separator.join(str(v) for r in spark.sql(text).limit(limit).collect() for v in r if v is not None)


def define_aggregate(spark: SparkSession, name: str, returns: str, f: Callable) -> None:
    """An aggregate and window function of the session from a function of a group's (or frame's) values as a Series.

    A group is gathered in one task: for frames and groups of a known size.  What sums, counts and extremes can say is
    better written as an expression of those, which Spark aggregates within tasks first.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.functions import PandasUDFType

    spark.udf.register(name, F.pandas_udf(f, returns, PandasUDFType.GROUPED_AGG))


def numbered(df: DataFrame, name: str = "id", start: int = 1) -> DataFrame:
    """df with consecutive numbers in the order of its partitions and rows: no shuffle.

    df is written once to the shared folder, so that the counts and the numbers are of the same rows; the offsets, a
    number for each partition, are broadcast.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from millrace.plans.lineage import cut

    # the high bits of monotonically_increasing_id are the partition, the low 33 count its rows
    made = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    sizes = made.groupBy(part.alias("_part")).count()
    before = F.sum("count").over(Window.orderBy("_part")) - F.col("count")
    offsets = sizes.select("_part", before.alias("_before"))
    number = F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + start
    return made.join(F.broadcast(offsets), part == F.col("_part")).select(*df.columns, number.cast("long").alias(name))


def completion(spark: SparkSession, prefix: str) -> DataFrame:
    """(candidate, kind) of what begins with a prefix: keywords, functions, tables and their columns, in any case."""
    from functools import reduce

    from pyspark.sql import functions as F

    words = spark.sql("SELECT lower(keyword) AS candidate, 'keyword' AS kind FROM sql_keywords()")
    names = [(f.name, "function") for f in spark.catalog.listFunctions()]
    for t in spark.catalog.listTables():
        names += [(t.name, "table"), *((c, "column") for c in spark.table(t.name).columns)]
    known = reduce(DataFrame.unionAll, [words, spark.createDataFrame(names, "candidate string, kind string")])
    return known.where(F.startswith(F.lower("candidate"), F.lit(prefix.lower()))).distinct().orderBy("candidate", "kind")


def import_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """.import: a CSV file as a view."""
    from millrace.sources.formats import csv

    df = csv(spark, path)
    df.createOrReplaceTempView(name)
    return df


def dump(spark: SparkSession, names: list[str], folder: str) -> None:
    """.dump and .backup: tables as Parquet folders; restore() reads them back."""
    for n in names:
        spark.table(n).write.mode("overwrite").parquet(f"{folder}/{n}.parquet")


def restore(spark: SparkSession, names: list[str], folder: str) -> None:
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """.explain: the plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
