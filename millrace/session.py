"""Sessions, and the tables of a folder as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(app: str = "millrace", **conf: str) -> SparkSession:
    """A session with UTC, ANSI arithmetic, adaptive execution and Arrow; a master set elsewhere is kept."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Register the folder's tables as temporary views.  Only the footers are read."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
