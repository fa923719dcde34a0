"""Structured Streaming over event tables: buckets, sliding and session windows, deduplication, upserts, and state per key.

Every function takes a streaming (or static) DataFrame with the columns of `events` and returns one; late rows are those
behind the watermark, which bounds the state but for that of running_totals (see there).  Checkpoints make each query
restartable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files: int = 8, pattern: str = "events*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream, at most so many a trigger."""
    raw = spark.readStream.schema(SCHEMA.replace("ts timestamp", "ts timestamp_ntz")).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by bucket and type: the stream's equal of time_bucket and GROUP BY."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("bucket"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("a"), F.col("window.end").alias("b"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("a"), F.col("session_window.end").alias("b"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def joined(left: DataFrame, right: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of two streams of one user, right at most so long after left; both states end with the watermark."""
    a = left.withWatermark("ts", late).select(F.col("user_id").alias("lu"), F.col("ts").alias("lt"), F.col("event_id").alias("left_id"))
    b = right.withWatermark("ts", late).select(F.col("user_id").alias("ru"), F.col("ts").alias("rt"), F.col("event_id").alias("right_id"))
    return a.join(b, F.expr(f"lu = ru AND rt >= lt AND rt <= lt + INTERVAL {within}")).select(F.col("lu").alias("user_id"), "left_id", "right_id")


def running_totals(events: DataFrame, idle: str | None = None, late: str = "1 hour") -> DataFrame:
    """user_id, first_ts, n, total after each trigger in which a user has events, from state kept per user.

    State is two numbers and a time for each user.  It grows with the users; with `idle`, a user without events for so
    long (in event time) is forgotten, and counts anew from the next event on, under another first_ts.
    """
    import pandas as pd

    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        first, n, total = state.get if state.exists else (None, 0, 0.0)
        last = None
        for pdf in batches:
            first = min(x for x in (first, pdf["ts"].min()) if x is not None)
            last = max(x for x in (last, pdf["ts"].max()) if x is not None)
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((first, n, total))
        if wait:
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "first_ts": [first], "n": [n], "total": [round(total, 4)]})

    rows = events.withWatermark("ts", late) if idle else events
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, first_ts timestamp, n long, total double", "first timestamp, n long, total double", "update", "EventTimeTimeout" if idle else "NoTimeout")


def upsert(changes: DataFrame, key: str, order: str, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each trigger's last row of every key to `write` (rows, trigger number)."""

    def batch(df: DataFrame, number: int) -> None:
        names = [c for c in df.columns if c != key]
        write(df.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("_last")).select(key, "_last.*"), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(df: DataFrame, mode: str, folder: str, keys: list[str] | None = None) -> DataFrame:
    """Run a query over all that is there, into files of the shared folder, and give its result as a table.

    Each trigger writes a folder of its own, and overwrites it when it is run again, so a restart neither loses nor
    repeats rows.  `append` gives all rows, `complete` those of the last trigger, `update` the last row of each key.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/trigger={number}")

    q = df.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = df.sparkSession
    try:
        rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("trigger", T.LongType())])).parquet(f"{folder}/rows")
    except AnalysisException:  # no trigger: nothing was there
        return spark.createDataFrame([], df.schema)
    if mode == "complete":
        last = rows.agg(F.max("trigger").alias("last"))
        return rows.join(F.broadcast(last), F.col("trigger") == F.col("last")).select(*df.columns)
    if mode == "update":
        names = [c for c in df.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "trigger").alias("_last")).select(*keys, "_last.*").select(*df.columns)
    return rows.select(*df.columns)
