"""Window aggregates of price series: sma, ema and rsi over a frame of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def frame(partition: list[str], order: list[str], rows: int) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(1 - rows, 0)


def sma(x: str, w: WindowSpec) -> Column:
    return F.avg(x).over(w)


def ema(x: str, w: WindowSpec) -> Column:
    """Exponential average over a frame: alpha = 2 / (rows + 1), seeded with the frame's first value."""
    values = F.collect_list(F.col(x).cast("double")).over(w)
    alpha = F.lit(2.0) / (F.size(values) + 1)
    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values[0], lambda e, v: e + alpha * (v - e)))


def rsi(x: str, w: WindowSpec) -> Column:
    """Relative strength over a frame: 100 gains / (gains + losses); null for one row, 100 where nothing was lost."""
    values = F.collect_list(F.col(x).cast("double")).over(w)
    n = F.size(values)
    steps = F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    gains = F.aggregate(steps, F.lit(0.0), lambda s, d: s + F.greatest(d, F.lit(0.0)))
    losses = F.aggregate(steps, F.lit(0.0), lambda s, d: s + F.greatest(-d, F.lit(0.0)))
    return F.when(n > 1, F.when(losses == 0, F.lit(100.0)).otherwise(100.0 * gains / (gains + losses)))


def gap_fill(df: DataFrame, key: str, time: str, value: str, interval: str) -> DataFrame:
    """key, bucket, value: one row for every bucket between a key's first and last, empty ones null.

    interval: an interval of fixed length such as `1 hour`.
    """
    buckets = df.groupBy(key, F.window(F.col(time).cast("timestamp"), interval)["start"].alias("bucket")).agg(F.sum(value).alias(value))
    span = buckets.groupBy(key).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(key, F.explode(F.expr(f"sequence(a, b, interval {interval})")).alias("bucket"))
    return span.join(buckets, [key, "bucket"], "left")
