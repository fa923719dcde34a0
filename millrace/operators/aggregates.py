"""Aggregates whose edge cases differ from Spark's own, as Columns; all keep partial aggregation.

Percentiles take p from 0 to 100.  Two-argument aggregates take (y, x) and leave out rows where either is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def total(x) -> Column:
    """sum as a double, 0.0 on no rows."""
    return F.coalesce(F.sum(F.col(x).cast("double")), F.lit(0.0))


def skewness(x) -> Column:
    return F.when((F.count(x) >= 3) & (F.var_pop(x) > 0), F.skewness(x))


def kurtosis(x) -> Column:
    """Excess kurtosis; null under 4 values."""
    return F.when((F.count(x) >= 4) & (F.var_pop(x) > 0), F.kurtosis(x))


def corr(y, x) -> Column:
    """Null where a variance is 0."""
    return F.try_divide(F.covar_pop(y, x), F.stddev_pop(F.when(F.col(x).isNotNull(), F.col(y))) * F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))))


def regr_r2(y, x) -> Column:
    """Null where a variance is 0 (Spark: 1.0 for a constant y)."""
    return F.when((F.regr_syy(y, x) > 0) & (F.regr_sxx(y, x) > 0), F.regr_r2(y, x))


def percentile(x, p: float) -> Column:
    return F.percentile(x, p / 100)


def percentile_disc(x, p: float) -> Column:
    return F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {x})")


def array_agg_json(x) -> Column:
    """A JSON array of the values that are not null, in ascending order (an order that partitioning cannot change)."""
    return F.to_json(F.sort_array(F.collect_list(x)))


def group_object_json(k, v) -> Column:
    return F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(k).cast("string").alias("key"), F.col(v).alias("value"))))))


def string_agg(x, separator: str = ",") -> Column:
    return F.expr(f"listagg({x}, '{separator}') WITHIN GROUP (ORDER BY {x})")


def minhash(x, k: int = 64) -> Column:
    """k minima of seeded hashes in one aggregation: an array of longs that a merge takes position by position."""
    return F.array(*(F.min(F.xxhash64(F.lit(i), F.col(x))) for i in range(k)))


def hll(x, precision: int = 14) -> Column:
    return F.hll_sketch_agg(x, precision)


def count_min(x, eps: float = 0.001, confidence: float = 0.98, seed: int = 1) -> Column:
    return F.count_min_sketch(x, F.lit(eps), F.lit(confidence), F.lit(seed))


def kll(x) -> Column:
    """A mergeable quantile sketch (KLL); read it with kll_quantile."""
    return F.kll_sketch_agg_double(F.col(x).cast("double"))


def kll_quantile(sketch, q: float) -> Column:
    """The q-quantile (0 to 1) of a kll sketch; Spark wants q to be constant."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(q)))


def decimal_sum(x, scale: int = 18) -> Column:
    """The exact sum of numbers in text, as text with as many fraction digits as the longest of them; what is no number is
    left out, null for none.  At most `scale` fraction digits, 38 digits in all."""
    number = f"try_cast({x} AS DECIMAL(38, {scale}))"
    digits = F.max(F.expr(f"CASE WHEN {number} IS NOT NULL THEN length(regexp_extract({x}, '[.]([0-9]+)', 1)) END"))
    whole = F.sum(F.expr(number)).cast("string")
    return F.when(digits == 0, F.substring_index(whole, ".", 1)).otherwise(F.concat(F.substring_index(whole, ".", 1), F.lit("."), F.left(F.substring_index(whole, ".", -1), digits)))


def approx_top_k(x, k: int, max_items: int = 10_000) -> Column:
    """The k most frequent values as an array of (item, count), from a mergeable sketch of max_items counters."""
    return F.expr(f"approx_top_k({x}, {k}, {max_items})")


def merged_centroids(mean: np.ndarray, weight: np.ndarray, compression: float) -> tuple[np.ndarray, np.ndarray]:
    """A t-digest's centroids (Dunning 2019, scale function k1): neighbours are merged while they span one step of k at most."""
    order = np.argsort(mean, kind="stable")
    mean, weight = mean[order], weight[order]
    share = np.concatenate([[0.0], np.cumsum(weight)]) / max(weight.sum(), 1e-300)
    k = compression / (2 * np.pi) * np.arcsin(np.clip(2 * share - 1, -1, 1))
    group, first, g = np.zeros(len(mean), np.int64), k[0] if len(k) else 0.0, 0
    for i in range(len(mean)):
        if k[i + 1] - first > 1 and i and group[i - 1] == g:
            g, first = g + 1, k[i]
        group[i] = g
    w = np.bincount(group, weight)
    return np.bincount(group, mean * weight) / w, w


DIGEST = "array<struct<mean:double,weight:double>>"


def t_digest(df: DataFrame, keys: list[str], value: str, name: str = "digest", compression: float = 100.0) -> DataFrame:
    """keys and a t-digest of a number: centroids in order, at most about `compression` of them; read it with t_digest_quantile.

    Every task makes a digest of each group that it meets, and only those are shuffled and merged.  Nulls and NaNs are
    left out.
    """
    fields = df.select(*keys).schema.fields
    schema = T.StructType([*fields, T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("weight", T.ArrayType(T.DoubleType()))])

    def local(frames):
        held: dict = {}
        for pdf in frames:
            for key, rows in pdf.groupby(keys, dropna=False) if keys else [((), pdf)]:
                x = rows[value].to_numpy(float)
                x = x[~np.isnan(x)]
                if not len(x):
                    continue
                key = tuple(None if v != v or v is None else v for v in key)
                m, w = held.get(key, (np.zeros(0), np.zeros(0)))
                held[key] = merged_centroids(np.concatenate([m, x]), np.concatenate([w, np.ones(len(x))]), compression)
            if len(held) > 10_000:
                yield from out(held)
        yield from out(held)

    def out(held):
        if held:
            columns = {c: [k[i] for k in held] for i, c in enumerate(keys)}
            yield pd.DataFrame(columns | {"mean": [m.tolist() for m, _ in held.values()], "weight": [w.tolist() for _, w in held.values()]})
            held.clear()

    @F.pandas_udf(DIGEST)
    def merge(mean: pd.Series, weight: pd.Series) -> pd.Series:
        rows = []
        for m, w in zip(mean, weight):
            m, w = merged_centroids(np.concatenate(list(m)), np.concatenate(list(w)), compression)
            rows.append([{"mean": a, "weight": b} for a, b in zip(m.tolist(), w.tolist())])
        return pd.Series(rows)

    parts = df.select(*keys, F.col(value).cast("double").alias(value)).mapInPandas(local, schema)
    # A group has one digest for each task that met it: bounded by the number of tasks, not of rows.
    return parts.groupBy(*keys).agg(F.collect_list("mean").alias("m"), F.collect_list("weight").alias("w")).select(*keys, merge("m", "w").alias(name))


def t_digest_quantile(digest: Column, q: float) -> Column:
    """The q-quantile (0 to 1) of a t-digest: between the middles of centroids, in proportion."""
    total_ = F.aggregate(digest, F.lit(0.0), lambda s, c: s + c["weight"])
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("at"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("found"))

    def step(s, c):
        middle, want = s["seen"] + c["weight"] / 2, F.lit(q) * total_
        between = F.when(s["mean"].isNull(), c["mean"]).otherwise(s["mean"] + (c["mean"] - s["mean"]) * F.try_divide(want - s["at"], middle - s["at"]))
        found = F.coalesce(s["found"], F.when(want <= middle, between))
        return F.struct((s["seen"] + c["weight"]).alias("seen"), middle.alias("at"), c["mean"].alias("mean"), found.alias("found"))

    return F.aggregate(digest, start, step, lambda s: F.coalesce(s["found"], s["mean"]))
