"""Search operators: nearest vectors, full text with BM25, fuzzy words, near-duplicate texts by MinHash bands."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance(a: Column, b: Column, metric: str) -> Column:
    """l1, l2 or cosine distance of two arrays of numbers."""
    d = lambda x: x.cast("double")
    total = lambda z: F.aggregate(z, F.lit(0.0), lambda s, x: s + x)
    if metric == "l1":
        return total(F.zip_with(a, b, lambda x, y: F.abs(d(x) - d(y))))
    if metric == "l2":
        return F.sqrt(total(F.zip_with(a, b, lambda x, y: (d(x) - d(y)) * (d(x) - d(y)))))
    if metric == "cosine":
        dot = lambda x, y: total(F.zip_with(x, y, lambda u, v: d(u) * d(v)))
        return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    raise ValueError(f"no metric {metric!r}")


BLOCK = 4096
ROWS = 1 << 14


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of every row of v to every row of q, as rows of q."""
    if metric == "cosine":
        lengths = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None]
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 - (q @ v.T) / lengths
    if metric == "l2":
        return np.stack([np.sqrt(((v - x) ** 2).sum(1)) for x in q])
    if metric == "l1":
        return np.stack([np.abs(v - x).sum(1) for x in q])
    raise ValueError(f"no metric {metric!r}")


def _nearest(held, k: int, metric: str):
    """Arrow batches of (vec_id, vector) -> (number, query_id, vec_id, distance): each query's k nearest rows of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = held.value
        best_id, best = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids, v = np.asarray(part.column(0)), np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                for lo in range(0, len(q), 256):
                    d = np.round(_distances(q[lo : lo + 256], v, metric), 9)
                    d[(ids[None] == q_ids[lo : lo + 256, None]) | np.isnan(d)] = np.inf
                    if d.shape[1] > 4 * k:  # all that are as near as the k-th nearest, ties included
                        keep = np.flatnonzero((d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]).any(0))
                    else:
                        keep = np.arange(d.shape[1])
                    rows = slice(lo, lo + 256)
                    i = np.concatenate([best_id[rows], np.broadcast_to(ids[keep], (len(d), len(keep)))], 1)
                    x = np.concatenate([best[rows], d[:, keep]], 1)
                    order = np.lexsort((i, x), axis=1)[:, :k]
                    if lo == 0:
                        new_id, new = np.full((len(q), order.shape[1]), -1), np.full((len(q), order.shape[1]), np.inf)
                    new_id[rows], new[rows] = np.take_along_axis(i, order, 1), np.take_along_axis(x, order, 1)
                best_id, best = new_id, new
        at, n = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(q_ids[at]), pa.array(best_id[at, n]), pa.array(best[at, n])], names=["number", "query_id", "vec_id", "distance"])

    return run


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest base rows of each query, another row than itself; ties by id.

    Vectors have one length; null vectors take no part.  Queries are broadcast in blocks of at most `block` rows, each task
    multiplies its base rows with a block as matrices, and only the k best of a query leave it.
    """
    spark = queries.sparkSession
    some = queries.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    rows = base.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    n = some.count()
    parts = -(-2 * n // block) if n > block else 1
    out = []
    for i in range(parts if n else 0):
        part = some.where(F.pmod(F.xxhash64("id", "v"), F.lit(parts)) == i).collect()
        for at in range(0, len(part), block):
            held = spark.sparkContext.broadcast((np.array([r[0] for r in part[at : at + block]], np.int64), np.array([r[1] for r in part[at : at + block]], np.float64)))
            best = rows.mapInArrow(_nearest(held, k, metric), "number long, query_id long, vec_id long, distance double")
            w = Window.partitionBy("number").orderBy("distance", "vec_id")
            best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            out.append(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "distance"))
    return reduce(DataFrame.unionAll, out) if out else spark.createDataFrame([], "query_id long, rank int, vec_id long, distance double")


def lsh_bits(vector: str, width: int, bits: int, seed: int = 11) -> Column:
    """The signs of `bits` random projections of a vector of `width` numbers, as a long: near directions share most signs."""
    planes = np.random.default_rng(seed).normal(size=(bits, width))

    @F.pandas_udf("long")
    def signs(v: pd.Series) -> pd.Series:
        return pd.Series(((np.stack(v.to_numpy()).astype(float) @ planes.T) > 0) @ (1 << np.arange(bits)))

    return signs(F.col(vector))


def lsh(base: DataFrame, width: int, tables: int = 12, bits: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(bucket table, key, vec_id, vector): every row in one bucket of each of `tables` hash tables; write it bucketed by (t, key)."""
    keys = F.array(*(F.struct(F.lit(t).alias("t"), lsh_bits(vector, width, bits, seed=100 + t).alias("key")) for t in range(tables)))
    return base.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.explode(keys).alias("b")).select("b.t", "b.key", "vec_id", "v")


def lsh_search(index: DataFrame, queries: DataFrame, width: int, k: int, tables: int = 12, bits: int = 8, metric: str = "cosine", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest rows among those that share a bucket with a query.

    Approximate: a row that shares no bucket is not seen.  Buckets are joined by key, so no row meets all queries.
    """
    asked = lsh(queries, width, tables, bits, vec_id, vector).select("t", "key", F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    pairs = asked.join(index, ["t", "key"]).where("query_id <> vec_id").dropDuplicates(["query_id", "vec_id"])
    scored = pairs.select("query_id", "vec_id", F.round(distance(F.col("q"), F.col("v"), metric), 9).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "distance")


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, tf, length): an inverted index, pre-aggregated within tasks."""
    words = docs.select(F.col(doc_id).alias("doc_id"), terms(F.col(text)).alias("_w"))
    return words.select("doc_id", F.size("_w").alias("length"), F.explode("_w").alias("term")).groupBy("term", "doc_id", "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: list[str], k: int = 10, k1: float = 1.2, b: float = 0.75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): the k best texts for a query of words.  Only its terms are counted; no index of all terms is made."""
    from millrace.plans.lineage import cut

    wanted = [q.lower() for q in dict.fromkeys(query)]
    n, low = len(wanted), F.lower(F.col(text))
    word = lambda q: F.lit(rf"(?<![\p{{L}}\p{{N}}]){re.escape(q)}(?![\p{{L}}\p{{N}}])")
    tf = F.array(*(F.regexp_count(low, word(q)) for q in wanted))
    # Texts are gone through once; the statistics and the scores are taken from the narrow table.
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.regexp_count(low, F.lit(r"[\p{L}\p{N}]+")).alias("length"), tf.alias("tf")))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *(F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"df{i}") for i in range(n)))
    score = sum((F.ln((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1) * F.col("tf")[i] * (k1 + 1) / (F.col("tf")[i] + k1 * (1 - b + b * F.col("length") / F.col("mean"))) for i in range(n)), F.lit(0.0))
    return rows.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats)).select("doc_id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def match(docs: DataFrame, query: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows whose text has every word of a query, or, after OR, those of another part; `word*` stands for a beginning, NOT leaves out."""
    low = F.lower(F.col(text))

    def has(word: str) -> Column:
        end = "" if word.endswith("*") else r"(?![\p{L}\p{N}])"
        return F.regexp_like(low, F.lit(rf"(?<![\p{{L}}\p{{N}}]){re.escape(word.lower().rstrip('*'))}{end}"))

    wanted = F.lit(False)
    for part in query.split(" OR "):
        one, left_out = F.lit(True), False
        for word in part.split():
            if word == "NOT":
                left_out = True
            elif word != "AND":
                one, left_out = one & (~has(word) if left_out else has(word)), False
        wanted = wanted | one
    return docs.where(wanted)


def spellfix(words: DataFrame, word: str, query: str, k: int = 10) -> DataFrame:
    """(word, distance): the k words nearest to a query by edit distance, ties by the word."""
    return words.select(F.col(word).alias("word")).distinct().withColumn("distance", F.levenshtein("word", F.lit(query))).orderBy("distance", "word").limit(k)


def by_prefix(words: DataFrame, word: str, prefix: str) -> DataFrame:
    """Distinct words of a prefix; the filter reaches the scan."""
    return words.where(F.col(word).startswith(prefix)).select(word).distinct()


def ivf(base: DataFrame, cells: int, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 7, sample: int = 20_000):
    """(rows with their cell, centres): k-means on a bounded sample; every row is assigned.  Query with ivf_search."""
    import numpy as np

    h = F.xxhash64(F.col(vec_id), F.lit(seed))
    x = np.array([r[0] for r in base.orderBy(h).limit(sample).select(vector).collect()], float)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(15):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])

    @F.pandas_udf("int")
    def cell(v):
        m = np.stack(v.to_numpy()).astype(float)
        import pandas as pd

        return pd.Series(((m * m).sum(1)[:, None] - 2 * m @ centres.T + (centres * centres).sum(1)).argmin(1))

    return base.withColumn("cell", cell(F.col(vector))), centres


def ivf_search(indexed: DataFrame, centres, query: list[float], k: int, probes: int, metric: str = "l2", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows among the cells nearest to a query; write `indexed` partitioned by cell to prune files."""
    import numpy as np

    near = [int(i) for i in ((np.asarray(centres) - np.asarray(query)) ** 2).sum(1).argsort()[:probes]]
    q = F.array(*(F.lit(float(x)) for x in query))
    return indexed.where(F.col("cell").isin(near)).select(F.col(vec_id).alias("vec_id"), distance(q, F.col(vector), metric).alias("distance")).orderBy("distance", "vec_id").limit(k)
