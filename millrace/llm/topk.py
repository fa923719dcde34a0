"""Exact top-k inner products by columnar branch and bound.

Vectors are held dimension by dimension (vertical layout).  Scores grow one block of dimensions at a time; after each
block a candidate's score is bounded by what it has plus the product of the two remaining norms (Cauchy-Schwarz), and
candidates whose bound is under the k-th best score are compacted away.  No candidate that could reach the first k,
ties included, is dropped.

Queries go in blocks of at most BLOCK rows: a block is broadcast (its size is fixed), every task scans its candidates
against it, and the best k of each task and query are merged.  The candidates are never shuffled, and a block's results are
written before the next block starts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import written

BLOCK = 8192
CANDIDATES = 1 << 15
DIMENSIONS = 16
EXACT = 1 << 52
TOP, LOW = (1 << 63) - 1, -(1 << 63)


def quantised(vector: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component as a double; multiplying by a power of two and floor are exact."""
    return np.floor(np.asarray(vector, np.float64) * 256.0)


def finite(vector: Column) -> Column:
    """True for vectors that are not null and hold neither nulls nor NaN nor infinities."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, good), F.lit(False))


def matrix(vectors, width: int) -> np.ndarray:
    """width x n, column by column; shorter vectors are filled with zeros, which add nothing to an inner product."""
    n = len(vectors)
    lengths = np.array([len(v) for v in vectors], np.int64)
    if n and (lengths == width).all():
        flat = np.asarray(vectors.flatten(), np.float64) if isinstance(vectors, pa.Array) else np.concatenate(vectors)
        return np.ascontiguousarray(quantised(flat).reshape(n, width).T)
    out = np.zeros((n, width))
    for i, v in enumerate(vectors):
        v = quantised(np.array(v.as_py() if isinstance(v, pa.Scalar) else v, np.float64))[:width]
        out[i, : len(v)] = v
    return np.ascontiguousarray(out.T)


def rest_norms(columns: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of the dimensions from each cut on, rounded up; cuts x n."""
    squares = columns * columns
    return np.stack([np.sqrt(squares[c:].sum(axis=0)) * (1 + 1e-9) + 1e-9 for c in cuts])


def search(q: np.ndarray, q_rest: np.ndarray, own: int, columns: np.ndarray, rest: np.ndarray, ids: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions of the candidates that can be among the best k, their scores, scores' dimensions worked on).

    floor: a score that k candidates of other chunks reach already.
    """
    cuts = list(range(0, len(q), DIMENSIONS))
    keep = np.flatnonzero(ids != own)
    score = np.zeros(len(keep))
    whole, work = len(keep) == len(ids), 0
    for c, at in enumerate(cuts):
        end = min(at + DIMENSIONS, len(q))
        score = score + q[at:end] @ (columns[at:end] if whole else columns[at:end][:, keep])
        work += (end - at) * len(keep)
        if len(keep) <= k:
            continue
        slack = q_rest[c + 1] * rest[c + 1][keep] if end < len(q) else 0.0
        # The k-th largest of what candidates reach at least is a score that k of them reach.
        reached = max(floor, np.partition(score - slack, len(score) - k)[len(score) - k])
        ok = score + slack >= reached
        if not ok.all():
            keep, score, whole = keep[ok], score[ok], False
    return keep, score, work


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _wide(q, columns, ids, own, k):
    """The same scores in whole numbers of any size, held to the range of a long; for components beyond 2**20 or so."""
    got = []
    for i in np.flatnonzero(ids != own).tolist():
        s = sum(int(a) * int(b) for a, b in zip(q.tolist(), columns[:, i].tolist(), strict=True))
        got.append((-max(LOW, min(TOP, s)), int(ids[i])))
    got = sorted(got)[:k]
    return np.array([i for _, i in got], np.int64), np.array([-s for s, _ in got], object)


def _scan(held, k: int):
    def run(batches):
        q_ids, q_columns = held.value
        width = q_columns.shape[0]
        cuts = [*range(0, width, DIMENSIONS), width]
        q_rest = rest_norms(q_columns, cuts)
        largest = np.abs(q_columns).max(initial=0.0)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def take(ids, columns):
            exact = largest * np.abs(columns).max(initial=0.0) * max(width, 1) < EXACT
            rest = rest_norms(columns, cuts) if exact else None
            for j in range(len(q_ids)):
                own, q = q_ids[j], q_columns[:, j]
                old = best.get(j)
                if exact:
                    floor = old[1][-1] if old is not None and len(old[1]) == k and old[1].dtype != object else -np.inf
                    at, scores, _ = search(q, q_rest[:, j], own, columns, rest, ids, k, floor)
                    found, scores = ids[at], scores
                else:
                    found, scores = _wide(q, columns, ids, own, k)
                if old is not None:
                    found, scores = np.concatenate([old[0], found]), np.concatenate([old[1], scores])
                best[j] = _best(found, scores, k)

        parts, n = [], 0
        for b in batches:
            parts.append(b)
            n += b.num_rows
            if n >= CANDIDATES:
                t = pa.Table.from_batches(parts).combine_chunks()
                take(np.asarray(t.column(0)), matrix(t.column(1).combine_chunks(), width))
                parts, n = [], 0
        if n:
            t = pa.Table.from_batches(parts).combine_chunks()
            take(np.asarray(t.column(0)), matrix(t.column(1).combine_chunks(), width))
        if best:
            number = np.concatenate([np.full(len(v[0]), j) for j, v in best.items()])
            found = [number, q_ids[number], np.concatenate([v[0] for v in best.values()])]
            scores = pa.array([int(s) for v in best.values() for s in v[1]], pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, found), scores], names=["number", "query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates by the integer inner product of floor(256 x).

    Queries are the rows whose id is divisible by `every`; candidates are all rows of another id.  Ties go to the smaller
    vec_id.  Null vectors, vectors with null or non-finite components and rows with a null id take no part; a shorter
    vector counts as filled with zeros.  Scores beyond a long are held to its range.  Every candidate row counts, so a
    repeated row can take several ranks.  Repeated query rows (same id and vector) are one query; an id with several
    vectors is a query for each of them.  An empty table, or one without queries, gives no rows.  Extra columns are not
    read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull())
    rows = rows.where(finite(F.col("v")))
    queries = written(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]))
    n, width = queries.count(), rows.agg(F.max(F.size("v"))).first()[0] or 0
    # About half a block each, dealt by a hash of the whole row, so that an id of many vectors is spread as well.
    blocks = -(-2 * n // block) if n > block else 1
    found = []
    for i in range(blocks if n else 0):
        part = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == i).collect()
        for at in range(0, len(part), block):
            some = part[at : at + block]
            held = spark.sparkContext.broadcast((np.array([r[0] for r in some], np.int64), matrix([np.array(r[1], np.float64) for r in some], width)))
            best = rows.mapInArrow(_scan(held, k), "number long, query_id long, vec_id long, score long")
            order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
            best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            found.append(written(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")))
            held.destroy()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionAll, found)
