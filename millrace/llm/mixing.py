"""Mixing sources to target weights by soft membership.

1. A labelled table teaches a multinomial logistic regression on byte frequencies; it gives every document a posterior
   over domains (here: the combinations of quality and toxic in `labels`).
2. Rates r >= 0, one per document, minimise 0.35 e' M^-1 e + ridge / 2 * sum_d t_d (r_d - 1)^2 by projected gradient:
   e_k = sum_d r_d t_d p_dk - T_k is what a domain's expected tokens miss its target by, t_d are tokens, p_dk posteriors,
   and M = sum_d t_d p_d p_d' scales the squares so that steps are about equal in all directions.  In the metric that
   weighs a document by its tokens a step is r_d := max(0, r_d - ridge (r_d - 1) - 0.7 p_d' M^-1 e).  A gradient needs
   one small vector over the domains, a sum over all documents; the rates of every iterate follow from the vectors so
   far, so an iteration is one aggregation of a narrow table and no rate is shuffled or stored.
3. Rates become whole copies by a hash of the document: floor(r), and one more with the probability of the rest.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import append_columns, bounded_sample, held_out, one_per_id, renamed, restored, slices, written

MAX_LABELLED = 8000
FEATURES = 256 + 3
TARGETS = {"q1t0": 0.78, "q0t0": 0.12, "q1t1": 0.08, "q0t1": 0.02}


#: A label's domain; BY_QUALITY leaves toxicity out, for corpora that it has been filtered from.
DOMAIN = "concat('q', quality, 't', toxic)"
BY_QUALITY = "concat('q', quality)"
QUALITY_TARGETS = {"q1": 0.9, "q0": 0.1}


def features(text: str | None) -> tuple[np.ndarray, int]:
    """Square roots of byte frequencies, with length, bytes a word and a repeated-line share; and the number of words."""
    raw = (text or "").encode()
    words = len(raw.split())
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = raw.split(b"\n")
    x = np.concatenate([np.sqrt(n / max(len(raw), 1)), [np.log1p(len(raw)) / 10, min(2.0, len(raw) / max(words, 1) / 10), 1 - len(set(lines)) / len(lines)]])
    return x, words


class DomainModel:
    def __init__(self, domains: list[str], weights: np.ndarray, bias: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.domains, self.weights, self.bias, self.mean, self.scale = domains, weights, bias, mean, scale

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights + self.bias
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, n: int = MAX_LABELLED, rounds: int = 400, l2: float = 1e-3, domain: str = DOMAIN) -> DomainModel:
    """Learn domains (an expression over labels) from at most n labelled rows outside the held-out ones; n x FEATURES numbers come to the driver.

    Rows with a null label are left out; a repeated id counts once, with its least domain and text.  Without labelled rows there is one domain, "all", of posterior 1.
    """
    ids = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy(F.col("doc_id").alias("id")).agg(F.min(F.expr(domain)).alias("domain"))
    ids = ids.join(F.broadcast(bounded_sample(ids, "id", n)), "id")
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    rows = one_per_id(rows, "id", "text", "domain").select("domain", "text")

    def measured(batches):
        for b in slices(batches):
            x = [features(t)[0].astype(np.float32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], names=["domain", "x"])

    got = sorted((r["domain"], r["x"]) for r in rows.mapInArrow(measured, "domain string, x binary").collect())
    domains = sorted({d for d, _ in got}) or ["all"]
    if len(domains) < 2:
        return DomainModel(domains, np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(FEATURES), np.ones(FEATURES))
    x = np.array([np.frombuffer(b, np.float32) for _, b in got], np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    y = np.eye(len(domains))[[domains.index(d) for d, _ in got]]
    w, b = np.zeros((FEATURES, len(domains))), np.log(y.mean(axis=0))
    m_w = m_b = 0
    v_w, v_b = np.zeros_like(w), np.zeros_like(b)
    for i in range(1, rounds + 1):
        z = x @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - y) / len(y)
        g_w, g_b = x.T @ g + l2 * w, g.sum(axis=0)
        m_w, m_b = 0.9 * m_w + 0.1 * g_w, 0.9 * m_b + 0.1 * g_b
        v_w, v_b = 0.99 * v_w + 0.01 * g_w**2, 0.99 * v_b + 0.01 * g_b**2
        fix1, fix2 = 1 - 0.9**i, 1 - 0.99**i
        w -= 0.03 * m_w / fix1 / (np.sqrt(v_w / fix2) + 1e-8)
        b -= 0.03 * m_b / fix1 / (np.sqrt(v_b / fix2) + 1e-8)
    return DomainModel(domains, w, b, mean, scale)


def memberships(df: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """df with n_tokens (words) and posterior (in the order of model.domains) of every whole text."""
    held = df.sparkSession.sparkContext.broadcast(model)
    at = [c for c in df.columns if c not in ("n_tokens", "posterior")].index(text)

    def factory():
        m = held.value

        def run(b):
            got = [features(t) for t in b.column(at).to_pylist()]
            p = m.posterior(np.array([x for x, _ in got])) if got else []
            return [[n for _, n in got], [list(map(float, row)) for row in p]]

        return run

    return append_columns(df, {"n_tokens": "long", "posterior": "array<double>"}, factory)


def rates(posterior: np.ndarray, steps: np.ndarray, shrink: float) -> np.ndarray:
    """Rates after the given gradient vectors: r := max(0, r - shrink (r - 1) - p . g), from r = 1."""
    r = np.ones(len(posterior))
    for moved in (posterior @ g for g in steps):
        r = np.maximum(0.0, r - shrink * (r - 1) - moved)
    return r


def stacked(column: pa.Array, k: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, k)


def rated(members: DataFrame, steps: list, shrink: float, k: int) -> DataFrame:
    """members with `rate`."""
    at, g = [c for c in members.columns if c != "rate"].index("posterior"), np.array(steps).reshape(-1, k)
    return append_columns(members, {"rate": "double"}, lambda: lambda b: [rates(stacked(b.column(at), k), g, shrink)])


def totals(members: DataFrame, steps: list, shrink: float, k: int) -> np.ndarray:
    """Expected tokens of each domain under the rates of `steps`: sums within tasks, then over them."""
    g = np.array(steps).reshape(-1, k)

    def run(batches):
        out = np.zeros(k)
        for b in slices(batches):
            p = stacked(b.column(1), k)
            out += (rates(p, g, shrink) * np.asarray(b.column(0), np.float64)) @ p
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=[f"d{i}" for i in range(k)])

    sums = members.select("n_tokens", "posterior").mapInArrow(run, ", ".join(f"d{i} double" for i in range(k)))
    return np.array([float(x or 0) for x in sums.agg(*(F.sum(f"d{i}") for i in range(k))).first()])


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None, rounds: int = 60, ridge: float = 1e-4, tolerance: float = 1e-4) -> tuple[list[list[float]], float, dict]:
    """(gradient vectors, shrink, report) for rates(); members: n_tokens, posterior.

    targets: weights of domains, scaled to sum 1 over those that hold tokens; domains without a target get 0.  total:
    target tokens (default: so many that the scarcest domain against its target keeps a rate of about 1).  Rounds end at a
    relative error under `tolerance`; targets that are missed by over ten times that are warned of.
    """
    k = len(domains)
    w = F.col("n_tokens").cast("double")
    p = [F.col("posterior")[i] for i in range(k)]
    first = members.agg(F.sum(w), *(F.sum(w * x) for x in p), *(F.sum(w * p[i] * p[j]) for i in range(k) for j in range(k))).first()
    tokens = float(first[0] or 0)
    if not tokens:
        return [], 0.0, {"domains": domains, "target": [0.0] * k, "reached": [0.0] * k, "error": 0.0, "rounds": 0}
    have = np.array([float(x or 0) for x in first[1 : 1 + k]])
    moment = np.array([float(x or 0) for x in first[1 + k :]]).reshape(k, k)
    wish = np.array([max(0.0, targets.get(d, 0.0)) if have[i] > 0 else 0.0 for i, d in enumerate(domains)])
    wish = wish / wish.sum() if wish.sum() else have / have.sum()
    if total is None:
        total = float(max(have[i] / wish[i] for i in range(k) if wish[i] > 0))
    goal = wish * total
    inverse = np.linalg.inv(moment + 1e-3 * np.trace(moment) / k * np.eye(k))
    steps, reached, error, best = [], have, np.inf, (np.inf, 0)
    for i in range(rounds + 1):
        error = float(np.abs(reached - goal).max() / total)
        if error < best[0]:
            best = (error, i)
        if error < tolerance or i == rounds:
            break
        steps.append([float(x) for x in 0.7 * inverse @ (reached - goal)])
        reached = totals(members, steps, ridge, k)
    steps = steps[: best[1]]
    if best[0] > 10 * tolerance:
        warnings.warn(f"mixing: expected domain tokens miss their targets by {best[0]:.2%} of all tokens", stacklevel=2)
    return steps, ridge, {"domains": domains, "target": goal.tolist(), "error": best[0], "rounds": best[1]}


def copies(r: Column, *key: Column) -> Column:
    """floor(r), and one more where a hash of the key, as a number from 0 to 1, is under what is left."""
    u = F.pmod(F.xxhash64(*key, F.lit(29)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(r) + (u < r - F.floor(r)).cast("long")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, model: DomainModel | None = None) -> DataFrame:
    """doc_id, n_tokens, posterior, domain (the likeliest), rate and copies of every document.

    Null and empty texts have no tokens and rate by their posterior like any other.  Repeated rows and ties are rated
    alike; an empty table gives no rows.  Extra columns are not read.
    """
    model = model or fit(docs, labels)
    members = written(memberships(docs.select("doc_id", F.col("text")), model).select("doc_id", "n_tokens", "posterior"))
    steps, shrink, _ = fit_rates(members, model.domains, targets or TARGETS)
    names = F.array(*(F.lit(d) for d in model.domains))
    likeliest = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    out = rated(members, steps, shrink, len(model.domains)).withColumn("domain", likeliest)
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domain: str = DOMAIN) -> DataFrame:
    """docs with each row as often as its rate says; the columns are those of docs, whatever their names."""
    model = fit(docs, labels, domain=domain)
    rows, name = renamed(docs)
    members = written(memberships(docs.select("text"), model).select("n_tokens", "posterior"))
    steps, shrink, _ = fit_rates(members, model.domains, targets or TARGETS)
    made = rated(memberships(rows, model, name["text"]), steps, shrink, len(model.domains))
    made = made.withColumn("copies", copies(F.col("rate"), F.col(name["doc_id"]), F.col(name["text"]))).where("copies > 0")
    return restored(made.select(*rows.columns, F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")), docs)
