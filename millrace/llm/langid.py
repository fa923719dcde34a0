"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are n-grams of 1 to 3 code points of the lower-cased text, hashed to 2**BITS slots, weighed ln(1 + tf) * idf
and scaled to length 1.  FTRL-proximal (McMahan et al. 2013) fits the weights under an elastic net (l1 and l2); a
temperature fitted on a part kept out of training then calibrates the probabilities (Guo et al. 2017).

Document frequencies are counted over all documents that may be learned from; the weights are fitted on a bounded sample
of whole texts (MAX_DOCUMENTS, shared out over the languages); prediction covers every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import SEED, append_columns, held_out, near, one_per_id, slices

BITS = 14
SLOTS = 1 << BITS
CHUNK = 1 << 20
MAX_DOCUMENTS = 4000
UNKNOWN = "und"
#: A letter in the sense of Unicode's general categories L*; numerals such as a half or a Roman eight are none.
LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """How often each slot's n-grams occur in the text; a long text is gone through in chunks."""
    c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    out = np.zeros(SLOTS, np.int64)
    for at in range(0, len(c), CHUNK):
        part = c[at : at + CHUNK + 2]
        one = part[:CHUNK] * np.uint32(0x9E3779B1)
        out += np.bincount(one >> np.uint32(32 - BITS), minlength=SLOTS)
        two = (part[:-1] * np.uint32(0x85EBCA6B) + part[1:])[:CHUNK] * np.uint32(0xC2B2AE35)
        out += np.bincount(two >> np.uint32(32 - BITS), minlength=SLOTS)
        if len(part) > 2:
            three = ((part[:-2] * np.uint32(0x27D4EB2F) + part[1:-1]) * np.uint32(0x165667B1) + part[2:]) * np.uint32(0x9E3779B1)
            out += np.bincount(three >> np.uint32(32 - BITS), minlength=SLOTS)
    return out


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    n = counts(text)
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass
class LanguageModel:
    """labels in order; idf by slot; weights slot x label; bias by label; temperature."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def values(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = np.log1p(n) * self.idf[at]
        norm = np.sqrt(v @ v)
        return v / norm if norm else v

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.values(at, n) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(label, probability); `und` with score 0 for a null text, one without a letter, or a model without labels."""
        if not text or not self.labels or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*sparse(text)) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(min(1.0, p[k]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], frequency: np.ndarray | None = None, documents: int = 0, epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01, calibrate: float = 0.2) -> LanguageModel:
    """Fit to (slots, counts, label) rows.  No rows give a model that knows no label; one label is always predicted.

    frequency: by slot, in how many of `documents` documents it occurs (default: those of the rows).
    """
    labels = sorted({y for _, _, y in rows})
    if frequency is None:
        frequency, documents = np.bincount(np.concatenate([at for at, _, _ in rows] or [np.zeros(0, np.int64)]), minlength=SLOTS), len(rows)
    idf = np.log((1 + documents) / (1 + frequency)) + 1
    k, rng = len(labels), np.random.default_rng(5)
    model = LanguageModel(labels, idf, np.zeros((SLOTS, k)), np.zeros(k))
    if k < 2:
        return model
    order = rng.permutation(len(rows))
    kept = order[: int(len(rows) * calibrate)]
    fitted = order[len(kept) :]
    z, n, w, bias, nb = np.zeros((SLOTS, k)), np.zeros((SLOTS, k)), model.weights, model.bias, np.zeros(k)
    index = {y: i for i, y in enumerate(labels)}
    x = {i: model.values(*rows[i][:2])[:, None] for i in fitted}
    for _ in range(epochs):
        for i in rng.permutation(fitted):
            at, v = rows[i][0], x[i]
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = softmax((v * wi).sum(0) + bias)
            g[index[rows[i][2]]] -= 1
            step = v * g
            new = ni + step * step
            z[at] = zi + step - (np.sqrt(new) - np.sqrt(ni)) / alpha * wi
            n[at] = new
            nb += g * g
            bias -= alpha * g / (beta + np.sqrt(nb)) * 0.1
    w[:] = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    if len(kept):
        logits = np.array([model.logits(*rows[i][:2]) for i in kept])
        y = np.array([index[rows[i][2]] for i in kept])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
        low, high = np.log(0.02), np.log(20)
        for _ in range(60):  # golden sections of ln T; the loss has one minimum
            a, b = high - (high - low) * 0.618, low + (high - low) * 0.618
            low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def _features(batches):
    for b in slices(batches):
        lang, at, n = [], [], []
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s, c = sparse(text)
            lang.append(y)
            at.append(s.astype(np.int32).tobytes())
            n.append(c.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "slots", "counts"])


def _frequencies(batches):
    """In how many of a task's texts each slot occurs; slot -1 counts the texts."""
    found, n = np.zeros(SLOTS, np.int64), 0
    for b in slices(batches):
        for text in b.column(0).to_pylist():
            found += counts(text) > 0
            n += 1
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], names=["slot", "n"])


def quotas(sizes: dict[str, int], n: int) -> dict[str, int]:
    """n shared out over labels: the same for each, and what a label has too few documents for goes to the others."""
    out, left = {}, n
    for i, y in enumerate(sorted(sizes, key=lambda y: (sizes[y], y))):
        out[y] = min(sizes[y], max(1, left // (len(sizes) - i)))
        left -= out[y]
    return out


def _sample(can: DataFrame, n: int) -> DataFrame:
    """(id, lang) of at most n documents (or one of each language), chosen by a hash; an id has the least of its languages."""
    sizes = {r[0]: r[1] for r in can.groupBy("lang").agg(F.approx_count_distinct("id", 0.02)).collect()}
    share = quotas(sizes, n)
    if not share:
        return can.select("id", "lang").limit(0)
    limits = can.sparkSession.createDataFrame([(y, share[y], min(1.0, (1.2 * share[y] + 200) / sizes[y])) for y in share], "lang string, quota int, share double")
    some = can.select("id", "lang").join(F.broadcast(limits), "lang").where(near(F.col("id"), F.col("share")))
    some = some.groupBy("id").agg(F.min(F.struct("lang", "quota")).alias("least")).select("id", "least.*")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(SEED)), "id")
    return some.withColumn("rank", F.row_number().over(order)).where("rank <= quota").select("id", "lang")


def fit(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> LanguageModel:
    """Learn from doc_id, text and non-null lang of rows that are not held out and have a letter.

    The idf is that of all such rows.  The sample's ids are chosen from narrow columns; a repeated id counts once there,
    with its least text.  To the driver come SLOTS counts and max_documents sparse count vectors of at most SLOTS entries.
    """
    can = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang")
    seen = {r[0]: r[1] for r in can.select("text").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect()}
    frequency = np.zeros(SLOTS)
    for slot, n in seen.items():
        if slot >= 0:
            frequency[slot] = n
    rows = one_per_id(can.join(F.broadcast(_sample(can, max_documents)), ["id", "lang"]), "id", "text", "lang").select("text", "lang")
    got = rows.mapInArrow(_features, "lang string, slots binary, counts binary").collect()
    made = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["counts"], np.int32), r["lang"]) for r in got]
    made.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))  # the same order however the rows came
    return train(made, frequency, seen.get(-1, 0))


def predict(df: DataFrame, model: LanguageModel, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the language of every whole text and its calibrated probability.

    Null texts, and texts without a letter, are `und` with score 0.  Other columns, repeated rows and ties between rows
    do not matter; ties between labels go to the first by name.  The broadcast model has SLOTS x labels weights.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    at = [c for c in df.columns if c not in (label, score)].index(text)

    def factory():
        m = held.value

        def run(b):
            got = [m.predict(t) for t in b.column(at).to_pylist()]
            return [[y for y, _ in got], [p for _, p in got]]

        return run

    return append_columns(df, {label: "string", score: "double"}, factory)
