"""Toxicity by maximum-scoring segments of token log-odds.

1. Token weights: log-odds of a word between toxic and other labelled texts under an informative Dirichlet prior
   (Monroe, Colaresi and Quinn 2008).  A word counts once a text, and texts in which it has the same context (its
   neighbours) once together, so copied texts weigh no more than one.  Words whose z-score is under `z` take the weight
   of the longest proven stem that they begin with (many endings are each too rare to be proven), or the background's.
2. Passages: the linear-time scan of Ruzzo and Tompa (1999) finds all maximal segments of positive score.
3. Calibration: a segment of score S in a text of n words has E-value K n exp(-lambda S) (Karlin and Altschul 1990);
   lambda solves sum p(s) exp(lambda s) = 1 over the background, K comes from the segments seen in clean texts.
   A text's evidence is the sum of the significant segments' -ln E; a logistic fit maps it to a probability.  Since words
   were counted once a text, a toxic word adds to the evidence once a text: its repeats are no news, in clean texts either.
   Passages are found with all their words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import append_columns, bounded_sample, held_out, one_per_id, slices, written

WORD = re.compile(r"\w+")
MAX_LABELLED = 20_000
FLUSH = 1 << 16
BUCKETS = 1 << 20
#: Code points of a stem, and how many words must begin with it.
SHORTEST, LONGEST = 4, 12
MIN_FORMS = 3
#: The least proven log-odds of a toxic word or stem; many weaker ones by chance would outweigh a toxic one.
LEAST_ODDS = math.log(2)


@dataclass
class ToxicityModel:
    """weights: word -> log-odds; base: weight of every other word; lam, k: of the E-value; a, b: of the logistic map.

    stems: beginning -> log-odds of the words that begin so and have no weight of their own; the longest counts.
    """

    weights: dict[str, float] = field(default_factory=dict)
    base: float = -0.1
    lam: float = 1.0
    k: float = 0.1
    a: float = 0.0
    b: float = -3.0
    max_e: float = 0.05
    stems: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.positive = frozenset(w for w, s in self.weights.items() if s > 0)
        self.heads = frozenset(s[:SHORTEST] for s in self.stems)

    def weight(self, word: str) -> float:
        if (s := self.weights.get(word)) is not None:
            return s
        return next((self.stems[t] for t in beginnings(word) if t in self.stems), self.base)

    def segments(self, words: list[str], repeats: bool = False) -> list[tuple[int, int, float]]:
        """All maximal segments as (first word, end, score); a toxic word's repeats are as any other word, or score again."""
        if self.positive.isdisjoint(words) and (not self.heads or self.heads.isdisjoint([w[:SHORTEST] for w in words])):
            return []
        get, base, heads = self.weights.get, self.base, self.heads
        scores = [self.weight(w) if w[:SHORTEST] in heads else get(w, base) for w in words]
        if not repeats:
            seen = set()
            for i, s in enumerate(scores):
                if s > 0:
                    if words[i] in seen:
                        scores[i] = base
                    seen.add(words[i])
        return maximal_segments(scores)

    def e_value(self, score: float, n: int) -> float:
        return self.k * max(n, 1) * math.exp(-self.lam * score)

    def significant(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """The toxic passages of a text: first code point, end, score, E-value."""
        text = (text or "").lower()
        found = [(m.start(), m.end()) for m in WORD.finditer(text)]
        out = []
        for i, j, s in self.segments([text[a:b] for a, b in found], repeats=True):
            if (e := self.e_value(s, len(found))) <= self.max_e:
                out.append((found[i][0], found[j - 1][1], s, e))
        return out

    def evidence(self, text: str | None) -> tuple[float, int]:
        """The sum of -ln E, and the number of toxic passages."""
        words = WORD.findall((text or "").lower())
        found = [e for _, _, s in self.segments(words) if (e := self.e_value(s, len(words))) <= self.max_e]
        n = sum(self.e_value(s, len(words)) <= self.max_e for _, _, s in self.segments(words, repeats=True)) if found else 0
        return -sum(math.log(max(e, 1e-300)) for e in found), n

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.a * math.log1p(evidence) + self.b))))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences, left to right, in time linear in len(scores).

    Candidates lie on a stack with the running total before (left) and after (right) them.  `below` links each to the
    nearest candidate under it whose left total is smaller, so that each candidate is passed over once.
    """
    stack: list[list] = []
    total = 0.0
    for at, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        first, left = at, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append([first, at + 1, left, total, j])
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(i, j, right - left) for i, j, left, right, _ in stack]


def _contexts(batches, terms: Callable[[str], Iterable[str]] = lambda w: (w,)):
    """One row for each word of a text: (word, toxic, context), the context being the least hash of its neighbours.

    A word counts once a text, so a long text weighs no more than a short one; copies, edited ones too, mostly have the
    same least context and fall together when the rows are made distinct.  terms: what is counted for a word, if not itself.
    """
    for b in slices(batches):
        seen = set()
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = ["", *WORD.findall((text or "").lower()), ""]
            least: dict[str, int] = {}
            for a, w, c in zip(words, words[1:], words[2:], strict=False):
                for t in terms(w):
                    if (h := hash_pair(a, c)) < least.get(t, 1 << 32):
                        least[t] = h
            seen.update((t, toxic, h) for t, h in least.items())
        seen = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["word", "toxic", "context"])


def _counted(sample: DataFrame, terms=_contexts) -> DataFrame:
    """(word, y1, y0): the different contexts of a word in toxic and in other texts."""
    toxic = F.col("toxic").cast("long")
    return sample.mapInArrow(terms, "word string, toxic int, context long").distinct().groupBy("word").agg(F.sum(toxic).alias("y1"), F.sum(1 - toxic).alias("y0"))


def beginnings(word: str) -> Iterator[str]:
    """What of a word can be a stem, longest first."""
    return (word[:n] for n in range(min(len(word), LONGEST), SHORTEST - 1, -1))


def hash_pair(a: str, b: str) -> int:
    return zlib.crc32(b.encode(), zlib.crc32(a.encode() + b"\0"))


def labelled(docs: DataFrame, labels: DataFrame, n: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most n labelled ids outside the held-out rows; equal texts of one label are one row.

    The ids are chosen from the labels alone, so the broadcast side holds n rows at most.  A repeated id counts once, with
    its greatest label and its least text.
    """
    ids = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = ids.join(F.broadcast(bounded_sample(ids, "id", n)), "id")
    found = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    return one_per_id(found, "id", "text", "toxic").select("text", "toxic").distinct()


def _frequencies(wanted: np.ndarray):
    """(word, n): in how many of a task's texts a word occurs, for words whose hash is wanted; a null word counts them all.

    Counts leave the task in parts of at most FLUSH words or so.
    """

    def run(batches):
        found: Counter[str] = Counter()
        total, held = 0, wanted.tobytes()  # a byte string is indexed faster than an array

        def part(more: list):
            words, n = [*found, *(w for w, _ in more)], [*found.values(), *(k for _, k in more)]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                words = set(WORD.findall((text or "").lower()))
                total += len(words)
                found.update(w for w in words if held[zlib.crc32(w.encode()) & BUCKETS - 1])
                if len(found) > FLUSH:
                    yield part([])
        yield part([(None, total)])

    return run


def fit(docs: DataFrame, labels: DataFrame, n: int = MAX_LABELLED, z: float = 3.0, prior: float = 0.1, min_texts: int = 5) -> ToxicityModel:
    """Learn from at most n labelled texts (see labelled()); without toxic or without clean texts no word is toxic.

    docs: doc_id, text.  labels: doc_id, toxic (0 or 1; null rows are left out).  prior: strength of the Dirichlet prior,
    as a share of all counts; its shape is that of the words of all documents, which are counted without their labels.
    Of those only the words that at least min_texts counts of the sample hold are summed, found by BUCKETS hash buckets.
    Only words and stems whose log-odds are proven (|d| >= z sigma over at least min_texts counts) reach the driver.
    """
    sample = written(labelled(docs, labels, n))
    counts = written(_counted(sample))
    n1, n0 = counts.agg(F.sum("y1"), F.sum("y0")).first()
    model = ToxicityModel()
    if not n1 or not n0:
        return model
    enough = F.col("y1") + F.col("y0") >= min_texts
    wanted = np.zeros(BUCKETS, bool)
    buckets = counts.where(enough).select(F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(BUCKETS)).cast("int").alias("at"))
    wanted[[r[0] for r in buckets.distinct().collect()]] = True
    corpus = written(docs.select("text").mapInArrow(_frequencies(wanted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    whole = corpus.where(F.col("word").isNull()).first()["n"]
    share = prior * (n1 + n0)

    def tested(rows: DataFrame, a) -> DataFrame:
        """The proven ones of rows of y1 and y0; a: the prior's counts of the word."""
        y1, y0 = F.col("y1"), F.col("y0")
        odds = lambda y, all_: F.log((y + a) / (F.lit(float(all_ + share)) - y - a))
        rows = rows.where(enough).withColumn("d", odds(y1, n1) - odds(y0, n0)).withColumn("sigma", F.sqrt(1 / (y1 + a) + 1 / (y0 + a)))
        return rows.where(F.abs("d") >= z * F.col("sigma")).select("word", "y1", "y0", a.alias("a"), "d", "sigma")

    proven = tested(counts.where(enough).join(corpus, "word"), F.col("n") * F.lit(share / whole)).collect()
    weights, other1, other0, p = {}, float(n1), float(n0), []
    for w, y1, y0, a, d, sigma in sorted(proven):
        # the near bound of the interval, so that a weight rests on what the counts prove
        bound = d - math.copysign(min(abs(d), 1.645 * sigma), d)
        if 0 <= bound < LEAST_ODDS:
            continue
        weights[w] = bound
        other1, other0 = other1 - y1, other0 - y0
        p.append(((y0 + a) / (n0 + share), weights[w]))
    stems, all_of = _stems(sample, counts, weights, lambda rows: tested(rows, F.lit(prior) * (F.col("y1") + F.col("y0"))).where("d > 0"))
    for s, (y1, y0) in all_of.items():
        other1, other0 = other1 - y1, other0 - y0
        p.append(((y0 + prior * (y1 + y0)) / (n0 + share), stems[s]))
    # Words without a weight of their own share one; it is kept under -0.1 so that a chance run loses score.
    base = min(-0.1, math.log(max(other1, 1.0) / n1) - math.log(max(other0, 1.0) / n0))
    p.append((max(1e-9, 1 - sum(x for x, _ in p)), base))
    model = ToxicityModel(weights, base, _root(p), stems=stems)
    # K: segments of clean texts per word and exp(-lambda S); half a segment is added, so it is never zero.
    words0, seen = sample.where("toxic = 0").mapInArrow(_measured(model), "words long, segments long").agg(F.sum("words"), F.sum("segments")).first()
    least = min([s for _, s in p if s > 0], default=1.0)
    model.k = min(1.0, (seen + 0.5) / max(words0, 1) * math.exp(model.lam * least))
    rows = sample.mapInArrow(_evidence(model), "evidence double, toxic int").collect()
    model.a, model.b = _logistic(sorted((math.log1p(r["evidence"]), r["toxic"]) for r in rows))
    return model


def _stems(sample: DataFrame, counts: DataFrame, weights: dict[str, float], tested: Callable[[DataFrame], DataFrame]) -> tuple[dict[str, float], dict[str, list[int]]]:
    """The weights of toxic stems, and y1 and y0 summed over the words that take each stem's weight.

    A stem stands for the words that begin with it and have no weight of their own.  Their summed counts say which stems
    are likely; since one text can hold many of the words, each of those is then counted in the texts, once a text like a
    word, and must be proven by that.  The prior's shape is that of the sample, without its labels.
    """
    spark = sample.sparkSession
    rest = counts.where(F.length("word") >= SHORTEST).join(F.broadcast(spark.createDataFrame([(w,) for w in sorted(weights)], "word string")), "word", "left_anti")
    stem = F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda n: F.substring(F.col("word"), F.lit(1), n)))
    sums = rest.select(stem.alias("word"), "y1", "y0").groupBy("word").agg(F.count(F.lit(1)).alias("forms"), F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    likely = {r["word"]: [r["y1"], r["y0"]] for r in tested(sums.where(F.col("forms") >= MIN_FORMS)).collect()}
    if not likely:
        return {}, {}
    heads = frozenset(s[:SHORTEST] for s in likely)

    def terms(w: str) -> Iterable[str]:
        return [t for t in beginnings(w) if t in likely] if w[:SHORTEST] in heads and w not in weights else ()

    found = tested(_counted(sample, lambda batches: _contexts(batches, terms))).collect()
    stems = {r["word"]: s for r in found if (s := r["d"] - 1.645 * r["sigma"]) >= LEAST_ODDS}
    all_of = {s: list(likely[s]) for s in sorted(stems)}
    for s in all_of:  # the words of a longer stem are not the shorter one's
        if above := next((t for t in beginnings(s[:-1]) if t in stems), None):
            all_of[above] = [x - y for x, y in zip(all_of[above], likely[s], strict=True)]
    return stems, all_of


def _measured(model: ToxicityModel):
    """Words and segments of each text."""

    def run(batches):
        for b in slices(batches):
            words = [WORD.findall((t or "").lower()) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int64()), pa.array([len(model.segments(w)) for w in words], pa.int64())], names=["words", "segments"])

    return run


def _evidence(model: ToxicityModel):
    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([model.evidence(t)[0] for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["evidence", "toxic"])

    return run


def _root(p: list[tuple[float, float]]) -> float:
    """The positive lambda with sum p exp(lambda s) = 1, by bisection; 1 where no score is positive."""
    if not any(s > 0 for _, s in p):
        return 1.0
    f = lambda x: sum(q * math.exp(min(700.0, x * s)) for q, s in p) - 1
    low, high = 1e-6, 1e-3
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def _logistic(points: list[tuple[float, int]], ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a one-dimensional logistic regression, by Newton steps."""
    a, b = 0.1, -1.0
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y in points:
            q = 1 / (1 + math.exp(-max(-500.0, min(500.0, a * x + b))))
            w = q * (1 - q)
            g0, g1 = g0 + (q - y) * x, g1 + q - y
            h00, h01, h11 = h00 + w * x * x, h01 + w * x, h11 + w
        g0, g1, h00, h11 = g0 + ridge * a, g1 + ridge * b, h00 + ridge, h11 + ridge
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return max(a, 0.0), b


def score(df: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """df with score (0 to 1), predicted (1 if score >= threshold, else 0) and passages (number of toxic ones).

    A null or empty text has no passage and gets the score of no evidence.  Equal texts score equally; other columns,
    repeated rows and the order of rows do not matter.  Broadcast are the weights of the proven words,
    each of which at least min_texts of the labelled texts hold.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    at = [c for c in df.columns if c not in ("score", "predicted", "passages")].index(text)

    def factory():
        m = held.value

        def run(b):
            got = [m.evidence(t) for t in b.column(at).to_pylist()]
            scores = [m.probability(x) for x, _ in got]
            return [scores, [int(s >= threshold) for s in scores], [n for _, n in got]]

        return run

    return append_columns(df, {"score": "double", "predicted": "int", "passages": "int"}, factory)
