"""Language, toxicity and mixing: held-out accuracy and defined results for odd tables."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, toxicity
from millrace.llm.common import held_out, read
from millrace.llm.queries import op1_mixing, op2_language, op10_toxicity
from tests.llm.helpers import documents, rows

SMALL = "/root/testdata/sf0.01"


def plain_segments(scores):
    """All maximal segments by their definition: the best one, then left and right of it."""
    def go(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        *_, i, j = best
        return go(a, i) + [(i, j)] + go(j, b)

    return go(0, len(scores))


def test_maximal_segments():
    rnd = random.Random(6)
    for _ in range(300):
        scores = [rnd.choice((-3.1, -1.7, -0.53, 0.61, 1.23, 2.9)) + rnd.random() / 100 for _ in range(rnd.randrange(14))]
        got = toxicity.maximal_segments(scores)
        assert [(i, j) for i, j, _ in got] == plain_segments(scores)
        assert all(abs(s - sum(scores[i:j])) < 1e-9 for i, j, s in got)


def test_extreme_value_root():
    p = [(0.01, 3.0), (0.99, -0.2)]
    assert abs(sum(q * math.exp(toxicity._root(p) * s) for q, s in p) - 1) < 1e-6


def test_toxicity_held_out(spark):
    got = op10_toxicity(spark, SMALL)
    labels = read(spark, SMALL, "labels")
    seen = got.where("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    assert sum(r["toxic"] == r["predicted"] for r in seen) / len(seen) > 0.93
    assert got.count() == read(spark, SMALL, "documents").count()
    assert got.where("score < 0 OR score > 1 OR predicted <> CAST(score >= 0.7 AS INT)").count() == 0
    assert sum(r["toxic"] == 0 and r["predicted"] == 1 for r in seen) <= 2


def test_toxic_passages_are_located():
    m = toxicity.ToxicityModel({"vile": 3.0, "foul": 3.0}, -0.2, 1.0, 0.01)
    text = "A calm start of words. Then vile and FOUL things. " + "calm words " * 60 + "vile."
    spans = m.significant(text)
    assert text[spans[0][0] : spans[0][1]] == "vile and FOUL"
    assert m.evidence(None) == m.evidence("") == (0.0, 0)


def test_toxicity_odd_tables(spark):
    docs = documents(spark, [None, "", "text", "text"])
    labels = spark.createDataFrame([(0, 1, None), (2, None, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert not model.weights
    got = rows(toxicity.score(docs.withColumnRenamed("source", "score"), model).select("doc_id", "predicted", "passages"))
    assert got == [(i, 0, 0) for i in range(4)]
    assert toxicity.fit(docs.limit(0), labels.limit(0)).weights == {}
    assert rows(toxicity.score(docs.limit(0), model)) == []


def test_language_held_out(spark):
    got = op2_language(spark, SMALL).join(read(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id")
    seen = got.where("held_out AND lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in seen) / len(seen) > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_counts_in_chunks(monkeypatch):
    text = "Ça va bien? Größe und Maß. " * 20
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "CHUNK", 13)
    assert (langid.counts(text) == whole).all() and whole.sum() == 3 * len(text) - 3


def test_language_odd_texts(spark):
    model = langid.train([(*langid.sparse(t), y) for t, y in (("the cat and the dog " * 3, "en"), ("der hund und die katze " * 3, "de"))] * 20)
    df = documents(spark, [None, "", "123 !?", "the dog", "der Hund und", "the dog"]).withColumnRenamed("source", "lang_pred")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(df, model).orderBy("doc_id").collect()]
    assert got == [(0, "und"), (1, "und"), (2, "und"), (3, "en"), (4, "de"), (5, "en")]
    assert rows(langid.predict(df.limit(0), model)) == []
    none = langid.fit(df.limit(0).withColumn("lang", F.lit("x")))
    assert none.labels == [] and none.predict("the dog") == ("und", 0.0)


def test_elastic_net_gives_zeros_and_temperature_is_fitted():
    rows_ = [(*langid.sparse(t), y) for t, y in (("aaa bbb", "x"), ("ccc ddd", "y"))] * 30
    loose, tight = langid.train(rows_, l1=0.0), langid.train(rows_, l1=0.5)
    assert (tight.weights != 0).sum() < (loose.weights != 0).sum()
    assert loose.temperature > 0 and loose.temperature != 1.0


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 3000)
    data = [(i, int(n), [float(x) for x in row]) for i, (n, row) in enumerate(zip(rng.integers(1, 900, 3000), p, strict=True))]
    members = spark.createDataFrame(data, "doc_id long, n_tokens long, posterior array<double>")
    steps, shrink, report = mixing.fit_rates(members, ["a", "b", "c"], {"a": 0.5, "b": 0.3, "c": 0.2})
    r = mixing.rates(p, np.array(steps), shrink)
    reached = (r * np.array([d[1] for d in data])) @ p
    assert (r >= 0).all() and report["error"] < 1e-3
    assert np.abs(reached / reached.sum() - [0.5, 0.3, 0.2]).max() < 2e-3


def test_mixing(spark):
    got = op1_mixing(spark, SMALL)
    assert got.count() == read(spark, SMALL, "documents").count()
    assert got.where("rate < 0 OR copies < floor(rate) OR copies > floor(rate) + 1").count() == 0
    docs = documents(spark, [None, "", "a b", "a b"])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = mixing.mix(docs, labels)
    assert [r["rate"] for r in one.collect()] == [1.0] * 4 and one.count() == 4
    assert mixing.resample(docs, labels).columns == docs.columns
    assert mixing.mix(docs.limit(0), labels).count() == 0


def test_held_out_rows(spark):
    import zlib

    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


def test_letters():
    model = langid.train([(*langid.sparse("the dog"), "en")])
    assert [model.predict(t)[0] for t in ("½ ² ①", "Ⅷ", "_1_", "ª1", "1é", "漢")] == ["und"] * 3 + ["en"] * 3


def test_sample_is_shared_out():
    assert langid.quotas({"a": 5, "b": 100, "c": 1000}, 60) == {"a": 5, "b": 27, "c": 28}
    assert langid.quotas({}, 9) == {} and langid.quotas({"a": 3, "b": 3}, 1) == {"a": 1, "b": 1}


def test_repeated_ids_leave_the_sample_whole(spark):
    data = [(i, f"text {'abcdefghij'[i % 10]} number {i} of one", "xy"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    for hot in (2, 3, 5, 7):
        many = docs.unionAll(spark.range(20000).selectExpr(f"{hot}L AS doc_id", "'again' AS text", "'x' AS lang"))
        chosen = langid._sample(many.select(F.col("doc_id").alias("id"), "lang"), 200)
        assert chosen.count() == chosen.select("id").distinct().count() == 200
        assert sorted(r[1] for r in chosen.groupBy("lang").count().collect()) == [100, 100]
        model = langid.fit(many, max_documents=200)
        assert model.labels == ["x", "y"]


def test_language_model_against_a_slow_one(spark):
    """Slots, idf, weights and temperature from a plain dictionary version of the same learner."""
    docs = documents(spark, [f"the {a} and the {b} of it" for a in ("cat", "dog", "cow") for b in ("sea", "sun", "fog")] + [f"der {a} und die {b} davon" for a in ("Hund", "Kater", "Stier") for b in ("See", "Sonne", "Nacht")])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") < 9, "en").otherwise("de"))
    got = langid.fit(docs)
    rows_ = [(r["text"], r["lang"]) for r in docs.where(~held_out(F.col("doc_id"))).collect()]
    grams = lambda t: [t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]
    slot = {g: [s for s in np.flatnonzero(langid.counts(g))] for t, _ in rows_ for g in grams(t)}
    assert all(len(slot[g]) <= 2 * len(g) for g in slot)
    one = lambda g: int(np.flatnonzero(langid.counts(g) - sum((langid.counts(p) for p in {g[:-1], g[1:]}), np.zeros(langid.SLOTS, int)) > 0)[0]) if len(g) > 1 else int(slot[g][0])
    for text, _ in rows_:
        at, n = langid.sparse(text)
        assert n.sum() == len(grams(text)) and {one(g) for g in set(grams(text)) if len(g) == 1} <= set(at.tolist())
    df = {}
    for text, _ in rows_:
        for s in langid.sparse(text)[0].tolist():
            df[s] = df.get(s, 0) + 1
    assert all(abs(got.idf[s] - (math.log((1 + len(rows_)) / (1 + df.get(s, 0))) + 1)) < 1e-12 for s in range(langid.SLOTS))
    # the learner, number by number
    made = sorted(((*langid.sparse(t), y) for t, y in rows_), key=lambda r: (r[2], len(r[0]), r[0].astype(np.int32).tobytes(), r[1].astype(np.int32).tobytes()))
    labels, rng = sorted({y for *_, y in made}), np.random.default_rng(5)
    order = rng.permutation(len(made))
    fitted = order[int(len(made) * 0.2) :]
    z, n, bias, nb = {}, {}, [0.0] * 2, [0.0] * 2

    def weight(s, k):
        v = z.get((s, k), 0.0)
        return 0.0 if abs(v) <= 0.01 else -(v - math.copysign(0.01, v)) / ((1.0 + math.sqrt(n.get((s, k), 0.0))) / 0.5 + 0.01)

    for _ in range(2):
        for i in rng.permutation(fitted):
            at, c, y = made[i]
            x = {int(s): math.log1p(int(m)) * got.idf[s] for s, m in zip(at, c, strict=True)}
            norm = math.sqrt(sum(v * v for v in x.values()))
            x = {s: v / norm for s, v in x.items()}
            old = {(s, k): weight(s, k) for s in x for k in range(2)}
            e = [sum(x[s] * old[s, k] for s in x) + bias[k] for k in range(2)]
            top = max(e)
            p = [math.exp(v - top) for v in e]
            for k in range(2):
                g = p[k] / sum(p) - (labels[k] == y)
                for s in x:
                    step, before = x[s] * g, n.get((s, k), 0.0)
                    n[s, k] = before + step * step
                    z[s, k] = z.get((s, k), 0.0) + step - (math.sqrt(n[s, k]) - math.sqrt(before)) / 0.5 * old[s, k]
                nb[k] += g * g
                bias[k] -= 0.5 * g / (1.0 + math.sqrt(nb[k])) * 0.1
    assert got.labels == labels and np.abs(got.bias - bias).max() < 1e-9
    assert all(abs(got.weights[s, k] - weight(s, k)) < 1e-9 for s in range(langid.SLOTS) for k in range(2))


def labelled_corpus(spark, repeat=True):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(400):
        t = rnd.choices(words, k=30)
        if i % 4 == 0:
            t[5:7] = ["vile", "foul"]
        texts.append((i, " ".join(t)))
    docs = texts + [(2, "one more text of this id")] * 3 + [(8, "zz vile foul")] * 2 if repeat else texts
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)] + ([(2, 0, 1)] * 2 if repeat else [])
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_models_do_not_depend_on_the_layout(spark):
    docs, labels = labelled_corpus(spark)
    made = []
    for part in (1, 3, 7):
        d, y = docs.repartition(part).orderBy(F.rand(part)), labels.repartition(part)
        t, m = toxicity.fit(d, y), mixing.fit(d, y)
        made.append((t.weights, t.base, t.lam, t.k, t.a, t.b, m.domains, m.weights.tolist(), m.bias.tolist()))
    assert made[0] == made[1] == made[2] and made[0][0].keys() >= {"vile", "foul"}


def test_toxicity_model_against_a_slow_one(spark):
    docs, labels = labelled_corpus(spark, repeat=False)
    got = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    learn = {r["id"] for r in docs.select(F.col("doc_id").alias("id")).where(~held_out(F.col("id"))).collect()}
    seen = set()
    for i in learn:
        around = ["", *texts[i], ""]
        for w in set(texts[i]):
            seen.add((w, i % 4 == 0, min(toxicity.hash_pair(a, c) for a, b, c in zip(around, around[1:], around[2:]) if b == w)))
    y = [{}, {}]
    for w, toxic, _ in seen:
        y[toxic][w] = y[toxic].get(w, 0) + 1
    corpus = {}
    for t in texts.values():
        for w in set(t):
            corpus[w] = corpus.get(w, 0) + 1
    n0, n1 = (sum(x.values()) for x in y)
    prior, weights, p, o0, o1 = 0.1 * (n0 + n1), {}, [], n0, n1
    for w in sorted(set(y[0]) | set(y[1])):
        y0, y1, a = y[0].get(w, 0), y[1].get(w, 0), 0.1 * (n0 + n1) * corpus[w] / sum(corpus.values())
        d = math.log((y1 + a) / (n1 + prior - y1 - a)) - math.log((y0 + a) / (n0 + prior - y0 - a))
        sigma = math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        if y0 + y1 >= 5 and abs(d) >= 3 * sigma:
            weights[w] = math.copysign(abs(d) - 1.645 * sigma, d)
            p.append(((y0 + a) / (n0 + prior), weights[w]))
            o0, o1 = o0 - y0, o1 - y1
    base = min(-0.1, math.log(o1 / n1) - math.log(o0 / n0))
    p.append((1 - sum(x for x, _ in p), base))
    assert got.weights.keys() == weights.keys() and all(abs(got.weights[w] - weights[w]) < 1e-9 for w in weights)
    assert abs(got.base - base) < 1e-9 and abs(sum(q * math.exp(got.lam * s) for q, s in p) - 1) < 1e-6
    clean = [texts[i] for i in learn if i % 4]
    score = lambda t: [weights.get(w, base) for w in t]
    found = [[sum(score(t)[i:j]) for i, j in plain_segments(score(t))] for t in clean]
    k = (sum(map(len, found)) + 0.5) / sum(map(len, clean)) * math.exp(got.lam * min(s for _, s in p if s > 0))
    assert abs(got.k - min(1.0, k)) < 1e-9


def test_rates_against_a_plain_solver(spark):
    """The rates are the least squares of the stated objective, found here by many small steps on each rate."""
    rng = np.random.default_rng(8)
    p, t = rng.dirichlet([0.4, 0.4, 0.4], 200), rng.integers(1, 60, 200)
    members = spark.createDataFrame([(i, int(n), [float(x) for x in row]) for i, (n, row) in enumerate(zip(t, p, strict=True))], "doc_id long, n_tokens long, posterior array<double>")
    goal = np.array([0.6, 0.3, 0.1]) * t.sum() * 1.5
    steps, shrink, _ = mixing.fit_rates(members, ["a", "b", "c"], {"a": 0.6, "b": 0.3, "c": 0.1}, total=float(goal.sum()), rounds=200, ridge=0.05, tolerance=0.0)
    got = mixing.rates(p, np.array(steps), shrink)
    m = (p * t[:, None]).T @ p
    inverse = np.linalg.inv(m + 1e-3 * np.trace(m) / 3 * np.eye(3))

    def loss(r):
        e = (r * t) @ p - goal
        return 0.35 * e @ inverse @ e + 0.025 * (t * (r - 1) ** 2).sum()

    r = np.ones(200)
    for _ in range(20000):
        e = (r * t) @ p - goal
        r = np.maximum(0, r - 0.01 * (0.7 * p @ inverse @ e + 0.05 * (r - 1)))
    assert loss(got) <= loss(r) * 1.02 and np.abs((got * t) @ p - goal).max() <= np.abs((r * t) @ p - goal).max() + 1e-6


def test_rare_endings_of_a_toxic_stem(spark):
    """Each form is too rare to be proven; a stem whose many forms stand in one text only is no proof."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    ends = ["".join(rnd.choices("bdgklmnprst", k=5)) for _ in range(400)]
    texts, unseen = [], []
    for i in range(400):
        t = rnd.choices(words, k=30)
        if i % 4 == 0:
            t[5:8] = [f"grobi{e}" for e in ends[i : i + 3]]
        if i == 8:
            t += [f"solo{e}" for e in ends[:40]]
        texts.append((i, " ".join(t)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int"))
    assert "grobi" in model.stems and not any(s.startswith("solo") for s in model.stems)
    unseen = " ".join(words[:15] + ["Grobixyz", "grobiuvw", "grobiq"] + words[:15])
    got = rows(toxicity.score(documents(spark, [unseen, unseen.lower().replace("grobi", "solo"), " ".join(words)]), model).select("doc_id", "predicted"))
    assert got == [(0, 1), (1, 0), (2, 0)]


def test_repeats_of_a_toxic_word_are_no_further_evidence():
    m = toxicity.ToxicityModel({"vile": 3.0, "foul": 3.0}, -0.2, 1.0, 0.01, stems={"grob": 2.0, "grobia": 4.0})
    assert [m.weight(w) for w in ("vile", "grob", "grobheit", "grobian", "gro", "calm")] == [3.0, 2.0, 2.0, 4.0, -0.2, -0.2]
    calm = " calm" * 40
    once, repeated = m.evidence("vile foul" + 2 * calm), m.evidence("vile foul" + calm + " vile foul" + calm[:-10])
    assert abs(once[0] - repeated[0]) < 1e-9 and (once[1], repeated[1]) == (1, 2)
    assert len(m.significant("vile foul" + calm + " vile foul" + calm)) == 2
