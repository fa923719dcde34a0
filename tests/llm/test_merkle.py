import hashlib
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import merkle
from tests.llm.helpers import documents, rows

TEXT = st.text(alphabet="ab. \n", max_size=60)


@given(TEXT, TEXT)
def test_roots_tell_texts_apart(a, b):
    x, y = merkle.fingerprint(a), merkle.fingerprint(b)
    assert (x[:64] == y[:64]) == (a == b) == (merkle.likeness(x, y) == 1)
    assert x[:64] == merkle.tree(a).digest
    assert 0 <= merkle.likeness(x, y) == merkle.likeness(y, x) <= 1
    # by definition: the pieces that both have, and those that both begin and end with
    p, q = (plain_pieces(t) for t in (a, b))
    if a != b:
        assert merkle.likeness(x, y) == min(2 * sum((Counter(p) & Counter(q)).values()) / (len(p) + len(q)), 1 - 1e-9)
        head = next((i for i, (c, d) in enumerate(zip(p, q)) if c != d), min(len(p), len(q)))
        tail = next((i for i, (c, d) in enumerate(zip(p[::-1], q[::-1])) if c != d), min(len(p), len(q)))
        assert merkle.changed(x, y) == (head, len(p) - min(tail, min(len(p), len(q)) - head))


def plain_pieces(text):
    out = []
    for sentence in (e for s in text.split("\n\n") for p in s.split("\n") for e in p.split(". ")):
        words = sentence.split(" ")
        out += [" ".join(words[i : i + 8]) for i in range(0, len(words), 8)]
    return out


@given(TEXT, TEXT, TEXT)
def test_edits_are_within_the_spans(head, tail, new):
    a, b = head + "\n" + "old" + "\n" + tail, head + "\n" + new + "\n" + tail
    spans = merkle.edits(merkle.tree(a), merkle.tree(b))
    assert bool(spans) == (a != b)
    if spans:
        (s, _), (t, _) = spans[0]
        (_, e), (_, f) = spans[-1]
        assert a[: min(s, t)] == b[: min(s, t)] and (a[e:] == b[f:] or len(a) - e != len(b) - f)


def brute(docs):
    order = sorted(docs, key=lambda d: (d[0], hashlib.md5(d[1].encode()).hexdigest()), reverse=True)
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        new = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        p, q, r = map(merkle.fingerprint, (t, new, u))
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), p, q, merkle.likeness(p, q), merkle.likeness(p, r), *merkle.changed(p, q)))
    return sorted(out, key=repr)


def test_frame(spark):
    texts = [None, "", "one", "Sentence one. Sentence two.\nMore text here\n\nNew section. " * 20, "x" * 50, "é" * 31, *(f"text number {i} of many. It has two sentences." for i in range(40))]
    df = documents(spark, texts, first=-3)
    want = brute([(i - 3, t or "") for i, t in enumerate(texts)])
    assert rows(merkle.edit_likeness(df.repartition(5))) == want
    assert rows(merkle.edit_likeness(df.limit(0))) == []
    one = documents(spark, ["only one"])
    assert rows(merkle.edit_likeness(one)) == brute([(0, "only one")])
    assert rows(merkle.edit_likeness(one.unionAll(one))) == brute([(0, "only one")] * 2)


def test_one_id_on_many_texts_is_spread(spark):
    docs = [(5, f"text {i} of the one id. It goes on.") for i in range(200)] + [(None, f"no id {i}") for i in range(50)] + [(i, "other") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [(r[0], *r[1:]) for r in rows(merkle.edit_likeness(df))]
    low = -(1 << 63)
    want = [(None if r[0] == low else r[0], *r[1:]) for r in brute([(low if i is None else i, t) for i, t in docs])]
    assert got == sorted(want, key=repr)
    cuts = merkle._cuts(spark.createDataFrame([(5, i) for i in range(4000)], "k long, h long"), 8)
    assert len(cuts) == 7 and {k for k, _ in cuts} == {5}


def test_near_is_nearer_than_next():
    a = " ".join(f"alpha{i} beta{i} gamma{i}." for i in range(60))
    b = " ".join(f"delta{i} eps{i} zeta{i}." for i in range(60))
    p, q, r = merkle.fingerprint(a), merkle.fingerprint(merkle.edited(a, b)), merkle.fingerprint(b)
    assert 0.4 < merkle.likeness(p, q) < 0.6 and merkle.likeness(p, r) < 0.05
