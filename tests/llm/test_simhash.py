import collections
import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from tests.llm.helpers import documents, rows


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, near):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                parent[find(a)] = find(b)
    out = collections.defaultdict(set)
    for x in nodes:
        out[find(x)].add(x)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one Two", "A b c", "Ä ö ü ß É", "x " * 500, "a\x0bb\x0cc\x1fd e", "no break here and there"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_long_texts_go_through_in_parts(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "b", "c", "d", "e"], k=400))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PART", 7)
    assert simhash.fingerprint(text) == whole == plain(text)


def test_planes_cover_all_triples():
    from itertools import combinations

    found = simhash.planes()
    assert len(found) == 14 and all(m.bit_count() == 32 for m in found)
    for three in combinations(range(8), 3):
        assert any(all(not m >> 8 * x & 0xFF for x in three) for m in found)


@pytest.mark.parametrize("limit", [4096, 16])
def test_links_join_what_all_pairs_join(spark, limit):
    rnd = random.Random(3)
    nodes = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rnd.randrange(9)):
                x ^= 1 << rnd.randrange(64)
            nodes.add(x)
    nodes = sorted(nodes)
    want = {g for g in groups(nodes, lambda a, b: (a ^ b).bit_count() <= 3) if len(g) > 1}
    df = spark.createDataFrame([(simhash.signed(x),) for x in nodes], "fp long").repartition(3)
    got = collections.defaultdict(set)
    for r in simhash.components(simhash.links(df, limit)).collect():
        got[r.root].add(r.node & (1 << 64) - 1)
    assert {frozenset(g) for g in got.values()} == want


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [base, base, base.replace("word7 ", "other "), "quite another text of its own", None, "", " ", base.upper().replace("WORD", "word")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts, first=10)).collect()}
    prints = {10 + i: plain(t) for i, t in enumerate(texts)}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    for g in groups(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3):
        assert {got[i]["component_id"] for i in g} == {min(g)}


def test_repeats_nulls_and_an_empty_table(spark):
    df = documents(spark, ["same text here now", "same text here now"])
    twice = df.unionAll(df).unionAll(spark.createDataFrame([(None, "same text here now", None, None, None)], df.schema))
    got = rows(simhash.near_duplicates(twice))
    assert [(r[0], r[2]) for r in got] == [(0, 0), (0, 0), (1, 0), (1, 0), (None, 0)]
    assert rows(simhash.near_duplicates(df.limit(0))) == []
    odd = df.withColumnRenamed("source", "fp").withColumnRenamed("lang", "component_id")
    assert len(rows(simhash.near_duplicates(odd))) == 2


def test_likeness_groups_find_what_all_pairs_find(spark):
    rnd = random.Random(8)
    texts = []
    for g in range(6):
        base = [f"g{g}w{rnd.randrange(400)}" for _ in range(220)]
        texts.append(" ".join(base))
        for _ in range(5):
            copy = list(base)
            for _ in range(rnd.randrange(1, 4)):
                copy[rnd.randrange(220)] = f"new{rnd.random()}"
            texts.append(" ".join(copy))
    texts += ["short text", "short text", "other short", None, "", "x"]
    df = documents(spark, texts)
    got = {r["id"]: r["component_id"] for r in simhash.likeness_groups(df, prints=6).collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t or "", i)
    assert set(got) == set(first.values())
    sets = {i: simhash.shingles(texts[i] or "", 5) for i in got}
    for g in groups(sorted(got), lambda a, b: simhash.jaccard(sets[a], sets[b]) >= 0.8):
        assert {got[i] for i in g} == {min(g)}
    assert rows(simhash.likeness_groups(df.limit(0))) == []


def test_recall_as_shipped(spark):
    """Of 700 pairs of texts of 60 to 900 words at a likeness of 0.8 or more, at least 0.95 are joined, and no others."""
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randrange(2, 9))) for _ in range(3000)]
    texts = []
    while len(texts) < 1400:
        a = rnd.choices(words, [1 / (i + 3) for i in range(3000)], k=rnd.randrange(60, 900))
        b = list(a)
        for _ in range(rnd.randrange(1, 2 + len(a) // 45)):
            i = rnd.randrange(len(b))
            b[i : i + rnd.randrange(2)] = rnd.choices(words, k=rnd.randrange(2))
        s, t = " ".join(a), " ".join(b)
        if s != t and simhash.jaccard(simhash.shingles(s, 5), simhash.shingles(t, 5)) >= 0.8:
            texts += [s, t]
    got = {r["id"]: r["component_id"] for r in simhash.likeness_groups(documents(spark, texts)).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, 1400, 2)) / 700 >= 0.95
    assert all(got[i] // 2 == i // 2 for i in got)


def test_an_id_of_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    df = documents(spark, [b, a, a, b]).selectExpr("CASE WHEN doc_id = 0 THEN 5 WHEN doc_id = 1 THEN 3 ELSE 5 END AS doc_id", "text")
    got = rows(simhash.likeness_groups(df).select("id", "component_id", "first"))
    assert got == [(3, 3, True), (5, 5, True)]


@pytest.mark.parametrize("block", [simhash.BLOCK, 40])
def test_large_groups_of_edited_copies_keep_their_links(spark, block):
    rnd = random.Random(5)
    texts = []
    for g in range(2):
        base = [f"g{g}w{rnd.randrange(900)}" for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(300):
            copy = list(base)
            for _ in range(rnd.randrange(1, 7)):
                copy[rnd.randrange(300)] = f"new{rnd.random()}"
            texts.append(" ".join(copy))
    got = {r["id"]: r["component_id"] for r in simhash.likeness_groups(documents(spark, texts), block=block).collect()}
    prints = [simhash.word_prints(t, 4) for t in texts]
    sets = [simhash.shingles(t, 5) for t in texts]

    def near(a, b):
        return a // 301 == b // 301 and any(((x ^ y) & (1 << 64) - 1).bit_count() <= 3 for x, y in zip(prints[a], prints[b], strict=True)) and simhash.jaccard(sets[a], sets[b]) >= 0.8

    want = groups(range(len(texts)), near)
    assert max(map(len, want)) > 100
    for g in want:
        assert len({got[i] for i in g}) == 1
    for g in groups(range(len(texts)), lambda a, b: got[a] == got[b]):
        if len(g) > 1:  # nothing is joined that no pair at the likeness joins
            assert all(any(a != b and simhash.jaccard(sets[a], sets[b]) >= 0.8 for b in g) for a in g)


@pytest.mark.parametrize("joined", [False, True])
def test_closing_links_join_what_all_pairs_join(joined):
    rnd = random.Random(6)
    sets = [np.unique(np.array([rnd.randrange(12) for _ in range(rnd.randrange(9))], np.uint64)) for _ in range(120)]
    labels = np.array([i - i % 7 if joined else i for i in range(120)])
    got = simhash.closing_links(labels, sets, 0.8)
    near = {(a, b) for a, b in got}
    assert all(simhash.jaccard(sets[a], sets[b]) >= 0.8 for a, b in near)
    assert groups(range(120), lambda a, b: labels[a] == labels[b] or (a, b) in near or (b, a) in near) == groups(range(120), lambda a, b: labels[a] == labels[b] or simhash.jaccard(sets[a], sets[b]) >= 0.8)


def test_jaccard():
    a, b = simhash.shingles("a b c d e f g", 5), simhash.shingles("a b c d e f h", 5)
    assert len(a) == 3 and simhash.jaccard(a, b) == 2 / 4 and simhash.jaccard(a, a) == 1
    assert len(simhash.shingles("a b", 5)) == 1 and simhash.jaccard(simhash.shingles("", 5), simhash.shingles(" ", 5)) == 1
