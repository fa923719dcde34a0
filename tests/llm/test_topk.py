import random

import numpy as np
import pytest

from millrace.llm import topk
from tests.llm.helpers import rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, k=5, every=50):
    good = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in data if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(s, 1)]
    return sorted(out, key=repr)


def frame(spark, data):
    return spark.createDataFrame([(i, v, 0) for i, v in data], SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [topk.BLOCK, 3])
def test_same_as_brute_force(spark, block):
    rnd = random.Random(2)
    data = [(i, [rnd.gauss(0, 1) for _ in range(40)]) for i in range(400)]
    data[7] = (7, None)
    data[9] = (9, [float("nan")] * 40)
    data[11] = (11, [None, *[0.1] * 39])
    data[100] = (100, [float("inf")] * 40)
    data += [(1000 + i, data[150][1]) for i in range(20)]  # ties
    assert rows(topk.top_k(frame(spark, data), block=block)) == brute(data)


def test_few_and_huge(spark):
    assert rows(topk.top_k(frame(spark, [(0, [1.0, 2.0])]))) == []
    assert rows(topk.top_k(frame(spark, [(1, [1.0])]))) == []
    assert rows(topk.top_k(frame(spark, [(0, [1.0])]).limit(0))) == []
    data = [(0, [1e7, -1e7]), (3, [1e7, 1.0]), (4, [0.5, 1e7])]
    assert rows(topk.top_k(frame(spark, data))) == brute(data)
    big = [(0, [1e30, 0.0]), (1, [1e30, 0.0]), (2, [-1e30, 1.0])]
    assert rows(topk.top_k(frame(spark, big))) == [(0, 1, 1, topk.TOP), (0, 2, 2, topk.LOW)]


@pytest.mark.parametrize("partitions", [1, 3])
def test_repeated_candidate_rows_count_each(spark, partitions):
    rnd = random.Random(4)
    data = [(i, [rnd.gauss(0, 1) for _ in range(20)]) for i in range(60)]
    best = brute(data)[0][2]
    for n in (3, 5):
        more = data + n * [data[best]]
        assert rows(topk.top_k(spark.createDataFrame([(i, v, 0) for i, v in more], SCHEMA).coalesce(partitions))) == brute(more)
    small = spark.createDataFrame([(i, [1.0], 0) for i in (0, *[1] * 6, *range(2, 8))], SCHEMA).coalesce(partitions)
    assert [r[2] for r in rows(topk.top_k(small))] == [1] * 5


def test_an_id_of_several_vectors(spark):
    rnd = random.Random(9)
    data = [(i, [rnd.gauss(0, 1) for _ in range(20)]) for i in range(40)]
    more = [*data, (0, [rnd.gauss(0, 1) for _ in range(20)]), data[0]]  # two queries of one id, one of them twice
    assert rows(topk.top_k(frame(spark, more))) == brute(more[:-1])


def test_candidates_are_left_out_early():
    rng = np.random.default_rng(1)
    columns = np.round(rng.normal(size=(64, 5000)) * 20) * np.linspace(4, 0.1, 64)[:, None]
    columns = np.floor(columns)
    cuts = [0, 16, 32, 48, 64]
    rest = topk.rest_norms(columns, cuts)
    at, score, work = topk.search(columns[:, 0], rest[:, 0], 0, columns, rest, np.arange(5000), 5)
    want = np.argsort(-(columns[:, 0] @ columns)[1:], kind="stable")[:5] + 1
    assert set(want) <= set(at) and work < 0.7 * 64 * 4999
