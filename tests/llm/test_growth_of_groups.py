"""Large groups in the steps that the training-data operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from millrace.llm import simhash


def plain(pairs: list[tuple[int, int]]) -> dict[int, int]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("bound", [1 << 20, 50])
def test_a_dense_group_keeps_about_an_edge_a_node(spark, monkeypatch, bound):
    rng = np.random.default_rng(3)
    u = np.repeat(np.arange(1, 300), 20)
    pairs = [(int(a), int(b)) for a, b in zip(u, rng.random(len(u)) * u, strict=True)]
    pairs += [(-5, 7000), (7000, 6000), (6000, 1 << 40), (9, 9)] + [(i, i + 1) for i in range(8000, 8100)]
    kept, written = [], simhash.written

    def counted(df):
        out = written(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    monkeypatch.setattr(simhash, "CONTRACTED", bound)
    edges = spark.createDataFrame(pd.DataFrame(pairs, columns=["a", "b"])).repartition(3)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == plain([p for p in pairs if p[0] != p[1]])
    assert bound == 50 or kept[0] <= len(found)
