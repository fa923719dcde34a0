"""Operators whose results must not depend on layouts, group sizes or triggers, against brute force."""

import math
import os
import pathlib
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import relational, search
from millrace.plans import lineage
from millrace.session import table
from millrace.streaming import events as E
from tests.oracle import FOLDER


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The events in 20 files that are out of time order, so that a stream over them takes several triggers."""
    at = str(tmp_path_factory.mktemp("events"))
    table(spark, FOLDER, "events").repartition(20, F.rand(3)).write.mode("overwrite").parquet(at)
    return at


def drained(make, spark, files, tmp_path, mode, keys=None):
    got = E.drain(make(E.source(spark, files, 3, "part*.parquet")), mode, f"{tmp_path}/drained", keys)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_totals_over_many_triggers(spark, files, tmp_path):
    want = table(spark, FOLDER, "events").groupBy("user_id").agg(F.min(F.col("ts").cast("timestamp")).alias("f"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("t"))
    got = drained(E.running_totals, spark, files, tmp_path, "update", ["user_id"])
    same = lambda r: (r[0], r[1], r[2], round(r[3], 3))
    assert sorted(map(same, got), key=repr) == sorted((same(tuple(r)) for r in want.collect()), key=repr)


def test_windows_over_many_triggers(spark, files, tmp_path):
    late = "3650 days"
    static = table(spark, FOLDER, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for i, make in enumerate((lambda e: E.tumbling(e, late=late).drop("total"), lambda e: E.sliding(e, late=late), lambda e: E.sessions(e, late=late))):
        want = sorted((tuple(r) for r in make(static).collect()), key=repr)
        assert drained(make, spark, files, f"{tmp_path}/{i}", "complete") == want
    assert len(drained(lambda e: E.deduplicated(e, late), spark, files, f"{tmp_path}/d", "append")) == static.count()


def test_idle_users_are_forgotten(spark, tmp_path):
    names = ("event_id", "ts", "user_id", "event_type", "value", "props")
    os.makedirs(f"{tmp_path}/all")
    for k, (user, day) in enumerate([(1, 1), (2, 2), (2, 9), (2, 10), (1, 12)]):
        row = spark.sql(f"SELECT {k}L, timestamp_ntz'2024-01-{day:02d} 00:00:00', {user}L, 'x', 1.0D, '{{}}'").toDF(*names)
        row.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        (file,) = pathlib.Path(f"{tmp_path}/in/{k}").glob("*.parquet")
        shutil.move(file, f"{tmp_path}/all/{k}.parquet")
        os.utime(f"{tmp_path}/all/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    totals = E.running_totals(E.source(spark, f"{tmp_path}/all", 1, "*.parquet"), idle="3 days")
    got = E.drain(totals, "update", f"{tmp_path}/one", ["user_id", "first_ts"]).collect()
    periods = sorted((r["user_id"], str(r["first_ts"])[:10], r["n"]) for r in got)
    assert (1, "2024-01-12", 1) in periods and (1, "2024-01-01", 1) in periods and sum(n for *_, n in periods) == 5


def test_percentiles_of_groups_of_any_size(spark):
    rnd = random.Random(7)
    data = [("a", rnd.choice([rnd.gauss(0, 1), 3.0, rnd.gauss(0, 1e9)])) for _ in range(3000)] + [("b", 1.5)] * 500 + [("c", 7.0), (None, 1.0), (None, 2.0), ("d", None), ("c", float("nan"))]
    df = spark.createDataFrame(data, "k string, x double").repartition(3)
    groups = {}
    for k, x in data:
        if x is not None and not math.isnan(x):
            groups.setdefault(k, []).append(x)
    wanted = {"p0": ("cont", 0.0), "p37": ("cont", 0.37), "mid": ("cont", 0.5), "d9": ("disc", 0.9), "d0": ("disc", 0.0), "p1": ("cont", 1.0)}
    for limit in (1_000_000, 20):
        got = {r["k"]: r for r in relational.percentiles(df, ["k"], "x", wanted, limit=limit, buckets=10).collect()}
        assert set(got) == set(groups)
        for k, xs in groups.items():
            xs = sorted(xs)
            for name, (kind, p) in wanted.items():
                h = p * (len(xs) - 1)
                want = xs[math.floor(h)] + (h - math.floor(h)) * (xs[math.ceil(h)] - xs[math.floor(h)]) if kind == "cont" else xs[max(0, math.ceil(p * len(xs)) - 1)]
                assert got[k][name] == pytest.approx(want, rel=1e-12), (k, name)
    assert relational.percentiles(df.limit(0), ["k"], "x", wanted).count() == 0


def test_frames_of_peer_groups_with_nulls(spark):
    data = [("a", 1, 5), ("a", 1, None), ("a", 2, 7), ("a", None, 2), ("a", None, 3), (None, 1, 1), (None, 2, 4), ("b", 3, None)]
    df = spark.createDataFrame(data, "p string, o int, v int")
    got = relational.groups_frame(df, ["p"], "o", 1, 0, "count", "*", "n").collect()
    assert sorted((tuple(r)[:3] + (r["n"],) for r in got), key=repr) == sorted([("a", 1, 5, 4), ("a", 1, None, 4), ("a", 2, 7, 3), ("a", None, 2, 2), ("a", None, 3, 2), (None, 1, 1, 1), (None, 2, 4, 2), ("b", 3, None, 1)], key=repr)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in relational.sum_excluding(df, ["p"], "o", "v", {"c": "current row", "g": "group", "t": "ties"}).collect()}
    assert got["a", 2, 7] == (10, 10, 17) and got["a", 1, 5] == (5, 5, 10) and got["a", None, 3] == (2, 0, 3) and got["b", 3, None] == (0, 0, 0)


@pytest.mark.parametrize("metric", ["cosine", "l2", "l1"])
@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_rows(spark, metric, block):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 12)).round(1)
    v[40:60] = v[10]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["distance"]) for r in search.knn(df.where("vec_id % 20 = 0"), df, 5, metric, block=block).collect()}
    for q in range(0, 300, 20):
        d = {"l1": np.abs(v - v[q]).sum(1), "l2": np.sqrt(((v - v[q]) ** 2).sum(1)), "cosine": 1 - v @ v[q] / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]))}[metric]
        best = sorted((round(float(d[i]), 9) + 0.0, i) for i in range(300) if i != q)[:5]
        assert [got[q, n][0] for n in range(1, 6)] == [i for _, i in best]
    plan = search.knn(df.limit(3), df, 5, metric)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lsh_recall(spark):
    e = table(spark, FOLDER, "embeddings").select("vec_id", "embedding")
    width = len(e.first()["embedding"])
    q = e.where("vec_id % 50 = 0")
    exact = {(r["query_id"], r["vec_id"]) for r in search.knn(q, e, 5).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in search.lsh_search(search.lsh(e, width, 64, 5), q, width, 5, 64, 5).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_scratch_is_shared(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        sparkContext = Context()
        conf = spark.conf

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError, match="checkpoint"):
            lineage.scratch_dir(Session())
