"""Planar geometry against known values and a plain point-in-polygon."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import spatial
from millrace.functions.registry import sql

HOLED = "POLYGON((0 0,10 0,10 10,0 10,0 0),(2 2,2 4,4 4,4 2,2 2))"
TWO = "MULTIPOLYGON(((0 0,2 0,2 2,0 2,0 0)),((5 5,8 5,8 9,5 9,5 5)))"


def g(wkt):
    return f"st_geomfromtext('{wkt}')"


CASES = [
    (f"st_area({g(HOLED)})", 96.0),
    (f"st_perimeter({g(HOLED)})", 48.0),
    (f"st_nrings({g(HOLED)})", 2),
    (f"st_numinteriorrings({g(HOLED)})", 1),
    (f"st_area({g(TWO)})", 16.0),
    (f"st_numgeometries({g(TWO)})", 2),
    (f"st_astext({g(TWO)})", TWO),
    (f"st_astext({g(HOLED)})", HOLED),
    (f"st_astext(st_geomfromgeojson(st_asgeojson({g(TWO)})))", TWO),
    (f"st_astext(st_geomfromgeojson(st_asgeojson({g(HOLED)})))", HOLED),
    (f"st_astext(st_geometryn({g(TWO)}, 2))", "POLYGON((5 5,8 5,8 9,5 9,5 5))"),
    (f"st_astext(st_interiorringn({g(HOLED)}, 1))", "LINESTRING(2 2,2 4,4 4,4 2,2 2)"),
    (f"st_astext({g('MULTIPOINT((1 2),(3 4))')})", "MULTIPOINT(1 2,3 4)"),
    (f"st_astext(st_centroid({g('LINESTRING(0 0,4 0,4 2)')}))", "POINT(2.6666666666666665 0.3333333333333333)"),
    (f"st_length({g('MULTILINESTRING((0 0,3 4),(0 0,0 2))')})", 7.0),
    (f"st_contains({g(HOLED)}, st_makepoint(3, 3))", False),
    (f"st_contains({g(HOLED)}, st_makepoint(5, 5))", True),
    (f"st_contains({g(HOLED)}, st_makepoint(10, 5))", False),
    (f"st_covers({g(HOLED)}, st_makepoint(10, 5))", True),
    (f"st_intersects({g(HOLED)}, {g('LINESTRING(-5 5,15 5)')})", True),
    (f"st_intersects({g(HOLED)}, st_makeenvelope(2.5, 2.5, 3.5, 3.5))", False),
    (f"st_distance({g(HOLED)}, st_makepoint(3, 3))", 1.0),
    (f"st_distance({g('LINESTRING(0 0,10 0)')}, {g('LINESTRING(5 3,5 9)')})", 3.0),
    (f"st_within(st_makeenvelope(5, 5, 6, 6), {g(HOLED)})", True),
    (f"st_within(st_makeenvelope(1, 1, 6, 6), {g(HOLED)})", False),
    (f"st_isclosed({g('LINESTRING(0 0,1 1,0 0)')})", True),
    (f"st_astext(st_boundary({g(HOLED)}))", "MULTILINESTRING((0 0,10 0,10 10,0 10,0 0),(2 2,2 4,4 4,4 2,2 2))"),
    (f"st_astext(st_removerepeatedpoints({g('LINESTRING(0 0,0 0,1 1,1 1,0 0)')}))", "LINESTRING(0 0,1 1,0 0)"),
    ("st_geomfromtext('nonsense') IS NULL", True),
    ("st_area(st_geomfromtext(NULL)) IS NULL", True),
]


def test_known_values(spark):
    got = sql(spark, "SELECT " + ", ".join(f"{c} AS v{i}" for i, (c, _) in enumerate(CASES))).first()
    assert [(c, v) for (c, _), v in zip(CASES, got, strict=True)] == [(c, pytest.approx(w) if isinstance(w, float) else w) for c, w in CASES]


def test_points_in_a_polygon(spark):
    rnd = random.Random(2)
    ring = [(math.cos(a) * r, math.sin(a) * r) for a, r in ((2 * math.pi * i / 12, rnd.uniform(2, 9)) for i in range(12))]
    wkt = "POLYGON((" + ",".join(f"{x} {y}" for x, y in [*ring, ring[0]]) + "))"

    def inside(px, py):
        turns = 0.0
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            turns += math.atan2((ax - px) * (by - py) - (ay - py) * (bx - px), (ax - px) * (bx - px) + (ay - py) * (by - py))
        return abs(turns) > math.pi

    points = [(rnd.uniform(-10, 10), rnd.uniform(-10, 10)) for _ in range(300)]
    spark.createDataFrame(points, "x double, y double").createOrReplaceTempView("some_points")
    got = sql(spark, f"SELECT x, y, st_contains({g(wkt)}, st_makepoint(x, y)) AS c FROM some_points").collect()
    assert all(r["c"] == inside(r["x"], r["y"]) for r in got)


def test_aggregates(spark):
    df = sql(spark, "SELECT id % 2 AS k, id AS o, st_makepoint(id, id * id) AS g FROM range(6)")
    df.groupBy("k").agg(spatial.extent("g").alias("e"), spatial.collected("g").alias("c"), spatial.line_of("g", "o").alias("l")).createOrReplaceTempView("grouped_points")
    got = {r["k"]: r for r in sql(spark, "SELECT k, e, st_npoints(c) AS n, st_geometrytype(c) AS t, st_astext(l) AS l FROM grouped_points").collect()}
    assert tuple(got[1]["e"]) == (1.0, 1.0, 5.0, 25.0) and got[1]["n"] == 3 and got[1]["t"] == "ST_MultiPoint" and got[0]["l"] == "LINESTRING(0 0,2 4,4 16)"


def test_plans_stay_in_the_jvm(spark):
    plan = sql(spark, f"SELECT st_area({g(HOLED)}) + id AS a FROM range(3)")._jdf.queryExecution().toString()
    assert "Python" not in plan and F is not None
