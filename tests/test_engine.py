"""Front ends, sources, generators and plans."""

import io
import tarfile
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import generators, relational, search, windows
from millrace.plans import frontends
from millrace.session import table
from millrace.sources import formats
from tests.oracle import FOLDER

CARS = [("A", 21.0, 6, 110), ("B", 22.8, 4, 93), ("C", 21.4, 6, 110), ("D", 18.7, 8, 175), ("E", 18.1, 6, 105), ("F", 19.2, 6, 123)]


@pytest.fixture(scope="module")
def cars(spark):
    spark.createDataFrame(CARS, "model string, mpg double, cyl int, hp int").createOrReplaceTempView("mtcars")


@pytest.mark.parametrize("text", ["from mtcars | filter cyl == 6 | select {mpg, hp} | sort {-hp, -mpg}", "dplyr( mtcars |> filter(cyl == 6) |> select(mpg, hp) |> arrange(desc(hp), desc(mpg)) )"])
def test_front_ends(spark, cars, text):
    assert [tuple(r) for r in frontends.run(spark, text).collect()] == [(19.2, 123), (21.4, 110), (21.0, 110), (18.1, 105)]


def test_visualize(spark):
    spark.createDataFrame([("apple", 3), ("pear", 1)], "label string, n int").createOrReplaceTempView("viz")
    got = [tuple(r) for r in frontends.run(spark, "VISUALIZE SELECT label, n FROM viz").collect()]
    assert got == [("apple", 3, "#" * 20), ("pear", 1, "#" * 7)]


def test_what_is_no_query(spark):
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        frontends.run(spark, "selectt 1 fromm")
    with pytest.raises(frontends.FrontEndError):
        frontends.prql("from t | frobnicate x")


def test_prices(spark):
    data = [(1, 10.0), (2, 11.0), (3, 12.0), (4, 13.0), (5, 14.0), (6, 13.0), (7, 11.0)]
    w = windows.frame([], ["t"], 3)
    got = spark.createDataFrame(data, "t int, close double").select("t", *(F.round(f("close", w), 4) for f in (windows.sma, windows.ema, windows.rsi))).orderBy("t").collect()
    assert [tuple(r)[1:] for r in got] == [(10.0, 10.0, None), (10.5, 10.6667, 100.0), (11.0, 11.25, 100.0), (12.0, 12.25, 100.0), (13.0, 13.25, 100.0), (13.3333, 13.25, 50.0), (12.6667, 12.25, 0.0)]


def test_series(spark):
    values = lambda *a: [r[0] for r in generators.generate_series(spark, *a).orderBy("value").collect()]
    assert values(1, 10) == list(range(1, 11)) and values(5, 1, -2) == [1, 3, 5] and values(3, 2) == []
    with pytest.raises(ValueError, match="step"):
        generators.generate_series(spark, 1, 2, 0)


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "p long, c long")
    assert sorted(tuple(r) for r in relational.closure(edges, "p", "c", 1).collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x, ""y"""\nbad,z\n')
    assert [tuple(r) for r in formats.csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'x, "y"'), ("bad", "z")]
    assert [tuple(r) for r in formats.typed_csv(spark, str(tmp_path / "a.csv"), "k int, v string").collect()] == [(1, 'x, "y"'), (None, "z")]
    t = pa.table({"a": [1, 2, 3], "b": ["x", None, "z"]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t, max_chunksize=2)
    with pa.OSFile(str(tmp_path / "s.arrow"), "wb") as f, pa.ipc.new_stream(f, t.schema) as w:
        w.write_table(t)
    for name in ("t.arrow", "s.arrow"):
        assert sorted(tuple(r) for r in formats.arrow(spark, str(tmp_path / name)).collect()) == [(1, "x"), (2, None), (3, "z")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.txt", "1")
        z.writestr("dir/", "")
    assert [(r["name"], r["size"], r["data"]) for r in formats.zip_entries(spark, str(tmp_path / "*.zip")).orderBy("name").collect()] == [("dir/", 0, None), ("one.txt", 1, bytearray(b"1"))]
    with tarfile.open(tmp_path / "a.tar", "w") as z:
        info = tarfile.TarInfo("f")
        info.size = 2
        z.addfile(info, io.BytesIO(b"ab"))
    assert [bytes(r["data"]) for r in formats.tar_entries(spark, str(tmp_path / "a.tar")).collect()] == [b"ab"]


def test_sinks(spark, tmp_path):
    nation = table(spark, FOLDER, "nation")
    formats.write(nation, str(tmp_path / "out"), by=["n_regionkey"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 25
    formats.bucketed(nation, "nation_b", ["n_nationkey"], 4)
    plan = spark.table("nation_b").alias("a").join(spark.table("nation_b").alias("b"), "n_nationkey").hint("merge")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    spark.sql("DROP TABLE nation_b")


@pytest.mark.parametrize(("mode", "text"), [("list", "1|\n2|b"), ("csv", "k,v\n1,\n2,b"), ("json", '[{"k": 1, "v": null}, {"k": 2, "v": "b"}]'), ("markdown", "| k | v |\n| - | - |\n| 1 |   |\n| 2 | b |"), ("line", "k = 1\nv = \n\nk = 2\nv = b")])
def test_shown(spark, mode, text):
    assert formats.shown(spark.createDataFrame([(1, None), (2, "b")], "k int, v string"), mode) == text


def test_profile(spark):
    got = {r["column"]: r for r in formats.profile(table(spark, FOLDER, "nation")).collect()}
    assert got["n_regionkey"]["distinct"] == 5 and got["n_name"]["nulls"] == 0
    assert formats.schema_sql(table(spark, FOLDER, "region"), "r") == "CREATE TABLE r (r_regionkey INT, r_name STRING)"


def test_filters_and_columns_reach_the_scan(spark):
    df = table(spark, FOLDER, "orders").where("o_orderkey > 100").select("o_totalprice")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,100)]" in plan and "o_comment" not in plan and "o_custkey" not in plan


def test_index_search_finds_most_neighbours(spark):
    e = table(spark, FOLDER, "embeddings")
    indexed, centres = search.ivf(e, 12)
    indexed = indexed.cache()
    hits = total = 0
    for q in e.where("vec_id % 100 = 0").collect():
        exact = {r[0] for r in search.ivf_search(indexed, centres, q["embedding"], 5, 12).collect()}
        hits += len(exact & {r[0] for r in search.ivf_search(indexed, centres, q["embedding"], 5, 8).collect()})
        total += 5
    assert hits / total >= 0.9


def test_commands(spark, tmp_path):
    from millrace.plans import commands

    commands.define(spark, "plus_two", "x BIGINT", "BIGINT", "x + 2")
    assert commands.evaluate(spark, "SELECT plus_two(id) FROM range(3)", ",") == "2,3,4"
    commands.define_drop(spark, "plus_two")
    got = commands.numbered(spark.range(100).repartition(7), "n").collect()
    assert sorted(r["n"] for r in got) == list(range(1, 101))
    spark.range(3).createOrReplaceTempView("three")
    commands.dump(spark, ["three"], str(tmp_path))
    commands.restore(spark, ["three"], str(tmp_path))
    assert spark.table("three").count() == 3 and "Scan parquet" in commands.explain(spark.table("three"))


def test_sketch_functions(spark):
    from millrace.functions.registry import sql

    got = sql(spark, "SELECT bloom_might_contain(f, 'x') AS a, bloom_might_contain(f, 'y') AS b, bloom_count(f) AS n, bloom_size_bits(f) AS m FROM (SELECT bloom_add(bloom_create(100L, 0.01), 'x') AS f)").first()
    assert tuple(got) == (1, 0, 1, 959)
    assert sql(spark, "SELECT hll_cardinality(hll_merge(hll_sketch_agg(id, 14), hll_sketch_agg(id + 500, 14))) AS n FROM range(1000)").first()["n"] == pytest.approx(1500, rel=0.05)
    from millrace.operators import aggregates

    sketch = spark.range(1001).agg(aggregates.kll("id").alias("s"))
    assert sketch.select(aggregates.kll_quantile("s", 0.5).alias("q")).first()["q"] == pytest.approx(500, abs=20)


def test_phonetics():
    from millrace.functions.phonetics import caverphone, metaphone, select, uuid7

    assert metaphone("Thompson") == "0MSN" or metaphone("Thompson") == "0MPSN"
    assert metaphone("Smith") == "SM0" and metaphone("Knight") == "NT"
    assert caverphone("") == "1111111111" and caverphone("Thompson") == "TMPSN11111"
    assert select("<p class='a b'>one <b>two</b></p><p>x</p>", "p.b").found == [["one ", "two"]]
    assert len(uuid7()) == 36 and uuid7()[14] == "7"
