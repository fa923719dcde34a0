"""Relational operators: joins, grouping, set operations, recursion, top-k, and frames that Spark's windows lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of left and right with low <= point < high, as an equi-join on cells of the given width.

    A range goes to each cell that it touches and a point to one, so a pair meets once; the shuffle is by cell, and AQE
    splits a crowded one.  Choose a width near the usual length of a range: shorter ones copy ranges to more cells.
    """
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    spread = right.where(F.col(low) < F.col(high)).withColumn("_cell", F.explode(cells))
    return left.withColumn("_cell", F.floor(F.col(point) / width)).join(spread, "_cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_cell")


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row at or before its time, by key: one shuffle, one sort, no row pairs."""
    a = left.select(F.col(by).alias("_by"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_value"))
    b = right.select(F.col(by).alias("_by"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_value"))
    w = Window.partitionBy("_by").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionAll(b).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", *(F.col(f"_last.{v}").alias(f"asof_{v}") for v in values))


#: How a peer group's value, and then a frame's, comes from values: (of rows, of peer groups).
COMBINED = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def _peers(df: DataFrame, partition: list[str], order: str, kind: str, value: str) -> DataFrame:
    """One row for each peer group (rows of one partition and order value), with its aggregate `_v`."""
    return df.groupBy(*partition, order).agg(COMBINED[kind][0](F.lit(1) if value == "*" else F.col(value)).alias("_v"))


def _back(df: DataFrame, peers: DataFrame, partition: list[str], order: str, names: list[str]) -> DataFrame:
    """df with columns of its peer groups; nulls of the keys are equal."""
    keys = [*partition, order]
    right = peers.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *names)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(right, same, "left").select(*df.columns, *names)


def groups_frame(df: DataFrame, partition: list[str], order: str, before: int, after: int, kind: str, value: str, name: str) -> DataFrame:
    """A GROUPS frame: count ("*" or a column), sum, min or max over the peer groups from `before` ahead to `after` behind.

    Rows are aggregated to peer groups before anything is sorted, so only those go through the window.
    """
    w = Window.partitionBy(*partition).orderBy(order)
    ranked = _peers(df, partition, order, kind, value)
    framed = ranked.withColumn(name, COMBINED[kind][1]("_v").over(w.rowsBetween(-before, after)))
    return _back(df, framed, partition, order, [name])


def sum_excluding(df: DataFrame, partition: list[str], order: str, value: str, names: dict[str, str]) -> DataFrame:
    """Running sums with EXCLUDE, names -> what is left out: `current row`, `group` (it and its peers) or `ties` (its peers).

    The running sums are those of peer groups, joined back to the rows.
    """
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    peers = _peers(df, partition, order, "sum", value).withColumn("_v", F.coalesce("_v", F.lit(0))).withColumn("_whole", F.sum("_v").over(w))
    out = _back(df, peers, partition, order, ["_v", "_whole"])
    own, whole, group = F.coalesce(F.col(value), F.lit(0)), F.col("_whole"), F.col("_v")
    made = {"current row": whole - own, "group": whole - group, "ties": whole - group + own}
    return out.select(*df.columns, *(made[kind].alias(name) for name, kind in names.items()))


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each partition.  Spark keeps k rows a task before the shuffle (WindowGroupLimit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def top_items(df: DataFrame, x: str, k: int | None = None, name: str = "n") -> DataFrame:
    """Each value of x (null too) with its exact count, or the k most frequent of them, equal counts by the value.

    Counts are pre-aggregated in the tasks; A.approx_top_k is the sketch of bounded memory.
    """
    found = df.groupBy(x).agg(F.count(F.lit(1)).alias(name))
    return found if k is None else found.orderBy(F.desc(name), F.asc(x)).limit(k)


def mode(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group, ties to the smallest; counted in two partial aggregations."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(name))


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]], limit: int = 1_000_000, buckets: int = 1000) -> DataFrame:
    """keys and exact percentiles of a number, names -> (`cont` or `disc`, share from 0 to 1); nulls and NaNs are left out.

    Groups of any size: where one has more than `limit` values, the bracket of each wanted rank is narrowed first, to one
    of `buckets` equal parts at a time.  A round counts the parts of the brackets (partial aggregation; the shuffle is
    groups x parts), so no task ever holds more than about `limit` different values.
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    at = {n: (F.lit(p) * (F.col("_n") - 1) if kind == "cont" else F.greatest(F.ceil(F.lit(p) * F.col("_n")) - 1, F.lit(0))) for n, (kind, p) in wanted.items()}
    ranks = F.array(*(F.struct(F.lit(n).alias("_name"), f(x).cast("long").alias("_rank")) for n, x in at.items() for f in (F.floor, F.ceil)))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    places = sizes.select(*keys, *(x.alias(f"_at_{n}") for n, x in at.items()))
    todo = sizes.select(*keys, F.explode(F.array_distinct(ranks)).alias("_r"), "_n", "_lo", "_hi").select(*keys, "_r._name", "_r._rank", F.col("_r._rank").alias("_left"), "_n", "_lo", "_hi")

    def brackets(t: DataFrame) -> tuple[DataFrame, list[str]]:
        ends = t.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_lo", "_hi").distinct()
        same = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return rows.join(ends, same), [*keys, "_lo", "_hi"]

    def pick(t: DataFrame, counted: DataFrame, by: list[str], order: str) -> DataFrame:
        """Each wanted rank's row of the counted parts, with _before: what lies under it in the bracket."""
        upto = counted.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy(order)))
        b = upto.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by)), *(c for c in upto.columns if c not in by))
        same = (F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_c"))
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
        return t.join(b, same).withColumn("_left", F.col("_left") - (F.col("_upto") - F.col("_c")))

    from millrace.plans.lineage import cut

    while (todo.where("_lo < _hi").agg(F.max("_n")).first()[0] or 0) > limit:
        inside, by = brackets(todo.where("_lo < _hi"))
        part = F.least(F.width_bucket("_x", "_lo", "_hi", F.lit(buckets)), F.lit(buckets))
        counted = inside.groupBy(*by, part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_from"), F.max("_x").alias("_to"))
        narrow = pick(todo.where("_lo < _hi"), counted, by, "_part").select(*keys, "_name", "_rank", "_left", F.col("_c").alias("_n"), F.col("_from").alias("_lo"), F.col("_to").alias("_hi"))
        todo = cut(narrow.unionAll(todo.where("_lo = _hi")))
    inside, by = brackets(todo)
    found = pick(todo, inside.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c")), by, "_x").select(*keys, "_name", "_rank", "_x")
    picked = found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "_name", "_rank"), "_x"))).alias("_m"))
    out = _joined(places, picked, keys)
    value_at = lambda n, f: F.col("_m")[F.concat(F.lit(n + "|"), f(F.col(f"_at_{n}")).cast("long").cast("string"))]
    between = lambda n: value_at(n, F.floor) + (F.col(f"_at_{n}") - F.floor(f"_at_{n}")) * (value_at(n, F.ceil) - value_at(n, F.floor))
    return out.select(*keys, *(between(n).alias(n) for n in wanted))


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with b's other columns, by keys whose nulls are equal."""
    right = b.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in b.columns if c not in keys))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return a.join(right, same).drop(*(f"_k{i}" for i in range(len(keys))))


def closure(edges: DataFrame, parent: str, child: str, root, limit: int = 1024) -> DataFrame:
    """(id, depth) of what can be reached from a root over parent-child rows, breadth first; a node counts once.

    Each round joins the newest level only, and its result is cut from its lineage; what has been seen is left out, so
    cycles end.
    """
    from millrace.plans.lineage import cut

    spark = edges.sparkSession
    e = edges.select(F.col(parent).alias("_p"), F.col(child).alias("_c")).distinct()
    seen = front = spark.range(1).select(F.lit(root).cast(edges.schema[child].dataType).alias("id"), F.lit(0).alias("depth"))
    for depth in range(1, limit):
        front = cut(front.join(e, front["id"] == e["_p"]).select(F.col("_c").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = seen.unionAll(front)
    return seen
