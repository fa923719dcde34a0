"""SimHash near-duplicates through an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at least 5
positional bytes (same value at the same position).  The index holds, for each fingerprint, the postings of 14 sets of
4 positions: the planes of the affine space of 3 dimensions over 2 elements.  Any 3 positions lie in one such plane,
whose complement is a plane too, so every linked pair meets in a posting list.  In a list the shared positional bytes of
a pair are tallied; pairs that reach 5 are verified bit by bit.

No list is worked on whole when it is long: beyond LIMIT fingerprints it is split by further positions (at most 3 of 4
parts of the remaining bits can differ, so a linked pair shares one), again and again until lists are short.  The number
of bits left falls at every split, so this ends.  Lists give the links of a star for each local component, never all
pairs, and components are found by alternating large and small stars (Kiveris et al. 2014).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import append_columns, dropped, parts, slices, written

SEED = 42
LIMIT = 4096
DISTANCE = 3
PART = 1 << 15
BLOCK = 256
CONTRACTED = 1 << 20
BLOCK_BYTES = 1 << 23


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of the word shingles (repeats included), unsigned; 0 for a null text or one without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h, seed = xxhash.xxh64_intdigest, SEED
    if len(words) < width:
        return h(b" ".join(words), seed)
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        part = words[at : at + PART + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))
        got = np.fromiter((h(g, seed) for g in grams), np.uint64)
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", width: int = 3, name: str = "fp") -> DataFrame:
    """df with the fingerprint of every whole text as a signed long; other columns pass through."""
    at = [c for c in df.columns if c != name].index(text)

    def factory():
        def run(b):
            got = np.array([fingerprint(t, width) for t in b.column(at).to_pylist()], np.uint64)
            return [got.view(np.int64)]

        return run

    return append_columns(df, {name: "long"}, factory)


def planes() -> list[int]:
    """Bit masks of the 14 sets of 4 byte positions."""
    out = []
    for a in range(1, 8):
        for side in (0, 1):
            out.append(sum(0xFF << 8 * x for x in range(8) if (a & x).bit_count() % 2 == side))
    return out


def split(mask: int) -> list[int]:
    """The mask with each quarter of the bits outside it."""
    rest = [i for i in range(64) if not mask >> i & 1]
    n = len(rest)
    return [mask | sum(1 << i for i in rest[n * k // 4 : n * (k + 1) // 4]) for k in range(4)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(x: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which differences x belong to linked pairs: 8 - distance shared positional bytes at least, then the bits."""
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = shared >= 8 - distance
    ok[ok] = np.bitwise_count(x[ok]) <= distance
    return ok


def star_links(x: np.ndarray, distance: int = DISTANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For a sorted list of distinct fingerprints: links from the least of each local component to its other members."""
    out, left = [], x
    while len(left) > 1:
        root, left = left[0], left[1:]
        edge = [root]
        while edge and len(left):
            ok = linked(left ^ edge.pop(), distance)
            if ok.any():
                new = left[ok]
                out.append((np.full(len(new), root, np.uint64), new))
                edge += list(new)
                left = left[~ok]
    return out


def _link_lists(limit: int, distance: int):
    """For Arrow batches of rows sorted by (mask, key): the links of each list, and the members of lists beyond the limit.

    What a task holds is one batch and one list of at most `limit` fingerprints.
    """

    def batch_of(a: np.ndarray, b: np.ndarray, more: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), more))], names=["a", "b", "more"])

    def finer(mask: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """The members of a list that is too long, under each of the finer masks."""
        to = np.array([signed(s) for s in split(int(mask[0]) & (1 << 64) - 1)], np.int64)
        return batch_of(np.repeat(to, len(fp)), np.tile(fp, len(to)), True)

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]  # of the list that is still open
        passed = None  # the key of an open list beyond the limit, whose members have been passed on
        for batch in batches:
            new = [np.asarray(batch.column(i)) for i in range(3)]
            mask, key, fp = (np.concatenate([h, n.view(h.dtype)]) for h, n in zip(held, new, strict=True))
            if passed is not None:
                other = np.flatnonzero((mask != passed[0]) | (key != passed[1]))
                n = other[0] if len(other) else len(fp)
                if n:
                    yield finer(mask[:n], fp[:n])
                    mask, key, fp = mask[n:], key[n:], fp[n:]
                if len(fp):
                    passed = None
            if not len(fp):
                held = [x[:0] for x in (mask, key, fp)]
                continue
            starts = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
            sizes = np.diff(np.append(starts, len(fp)))
            at, n = starts[-1], sizes[-1]
            if n > limit:
                passed = (mask[at], key[at])
                yield finer(mask[at:], fp[at:])
                at = len(fp)
            held = [x[at:].copy() for x in (mask, key, fp)]
            starts, sizes = starts[:-1], sizes[:-1]
            two = starts[sizes == 2]
            ok = linked(fp[two] ^ fp[two + 1], distance)
            two = two[ok]
            yield batch_of(np.minimum(fp[two], fp[two + 1]).view(np.int64), np.maximum(fp[two], fp[two + 1]), False)
            longer = sizes > 2
            for s, n in zip(starts[longer].tolist(), sizes[longer].tolist(), strict=True):
                if n > limit:
                    yield finer(mask[s : s + n], fp[s : s + n])
                else:
                    for a, b in star_links(np.sort(fp[s : s + n]), distance):
                        yield batch_of(a.view(np.int64), b, False)
        for a, b in star_links(np.sort(held[2]), distance):
            yield batch_of(a.view(np.int64), b, False)

    return run


def links(fps: DataFrame, limit: int = LIMIT, distance: int = DISTANCE, rows: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose closure is that of all pairs within the distance.

    a is the least of its local component, as an unsigned number.  No list of more than `limit` members is compared.
    rows: about how many fingerprints there are, for the number of tasks (default: they are counted).
    """
    if limit < 16:
        raise ValueError("a list limit under 16 cannot always be reached by splitting")
    if not 0 <= distance <= 3:
        raise ValueError("the planes guarantee a shared list for 3 differing bits at most")
    masks = F.array(*(F.lit(signed(m)) for m in planes()))
    n = fps.count() if rows is None else rows
    found, todo = [], fps.select(F.explode(masks).alias("mask"), "fp")
    while True:
        lists = todo.withColumn("key", F.expr("fp & mask")).select("mask", "key", "fp").repartition(F.col("mask"), F.col("key"))
        lists = lists.sortWithinPartitions("mask", "key").coalesce(parts(14 * n, 400_000))
        got = written(lists.mapInArrow(_link_lists(limit, distance), "a long, b long, more boolean"))
        found.append(got.where(~F.col("more")).select("a", "b"))
        if not (n := got.where("more").count()):
            return reduce(DataFrame.unionAll, found).distinct()
        todo = got.where("more").select(F.col("a").alias("mask"), F.col("b").alias("fp")).distinct()


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one edge for each node but the least of each: (node, least).  Least neighbours and jumps."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(x):
        a, b = root[x], root[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (next_ := root[root])).any():
            root = next_
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs with the same components: each CONTRACTED edges of a task become stars.

    A group in which many texts share many lists has many edges a node; its stars have fewer than one.
    """

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append([np.asarray(b.column(i)) for i in (0, 1)])
            n += b.num_rows
            if n >= CONTRACTED:
                held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                if n >= CONTRACTED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["u", "v"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*map(np.concatenate, zip(*held, strict=True)))], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, a: str = "a", b: str = "b", rows: int = 1 << 40) -> DataFrame:
    """(node, root): for every node of an edge, the least node of its component.  Rounds of large and small stars.

    rows: a bound on the edges, for the number of files.  Each round keeps its edges in the shared folder; the least neighbour is pre-aggregated, so a hub's edges are never
    gathered in one task.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    now = written(contracted(edges.distinct().coalesce(parts(rows))))
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
        new = written(contracted(small.coalesce(parts(2 * state[0]))))
        dropped(now)
        now, before = new, state
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, limit: int = LIMIT, distance: int = DISTANCE) -> DataFrame:
    """One row for each row of df: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable).

    Texts of fewer than `width` words count as one shingle; null texts, and texts without words, have fingerprint zero
    and link like any other.  Equal fingerprints link.  Repeated rows give repeated rows; rows with a null doc_id are
    linked but are never a component's id (null where a component has no other).  Extra columns are not read.
    """
    docs = written(fingerprints(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), width=width).select("doc_id", "fp"))
    n = docs.count()
    least = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = components(links(least, limit, distance, n), rows=14 * n)
    grouped = least.join(root, least["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    grouped = written(grouped.coalesce(parts(n)))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(ids, "root").select("fp", "component_id")
    out = docs.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out.coalesce(parts(n))


def word_prints(text: str, prints: int) -> list[int]:
    """`prints` independent SimHashes of the set of a text's words, signed.

    Each takes the words' hashes through a mixing step of its own (multiply, shift and xor, by odd constants).
    """
    words = set(text.encode().lower().split())
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    out = []
    for k in range(prints):
        m = np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1)
        x = h * m
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        ones = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]))
    return out


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.encode().lower().split()
    grams = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def closing_links(labels: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Positions of verified pairs that, with the labels' own unions, join all pairs of these sets at `least` likeness.

    A breadth-first search: each set reached is tested against all that are not, so only pairs of sets that are joined
    already go untested.
    """
    size = np.array([len(s) for s in sets], np.int64)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(sets)), size)
    mark = np.zeros(len(code) + 1, bool)
    left, out = np.ones(len(sets), bool), []
    while left.any():
        edge = np.flatnonzero(left & (labels == labels[left.argmax()])).tolist()
        left[edge] = False
        flat = left[owner]
        rest_code, rest_owner = code[flat], owner[flat]
        while edge and left.any():
            e = edge.pop()
            own = code[ends[e] - size[e] : ends[e]]
            mark[own] = True
            both = np.bincount(rest_owner[mark[rest_code]], minlength=len(sets))
            mark[own] = False
            either = size + size[e] - both
            ok = left & (np.where(either, both / np.maximum(either, 1), 1.0) >= least)
            if ok.any():
                new = np.flatnonzero(ok)
                out += [(e, v) for v in new.tolist()]
                new = np.flatnonzero(left & np.isin(labels, labels[new]))
                left[new] = False
                edge += new.tolist()
                flat = left[rest_owner]
                rest_code, rest_owner = rest_code[flat], rest_owner[flat]
    return out


def _untested_links(pairs: DataFrame, sure: DataFrame, sets: DataFrame, least: float, n: int, block: int, block_bytes: int) -> DataFrame | None:
    """(u, v): the verified pairs that star candidates miss, or None where there can be none.

    pairs: the candidates (u, v), whose closure has every pair of the index lists; sure: those verified; sets: (id, s).
    A closed class of candidates whose members are not all joined yet is dealt into blocks of about `block` members and
    `block_bytes` bytes, and every two blocks meet in a unit, so that every pair of the class is joined or tested.
    """
    classes = written(components(pairs, "u", "v", rows=n).coalesce(parts(n))).select(F.col("node").alias("id"), F.col("root").alias("class"))
    labels = components(sure, "u", "v", rows=n).select(F.col("node").alias("id"), F.col("root").alias("label"))
    members = classes.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).join(sets.select("id", F.length("s").alias("bytes")), "id")
    members = written(members.coalesce(parts(n)))
    per = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("label").alias("l"), F.max("label").alias("m")).where("n > 2 AND l <> m")
    per = written(per.select("class", F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / block_bytes)).cast("int").alias("blocks")).coalesce(1))
    if not per.take(1):
        return None
    own = F.pmod(F.xxhash64("id", F.lit(SEED)), F.col("blocks")).cast("int")
    dealt = members.join(per, "class").select("id", "class", "label", "blocks", own.alias("own"))
    # With one block a class is one unit; else each block meets each other one, and its own pairs meet there as well.
    other = F.explode(F.expr("CASE WHEN blocks = 1 THEN array(0) ELSE filter(sequence(0, blocks - 1), x -> x <> own) END"))
    dealt = dealt.withColumn("other", other).select("id", "class", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def test(table: pa.Table) -> pa.Table:
        ids, labels = np.asarray(table.column("id").combine_chunks()), np.asarray(table.column("label").combine_chunks())
        got = closing_links(labels, [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()], least)
        a, b = (np.array([p[i] for p in got], np.int64) for i in (0, 1))
        return pa.table({"u": ids[a], "v": ids[b]})

    units = dealt.join(sets, "id").select("id", "class", "label", "i", "j", "s")
    return written(units.groupBy("class", "i", "j").applyInArrow(test, "u long, v long"))


def text_key(text: Column) -> Column:
    """What stands for a whole text where rows of one id can differ: its SHA-256; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def likeness_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, prints: int = 4, limit: int = LIMIT, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, key, component_id, first) of each distinct text: groups of texts at a shingle likeness of `least`.

    id: the text's least doc_id; key: text_key(); component_id: the group's least id; first: whether the text stands for
    its group (least id, then least key, where one id has several texts).

    Candidates are the links that the byte-position index gives for any of several fingerprints of a text's word set,
    which an edit moves less than a fingerprint of shingles; each candidate pair is verified by the exact Jaccard
    likeness of its shingle sets.  Links of an index list run to the list's least fingerprint; where such a link fails the
    test, the other pairs of its closed class of candidates are tested too, block by block, but for those joined already.
    So no two texts that a fingerprint brings together stay apart at a likeness of `least`.  Null texts count as empty;
    rows of null id are left out.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("doc").isNotNull())
    rows = rows.withColumn("key", text_key(F.col("text")))

    def factory():
        return lambda b: [[word_prints(t, prints) for t in b.column(1).to_pylist()]]

    made = append_columns(rows, {"sig": "array<long>"}, factory).select("doc", "key", "sig")
    reps = made.groupBy("key").agg(F.min("doc").alias("doc"), F.first("sig").alias("sig"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("id"), "doc", "key", "sig"))
    n, pairs = reps.count(), []
    for j in range(prints):
        own = reps.select("id", F.col("sig")[j].alias("fp"))
        first = own.groupBy("fp").agg(F.min("id").alias("first"))
        edges = links(first, limit, DISTANCE, n)
        ends = (first.select(F.col("fp").alias(x), F.col("first").alias(y)) for x, y in (("a", "u"), ("b", "v")))
        pairs.append(reduce(lambda e, side: e.join(side, side.columns[0]), ends, edges).select("u", "v"))
        pairs.append(own.join(first, "fp").where("id > first").select(F.col("first").alias("u"), F.col("id").alias("v")))
    pairs = reduce(DataFrame.unionAll, pairs).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = written(pairs.coalesce(parts(n)))

    def cut(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, width).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "s"])

    def verify(batches):
        for b in slices(batches):
            a, c = ([np.frombuffer(x, np.uint64) for x in b.column(i).to_pylist()] for i in (2, 3))
            ok = pa.array([jaccard(x, y) >= least for x, y in zip(a, c, strict=True)], pa.bool_())
            yield b.select(["u", "v"]).filter(ok)

    wanted = pairs.select(F.col("u").alias("id")).unionAll(pairs.select("v")).distinct().join(reps.select("id", "doc", "key"), "id")
    sets = rows.join(wanted, ["doc", "key"]).select("id", "text").mapInArrow(cut, "id long, s binary").dropDuplicates(["id"])
    sets = written(sets)
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("sv")), "v")
    sure = written(both.select("u", "v", "su", "sv").mapInArrow(verify, "u long, v long"))
    more = _untested_links(pairs, sure, sets, least, n, block, block_bytes)
    if more is not None:
        sure = sure.unionAll(more)
    root = components(sure, "u", "v", rows=n)
    named = reps.join(root, reps["id"] == root["node"], "left").select("doc", "key", F.coalesce("root", "id").alias("root"))
    heads = named.groupBy("root").agg(F.min(F.struct("doc", "key")).alias("head"))
    first = (F.col("doc") == F.col("head.doc")) & (F.col("key") == F.col("head.key"))
    return named.join(heads, "root").select(F.col("doc").alias("id"), "key", F.col("head.doc").alias("component_id"), first.alias("first"))
