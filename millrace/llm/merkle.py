"""Document fingerprints: a Merkle tree over sections, paragraphs, sentences and pieces.

A text is cut at blank lines into sections, at line ends into paragraphs, at ". " into sentences and every WORDS words
into pieces; cutting loses nothing, so equal roots mean equal texts.  A piece's digest is the SHA-256 of its text, that of
a branch covers its level and its children's digests.  The fingerprint is the root's digest followed by the tree: each
section and paragraph with the first SHORT hex digits of its digest, and those of each piece, in order.

Two fingerprints are compared from the top: equal roots are equal texts, branches of equal digests are taken whole and
never entered, and only what is left of the others goes on to the next level.  Where the trees begin and cease to differ
locates the edit.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import append_columns, near, slices

WORDS = 8
SHORT = 12
ROOT = 64
SEPARATORS = ("\n\n", "\n", ". ", " ")
#: What parts the sections, paragraphs and sentences of a fingerprint; a section's and a paragraph's digest ends with ":".
MARKS = ("/", ";", ",")


@dataclass(frozen=True)
class Node:
    """digest (lowercase hex); start and end in code points; children (none: a piece)."""

    digest: str
    start: int
    end: int
    children: tuple[Node, ...] = ()


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def pieces(sentence: str) -> list[str]:
    if sentence.count(" ") < WORDS:
        return [sentence]
    words = sentence.split(" ")
    return [" ".join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)]


def tree(text: str | None) -> Node:
    """The whole tree, for spans of edits in code points; a null text counts as empty."""

    def build(part: str, start: int, level: int) -> Node:
        if level == 4:
            return Node(sha(part), start, start + len(part))
        parts = pieces(part) if level == 3 else part.split(SEPARATORS[level])
        children, at = [], start
        for p in parts:
            children.append(build(p, at, level + 1))
            at += len(p) + len(SEPARATORS[level])
        return Node(sha(str(level) + "".join(c.digest for c in children)), start, start + len(part), tuple(children))

    return build(text or "", 0, 0)


def edits(a: Node, b: Node) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Spans of a and of b between the unchanged branches; [] for equal roots.  Equal digests are never entered."""
    if a.digest == b.digest:
        return []
    if not a.children or not b.children:
        return [((a.start, a.end), (b.start, b.end))]
    x, y = list(a.children), list(b.children)
    head = 0
    while head < min(len(x), len(y)) and x[head].digest == y[head].digest:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail].digest == y[-1 - tail].digest:
        tail += 1
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if len(x) == len(y):
        return [e for c, d in zip(x, y, strict=True) for e in edits(c, d)]
    at = lambda kids, node: (kids[0].start, kids[-1].end) if kids else (node.children[head].start if head < len(node.children) else node.end,) * 2
    return [(at(x, a), at(y, b))]


def fingerprint(text: str | None) -> str:
    """The root's digest and the tree, as text; the same digests as tree()'s."""
    one, top, out = hashlib.sha256, [], []
    for section in (text or "").split("\n\n"):
        paragraphs, shown = [], []
        for paragraph in section.split("\n"):
            sentences, leaves = [], []
            for sentence in paragraph.split(". "):
                got = [one(p.encode()).hexdigest() for p in pieces(sentence)]
                sentences.append(one(("3" + "".join(got)).encode()).hexdigest())
                leaves.append("".join([d[:SHORT] for d in got]))
            paragraphs.append(sha("2" + "".join(sentences)))
            shown.append(paragraphs[-1][:SHORT] + ":" + ",".join(leaves))
        top.append(sha("1" + "".join(paragraphs)))
        out.append("/" + top[-1][:SHORT] + ":" + ";".join(shown))
    return sha("0" + "".join(top)) + "".join(out)


def parted(branch: str, level: int) -> list[str]:
    """The children of a branch of a fingerprint: sections, paragraphs, sentences, pieces."""
    if level == 3:
        return [branch[i : i + SHORT] for i in range(0, len(branch), SHORT)]
    return branch[SHORT + 1 :].split(MARKS[level])


def key(branch: str, level: int) -> str:
    """What branches of a level are compared by: the digest, or a sentence's digests of pieces."""
    return branch[:SHORT] if level < 2 else branch


def n_pieces(branch: str, level: int) -> int:
    """How many pieces are below a branch, whose children are of the given level: what is left of it beside digests and marks."""
    if level == 4:
        return 1
    if level == 3:
        return len(branch) // SHORT
    n = branch.count(":") - (level == 1)  # paragraphs
    above = (SHORT + 1) * n if level == 2 else (SHORT + 1) * (n + 1) + n - 1
    return (len(branch) - above - branch.count(",")) // SHORT


def sections(print_: str) -> list[str]:
    return print_[ROOT + 1 :].split("/")


def likeness(a: str, b: str) -> float:
    """1 for equal roots; else twice the shared pieces over all pieces (Dice), under 1.

    Level by level: branches that both sides have count whole; the children of those left over are compared next.
    """
    if a[:ROOT] == b[:ROOT]:
        return 1.0
    x, y = sections(a), sections(b)
    total = sum(n_pieces(s, 1) for s in chain(x, y))
    shared = 0
    for level in range(4):
        both = Counter(key(s, level) for s in x) & Counter(key(s, level) for s in y)
        left, taken = both.copy(), []
        for s in x:
            if left[k := key(s, level)] > 0:
                left[k] -= 1
                shared += n_pieces(s, level + 1)
            else:
                taken.append(s)
        x, left, other = taken, both, []
        for s in y:
            if left[k := key(s, level)] > 0:
                left[k] -= 1
            else:
                other.append(s)
        y = other
        if not x or not y:
            break
        if level < 3:
            x, y = ([c for s in side for c in parted(s, level + 1)] for side in (x, y))
    return min(2 * shared / total, 1 - 1e-9)


def _leading(a: list[str], b: list[str], level: int, back: bool) -> int:
    """How many pieces the branches have in common from one end on; equal branches are not entered."""
    n = 0
    a, b = (list(s) if back else list(reversed(s)) for s in (a, b))  # the end is popped from
    while a and b and key(a[-1], level) == key(b[-1], level):
        n += n_pieces(a.pop(), level + 1)
        b.pop()
    if a and b and level < 3:
        # Branches of unequal digests: their children, and those that follow, which may be cut otherwise.
        a, b = ([c for s in (side if back else reversed(side)) for c in parted(s, level + 1)] for side in (a, b))
        return n + _leading(a, b, level + 1, back)
    return n


def changed(a: str, b: str) -> tuple[int, int]:
    """The pieces of a, from and to, between those that it begins and ends with as b does; (n, n) for equal roots."""
    x, y = sections(a), sections(b)
    n = sum(n_pieces(s, 1) for s in x)
    if a[:ROOT] == b[:ROOT]:
        return n, n
    most = min(n, sum(n_pieces(s, 1) for s in y))
    head = min(_leading(x, y, 0, False), most)
    return head, n - min(_leading(x, y, 0, True), most - head)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `fingerprint`; null texts count as empty, other columns pass through."""
    at = [c for c in df.columns if c != "fingerprint"].index(text)
    return append_columns(df, {"fingerprint": "string"}, lambda: lambda b: [[fingerprint(t) for t in b.column(at).to_pylist()]])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, each bucket by falling id and then the row that follows its last; a row waits for its successor."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_from", "edit_to"]
    open_, out = None, []
    done = None  # a bucket whose successor has been met
    made = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
    for b in slices(batches):
        for bucket, tail, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if tail and done == bucket:
                continue
            print_ = open_[3] if open_ is not None and open_[2] == text else fingerprint(text)
            if open_ is not None and open_[0] == bucket:
                _, own, before, its = open_
                new = edited(before, text)
                new_print = its if new == before else fingerprint(new)
                out.append((own, len(before), sha(new), its, new_print, likeness(its, new_print), likeness(its, print_), *changed(its, new_print)))
            if tail:
                open_, done = None, bucket
            else:
                open_ = (bucket, doc_id, text, print_)
        if out:
            yield made()
            out = []


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_from long, edit_to long"
LOWEST = -(1 << 63)


def edit_likeness(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against its edited text and the next document's, by falling doc_id (after the last: the first).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and edit_from and edit_to: the
    pieces of the text that the edit lies in.  Null texts count as empty; null ids come last; rows of one id follow each
    other by the MD5 of their texts; a single document follows itself.  Rows are cut into ranges of about equal size, by id
    and MD5, so that an id of many texts is spread; the first row of a range goes to the range before as well: every text
    is shuffled once, and a task holds two texts.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("k"), F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("h"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(rows.select("k", "h"), parts)
    tops = rows.select(_bucket(cuts)("k", "h").alias("b"), "k", "h").groupBy("b").agg(F.max(F.struct("k", "h")).alias("top")).collect()
    tops = {r["b"]: tuple(r["top"]) for r in tops}
    order = sorted(tops, reverse=True)
    # The row of each range's highest key also closes the range of the next higher ones; the very highest closes the lowest.
    closes = {tops[b]: order[i - 1] for i, b in enumerate(order)}
    dealt = rows.select(F.explode(_dealt(cuts, closes)("k", "h")).alias("d"), "doc_id", "text", "k", "h")
    dealt = dealt.select(F.abs("d").alias("d"), (F.col("d") < 0).alias("tail"), "doc_id", "text", "k", "h")
    spread = dealt.repartitionById(len(cuts) + 1, F.col("d") - 1) if hasattr(dealt, "repartitionById") else dealt.repartition(len(cuts) + 1, "d")
    return spread.sortWithinPartitions("d", "tail", F.desc("k"), F.desc("h"), "text").select("d", "tail", "doc_id", "text").mapInArrow(_compare, SCHEMA)


def _cuts(keys: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Where ranges of about equal size end, from a sample of about 100 keys a range, chosen by a hash."""
    n, wanted = keys.count(), 100 * parts
    sample = keys.where(near(F.col("h"), min(1.0, wanted / max(n, 1)))).groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).collect()
    found = sorted((r["k"], r["h"], r["n"]) for r in sample)
    total, seen, out = sum(n for *_, n in found), 0, []
    for k, h, n in found:
        if (seen + n) * parts // total > seen * parts // total and (k, h) != found[-1][:2]:
            out.append((k, h))
        seen += n
    return out


def _packed(k: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(k, h) as byte strings in the same order."""
    both = np.empty((len(k), 2), ">u8")
    both[:, 0] = np.asarray(k, np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    both[:, 1] = np.asarray(h, np.int64)
    return both.view("S16").ravel()


def _bucket(cuts: list[tuple[int, int]]) -> Column:
    bounds = _packed(*np.array(cuts, np.int64).reshape(-1, 2).T)

    @F.pandas_udf("int")
    def bucket(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, _packed(k.to_numpy(), h.to_numpy())).astype(np.int32))

    return bucket


def _dealt(cuts: list[tuple[int, int]], closes: dict[tuple[int, int], int]) -> Column:
    """The ranges, from 1, that a row goes to: its own, and negative the one that it closes."""

    @F.pandas_udf("array<int>")
    def dealt(k: pd.Series, h: pd.Series) -> pd.Series:
        pairs = list(zip(k.tolist(), h.tolist(), strict=True))
        return pd.Series([[bisect_left(cuts, x) + 1, -1 - closes[x]] if x in closes else [bisect_left(cuts, x) + 1] for x in pairs])

    return dealt


def edit_likeness_sql() -> str:
    """edit_likeness() as DuckDB SQL: the same trees, the likeness as the Dice count of their pieces."""
    cut = f"list_transform(range(0, (len(string_split(e, ' ')) + {WORDS - 1}) // {WORDS}), lambda i: sha256(array_to_string(string_split(e, ' ')[i * {WORDS} + 1 : i * {WORDS} + {WORDS}], ' ')))"
    level = lambda split, name, inner: f"list_transform(string_split({split}), lambda {name}: {inner})"
    # A tree is built from the pieces up: sentences (digest, pieces), paragraphs (digest, shown), sections (digest, shown).
    tree_ = level("text, chr(10) || chr(10)", "s", level("s, chr(10)", "p", level("p, '. '", "e", cut)))
    join = lambda x, mark="": f"array_to_string({x}, '{mark}')"
    short = f"left(d, {SHORT})"
    sentence = f"{{'d': sha256('3' || {join('e')}), 'v': {join(f'list_transform(e, lambda d: {short})')}}}"
    field = lambda xs, f: f"list_transform({xs}, lambda x: x.{f})"
    paragraph = f"{{'d': sha256('2' || {join(field('p', 'd'))}), 'v': {join(field('p', 'v'), ',')}}}"
    shown = lambda xs: f"list_transform({xs}, lambda x: left(x.d, {SHORT}) || ':' || x.v)"
    section = f"{{'d': sha256('1' || {join(field('s', 'd'))}), 'v': {join(shown('s'), ';')}}}"
    prints = f"""SELECT id, flatten(flatten(flatten(t))) AS leaves, sha256('0' || {join(field('x3', 'd'))}) || '/' || {join(shown('x3'), '/')} AS print FROM (
  SELECT id, t, list_transform(x2, lambda s: {section}) AS x3 FROM (
  SELECT id, t, list_transform(x1, lambda s: list_transform(s, lambda p: {paragraph})) AS x2 FROM (
  SELECT id, t, list_transform(t, lambda s: list_transform(s, lambda p: list_transform(p, lambda e: {sentence}))) AS x1 FROM (
  SELECT id, {tree_} AS t FROM texts))))"""
    like = lambda x: f"CASE WHEN a.print = {x}.print THEN 1.0 ELSE least(2.0 * coalesce({x}_shared.n, 0) / (len(a.leaves) + len({x}.leaves)), 1 - 1e-9) END"
    common = lambda x, y: f"coalesce(list_position(list_transform(range(1, least(len({x}), len({y})) + 1), lambda i: {x}[i] = {y}[i]), false) - 1, least(len({x}), len({y})))"
    shared = lambda x: f"SELECT r, sum(least(m.n, o.n)) AS n FROM pairs JOIN counts AS m ON m.id = pairs.own JOIN counts AS o ON o.id = pairs.{x} AND o.leaf = m.leaf GROUP BY r"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, '')) DESC) AS r, count(*) OVER () AS n FROM documents),
p AS (SELECT d.*, f.text AS following FROM d JOIN d AS f ON f.r = d.r % d.n + 1),
q AS (SELECT *, left(text, length(text) - length(text) // 2) || left(following, length(text) // 2) AS edited FROM p),
texts AS (SELECT 2 * r AS id, text FROM q UNION ALL SELECT 2 * r + 1, edited FROM q),
prints AS ({prints}),
counts AS (SELECT id, left(leaf, {SHORT}) AS leaf, count(*) AS n FROM (SELECT id, unnest(leaves) AS leaf FROM prints) GROUP BY ALL),
pairs AS (SELECT r, 2 * r AS own, 2 * r + 1 AS e, 2 * (r % n + 1) AS f FROM q),
e_shared AS ({shared('e')}), f_shared AS ({shared('f')}),
m AS (SELECT q.doc_id, length(q.text) AS n_chars, sha256(q.edited) AS edited_sha256, a.print AS fingerprint, e.print AS edited_fingerprint, {like('e')} AS near_edited, {like('f')} AS near_next,
  a.leaves AS x, e.leaves AS y, list_reverse(a.leaves) AS u, list_reverse(e.leaves) AS v
  FROM q JOIN pairs USING (r) JOIN prints AS a ON a.id = own JOIN prints AS e ON e.id = pairs.e JOIN prints AS f ON f.id = pairs.f LEFT JOIN e_shared USING (r) LEFT JOIN f_shared USING (r)),
h AS (SELECT *, {common('x', 'y')} AS head, {common('u', 'v')} AS back FROM m)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, fingerprint, edited_fingerprint, CAST(near_edited AS DOUBLE) AS near_edited, CAST(near_next AS DOUBLE) AS near_next,
  CAST(CASE WHEN fingerprint = edited_fingerprint THEN len(x) ELSE head END AS BIGINT) AS edit_from,
  CAST(CASE WHEN fingerprint = edited_fingerprint THEN len(x) ELSE len(x) - least(back, least(len(x), len(y)) - head) END AS BIGINT) AS edit_to FROM h"""
