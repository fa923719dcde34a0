"""Byte-level BPE encoding and decoding with public ranks.

A text is cut by the tokenizer's pattern; each piece starts as single bytes, and the adjacent pair of lowest rank (the
leftmost of equals) is merged until no pair has a rank.  A segment tree over the byte positions of a piece keeps the
leftmost minimum: a leaf holds rank * width + position of the pair that starts there, an inner node the least of its
two children.  A merge changes three leaves (the pair itself, the pair before, the pair swallowed) and what lies above
them: logarithmic updates on live neighbours.  Trees of pieces of one width are stacked in an array and worked on
together, one merge of each piece a round.  Pieces once encoded are kept in a bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from millrace.llm.common import append_columns

CACHE = 120_000
BATCH = 128
CELLS = 1 << 18
NONE = np.int64(1) << 60


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file in order of rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without a gap")
    return [t for _, t in pairs]


class Pairs:
    """Rank of a pair of tokens, by an open-addressing hash table in arrays; -1 where the two do not merge."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.keys, self.ranks, self.bits = keys, ranks, len(keys).bit_length() - 1

    @staticmethod
    def of(tokens: list[bytes]) -> Pairs:
        rank = {t: i for i, t in enumerate(tokens)}
        found = {}
        for t in tokens:
            for i in range(1, len(t)):
                if (a := rank.get(t[:i])) is not None and (b := rank.get(t[i:])) is not None:
                    found[a << 32 | b] = rank[t]
        bits = max(8, (4 * len(found)).bit_length())
        keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        for k, r in found.items():
            at = (k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
            while keys[at] != -1:
                at = (at + 1) & ((1 << bits) - 1)
            keys[at], ranks[at] = k, r
        return Pairs(keys, ranks)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a << np.int64(32) | b
        at = ((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(k), -1, np.int64)
        left = np.arange(len(k))
        while len(left):
            held = self.keys[at]
            hit = held == k
            out[left[hit]] = self.ranks[at[hit]]
            go = ~hit & (held != -1)
            left, k, at = left[go], k[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out


class Encoder:
    """tokens by rank; pairs: made from them where they are not given, which takes about a second."""

    def __init__(self, tokens: list[bytes], pattern: str, cache: int = CACHE, pairs: Pairs | None = None):
        import regex

        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.pairs = pairs or Pairs.of(tokens)
        self.decimal = [str(i) for i in range(len(tokens))]
        self.ids = list(range(len(tokens)))  # one object for each id, which all cached pieces share
        self.cache: dict[str, tuple[int, ...]] = {}
        self.limit = cache

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The token ids of each piece; pieces are stacked by the width of their trees."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.rank.get(p)) is not None:
                out[i] = (r,)
            elif p:
                by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            step = max(1, CELLS // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._stack([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _stack(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        live = np.arange(width) < size[:, None]
        # Column `width` stands for "nothing there": its token never merges.
        token = np.full((n, width + 1), -1, np.int64)
        token[:, :width] = np.where(live, self.byte[raw], -1)
        after = np.minimum(np.arange(1, width + 2), size[:, None])
        after = np.where(after >= size[:, None], width, after)
        before = np.tile(np.arange(-1, width), (n, 1))
        before[before < 0] = width
        tree = np.full((n, 2 * width), NONE, np.int64)
        if width > 1:
            rows, cols = np.nonzero(np.arange(width - 1) < (size - 1)[:, None])
            r = self.pairs(token[rows, cols], token[rows, cols + 1])
            tree[rows, width + cols] = np.where(r >= 0, r * width + cols, NONE)
            for level in range(width.bit_length() - 2, -1, -1):
                a = 1 << level
                tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        act = np.flatnonzero(tree[:, 1] < NONE) if width > 1 else np.arange(0)
        while len(act):
            top = tree[act, 1]
            i, r = top % width, top // width
            j = after[act, i]
            k, p = after[act, j], before[act, i]
            token[act, i], token[act, j] = r, -1
            after[act, i], before[act, k] = k, i
            leaf = np.concatenate([j, i, p])
            # The pair that starts at j is gone; those that start at i and before it have new ranks.
            both = np.concatenate([act, act])
            left, right = np.concatenate([r, token[act, p]]), np.concatenate([token[act, k], r])
            known = (left >= 0) & (right >= 0)
            rank = np.full(len(both), -1, np.int64)
            rank[known] = self.pairs(left[known], right[known])
            start = np.concatenate([i, p])
            value = np.concatenate([np.full(len(act), NONE), np.where(rank >= 0, rank * width + start, NONE)])
            rows = np.concatenate([act, both])
            real = leaf < width
            rows, at, value = rows[real], leaf[real] + width, value[real]
            tree[rows, at] = value
            for _ in range(width.bit_length() - 1):
                at >>= 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            act = act[tree[act, 1] < NONE]
        rows, cols = np.nonzero(token[:, :width] >= 0)
        ids = token[rows, cols].tolist()
        ends = np.cumsum(np.bincount(rows, minlength=n)).tolist()
        ids = list(map(self.ids.__getitem__, ids))
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of whole texts; null is empty.  Pieces not yet known are merged together, once each."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.cache) > self.limit:
            self.cache = {}
        cache = self.cache
        new = [p for p in set(chain.from_iterable(cut)) if p not in cache]
        cache.update(zip(new, self.merge([p.encode() for p in new]), strict=True))
        return [list(chain.from_iterable(map(cache.__getitem__, pieces))) for pieces in cut]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str | None = None, digests: bool = True) -> DataFrame:
    """df with n_tokens, and as asked for the ids (a binary of int32) and the digests of ids and decoded bytes.

    Whole texts are encoded without special tokens, each match of the pattern on its own.  A null text counts as empty
    (0 tokens, digests of the empty string).  Other columns pass through, but for those of an output's name; repeated rows
    are encoded alike.  The vocabulary that is broadcast has a fixed size.
    """
    tokens = load_ranks(ranks)
    held = df.sparkSession.sparkContext.broadcast((tokens, Pairs.of(tokens)))
    outputs = {"n_tokens": "long"} | ({ids: "binary"} if ids else {}) | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {})
    at = [c for c in df.columns if c not in outputs].index(text)

    def factory():
        e = Encoder(held.value[0], pattern, pairs=held.value[1])  # its cache ends with the task
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def run(b):
            texts, made = b.column(at).to_pylist(), {}  # equal texts of a slice are encoded once
            some = list(dict.fromkeys(texts))
            for i in range(0, len(some), BATCH):
                for t, got in zip(some[i : i + BATCH], e.encode_batch(some[i : i + BATCH]), strict=False):
                    row = [len(got)]
                    if ids:
                        row.append(np.array(got, np.int32).tobytes())
                    if digests:
                        row += [sha(",".join(map(e.decimal.__getitem__, got)).encode()), sha(e.decode(got))]
                    made[t] = row
            return [[made[t][k] for t in texts] for k in range(len(outputs))]

        return run

    return append_columns(df, outputs, factory)
