"""Sketch functions: Bloom filters as kernels, cardinality, quantile and set-likeness sketches over Spark's own."""

from __future__ import annotations

import hashlib
import math
import struct

from millrace.functions.registry import kernel, parse

SPARK = parse("sketch", """
hll_cardinality(s BINARY) BIGINT = hll_sketch_estimate(s)
hll_merge(a BINARY, b BINARY) BINARY = hll_union(a, b, true)
t_digest_count(s BINARY) BIGINT = kll_sketch_get_n_double(s)
minhash_merge(a ARRAY<BIGINT>, b ARRAY<BIGINT>) ARRAY<BIGINT> = zip_with(a, b, (x, y) -> least(x, y))
bloom_count(f BINARY) BIGINT = CAST(conv(hex(substring(f, 9, 8)), 16, 10) AS BIGINT)
bloom_size_bits(f BINARY) BIGINT = CAST(conv(hex(substring(f, 1, 4)), 16, 10) AS BIGINT)
""")

HEADER = struct.Struct(">IIQ")  # bits, probes, insertions


def bloom_create(items: int, rate: float) -> bytes:
    m = max(8, math.ceil(-items * math.log(rate) / math.log(2) ** 2))
    return HEADER.pack(m, max(1, round(m / max(items, 1) * math.log(2))), 0) + bytes(-(-m // 8))


def probes(value, m: int, k: int) -> list[int]:
    """Double hashing: h1 + i h2."""
    d = hashlib.blake2b(str(value).encode(), digest_size=16).digest()
    a, b = int.from_bytes(d[:8], "big"), int.from_bytes(d[8:], "big") | 1
    return [(a + i * b) % m for i in range(k)]


def bloom_add(f: bytes, value) -> bytes:
    m, k, n = HEADER.unpack_from(f)
    bits = bytearray(f[HEADER.size :])
    for p in probes(value, m, k):
        bits[p >> 3] |= 1 << (p & 7)
    return HEADER.pack(m, k, n + 1) + bytes(bits)


def bloom_might_contain(f: bytes, value) -> int:
    m, k, _ = HEADER.unpack_from(f)
    return int(all(f[HEADER.size + (p >> 3)] >> (p & 7) & 1 for p in probes(value, m, k)))


FUNCTIONS = [*SPARK, kernel("sketch", "bloom_create", "binary", bloom_create), kernel("sketch", "bloom_add", "binary", bloom_add), kernel("sketch", "bloom_might_contain", "long", bloom_might_contain)]
