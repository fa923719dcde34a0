"""Smaller functions of several families: districts, key derivation, code challenges, rank tests, hashes and line simplification."""

from __future__ import annotations

import hashlib
import heapq
import hmac
import json
import math

import numpy as np

from millrace.functions.geo import simplify
from millrace.functions.registry import kernel, parse

EXPRESSIONS = parse("more", r"""
aba_fed_region(s STRING) STRING = get(array('Boston', 'New York', 'Philadelphia', 'Cleveland', 'Richmond', 'Atlanta', 'Chicago', 'St. Louis', 'Minneapolis', 'Kansas City', 'Dallas', 'San Francisco'), aba_frb_district(s) - 1)
pkce_challenge_s256(v STRING) STRING = rtrim('=', translate(base64(unhex(sha2(v, 256))), '+/', '-_'))
pkce_challenge_plain(v STRING) STRING = v
pkce_verifier(n INT DEFAULT 32) STRING = if(n BETWEEN 32 AND 96, left(translate(replace(base64(unhex(concat(sha2(uuid(), 512), sha2(uuid(), 512)))), '=', ''), '+/', '-_'), CAST(ceil(n * 4 / 3D) AS INT)), NULL)
aead_random_key_256() BINARY = unhex(sha2(concat(uuid(), uuid()), 256))
aead_random_nonce_96() BINARY = unhex(left(sha2(concat(uuid(), uuid()), 256), 24))
""")


def guarded(f):
    """Null for text that is not what the function works on."""

    def run(*args):
        try:
            return f(*args)
        except (ValueError, TypeError, IndexError, KeyError, ArithmeticError):
            return None

    return run


def compact(x) -> str:
    return json.dumps(x, separators=(",", ":"))


def numbers(text: str) -> np.ndarray:
    x = np.array(json.loads(text), float)
    if x.ndim != 1 or not len(x):
        raise ValueError("no list of numbers")
    return x


def mann_whitney(a: str, b: str) -> str:
    """The smaller U, with a two-sided p from the normal approximation (ties counted, continuity corrected)."""
    x, y = numbers(a), numbers(b)
    both = np.concatenate([x, y])
    values, at, n = np.unique(both, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[at]
    u = ranks[: len(x)].sum() - len(x) * (len(x) + 1) / 2
    u = min(u, len(x) * len(y) - u)
    total = len(both)
    spread = math.sqrt(len(x) * len(y) / 12 * (total + 1 - ((n**3 - n).sum()) / (total * (total - 1))))
    z = max(0.0, len(x) * len(y) / 2 - u - 0.5) / spread
    return compact({"U": int(u) if u == int(u) else float(u), "p": math.erfc(z / math.sqrt(2))})


def ks_2samp(a: str, b: str) -> str:
    """The largest distance of the two distribution functions, with the asymptotic p (Smirnov)."""
    x, y = np.sort(numbers(a)), np.sort(numbers(b))
    both = np.concatenate([x, y])
    d = float(np.abs(np.searchsorted(x, both, side="right") / len(x) - np.searchsorted(y, both, side="right") / len(y)).max())
    n = math.sqrt(len(x) * len(y) / (len(x) + len(y)))
    t = (n + 0.12 + 0.11 / n) * d
    p = 1.0 if t < 0.2 else 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))
    return compact({"D": int(d) if d == int(d) else d, "p": min(1.0, max(0.0, p)) if d else 1})


def visvalingam(text: str, least: float) -> str:
    """A line without the points whose triangle with their neighbours is smaller than `least`, the smallest first."""
    p = [[float(x), float(y)] for x, y in json.loads(text)]
    before, after = list(range(-1, len(p) - 1)), list(range(1, len(p) + 1))

    def area(i):
        (ax, ay), (bx, by), (cx, cy) = p[before[i]], p[i], p[after[i]]
        return abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2

    held = {i: area(i) for i in range(1, len(p) - 1)}
    heap = [(a, i) for i, a in held.items()]
    heapq.heapify(heap)
    while heap:
        a, i = heapq.heappop(heap)
        if held.get(i) != a:
            continue
        if a >= least:
            break
        del held[i]
        b, c = before[i], after[i]
        after[b], before[c] = c, b
        for k in (b, c):
            if k in held:
                held[k] = area(k)
                heapq.heappush(heap, (held[k], k))
    return compact([q for i, q in enumerate(p) if i in held or i in (0, len(p) - 1)])


def douglas_peucker(text: str, tolerance: float) -> str:
    p = [[float(x), float(y)] for x, y in json.loads(text)]
    return simplify(compact(p), tolerance) if p else "[]"


def murmur3_32(data, seed: int = 0) -> int:
    """MurmurHash3 of 32 bits, unsigned."""
    b = data.encode() if isinstance(data, str) else bytes(data)
    mask, h = (1 << 32) - 1, seed & (1 << 32) - 1
    turn = lambda x, r: (x << r | x >> 32 - r) & mask
    mixed = lambda k: turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    whole = len(b) - len(b) % 4
    for i in range(0, whole, 4):
        h = turn(h ^ mixed(int.from_bytes(b[i : i + 4], "little")), 13) * 5 + 0xE6546B64 & mask
    if whole < len(b):
        h ^= mixed(int.from_bytes(b[whole:], "little"))
    h ^= len(b)
    for r, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> r) * m & mask
    return h


def extract(ikm, salt, algorithm: str) -> bytes:
    """The first step of RFC 5869."""
    ikm, salt = (x.encode() if isinstance(x, str) else bytes(x or b"") for x in (ikm, salt))
    return hmac.new(salt or bytes(hashlib.new(algorithm).digest_size), ikm, algorithm).digest()


def expand(prk, info, length: int, algorithm: str) -> bytes | None:
    """The second step of RFC 5869."""
    size = hashlib.new(algorithm).digest_size
    prk, info = (x.encode() if isinstance(x, str) else bytes(x or b"") for x in (prk, info))
    if length is None or not 0 < length <= 255 * size or len(prk) < size:
        return None
    out = block = b""
    for i in range(1, -(-length // size) + 1):
        block = hmac.new(prk, block + info + bytes([i]), algorithm).digest()
        out += block
    return out[:length]


KERNELS = [
    *(kernel("more", f"hkdf_{a}_extract", "binary", lambda k, s, a=a: None if k is None else extract(k, s, a), nulls=True) for a in ("sha256", "sha512")),
    *(kernel("more", f"hkdf_{a}_expand", "binary", lambda k, i, n, a=a: None if k is None else expand(k, i, n, a), nulls=True) for a in ("sha256", "sha512")),
    kernel("more", "mann_whitney", "string", guarded(mann_whitney)),
    kernel("more", "ks_2samp", "string", guarded(ks_2samp)),
    kernel("more", "polyline_simplify_dp", "string", guarded(lambda s, e: douglas_peucker(s, float(e)))),
    kernel("more", "polyline_simplify_vw", "string", guarded(lambda s, e: visvalingam(s, float(e)))),
    kernel("more", "murmur3_32", "long", murmur3_32),
    kernel("more", "gamma", "double", guarded(math.gamma)),
    kernel("more", "lgamma", "double", guarded(math.lgamma)),
    kernel("more", "nextafter", "double", lambda x, y: math.nextafter(float(x), float(y))),
]

FUNCTIONS = [*EXPRESSIONS, *KERNELS]
