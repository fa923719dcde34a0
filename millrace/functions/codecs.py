"""Hashes, encodings and escapes."""

from __future__ import annotations

import base64
import binascii
import bz2
import gzip
import hashlib
import hmac
import html
import shlex
import zlib

from millrace.functions.registry import kernel, parse

BUILT_IN = parse("codec", r"""
sha1 = builtin ;; sha1(c_name) ;; sha1(c_name)
sha256(s STRING) STRING = sha2(s, 256) ;; sha256(c_name) ;; sha256(c_name)
sha224(s STRING) STRING = sha2(s, 224)
sha384(s STRING) STRING = sha2(s, 384)
sha512(s STRING) STRING = sha2(s, 512)
md5 = builtin ;; md5(c_name) ;; md5(c_name)
crc32 = builtin
hex = builtin ;; hex(c_name) ;; hex(c_name)
unhex = builtin ;; string(unhex(hex(c_name))) ;; c_name
base64_encode(b BINARY) STRING = base64(b) ;; base64_encode(binary(c_name)) ;; base64(encode(c_name))
base64_decode(s STRING) BINARY = unbase64(s) ;; string(base64_decode(base64(binary(c_name)))) ;; c_name
escape_url(s STRING) STRING = replace(url_encode(s), '+', '%20') ;; escape_url(c_name) ;; url_encode(c_name)
url_decode = builtin ;; url_decode(url_encode(c_name)) ;; c_name
html_escape(s STRING) STRING = replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\'', '&#39;') ;; html_escape(concat(c_name, '<&>')) ;; c_name || '&lt;&amp;&gt;'
html_encode_entities(s STRING) STRING = html_escape(s)
sql_quote(s STRING) STRING = concat('\'', replace(s, '\'', '\'\''), '\'') ;; sql_quote(c_name) ;; '''' || c_name || ''''
aes_gcm_seal(k BINARY, p BINARY, n BINARY, a BINARY) BINARY = substring(aes_encrypt(p, k, 'GCM', 'DEFAULT', n, a), 13)
aes_gcm_open(k BINARY, c BINARY, n BINARY, a BINARY) BINARY = try_aes_decrypt(concat(n, c), k, 'GCM', 'DEFAULT', a)
aes_cbc_seal(k BINARY, iv BINARY, p BINARY) BINARY = substring(aes_encrypt(p, k, 'CBC', 'PKCS', iv), 17)
aes_cbc_open(k BINARY, iv BINARY, c BINARY) BINARY = try_aes_decrypt(concat(iv, c), k, 'CBC', 'PKCS')
morse_letter(c STRING) STRING = element_at(split('.- -... -.-. -.. . ..-. --. .... .. .--- -.- .-.. -- -. --- .--. --.- .-. ... - ..- ...- .-- -..- -.-- --.. ----- .---- ..--- ...-- ....- ..... -.... --... ---.. ----.', ' '), instr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', c))
morse_encode(s STRING) STRING = array_join(transform(filter(split(upper(s), ''), c -> c RLIKE '[A-Z0-9 ]'), c -> if(c = ' ', '/', split('.- -... -.-. -.. . ..-. --. .... .. .--- -.- .-.. -- -. --- .--. --.- .-. ... - ..- ...- .-- -..- -.-- --.. ----- .---- ..--- ...-- ....- ..... -.... --... ---.. ----.', ' ')[instr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', c) - 1])), ' ')
morse_decode(s STRING) STRING = array_join(transform(split(trim(s), ' +'), w -> if(w = '/', ' ', substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', int(array_position(split('.- -... -.-. -.. . ..-. --. .... .. .--- -.- .-.. -- -. --- .--. --.- .-. ... - ..- ...- .-- -..- -.-- --.. ----- .---- ..--- ...-- ....- ..... -.... --... ---.. ----.', ' '), w)), 1))), '')
color_channel(s STRING, i INT) INT = int(conv(substr(ltrim('#', s), 2 * i - 1, 2), 16, 10))
color_red(s STRING) INT = color_channel(s, 1)
color_green(s STRING) INT = color_channel(s, 2)
color_blue(s STRING) INT = color_channel(s, 3)
color_rgb_to_hex(r INT, g INT, b INT) STRING = concat('#', lower(lpad(hex(r), 2, '0')), lower(lpad(hex(g), 2, '0')), lower(lpad(hex(b), 2, '0'))) ;; color_rgb_to_hex(int(c_custkey % 256), 0, 255) ;; '#' || lower(lpad(to_hex(c_custkey % 256), 2, '0')) || '00ff'
color_hex_to_rgb(s STRING) STRING = concat('[', color_red(s), ',', color_green(s), ',', color_blue(s), ']')
color_to_rgb(s STRING) STRING = concat('rgb(', color_red(s), ', ', color_green(s), ', ', color_blue(s), ')')
color_invert(s STRING) STRING = color_rgb_to_hex(255 - color_red(s), 255 - color_green(s), 255 - color_blue(s))
color_linear(c INT) DOUBLE = if(c / 255D <= 0.03928D, c / 255D / 12.92D, pow((c / 255D + 0.055D) / 1.055D, 2.4D))
color_luminance(s STRING) DOUBLE = 0.2126D * color_linear(color_red(s)) + 0.7152D * color_linear(color_green(s)) + 0.0722D * color_linear(color_blue(s))
color_contrast_ratio(a STRING, b STRING) DOUBLE = (greatest(color_luminance(a), color_luminance(b)) + 0.05D) / (least(color_luminance(a), color_luminance(b)) + 0.05D)
""")

BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def raw(x) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def base58_encode(x) -> str:
    b = raw(x)
    n, out = int.from_bytes(b, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return "1" * (len(b) - len(b.lstrip(b"\0"))) + out


def base58_decode(s: str) -> bytes | None:
    n = 0
    for c in s:
        if c not in BASE58:
            return None
        n = n * 58 + BASE58.index(c)
    return b"\0" * (len(s) - len(s.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def base32_decode(s: str) -> bytes | None:
    try:
        return base64.b32decode(s.upper() + "=" * (-len(s) % 8))
    except binascii.Error:
        return None


def crc(data: bytes, width: int, poly: int, start: int, reflect: bool, out: int) -> int:
    """A CRC bit by bit, by its usual parameters."""
    mask, top, c = (1 << width) - 1, 1 << (width - 1), start
    if reflect:
        poly = int(format(poly, f"0{width}b")[::-1], 2)
        for x in data:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ poly if c & 1 else c >> 1
        return c ^ out
    for x in data:
        c ^= x << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
    return c ^ out


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def xx(name: str):
    import xxhash

    return getattr(xxhash, name)


def lzma_safe(f):
    def run(x):
        try:
            return f(raw(x))
        except Exception:
            return None

    return run


ONES32, ONES64 = (1 << 32) - 1, (1 << 64) - 1
KERNELS = [
    *(kernel("hash", f"sha3_{n}", "string", lambda x, n=n: hashlib.new(f"sha3_{n}", raw(x)).hexdigest()) for n in (224, 256, 384, 512)),
    kernel("hash", "blake2b", "string", lambda x: hashlib.blake2b(raw(x)).hexdigest()),
    kernel("hash", "blake2s", "string", lambda x: hashlib.blake2s(raw(x)).hexdigest()),
    kernel("hash", "hmac_sha256", "string", lambda k, x: hmac.new(raw(k), raw(x), "sha256").hexdigest()),
    kernel("hash", "hmac_sha512", "string", lambda k, x: hmac.new(raw(k), raw(x), "sha512").hexdigest()),
    kernel("hash", "pbkdf2_sha256", "string", lambda p, s, n: hashlib.pbkdf2_hmac("sha256", raw(p), raw(s), n).hex()),
    kernel("hash", "xxh64", "long", lambda x, seed=0: signed(xx("xxh64_intdigest")(raw(x or ""), seed)), nulls=True),
    kernel("hash", "xxh32", "long", lambda x, seed=0: xx("xxh32_intdigest")(raw(x), seed)),
    kernel("hash", "xxh3", "long", lambda x: xx("xxh3_64_intdigest")(raw("" if x is None else str(x) if isinstance(x, int | float) else x)) & (1 << 63) - 1, nulls=True),
    kernel("hash", "xxh3_128", "binary", lambda x: xx("xxh3_128_digest")(raw(x))),
    kernel("hash", "crc16", "long", lambda x: crc(raw(x), 16, 0x8005, 0, True, 0)),
    kernel("hash", "crc32_bzip2", "long", lambda x: crc(raw(x), 32, 0x04C11DB7, ONES32, False, ONES32)),
    kernel("hash", "crc64_ecma", "long", lambda x: signed(crc(raw(x), 64, 0x42F0E1EBA9EA3693, 0, False, 0))),
    kernel("hash", "crc64_xz", "long", lambda x: signed(crc(raw(x), 64, 0x42F0E1EBA9EA3693, ONES64, True, ONES64))),
    kernel("codec", "base32_encode", "string", lambda x: base64.b32encode(raw(x)).decode().rstrip("=")),
    kernel("codec", "base32_decode", "binary", base32_decode),
    kernel("codec", "base58_encode", "string", base58_encode),
    kernel("codec", "base58_decode", "binary", base58_decode),
    kernel("codec", "base85_encode", "string", lambda x: base64.b85encode(raw(x)).decode()),
    kernel("codec", "html_unescape", "string", html.unescape),
    kernel("codec", "html_decode_entities", "string", html.unescape),
    kernel("codec", "shell_quote", "string", shlex.quote),
    kernel("codec", "gzip_compress", "binary", lambda x: gzip.compress(raw(x), mtime=0)),
    kernel("codec", "gzip_decompress", "binary", lzma_safe(gzip.decompress)),
    kernel("codec", "zlib_compress", "binary", lambda x: zlib.compress(raw(x))),
    kernel("codec", "zlib_decompress", "binary", lzma_safe(zlib.decompress)),
    kernel("codec", "bzip2_compress", "binary", lambda x: bz2.compress(raw(x))),
    kernel("codec", "bzip2_decompress", "binary", lzma_safe(bz2.decompress)),
    kernel("codec", "hexdump", "string", lambda x: "\n".join(f"{i:08x}  {raw(x)[i : i + 16].hex(' ')}" for i in range(0, len(raw(x)), 16))),
]

FUNCTIONS = [*BUILT_IN, *KERNELS]
