"""Second names of functions, and small packages whose functions are one expression or a call of the standard library."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import re

from millrace.functions.registry import kernel, parse

DATES = parse("datetime_alias", """
date_tz_convert(t TIMESTAMP, a STRING, b STRING) STRING = chrono_tz(t, a, b)
date_now_tz(z STRING) STRING = iso_text(from_utc_timestamp(current_timestamp(), z))
date_business_days_between(a TIMESTAMP, b TIMESTAMP) BIGINT = business_days_between(a, b)
date_iso_week(t TIMESTAMP) INT = weekofyear(t)
date_iso_year(t TIMESTAMP) INT = extract(YEAROFWEEK FROM t)
week(t TIMESTAMP) INT = weekofyear(t)
utc_timestamp() STRING = iso_text(current_timestamp())
sysdate() STRING = iso_text(current_timestamp())
makedate(y INT, m INT, d INT) DATE = make_date(y, m, d)
maketime(h INT, m INT, s INT) STRING = concat(lpad(h, 2, '0'), ':', lpad(m, 2, '0'), ':', lpad(s, 2, '0'))
to_seconds(t TIMESTAMP) BIGINT = unix_seconds(t) - unix_seconds(timestamp'0000-01-01 00:00:00')
timestamp_add(t TIMESTAMP, n INT, u STRING) TIMESTAMP = chrono_add(t, n, u)
timestamp_sub(t TIMESTAMP, n INT, u STRING) TIMESTAMP = chrono_add(t, -n, u)
timestamp_diff(a TIMESTAMP, b TIMESTAMP, u STRING) BIGINT = chrono_diff(a, b, u)
datetime_add(t TIMESTAMP, n INT, u STRING) TIMESTAMP = chrono_add(t, n, u)
datetime_sub(t TIMESTAMP, n INT, u STRING) TIMESTAMP = chrono_add(t, -n, u)
datetime_diff(a TIMESTAMP, b TIMESTAMP, u STRING) BIGINT = chrono_diff(a, b, u)
datetime_trunc(t TIMESTAMP, u STRING) TIMESTAMP = date_trunc(u, t)
parse_date(s STRING, f STRING) DATE = to_date(s, strftime_pattern(f))
parse_datetime(s STRING, f STRING) TIMESTAMP = to_timestamp(s, strftime_pattern(f))
parse_timestamp(s STRING, f STRING) TIMESTAMP = to_timestamp(s, strftime_pattern(f))
format_date(t TIMESTAMP, f STRING) STRING = date_format(t, strftime_pattern(f))
format_datetime(t TIMESTAMP, f STRING) STRING = date_format(t, strftime_pattern(f))
format_timestamp(t TIMESTAMP, f STRING) STRING = date_format(t, strftime_pattern(f))
date_bucket(n BIGINT, t TIMESTAMP) TIMESTAMP = chrono_time_bucket(n, t)
""")

LISTS = parse("array_alias", """
array_cat(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) ARRAY<DOUBLE> = concat(a, b)
array_concat(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) ARRAY<DOUBLE> = concat(a, b)
list_concat(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) ARRAY<DOUBLE> = concat(a, b)
array_length(a ARRAY<DOUBLE>) INT = size(a)
array_to_string(a ARRAY<STRING>, s STRING) STRING = array_join(a, s, '')
list_string_agg(a ARRAY<STRING>, s STRING) STRING = array_join(a, s, '')
list_aggr(a ARRAY<STRING>, s STRING) STRING = array_join(a, s, '')
array_slice(a ARRAY<DOUBLE>, lo INT, hi INT) ARRAY<DOUBLE> = list_slice(a, lo, hi)
array_reverse(a ARRAY<DOUBLE>) ARRAY<DOUBLE> = reverse(a)
list_append(a ARRAY<DOUBLE>, v DOUBLE) ARRAY<DOUBLE> = array_append(a, v)
list_prepend(v DOUBLE, a ARRAY<DOUBLE>) ARRAY<DOUBLE> = array_prepend(a, v)
list_indexof(a ARRAY<DOUBLE>, v DOUBLE) BIGINT = nullif(array_position(a, v), 0L)
list_distinct(a ARRAY<DOUBLE>) ARRAY<DOUBLE> = array_distinct(a)
list_unique(a ARRAY<DOUBLE>) ARRAY<DOUBLE> = array_distinct(a)
list_has(a ARRAY<DOUBLE>, v DOUBLE) BOOLEAN = exists(a, x -> x <=> v)
list_intersect(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) ARRAY<DOUBLE> = array_intersect(a, b)
array_sum(a ARRAY<DOUBLE>) DOUBLE = list_sum(a)
array_product(a ARRAY<DOUBLE>) DOUBLE = list_product(a)
array_avg(a ARRAY<DOUBLE>) DOUBLE = list_avg(a)
array_count(a ARRAY<DOUBLE>) INT = list_count(a)
array_to_json(a ARRAY<DOUBLE>) STRING = to_json(a)
vec_f32(s STRING) ARRAY<FLOAT> = from_json(s, 'array<float>')
""")

JSONS = parse("json_alias", """
json(s STRING) STRING = to_json(parse_json(s))
jsonb(s STRING) VARIANT = parse_json(s)
jsonb_valid(s STRING) INT = json_valid(s)
json_extract(s STRING, p STRING) STRING = get_json_object(s, p)
jsonb_extract(s STRING, p STRING) STRING = get_json_object(s, p)
jsonb_extract_path(s STRING, p STRING) STRING = get_json_object(s, p)
json_value(s STRING, p STRING) STRING = json_scalar(s, p)
jsonb_value(s STRING, p STRING) STRING = json_scalar(s, p)
jsonb_query(s STRING, p STRING) STRING = json_query(s, p)
jsonb_path_query(s STRING, p STRING) STRING = json_query(s, p)
jsonb_path_exists(s STRING, p STRING) INT = CAST(get_json_object(s, p) IS NOT NULL AS INT)
jsonb_array_length(s STRING) INT = json_array_length(s)
jsonb_object_keys(s STRING) STRING = to_json(json_object_keys(s))
jsonpath_count(s STRING, p STRING) INT = json_array_length(get_json_object(s, p))
""")

VARIADIC = [
    kernel("json_alias", "json_array", "string", lambda *a: json.dumps(list(a), separators=(",", ":"), ensure_ascii=False, default=str), nulls=True),
    kernel("json_alias", "jsonb_build_array", "string", lambda *a: json.dumps(list(a), separators=(",", ":"), ensure_ascii=False, default=str), nulls=True),
    kernel("json_alias", "json_object", "string", lambda *a: json.dumps(dict(zip(a[::2], a[1::2], strict=True)), separators=(",", ":"), ensure_ascii=False, default=str), nulls=True),
    kernel("json_alias", "jsonb_build_object", "string", lambda *a: json.dumps(dict(zip(a[::2], a[1::2], strict=True)), separators=(",", ":"), ensure_ascii=False, default=str), nulls=True),
]

SMALL = parse("small", """
text_concat(a STRING, b STRING) STRING = concat(coalesce(a, ''), coalesce(b, ''))
text_join(s STRING, a STRING, b STRING) STRING = concat_ws(s, a, b)
str_split(s STRING, sep STRING) STRING = to_json(split(s, concat('\\\\Q', sep, '\\\\E')))
is_ipv4_compat(s STRING) INT = CAST(s RLIKE '^::([0-9]{1,3}\\\\.){3}[0-9]{1,3}$' AS INT)
color_to_hex(s STRING) STRING = concat('#', lower(ltrim('#', s)))
color_mix(a STRING, b STRING, t DOUBLE) STRING = color_rgb_to_hex(int(round(255 * pow((1 - t) * pow(color_red(a) / 255D, 2.2D) + t * pow(color_red(b) / 255D, 2.2D), 1 / 2.2D))), int(round(255 * pow((1 - t) * pow(color_green(a) / 255D, 2.2D) + t * pow(color_green(b) / 255D, 2.2D), 1 / 2.2D))), int(round(255 * pow((1 - t) * pow(color_blue(a) / 255D, 2.2D) + t * pow(color_blue(b) / 255D, 2.2D), 1 / 2.2D))))
safe_cast_double(s STRING) DOUBLE = try_cast(s AS DOUBLE)
gen_random_uuid() STRING = uuid()
generate_uuid() STRING = uuid()
uuidv4() STRING = uuid()
uuid_variant(u STRING) STRING = CASE WHEN substr(lower(u), 20, 1) IN ('8', '9', 'a', 'b') THEN 'rfc4122' WHEN substr(lower(u), 20, 1) RLIKE '[0-7]' THEN 'ncs' WHEN substr(lower(u), 20, 1) IN ('c', 'd') THEN 'microsoft' ELSE 'future' END
uuid_timestamp_ms(u STRING) BIGINT = if(uuid_version(u) = 7, uuid_v7_timestamp(u), NULL)
aes_gcm_encrypt(k BINARY, p BINARY, n BINARY, a BINARY DEFAULT X'') BINARY = substring(aes_encrypt(p, k, 'GCM', 'DEFAULT', n, a), 13)
aes_gcm_decrypt(k BINARY, c BINARY, n BINARY, a BINARY DEFAULT X'') BINARY = try_aes_decrypt(concat(n, c), k, 'GCM', 'DEFAULT', a)
aes_cbc_encrypt(k BINARY, iv BINARY, p BINARY) BINARY = substring(aes_encrypt(p, k, 'CBC', 'PKCS', iv), 17)
aes_cbc_decrypt(k BINARY, iv BINARY, c BINARY) BINARY = try_aes_decrypt(concat(iv, c), k, 'CBC', 'PKCS')
zorder(x BIGINT, y BIGINT) BIGINT = zorder2(x, y)
unzorder(z BIGINT, n INT, k INT) BIGINT = aggregate(sequence(0, 62 div n), 0L, (a, i) -> a | shiftleft(shiftright(z, int(n * i + k)) & 1L, int(i)))
hexdump_compact(b BINARY) STRING = lower(hex(b))
sha1_hex(s STRING) STRING = sha1(coalesce(s, ''))
vat_normalize(s STRING) STRING = if(upper(regexp_replace(s, '[^A-Za-z0-9]', '')) RLIKE '^[A-Z]{2}[0-9A-Z]{2,12}$', upper(regexp_replace(s, '[^A-Za-z0-9]', '')), NULL)
vat_country(s STRING) STRING = left(vat_normalize(s), 2)
vat_is_valid_shape(s STRING) INT = CAST(vat_normalize(s) RLIKE '^(AT)?U[0-9]{8}$|^BE[01][0-9]{9}$|^DE[0-9]{9}$|^DK[0-9]{8}$|^ES[A-Z0-9][0-9]{7}[A-Z0-9]$|^FR[A-Z0-9]{2}[0-9]{9}$|^GB[0-9]{9}([0-9]{3})?$|^IT[0-9]{11}$|^NL[0-9]{9}B[0-9]{2}$|^PL[0-9]{10}$|^SE[0-9]{12}$' AS INT)
utm_zone(lat DOUBLE, lon DOUBLE) INT = int(floor((lon + 180) / 6)) % 60 + 1
""")


def hkdf(key: bytes, salt: bytes | None, info: bytes | None, length: int, algorithm: str = "sha256") -> bytes | None:
    """RFC 5869: extract, then expand; a null salt or info counts as empty, null for a length that the standard has not."""
    if key is None or length is None or not 0 < length <= 255 * hashlib.new(algorithm).digest_size:
        return None
    key, salt, info = (x.encode() if isinstance(x, str) else x or b"" for x in (key, salt, info))
    prk = hmac.new(bytes(salt) or bytes(hashlib.new(algorithm).digest_size), bytes(key), algorithm).digest()
    out = block = b""
    i = 1
    while len(out) < length:
        block = hmac.new(prk, block + bytes(info) + bytes([i]), algorithm).digest()
        out, i = out + block, i + 1
    return out[:length]


def utm(lat: float, lon: float) -> str:
    """`zone hemisphere easting northing` on WGS 84, by Krueger's series to the third order."""
    zone = int((lon + 180) // 6) % 60 + 1
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    p, dl = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    s = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(p)) - s * math.atanh(s * math.sin(p)))
    xi, eta = math.atan2(t, math.cos(dl)), math.atanh(math.sin(dl) / math.sqrt(1 + t * t))
    x = eta + sum(v * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, v in enumerate(alpha, 1))
    y = xi + sum(v * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, v in enumerate(alpha, 1))
    return f"{zone}{'N' if lat >= 0 else 'S'} {500000 + k0 * big * x:.2f} {(0 if lat >= 0 else 1e7) + k0 * big * y:.2f}"


def json5(s: str):
    """JSON with comments, single quotes, bare keys, trailing commas, hexadecimal numbers and signs."""
    token = re.compile(r"//[^\n]*|/\*.*?\*/|'((?:[^'\\]|\\.)*)'|\"(?:[^\"\\]|\\.)*\"|([A-Za-z_$][\w$]*)(?=\s*:)|0[xX][0-9a-fA-F]+|\+(?=[\d.])|(?<![\d.])\.(?=\d)|(?<=\d)\.(?![\d])|,(?=\s*[}\]])", re.S)

    def plain(m):
        t = m[0]
        if t.startswith(("//", "/*")) or t in ("+", ","):
            return ""
        if t[0] == "'":
            return json.dumps(m[1].replace("\\'", "'"))
        if t[0] == '"':
            return t
        return json.dumps(t) if m[2] else str(int(t, 16)) if t[:2].lower() == "0x" else "0." if m.string[m.start() - 1 : m.start()] not in tuple("0123456789") or not m.start() else ".0"

    return json.loads(re.sub(r",(\s*[}\]])", r"\1", token.sub(plain, s)))


def quiet(f, otherwise=None):
    def run(*a):
        try:
            return f(*a)
        except Exception:
            return otherwise

    return run


KERNELS = [
    kernel("small", "hkdf_sha256", "binary", hkdf, nulls=True),
    kernel("small", "hkdf_sha512", "binary", lambda k, s, i, n: hkdf(k, s, i, n, "sha512"), nulls=True),
    kernel("small", "utm_encode", "string", utm),
    kernel("small", "json5_parse", "string", quiet(lambda s: json.dumps(json5(s), separators=(",", ":"), ensure_ascii=False))),
    kernel("small", "json5_is_valid", "long", lambda s: 0 if s is None else int(quiet(lambda: (json5(s), 1)[1], 0)()), nulls=True),
    kernel("small", "idna_to_ascii", "string", quiet(lambda s: s.encode("idna").decode())),
    kernel("small", "idna_to_unicode", "string", quiet(lambda s: s.encode().decode("idna"))),
]

FUNCTIONS = [*DATES, *LISTS, *JSONS, *VARIADIC, *SMALL, *KERNELS]
