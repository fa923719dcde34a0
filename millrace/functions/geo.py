"""Places: distances and bearings as expressions; grid codes as kernels; planar geometry on WKT points and rings."""

from __future__ import annotations

import json

from millrace.functions.registry import kernel, parse

EXPRESSIONS = parse("geo", r"""
haversine_part(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) DOUBLE = pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)
haversine(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) DOUBLE = 2 * 6371008.8D * atan2(sqrt(haversine_part(a, b, c, d)), sqrt(1 - haversine_part(a, b, c, d))) ;; round(haversine(s_suppkey % 90, s_nationkey, 10, 20), 3) ;; round(2 * 6371008.8 * atan2(sqrt(pow(sin(radians(10 - s_suppkey % 90) / 2), 2) + cos(radians(s_suppkey % 90)) * cos(radians(10)) * pow(sin(radians(20 - s_nationkey) / 2), 2)), sqrt(1 - (pow(sin(radians(10 - s_suppkey % 90) / 2), 2) + cos(radians(s_suppkey % 90)) * cos(radians(10)) * pow(sin(radians(20 - s_nationkey) / 2), 2)))), 3)
bearing(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) DOUBLE = pmod(degrees(atan2(sin(radians(d - b)) * cos(radians(c)), cos(radians(a)) * sin(radians(c)) - sin(radians(a)) * cos(radians(c)) * cos(radians(d - b)))) + 360, 360) ;; round(bearing(s_suppkey % 90, s_nationkey, 10, 30), 6) ;; round((degrees(atan2(sin(radians(30 - s_nationkey)) * cos(radians(10)), cos(radians(s_suppkey % 90)) * sin(radians(10)) - sin(radians(s_suppkey % 90)) * cos(radians(10)) * cos(radians(30 - s_nationkey)))) + 360) % 360, 6)
within_radius(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, r DOUBLE) BOOLEAN = haversine(a, b, c, d) <= r
geo_midpoint(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) STRING = concat(round(degrees(atan2(sin(radians(a)) + sin(radians(c)), sqrt(pow(cos(radians(a)) + cos(radians(c)) * cos(radians(d - b)), 2) + pow(cos(radians(c)) * sin(radians(d - b)), 2)))), 6), ',', round(b + degrees(atan2(cos(radians(c)) * sin(radians(d - b)), cos(radians(a)) + cos(radians(c)) * cos(radians(d - b)))), 6))
latlon_normalize_lon(x DOUBLE) DOUBLE = pmod(x + 180, 360) - 180 ;; latlon_normalize_lon(s_suppkey * 7.0D) ;; CAST(((s_suppkey * 7.0 + 180) % 360) - 180 AS DOUBLE)
latlon_normalize_lat(x DOUBLE) DOUBLE = greatest(-90D, least(90D, x)) ;; latlon_normalize_lat(s_suppkey * 3.0D) ;; least(90.0::DOUBLE, s_suppkey * 3.0)
latlon_to_dms(x DOUBLE, axis STRING) STRING = concat(int(abs(x)), '° ', int(round(abs(x) * 3600, 6) / 60) % 60, '\' ', format_string('%.2f', pmod(round(abs(x) * 3600, 6), 60)), '" ', CASE axis WHEN 'lat' THEN if(x < 0, 'S', 'N') WHEN 'lon' THEN if(x < 0, 'W', 'E') END)
latlon_to_ddm(x DOUBLE, axis STRING) STRING = concat(int(abs(x)), '° ', format_string('%.3f', pmod(abs(x) * 60, 60)), '\' ', CASE axis WHEN 'lat' THEN if(x < 0, 'S', 'N') WHEN 'lon' THEN if(x < 0, 'W', 'E') END)
latlon_from_dms(s STRING) DOUBLE = if(s RLIKE '[0-9]', if(s RLIKE '[SWsw]|^\\s*-', -1, 1), NULL) * aggregate(transform(regexp_extract_all(s, '([0-9]+(?:\\.[0-9]+)?)', 1), (p, i) -> double(p) / pow(60D, i)), 0D, (a, v) -> a + v)
wkt_x(g STRING) DOUBLE = try_cast(regexp_extract(g, 'POINT *\\( *([-0-9.eE]+)', 1) AS DOUBLE) ;; wkt_x(concat('POINT(', s_suppkey, ' ', s_nationkey, ')')) ;; CAST(s_suppkey AS DOUBLE)
wkt_y(g STRING) DOUBLE = try_cast(regexp_extract(g, 'POINT *\\( *[-0-9.eE]+ +([-0-9.eE]+)', 1) AS DOUBLE) ;; wkt_y(concat('POINT(', s_suppkey, ' ', s_nationkey, ')')) ;; CAST(s_nationkey AS DOUBLE)
wkt_point(x DOUBLE, y DOUBLE) STRING = concat('POINT(', x, ' ', y, ')')
wkt_distance(a STRING, b STRING) DOUBLE = sqrt(pow(wkt_x(a) - wkt_x(b), 2) + pow(wkt_y(a) - wkt_y(b), 2)) ;; round(wkt_distance(concat('POINT(', s_suppkey, ' ', s_nationkey, ')'), 'POINT(0 0)'), 6) ;; round(sqrt(s_suppkey ** 2 + s_nationkey ** 2), 6)
ring_area(g STRING) DOUBLE = abs(aggregate(transform(sequence(1, size(split(regexp_extract(g, '\\(+([^()]*)\\)', 1), ',')) - 1), i -> double(split(trim(split(regexp_extract(g, '\\(+([^()]*)\\)', 1), ',')[i - 1]), ' +')[0]) * double(split(trim(split(regexp_extract(g, '\\(+([^()]*)\\)', 1), ',')[i]), ' +')[1]) - double(split(trim(split(regexp_extract(g, '\\(+([^()]*)\\)', 1), ',')[i]), ' +')[0]) * double(split(trim(split(regexp_extract(g, '\\(+([^()]*)\\)', 1), ',')[i - 1]), ' +')[1])), 0D, (a, v) -> a + v)) / 2
""")

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash_encode(lat: float, lon: float, precision: int = 12) -> str:
    spans, out, bits, even = [[-90.0, 90.0], [-180.0, 180.0]], "", 0, True
    for i in range(precision * 5):
        span, x = (spans[1], lon) if even else (spans[0], lat)
        mid = (span[0] + span[1]) / 2
        bits = bits * 2 + (x >= mid)
        span[0 if x >= mid else 1] = mid
        even = not even
        if i % 5 == 4:
            out, bits = out + BASE32[bits], 0
    return out


def geohash_box(code: str) -> tuple[float, float, float, float] | None:
    """(south, west, north, east)."""
    spans, even = [[-90.0, 90.0], [-180.0, 180.0]], True
    for c in code.lower():
        if c not in BASE32:
            return None
        for shift in range(4, -1, -1):
            span = spans[1] if even else spans[0]
            span[0 if BASE32.index(c) >> shift & 1 else 1] = (span[0] + span[1]) / 2
            even = not even
    return spans[0][0], spans[1][0], spans[0][1], spans[1][1]


def geohash_decode(code: str) -> str | None:
    if not (box := geohash_box(code)):
        return None
    return f"{(box[0] + box[2]) / 2:.6f},{(box[1] + box[3]) / 2:.6f}"


def geohash_neighbours(code: str) -> str | None:
    if not (box := geohash_box(code)):
        return None
    s, w, n, e = box
    lat, lon, h, d = (s + n) / 2, (w + e) / 2, n - s, e - w
    steps = {"n": (1, 0), "ne": (1, 1), "e": (0, 1), "se": (-1, 1), "s": (-1, 0), "sw": (-1, -1), "w": (0, -1), "nw": (1, -1)}
    move = lambda i, j: geohash_encode(min(90.0, max(-90.0, lat + i * h)), (lon + j * d + 180) % 360 - 180, len(code))
    return json.dumps({k: move(*v) for k, v in steps.items()}, separators=(",", ":"))


def maidenhead(lat: float, lon: float, precision: int = 3) -> str:
    x, y, out = lon + 180, lat + 90, ""
    for i in range(precision):
        base, letters = ((18, True), (10, False), (24, True), (10, False), (24, True))[i]
        sizes = (20, 2, 2 / 24, 2 / 240, 2 / 5760)
        a, b = int(x / sizes[i]), int(y / (sizes[i] / 2))
        x, y = x - a * sizes[i], y - b * sizes[i] / 2
        a, b = min(a, base - 1), min(b, base - 1)
        out += (chr(65 + a) + chr(65 + b)) if letters else f"{a}{b}"
    return out


def simplify(text: str, tolerance: float) -> str:
    """Douglas-Peucker on a JSON list of points."""
    p = json.loads(text)
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        i, j = todo.pop()
        (x1, y1), (x2, y2) = p[i], p[j]
        length = ((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5
        far, at = 0.0, i
        for k in range(i + 1, j):
            x, y = p[k]
            d = abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / length if length else ((x - x1) ** 2 + (y - y1) ** 2) ** 0.5
            if d > far:
                far, at = d, k
        if far > tolerance:
            keep.add(at)
            todo += [(i, at), (at, j)]
    return json.dumps([p[k] for k in sorted(keep)], separators=(",", ":"))


KERNELS = [
    kernel("geo", "geohash_encode", "string", geohash_encode),
    kernel("geo", "geohash_decode", "string", geohash_decode),
    kernel("geo", "geohash_bbox", "string", lambda s: json.dumps(geohash_box(s), separators=(",", ":")) if geohash_box(s) else None),
    kernel("geo", "geohash_neighbors", "string", geohash_neighbours),
    kernel("geo", "maidenhead_encode", "string", maidenhead),
    kernel("geo", "polyline_simplify", "string", simplify),
]

FUNCTIONS = [*EXPRESSIONS, *KERNELS]
