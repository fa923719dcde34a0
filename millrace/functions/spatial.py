"""Planar geometry as SQL functions: constructors, WKT and GeoJSON, accessors, measures, predicates and edits.

A geometry is a struct of its kind and its parts; a part is an array of rings (one for points and lines), a ring an array
of points.  Everything is an expression over those arrays, so calls are inlined and stay in the JVM; nothing is parsed
again between two calls.  Overlay, buffers, curves, rasters and topologies are not here.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.registry import Function, parse

P = "STRUCT<x: DOUBLE, y: DOUBLE>"
R = f"ARRAY<{P}>"
G = f"STRUCT<kind: STRING, parts: ARRAY<ARRAY<{R}>>>"


def _typed(lines: str) -> str:
    """The definitions with GEO, RING and POINT_ for the types of geometries, rings and points."""
    for name, kind in (("GEO", G), ("RING", R), ("POINT_", P)):
        lines = re.sub(rf"\b{name}\b", kind, lines)
    return lines


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """The arguments of a call whose opening parenthesis is at `at`, and where it ends."""
    out, depth, quoted, start = [], 0, False, at + 1
    for i in range(at, len(text)):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif quoted:
            continue
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return [*out, text[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    raise ValueError(f"no end of a call: {text[at:at + 40]}")


def _outside_quotes(pattern: str, put: Callable, text: str) -> str:
    return "".join(x if i % 2 else re.sub(pattern, put, x) for i, x in enumerate(re.split(r"('[^']*')", text)))


def _inlined(functions: list[Function]) -> list[Function]:
    """Each body with the calls of earlier functions written out, for Spark allows no SQL function inside a lambda.

    Lambda variables get numbers, so that what is put in keeps its meaning.
    """
    table: dict[str, Function] = {}
    numbers = count()
    out = []
    for f in functions:
        body, at = f.body, 0
        while m := re.compile(r"\b(\w+)\(").search(body, at):
            if m[1] not in table:
                at = m.end()
                continue
            used = table[m[1]]
            arguments, end = _arguments(body, m.end() - 1)
            put = used.body
            for v in sorted({x for pair in re.findall(r"\((\w+), (\w+)\) ->|\b(\w+) ->", put) for x in pair if x}):
                put = _outside_quotes(rf"(?<!\.)\b{v}\b", lambda _, to=f"{v.split('_')[0]}_{next(numbers)}": to, put)
            names = [x.split()[0] for x in re.split(r", (?=\w+ [A-Z])", used.parameters)]
            given = dict(zip(names, arguments, strict=True))
            put = _outside_quotes(rf"(?<!\.)\b({'|'.join(names)})\b", lambda x, given=given: f"({given[x[1]]})" if not given[x[1]].isidentifier() else given[x[1]], put)
            body = f"{body[:m.start()]}({put}){body[end:]}"
            at = m.start()
        made = replace(f, body=body)
        table[f.name] = made
        out.append(made)
    return out


#: Rings: signed double area, length, distance to a point, crossing number; helpers of what follows.
RINGS = parse("spatial", _typed(r"""
geo_point(x DOUBLE, y DOUBLE) POINT_ = named_struct('x', x, 'y', y)
ring_area2(r RING) DOUBLE = aggregate(sequence(1, greatest(size(r) - 1, 1)), 0D, (s, i) -> s + coalesce(get(r, i - 1).x * get(r, i).y - get(r, i).x * get(r, i - 1).y, 0D))
ring_length(r RING) DOUBLE = aggregate(sequence(1, greatest(size(r) - 1, 1)), 0D, (s, i) -> s + coalesce(sqrt(pow(get(r, i).x - get(r, i - 1).x, 2) + pow(get(r, i).y - get(r, i - 1).y, 2)), 0D))
ring_moment(r RING) RING = array(aggregate(sequence(1, greatest(size(r) - 1, 1)), named_struct('x', 0D, 'y', 0D), (s, i) -> named_struct('x', s.x + coalesce((get(r, i).x + get(r, i - 1).x) * (get(r, i - 1).x * get(r, i).y - get(r, i).x * get(r, i - 1).y), 0D), 'y', s.y + coalesce((get(r, i).y + get(r, i - 1).y) * (get(r, i - 1).x * get(r, i).y - get(r, i).x * get(r, i - 1).y), 0D))))
ring_winds(r RING, px DOUBLE, py DOUBLE) BOOLEAN = aggregate(sequence(1, greatest(size(r) - 1, 1)), false, (s, i) -> if(coalesce((get(r, i).y > py) <> (get(r, i - 1).y > py) AND px < (get(r, i - 1).x - get(r, i).x) * (py - get(r, i).y) / (get(r, i - 1).y - get(r, i).y) + get(r, i).x, false), NOT s, s))
segment_distance(px DOUBLE, py DOUBLE, ax DOUBLE, ay DOUBLE, bx DOUBLE, by_ DOUBLE) DOUBLE = element_at(transform(array(coalesce(least(greatest(try_divide((px - ax) * (bx - ax) + (py - ay) * (by_ - ay), (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0D), 1D), 0D)), t -> sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (by_ - ay), 2))), 1)
ring_distance(r RING, px DOUBLE, py DOUBLE) DOUBLE = array_min(transform(sequence(1, greatest(size(r) - 1, 1)), i -> segment_distance(px, py, get(r, i - 1).x, get(r, i - 1).y, coalesce(get(r, i), get(r, i - 1)).x, coalesce(get(r, i), get(r, i - 1)).y)))
turn(ax DOUBLE, ay DOUBLE, bx DOUBLE, by_ DOUBLE, cx DOUBLE, cy DOUBLE) DOUBLE = signum((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax))
rings_cross(a RING, b RING) BOOLEAN = exists(sequence(1, greatest(size(a) - 1, 1)), i -> exists(sequence(1, greatest(size(b) - 1, 1)), j -> coalesce(turn(get(a, i - 1).x, get(a, i - 1).y, get(a, i).x, get(a, i).y, get(b, j - 1).x, get(b, j - 1).y) * turn(get(a, i - 1).x, get(a, i - 1).y, get(a, i).x, get(a, i).y, get(b, j).x, get(b, j).y) < 0 AND turn(get(b, j - 1).x, get(b, j - 1).y, get(b, j).x, get(b, j).y, get(a, i - 1).x, get(a, i - 1).y) * turn(get(b, j - 1).x, get(b, j - 1).y, get(b, j).x, get(b, j).y, get(a, i).x, get(a, i).y) < 0, false)))
"""))

CONSTRUCTORS = parse("spatial", _typed(r"""
st_makepoint(x DOUBLE, y DOUBLE) GEO = named_struct('kind', 'POINT', 'parts', array(array(array(named_struct('x', x, 'y', y))))) ;; st_x(st_makepoint(s_acctbal, 2)) ;; s_acctbal
st_point(x DOUBLE, y DOUBLE) GEO = st_makepoint(x, y) ;; st_y(st_point(1, s_acctbal)) ;; s_acctbal
st_makeenvelope(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) GEO = named_struct('kind', 'POLYGON', 'parts', array(array(array(named_struct('x', x1, 'y', y1), named_struct('x', x1, 'y', y2), named_struct('x', x2, 'y', y2), named_struct('x', x2, 'y', y1), named_struct('x', x1, 'y', y1))))) ;; st_area(st_makeenvelope(0, 0, s_nationkey, 3)) ;; CAST(3 * s_nationkey AS DOUBLE)
st_makeline(a GEO, b GEO) GEO = named_struct('kind', 'LINESTRING', 'parts', array(array(concat(a.parts[0][0], b.parts[0][0])))) ;; st_length(st_makeline(st_makepoint(0, 0), st_makepoint(3 * s_nationkey, 4 * s_nationkey))) ;; CAST(5 * s_nationkey AS DOUBLE)
st_makepolygon(a GEO) GEO = named_struct('kind', 'POLYGON', 'parts', a.parts)
st_multi(g GEO) GEO = named_struct('kind', if(startswith(g.kind, 'MULTI'), g.kind, concat('MULTI', g.kind)), 'parts', g.parts)
st_collect(a GEO, b GEO) GEO = named_struct('kind', if(replace(a.kind, 'MULTI', '') = replace(b.kind, 'MULTI', ''), concat('MULTI', replace(a.kind, 'MULTI', '')), 'GEOMETRYCOLLECTION'), 'parts', concat(a.parts, b.parts))
wkt_ring(s STRING) RING = transform(split(regexp_replace(s, '[()]', ''), ','), p -> named_struct('x', CAST(split(trim(p), '\\s+')[0] AS DOUBLE), 'y', CAST(split(trim(p), '\\s+')[1] AS DOUBLE)))
st_geomfromtext(s STRING) GEO = if(s RLIKE '(?is)^\\s*MULTI|POLYGON|LINESTRING|POINT' AND NOT s RLIKE '(?i)EMPTY', named_struct('kind', upper(regexp_extract(s, '([A-Za-z]+)', 1)), 'parts', CASE upper(regexp_extract(s, '([A-Za-z]+)', 1)) WHEN 'POLYGON' THEN array(transform(regexp_extract_all(s, '\\(([^()]+)\\)', 1), r -> wkt_ring(r))) WHEN 'MULTIPOLYGON' THEN transform(regexp_extract_all(s, '\\(\\s*(\\([^()]+\\)(?:\\s*,\\s*\\([^()]+\\))*)\\s*\\)', 1), p -> transform(regexp_extract_all(p, '\\(([^()]+)\\)', 1), r -> wkt_ring(r))) WHEN 'MULTILINESTRING' THEN transform(regexp_extract_all(s, '\\(([^()]+)\\)', 1), r -> array(wkt_ring(r))) WHEN 'MULTIPOINT' THEN transform(wkt_ring(regexp_extract(s, '\\((.*)\\)', 1)), p -> array(array(p))) ELSE array(array(wkt_ring(regexp_extract(s, '\\(([^()]+)\\)', 1)))) END), NULL) ;; st_npoints(st_geomfromtext(concat('LINESTRING(0 0, 1 1, ', s_nationkey, ' 5)'))) ;; 3
st_pointfromtext(s STRING) GEO = if(st_geomfromtext(s).kind = 'POINT', st_geomfromtext(s), NULL)
st_linefromtext(s STRING) GEO = if(st_geomfromtext(s).kind = 'LINESTRING', st_geomfromtext(s), NULL)
st_polygonfromtext(s STRING) GEO = if(st_geomfromtext(s).kind = 'POLYGON', st_geomfromtext(s), NULL)
st_mpointfromtext(s STRING) GEO = if(st_geomfromtext(s).kind = 'MULTIPOINT', st_geomfromtext(s), NULL)
st_mlinefromtext(s STRING) GEO = if(st_geomfromtext(s).kind = 'MULTILINESTRING', st_geomfromtext(s), NULL)
st_mpolyfromtext(s STRING) GEO = if(st_geomfromtext(s).kind = 'MULTIPOLYGON', st_geomfromtext(s), NULL)
number_text(x DOUBLE) STRING = if(x = floor(x) AND abs(x) < 1e15, CAST(CAST(x AS BIGINT) AS STRING), CAST(x AS STRING))
ring_text(r RING) STRING = array_join(transform(r, p -> concat(number_text(p.x), ' ', number_text(p.y))), ',')
st_astext(g GEO) STRING = concat(g.kind, CASE g.kind WHEN 'POLYGON' THEN concat('(', array_join(transform(g.parts[0], r -> concat('(', ring_text(r), ')')), ','), ')') WHEN 'MULTIPOLYGON' THEN concat('(', array_join(transform(g.parts, p -> concat('(', array_join(transform(p, r -> concat('(', ring_text(r), ')')), ','), ')')), ','), ')') WHEN 'MULTIPOINT' THEN concat('(', array_join(transform(g.parts, p -> ring_text(p[0])), ','), ')') WHEN 'MULTILINESTRING' THEN concat('(', array_join(transform(g.parts, p -> concat('(', ring_text(p[0]), ')')), ','), ')') ELSE concat('(', ring_text(g.parts[0][0]), ')') END) ;; st_astext(st_makepoint(s_nationkey, 1)) ;; 'POINT(' || s_nationkey || ' 1)'
st_as_text(g GEO) STRING = st_astext(g)
ring_json(r RING) STRING = concat('[', array_join(transform(r, p -> concat('[', number_text(p.x), ',', number_text(p.y), ']')), ','), ']')
st_asgeojson(g GEO) STRING = concat('{"type":"', CASE g.kind WHEN 'POINT' THEN 'Point' WHEN 'LINESTRING' THEN 'LineString' WHEN 'POLYGON' THEN 'Polygon' WHEN 'MULTIPOINT' THEN 'MultiPoint' WHEN 'MULTILINESTRING' THEN 'MultiLineString' ELSE 'MultiPolygon' END, '","coordinates":', CASE g.kind WHEN 'POINT' THEN regexp_replace(ring_json(g.parts[0][0]), '^\\[|\\]$', '') WHEN 'LINESTRING' THEN ring_json(g.parts[0][0]) WHEN 'POLYGON' THEN concat('[', array_join(transform(g.parts[0], r -> ring_json(r)), ','), ']') WHEN 'MULTIPOINT' THEN ring_json(transform(g.parts, p -> p[0][0])) WHEN 'MULTILINESTRING' THEN concat('[', array_join(transform(g.parts, p -> ring_json(p[0])), ','), ']') ELSE concat('[', array_join(transform(g.parts, p -> concat('[', array_join(transform(p, r -> ring_json(r)), ','), ']')), ','), ']') END, '}') ;; st_asgeojson(st_makepoint(s_nationkey, 1)) ;; '{"type":"Point","coordinates":[' || s_nationkey || ',1]}'
st_geomfromgeojson(s STRING) GEO = element_at(transform(array(get_json_object(s, '$.coordinates')), c -> CASE get_json_object(s, '$.type') WHEN 'Point' THEN element_at(transform(array(from_json(c, 'ARRAY<DOUBLE>')), a -> st_makepoint(a[0], a[1])), 1) WHEN 'LineString' THEN named_struct('kind', 'LINESTRING', 'parts', array(array(transform(from_json(c, 'ARRAY<ARRAY<DOUBLE>>'), a -> geo_point(a[0], a[1]))))) WHEN 'MultiPoint' THEN named_struct('kind', 'MULTIPOINT', 'parts', transform(from_json(c, 'ARRAY<ARRAY<DOUBLE>>'), a -> array(array(geo_point(a[0], a[1]))))) WHEN 'Polygon' THEN named_struct('kind', 'POLYGON', 'parts', array(transform(from_json(c, 'ARRAY<ARRAY<ARRAY<DOUBLE>>>'), r -> transform(r, a -> geo_point(a[0], a[1]))))) WHEN 'MultiLineString' THEN named_struct('kind', 'MULTILINESTRING', 'parts', transform(from_json(c, 'ARRAY<ARRAY<ARRAY<DOUBLE>>>'), r -> array(transform(r, a -> geo_point(a[0], a[1]))))) WHEN 'MultiPolygon' THEN named_struct('kind', 'MULTIPOLYGON', 'parts', transform(from_json(c, 'ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>'), p -> transform(p, r -> transform(r, a -> geo_point(a[0], a[1]))))) END), 1)
"""))

ACCESSORS = parse("spatial", _typed(r"""
st_allpoints(g GEO) RING = flatten(flatten(g.parts))
st_geometrytype(g GEO) STRING = concat('ST_', CASE g.kind WHEN 'POINT' THEN 'Point' WHEN 'LINESTRING' THEN 'LineString' WHEN 'POLYGON' THEN 'Polygon' WHEN 'MULTIPOINT' THEN 'MultiPoint' WHEN 'MULTILINESTRING' THEN 'MultiLineString' WHEN 'MULTIPOLYGON' THEN 'MultiPolygon' ELSE 'GeometryCollection' END) ;; st_geometrytype(st_makepoint(1, s_nationkey)) ;; 'ST_Point'
st_dimension(g GEO) INT = CASE replace(g.kind, 'MULTI', '') WHEN 'POINT' THEN 0 WHEN 'LINESTRING' THEN 1 ELSE 2 END ;; st_dimension(st_makeenvelope(0, 0, 1, s_nationkey)) ;; 2
st_x(g GEO) DOUBLE = if(g.kind = 'POINT', g.parts[0][0][0].x, NULL)
st_y(g GEO) DOUBLE = if(g.kind = 'POINT', g.parts[0][0][0].y, NULL)
st_xmin(g GEO) DOUBLE = array_min(transform(st_allpoints(g), p -> p.x)) ;; st_xmin(st_makeenvelope(s_nationkey, 0, 30, 1)) ;; CAST(s_nationkey AS DOUBLE)
st_xmax(g GEO) DOUBLE = array_max(transform(st_allpoints(g), p -> p.x)) ;; st_xmax(st_makeenvelope(s_nationkey, 0, 30, 1)) ;; 30.0
st_ymin(g GEO) DOUBLE = array_min(transform(st_allpoints(g), p -> p.y)) ;; st_ymin(st_makeenvelope(s_nationkey, 0, 30, 1)) ;; 0.0
st_ymax(g GEO) DOUBLE = array_max(transform(st_allpoints(g), p -> p.y)) ;; st_ymax(st_makeenvelope(0, s_nationkey, 30, 100)) ;; 100.0
st_npoints(g GEO) INT = size(st_allpoints(g)) ;; st_npoints(st_makeenvelope(0, 0, s_nationkey, 1)) ;; 5
st_numpoints(g GEO) INT = if(g.kind = 'LINESTRING', size(g.parts[0][0]), NULL) ;; st_numpoints(st_makeline(st_makepoint(0, 0), st_makepoint(s_nationkey, 1))) ;; 2
st_nrings(g GEO) INT = if(st_dimension(g) = 2, size(flatten(g.parts)), 0) ;; st_nrings(st_makeenvelope(0, 0, s_nationkey, 1)) ;; 1
st_numinteriorrings(g GEO) INT = if(g.kind = 'POLYGON', size(g.parts[0]) - 1, NULL) ;; st_numinteriorrings(st_makeenvelope(0, 0, s_nationkey, 1)) ;; 0
st_numgeometries(g GEO) INT = size(g.parts) ;; st_numgeometries(st_multi(st_makepoint(s_nationkey, 1))) ;; 1
st_geometryn(g GEO, n INT) GEO = if(n BETWEEN 1 AND size(g.parts), named_struct('kind', replace(g.kind, 'MULTI', ''), 'parts', array(g.parts[n - 1])), NULL)
st_pointn(g GEO, n INT) GEO = element_at(transform(array(get(g.parts[0][0], if(n < 0, size(g.parts[0][0]) + n, n - 1))), p -> if(p IS NULL, NULL, st_makepoint(p.x, p.y))), 1)
st_startpoint(g GEO) GEO = if(g.kind = 'LINESTRING', st_pointn(g, 1), NULL) ;; st_astext(st_startpoint(st_makeline(st_makepoint(s_nationkey, 0), st_makepoint(9, 9)))) ;; 'POINT(' || s_nationkey || ' 0)'
st_endpoint(g GEO) GEO = if(g.kind = 'LINESTRING', st_pointn(g, -1), NULL) ;; st_astext(st_endpoint(st_makeline(st_makepoint(s_nationkey, 0), st_makepoint(9, 9)))) ;; 'POINT(9 9)'
st_exteriorring(g GEO) GEO = if(g.kind = 'POLYGON', named_struct('kind', 'LINESTRING', 'parts', array(array(g.parts[0][0]))), NULL)
st_interiorringn(g GEO, n INT) GEO = if(g.kind = 'POLYGON' AND n BETWEEN 1 AND size(g.parts[0]) - 1, named_struct('kind', 'LINESTRING', 'parts', array(array(g.parts[0][n]))), NULL)
st_boundary(g GEO) GEO = if(st_dimension(g) = 2, named_struct('kind', if(size(flatten(g.parts)) = 1, 'LINESTRING', 'MULTILINESTRING'), 'parts', transform(flatten(g.parts), r -> array(r))), if(g.kind = 'LINESTRING', named_struct('kind', 'MULTIPOINT', 'parts', array(array(array(g.parts[0][0][0])), array(array(element_at(g.parts[0][0], -1))))), NULL))
st_points(g GEO) GEO = named_struct('kind', 'MULTIPOINT', 'parts', transform(st_allpoints(g), p -> array(array(p))))
st_envelope(g GEO) GEO = st_makeenvelope(st_xmin(g), st_ymin(g), st_xmax(g), st_ymax(g)) ;; st_area(st_envelope(st_makeline(st_makepoint(0, 0), st_makepoint(2, s_nationkey)))) ;; CAST(2 * s_nationkey AS DOUBLE)
st_expand(g GEO, d DOUBLE) GEO = st_makeenvelope(st_xmin(g) - d, st_ymin(g) - d, st_xmax(g) + d, st_ymax(g) + d) ;; st_area(st_expand(st_makepoint(s_nationkey, 1), 2)) ;; 16.0
st_boundingdiagonal(g GEO) GEO = st_makeline(st_makepoint(st_xmin(g), st_ymin(g)), st_makepoint(st_xmax(g), st_ymax(g)))
st_isempty(g GEO) BOOLEAN = size(st_allpoints(g)) = 0 ;; st_isempty(st_makepoint(s_nationkey, 1)) ;; false
st_isclosed(g GEO) BOOLEAN = if(st_dimension(g) = 1, forall(g.parts, p -> p[0][0] = element_at(p[0], -1)), true) ;; st_isclosed(st_makeline(st_makepoint(s_nationkey, 1), st_makepoint(99, 1))) ;; false
st_iscollection(g GEO) BOOLEAN = startswith(g.kind, 'MULTI') OR g.kind = 'GEOMETRYCOLLECTION' ;; st_iscollection(st_multi(st_makepoint(s_nationkey, 1))) ;; true
st_ispolygonccw(g GEO) BOOLEAN = forall(g.parts, p -> ring_area2(p[0]) > 0 AND forall(slice(p, 2, greatest(size(p) - 1, 0)), r -> ring_area2(r) < 0))
st_ispolygoncw(g GEO) BOOLEAN = forall(g.parts, p -> ring_area2(p[0]) < 0 AND forall(slice(p, 2, greatest(size(p) - 1, 0)), r -> ring_area2(r) > 0)) ;; st_ispolygoncw(st_makeenvelope(0, 0, s_nationkey + 1, 1)) ;; true
st_coorddim(g GEO) INT = 2 ;; st_coorddim(st_makepoint(s_nationkey, 1)) ;; 2
st_ndims(g GEO) INT = 2 ;; st_ndims(st_makepoint(s_nationkey, 1)) ;; 2
st_hasz(g GEO) BOOLEAN = false ;; st_hasz(st_makepoint(s_nationkey, 1)) ;; false
st_hasm(g GEO) BOOLEAN = false ;; st_hasm(st_makepoint(s_nationkey, 1)) ;; false
"""))

MEASURES = parse("spatial", _typed(r"""
st_area(g GEO) DOUBLE = if(st_dimension(g) < 2, 0D, aggregate(g.parts, 0D, (s, p) -> s + abs(ring_area2(p[0])) / 2 - aggregate(slice(p, 2, greatest(size(p) - 1, 0)), 0D, (t, r) -> t + abs(ring_area2(r)) / 2)))
st_length(g GEO) DOUBLE = if(st_dimension(g) = 1, aggregate(g.parts, 0D, (s, p) -> s + ring_length(p[0])), 0D)
st_length2d(g GEO) DOUBLE = st_length(g) ;; st_length2d(st_makeline(st_makepoint(0, 0), st_makepoint(0, s_nationkey))) ;; CAST(s_nationkey AS DOUBLE)
st_perimeter(g GEO) DOUBLE = if(st_dimension(g) = 2, aggregate(flatten(g.parts), 0D, (s, r) -> s + ring_length(r)), 0D) ;; st_perimeter(st_makeenvelope(0, 0, s_nationkey, 2)) ;; CAST(2 * s_nationkey + 4 AS DOUBLE)
st_centroid(g GEO) GEO = CASE st_dimension(g) WHEN 2 THEN element_at(transform(array(named_struct('a', aggregate(flatten(g.parts), 0D, (s, r) -> s + ring_area2(r)), 'm', transform(flatten(g.parts), r -> ring_moment(r)[0]))), v -> st_makepoint(try_divide(aggregate(v.m, 0D, (s, p) -> s + p.x), 3 * v.a), try_divide(aggregate(v.m, 0D, (s, p) -> s + p.y), 3 * v.a))), 1) WHEN 0 THEN st_makepoint(aggregate(st_allpoints(g), 0D, (s, p) -> s + p.x) / size(st_allpoints(g)), aggregate(st_allpoints(g), 0D, (s, p) -> s + p.y) / size(st_allpoints(g))) ELSE element_at(transform(array(flatten(transform(g.parts, p -> transform(sequence(1, size(p[0]) - 1), i -> named_struct('l', sqrt(pow(p[0][i].x - p[0][i - 1].x, 2) + pow(p[0][i].y - p[0][i - 1].y, 2)), 'x', (p[0][i].x + p[0][i - 1].x) / 2, 'y', (p[0][i].y + p[0][i - 1].y) / 2))))), s -> st_makepoint(try_divide(aggregate(s, 0D, (t, e) -> t + e.l * e.x), aggregate(s, 0D, (t, e) -> t + e.l)), try_divide(aggregate(s, 0D, (t, e) -> t + e.l * e.y), aggregate(s, 0D, (t, e) -> t + e.l)))), 1) END ;; round(st_x(st_centroid(st_makeenvelope(0, 0, s_nationkey + 1, 2))), 9) ;; round((s_nationkey + 1) / 2, 9)
st_azimuth(a GEO, b GEO) DOUBLE = if(a = b, NULL, pmod(atan2(st_x(b) - st_x(a), st_y(b) - st_y(a)), 2 * pi())) ;; round(st_azimuth(st_makepoint(0, 0), st_makepoint(s_nationkey + 1, 0)), 9) ;; round(pi() / 2, 9)
st_distancesphere(a GEO, b GEO) DOUBLE = 2 * 6371008.7714150598D * asin(sqrt(pow(sin(radians(st_y(b) - st_y(a)) / 2), 2) + cos(radians(st_y(a))) * cos(radians(st_y(b))) * pow(sin(radians(st_x(b) - st_x(a)) / 2), 2))) ;; round(st_distancesphere(st_makepoint(0, 0), st_makepoint(s_nationkey, 0)), 3) ;; round(radians(s_nationkey) * 6371008.7714150598, 3)
covers_point(g GEO, px DOUBLE, py DOUBLE) BOOLEAN = st_dimension(g) = 2 AND exists(g.parts, p -> aggregate(p, false, (s, r) -> s <> ring_winds(r, px, py)) OR exists(p, r -> ring_distance(r, px, py) = 0))
outline_distance(g GEO, h GEO) DOUBLE = least(array_min(transform(st_allpoints(g), p -> array_min(transform(flatten(h.parts), r -> ring_distance(r, p.x, p.y))))), array_min(transform(st_allpoints(h), p -> array_min(transform(flatten(g.parts), r -> ring_distance(r, p.x, p.y))))))
st_intersects(g GEO, h GEO) BOOLEAN = exists(flatten(g.parts), a -> exists(flatten(h.parts), b -> rings_cross(a, b))) OR exists(st_allpoints(g), p -> covers_point(h, p.x, p.y)) OR exists(st_allpoints(h), p -> covers_point(g, p.x, p.y)) OR outline_distance(g, h) = 0 ;; st_intersects(st_makeenvelope(0, 0, 10, 10), st_makepoint(s_nationkey, 5)) ;; s_nationkey <= 10
st_disjoint(g GEO, h GEO) BOOLEAN = NOT st_intersects(g, h) ;; st_disjoint(st_makeenvelope(0, 0, 10, 10), st_makepoint(s_nationkey, 5)) ;; s_nationkey > 10
st_distance(g GEO, h GEO) DOUBLE = if(st_intersects(g, h), 0D, outline_distance(g, h)) ;; st_distance(st_makeenvelope(0, 0, 10, 10), st_makepoint(s_nationkey, 5)) ;; CAST(greatest(s_nationkey - 10, 0) AS DOUBLE)
st_maxdistance(g GEO, h GEO) DOUBLE = array_max(transform(st_allpoints(g), p -> array_max(transform(st_allpoints(h), q -> sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)))))) ;; st_maxdistance(st_makepoint(0, 0), st_makeline(st_makepoint(1, 0), st_makepoint(s_nationkey + 1, 0))) ;; CAST(s_nationkey + 1 AS DOUBLE)
st_dwithin(g GEO, h GEO, d DOUBLE) BOOLEAN = st_distance(g, h) <= d ;; st_dwithin(st_makepoint(0, 0), st_makepoint(s_nationkey, 0), 7) ;; s_nationkey <= 7
st_dfullywithin(g GEO, h GEO, d DOUBLE) BOOLEAN = st_maxdistance(g, h) <= d ;; st_dfullywithin(st_makepoint(0, 0), st_makepoint(s_nationkey, 0), 7) ;; s_nationkey <= 7
st_covers(g GEO, h GEO) BOOLEAN = CASE st_dimension(g) WHEN 2 THEN forall(st_allpoints(h), p -> covers_point(g, p.x, p.y)) AND NOT exists(flatten(g.parts), a -> exists(flatten(h.parts), b -> rings_cross(a, b))) AND (st_dimension(h) < 2 OR NOT exists(flatten(transform(g.parts, p -> flatten(slice(p, 2, greatest(size(p) - 1, 0))))), p -> covers_point(h, p.x, p.y) AND forall(flatten(h.parts), r -> ring_distance(r, p.x, p.y) > 0))) ELSE forall(st_allpoints(h), p -> exists(flatten(g.parts), r -> ring_distance(r, p.x, p.y) = 0)) END ;; st_covers(st_makeenvelope(0, 0, 10, 10), st_makepoint(s_nationkey, 10)) ;; s_nationkey <= 10
st_coveredby(g GEO, h GEO) BOOLEAN = st_covers(h, g) ;; st_coveredby(st_makepoint(s_nationkey, 10), st_makeenvelope(0, 0, 10, 10)) ;; s_nationkey <= 10
st_contains(g GEO, h GEO) BOOLEAN = st_covers(g, h) AND (st_dimension(g) < 2 OR st_dimension(h) = 2 OR exists(st_allpoints(h), p -> forall(flatten(g.parts), r -> ring_distance(r, p.x, p.y) > 0)) OR exists(flatten(h.parts), r -> exists(sequence(1, greatest(size(r) - 1, 1)), i -> coalesce(forall(flatten(g.parts), o -> ring_distance(o, (get(r, i).x + get(r, i - 1).x) / 2, (get(r, i).y + get(r, i - 1).y) / 2) > 0), false)))) ;; st_contains(st_makeenvelope(0, 0, 10, 10), st_makepoint(s_nationkey, 5)) ;; s_nationkey > 0 AND s_nationkey < 10
st_within(g GEO, h GEO) BOOLEAN = st_contains(h, g) ;; st_within(st_makepoint(s_nationkey, 5), st_makeenvelope(0, 0, 10, 10)) ;; s_nationkey > 0 AND s_nationkey < 10
st_containsproperly(g GEO, h GEO) BOOLEAN = st_covers(g, h) AND forall(st_allpoints(h), p -> forall(flatten(g.parts), r -> ring_distance(r, p.x, p.y) > 0)) ;; st_containsproperly(st_makeenvelope(0, 0, 10, 10), st_makepoint(s_nationkey, 5)) ;; s_nationkey > 0 AND s_nationkey < 10
st_equalsexact(g GEO, h GEO) BOOLEAN = g = h ;; st_equalsexact(st_makepoint(s_nationkey, 1), st_makepoint(3, 1)) ;; s_nationkey = 3
st_equals(g GEO, h GEO) BOOLEAN = st_covers(g, h) AND st_covers(h, g) ;; st_equals(st_makeenvelope(0, 0, s_nationkey, 1), st_reverse(st_makeenvelope(0, 0, 4, 1))) ;; s_nationkey = 4
st_linelocatepoint(g GEO, h GEO) DOUBLE = element_at(transform(array(g.parts[0][0]), r -> element_at(transform(array(array_min(transform(sequence(1, size(r) - 1), i -> named_struct('d', segment_distance(st_x(h), st_y(h), r[i - 1].x, r[i - 1].y, r[i].x, r[i].y), 'i', i)))), b -> (ring_length(slice(r, 1, b.i)) + least(greatest(coalesce(try_divide((st_x(h) - r[b.i - 1].x) * (r[b.i].x - r[b.i - 1].x) + (st_y(h) - r[b.i - 1].y) * (r[b.i].y - r[b.i - 1].y), sqrt(pow(r[b.i].x - r[b.i - 1].x, 2) + pow(r[b.i].y - r[b.i - 1].y, 2))), 0D), 0D), sqrt(pow(r[b.i].x - r[b.i - 1].x, 2) + pow(r[b.i].y - r[b.i - 1].y, 2)))) / ring_length(r)), 1)), 1) ;; round(st_linelocatepoint(st_makeline(st_makepoint(0, 0), st_makepoint(50, 0)), st_makepoint(s_nationkey, 3)), 9) ;; round(s_nationkey / 50, 9)
"""))

EDITS = parse("spatial", _typed(r"""
st_affine(g GEO, a DOUBLE, b DOUBLE, d DOUBLE, e DOUBLE, dx DOUBLE, dy DOUBLE) GEO = named_struct('kind', g.kind, 'parts', transform(g.parts, p -> transform(p, r -> transform(r, q -> named_struct('x', a * q.x + b * q.y + dx, 'y', d * q.x + e * q.y + dy)))))
st_translate(g GEO, dx DOUBLE, dy DOUBLE) GEO = st_affine(g, 1, 0, 0, 1, dx, dy) ;; st_astext(st_translate(st_makepoint(s_nationkey, 1), 2, 3)) ;; 'POINT(' || (s_nationkey + 2) || ' 4)'
st_scale(g GEO, sx DOUBLE, sy DOUBLE) GEO = st_affine(g, sx, 0, 0, sy, 0, 0) ;; st_astext(st_scale(st_makepoint(s_nationkey, 1), 2, 3)) ;; 'POINT(' || (s_nationkey * 2) || ' 3)'
st_transscale(g GEO, dx DOUBLE, dy DOUBLE, sx DOUBLE, sy DOUBLE) GEO = st_affine(g, sx, 0, 0, sy, dx * sx, dy * sy) ;; st_astext(st_transscale(st_makepoint(s_nationkey, 1), 1, 1, 2, 3)) ;; 'POINT(' || (s_nationkey * 2 + 2) || ' 6)'
st_rotate(g GEO, t DOUBLE) GEO = st_affine(g, cos(t), -sin(t), sin(t), cos(t), 0, 0) ;; round(st_y(st_rotate(st_makepoint(s_nationkey, 0), pi() / 2)), 9) ;; CAST(s_nationkey AS DOUBLE)
st_rotatez(g GEO, t DOUBLE) GEO = st_rotate(g, t) ;; round(st_y(st_rotatez(st_makepoint(s_nationkey, 0), pi() / 2)), 9) ;; CAST(s_nationkey AS DOUBLE)
st_flipcoordinates(g GEO) GEO = st_affine(g, 0, 1, 1, 0, 0, 0) ;; st_astext(st_flipcoordinates(st_makepoint(s_nationkey, 1))) ;; 'POINT(1 ' || s_nationkey || ')'
st_swapordinates(g GEO) GEO = st_flipcoordinates(g) ;; st_astext(st_swapordinates(st_makepoint(s_nationkey, 1))) ;; 'POINT(1 ' || s_nationkey || ')'
st_reverse(g GEO) GEO = named_struct('kind', g.kind, 'parts', transform(g.parts, p -> transform(p, r -> reverse(r)))) ;; st_astext(st_reverse(st_makeline(st_makepoint(0, 0), st_makepoint(s_nationkey, 1)))) ;; 'LINESTRING(' || s_nationkey || ' 1,0 0)'
st_force2d(g GEO) GEO = g ;; st_astext(st_force2d(st_makepoint(s_nationkey, 1))) ;; 'POINT(' || s_nationkey || ' 1)'
st_forcepolygonccw(g GEO) GEO = if(st_dimension(g) < 2, g, named_struct('kind', g.kind, 'parts', transform(g.parts, p -> transform(p, (r, i) -> if((ring_area2(r) > 0) = (i = 0), r, reverse(r)))))) ;; st_ispolygonccw(st_forcepolygonccw(st_makeenvelope(0, 0, s_nationkey + 1, 1))) ;; true
st_forcepolygoncw(g GEO) GEO = if(st_dimension(g) < 2, g, named_struct('kind', g.kind, 'parts', transform(g.parts, p -> transform(p, (r, i) -> if((ring_area2(r) < 0) = (i = 0), r, reverse(r)))))) ;; st_ispolygoncw(st_forcepolygoncw(st_makeenvelope(0, 0, s_nationkey + 1, 1))) ;; true
st_forcerhr(g GEO) GEO = st_forcepolygoncw(g) ;; st_ispolygoncw(st_forcerhr(st_makeenvelope(0, 0, s_nationkey + 1, 1))) ;; true
st_snaptogrid(g GEO, d DOUBLE) GEO = named_struct('kind', g.kind, 'parts', transform(g.parts, p -> transform(p, r -> aggregate(transform(r, q -> named_struct('x', rint(q.x / d) * d, 'y', rint(q.y / d) * d)), slice(r, 1, 0), (s, q) -> if(size(s) > 0 AND element_at(s, -1) = q, s, array_append(s, q)))))) ;; st_astext(st_snaptogrid(st_makepoint(s_nationkey + 0.3, 0.9), 1)) ;; 'POINT(' || s_nationkey || ' 1)'
st_removerepeatedpoints(g GEO) GEO = named_struct('kind', g.kind, 'parts', transform(g.parts, p -> transform(p, r -> filter(r, (q, i) -> i = 0 OR q <> r[i - 1]))))
st_addpoint(g GEO, h GEO) GEO = named_struct('kind', g.kind, 'parts', array(array(array_append(g.parts[0][0], h.parts[0][0][0])))) ;; st_npoints(st_addpoint(st_makeline(st_makepoint(0, 0), st_makepoint(s_nationkey, 1)), st_makepoint(5, 5))) ;; 3
st_setpoint(g GEO, n INT, h GEO) GEO = named_struct('kind', g.kind, 'parts', array(array(transform(g.parts[0][0], (q, i) -> if(i = if(n < 0, size(g.parts[0][0]) + n, n), h.parts[0][0][0], q))))) ;; st_astext(st_setpoint(st_makeline(st_makepoint(0, 0), st_makepoint(s_nationkey, 1)), 0, st_makepoint(5, 5))) ;; 'LINESTRING(5 5,' || s_nationkey || ' 1)'
st_removepoint(g GEO, n INT) GEO = named_struct('kind', g.kind, 'parts', array(array(filter(g.parts[0][0], (q, i) -> i <> n)))) ;; st_npoints(st_removepoint(st_makeline(st_makepoint(0, 0), st_makepoint(s_nationkey, 1)), 0)) ;; 1
st_shiftlongitude(g GEO) GEO = named_struct('kind', g.kind, 'parts', transform(g.parts, p -> transform(p, r -> transform(r, q -> named_struct('x', if(q.x < 0, q.x + 360, if(q.x > 180, q.x - 360, q.x)), 'y', q.y))))) ;; st_x(st_shiftlongitude(st_makepoint(-s_nationkey - 1, 0))) ;; CAST(359 - s_nationkey AS DOUBLE)
st_segmentize(g GEO, d DOUBLE) GEO = named_struct('kind', g.kind, 'parts', transform(g.parts, p -> transform(p, r -> flatten(transform(r, (q, i) -> if(i = 0, array(q), element_at(transform(array(CAST(greatest(ceil(sqrt(pow(q.x - r[i - 1].x, 2) + pow(q.y - r[i - 1].y, 2)) / d), 1) AS INT)), n -> transform(sequence(1, n), k -> named_struct('x', r[i - 1].x + (q.x - r[i - 1].x) * k / n, 'y', r[i - 1].y + (q.y - r[i - 1].y) * k / n))), 1))))))) ;; st_npoints(st_segmentize(st_makeline(st_makepoint(0, 0), st_makepoint(s_nationkey + 1, 0)), 1)) ;; CAST(s_nationkey + 2 AS INTEGER)
"""))

FUNCTIONS = _inlined([*RINGS, *CONSTRUCTORS, *ACCESSORS, *MEASURES, *EDITS])


def _point_range(g: Column, f: str, of: str) -> Column:
    return getattr(F, f"array_{f}")(F.transform(F.flatten(F.flatten(g["parts"])), lambda p: p[of]))


def extent(g) -> Column:
    """The envelope of all geometries of a group, as a struct; two minima and two maxima, aggregated within tasks first."""
    g = F.col(g) if isinstance(g, str) else g
    return F.struct(F.min(_point_range(g, "min", "x")).alias("xmin"), F.min(_point_range(g, "min", "y")).alias("ymin"), F.max(_point_range(g, "max", "x")).alias("xmax"), F.max(_point_range(g, "max", "y")).alias("ymax"))


def collected(g) -> Column:
    """A multi-geometry of a group's geometries; it holds all of them, so it is for groups of a known size."""
    g = F.col(g) if isinstance(g, str) else g
    return F.struct(F.concat(F.lit("MULTI"), F.regexp_replace(F.min(g["kind"]), "MULTI", "")).alias("kind"), F.flatten(F.collect_list(g["parts"])).alias("parts"))


def line_of(g, order) -> Column:
    """A line through a group's points in order of a column."""
    g = F.col(g) if isinstance(g, str) else g
    points = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), g["parts"][0][0][0].alias("p")))), lambda v: v["p"])
    return F.struct(F.lit("LINESTRING").alias("kind"), F.array(F.array(points)).alias("parts"))
