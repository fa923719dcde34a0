"""Array, set and vector functions.  Arrays are ARRAY columns; JSON text is for the edges only (from_json, to_json).

`element_at(transform(array(e), n -> ...), 1)` computes e once for a row and uses it as n in the inner lambda.
"""

from __future__ import annotations

from millrace.functions.registry import parse

LISTS = parse("array", r"""
array_append = builtin ;; array_append(sequence(1L, l_linenumber), 9L) ;; list_append(generate_series(1, l_linenumber), 9)
array_prepend = builtin ;; array_prepend(sequence(1L, l_linenumber), 0L) ;; list_prepend(0, generate_series(1, l_linenumber))
array_distinct = builtin ;; array_distinct(array(l_linenumber, 1, 1)) ;; CASE WHEN l_linenumber = 1 THEN [1] ELSE [l_linenumber, 1] END
array_remove = builtin ;; array_remove(sequence(1L, l_linenumber), 2L) ;; list_filter(generate_series(1, l_linenumber), lambda x: x <> 2)
array_intersect = builtin ;; array_intersect(sequence(1L, l_linenumber), array(2L, 3L)) ;; list_filter([2, 3]::BIGINT[], lambda x: x <= l_linenumber)
array_max = builtin ;; array_max(sequence(1L, l_linenumber)) ;; list_max(generate_series(1, l_linenumber))
array_min = builtin ;; array_min(sequence(2L, 1L + l_linenumber)) ;; list_min(generate_series(2, 1 + l_linenumber))
flatten = builtin ;; flatten(array(sequence(1L, l_linenumber), array(9L))) ;; list_append(generate_series(1, l_linenumber), 9)
list_cat(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) ARRAY<DOUBLE> = concat(a, b) ;; list_cat(array(l_quantity), array(l_tax)) ;; list_concat([l_quantity], [l_tax])
list_length(a ARRAY<DOUBLE>) INT = size(a) ;; list_length(sequence(1L, l_linenumber)) ;; CAST(l_linenumber AS INTEGER)
list_position(a ARRAY<DOUBLE>, v DOUBLE) BIGINT = nullif(array_position(a, v), 0L) ;; list_position(sequence(1L, l_linenumber), 3) ;; CASE WHEN l_linenumber >= 3 THEN 3::BIGINT END
list_to_string(a ARRAY<STRING>, sep STRING) STRING = array_join(a, sep, '') ;; list_to_string(array('a', l_returnflag), '-') ;; 'a-' || l_returnflag
list_slice(a ARRAY<DOUBLE>, lo INT, hi INT) ARRAY<DOUBLE> = if(greatest(if(lo < 0, lo + size(a) + 1, lo), 1) > least(if(hi < 0, hi + size(a) + 1, hi), size(a)), CAST(array() AS ARRAY<DOUBLE>), slice(a, greatest(if(lo < 0, lo + size(a) + 1, lo), 1), greatest(least(if(hi < 0, hi + size(a) + 1, hi), size(a)) - greatest(if(lo < 0, lo + size(a) + 1, lo), 1) + 1, 0))) ;; list_slice(sequence(1L, 5L), CAST(l_linenumber AS INT), 4) ;; list_slice([1.0, 2, 3, 4, 5]::DOUBLE[], l_linenumber, 4)
list_sort(a ARRAY<DOUBLE>) ARRAY<DOUBLE> = sort_array(a) ;; list_sort(array(l_quantity, l_tax, l_discount)) ;; list_sort([l_quantity, l_tax, l_discount])
list_contains(a ARRAY<DOUBLE>, v DOUBLE) BOOLEAN = exists(a, x -> x <=> v) ;; list_contains(sequence(1L, l_linenumber), 3) ;; l_linenumber >= 3
list_reverse(a ARRAY<DOUBLE>) ARRAY<DOUBLE> = reverse(a) ;; list_reverse(array(l_quantity, l_tax)) ;; [l_tax, l_quantity]
list_sum(a ARRAY<DOUBLE>) DOUBLE = aggregate(a, 0D, (s, x) -> s + coalesce(x, 0D)) ;; list_sum(sequence(1L, l_linenumber)) ;; CAST(l_linenumber * (l_linenumber + 1) / 2 AS DOUBLE)
list_product(a ARRAY<DOUBLE>) DOUBLE = aggregate(a, 1D, (s, x) -> s * coalesce(x, 1D)) ;; list_product(sequence(1L, l_linenumber)) ;; CAST(factorial(l_linenumber) AS DOUBLE)
list_count(a ARRAY<DOUBLE>) INT = size(filter(a, x -> x IS NOT NULL)) ;; list_count(array(l_quantity, NULL)) ;; 1
list_avg(a ARRAY<DOUBLE>) DOUBLE = aggregate(a, named_struct('s', 0D, 'n', 0D), (t, x) -> if(x IS NULL, t, named_struct('s', t.s + x, 'n', t.n + 1D)), t -> try_divide(t.s, t.n)) ;; list_avg(sequence(1L, l_linenumber)) ;; (l_linenumber + 1) / 2
list_min(a ARRAY<DOUBLE>) DOUBLE = array_min(a) ;; list_min(array(l_quantity, l_tax)) ;; least(l_quantity, l_tax)
list_max(a ARRAY<DOUBLE>) DOUBLE = array_max(a) ;; list_max(array(l_quantity, l_tax)) ;; greatest(l_quantity, l_tax)
array_dims(a ARRAY<DOUBLE>) STRING = if(size(a) = 0, NULL, concat('[1:', size(a), ']')) ;; array_dims(sequence(1L, l_linenumber)) ;; '[1:' || l_linenumber || ']'
array_lower(a ARRAY<DOUBLE>) INT = if(size(a) = 0, NULL, 1) ;; array_lower(array(l_tax)) ;; 1
array_upper(a ARRAY<DOUBLE>) INT = if(size(a) = 0, NULL, size(a)) ;; array_upper(array(l_tax)) ;; 1
array_ndims(a ARRAY<DOUBLE>) INT = if(size(a) = 0, NULL, 1) ;; array_ndims(array(l_tax)) ;; 1
array_positions(a ARRAY<DOUBLE>, v DOUBLE) ARRAY<INT> = filter(transform(a, (x, i) -> if(x <=> v, i + 1, NULL)), x -> x IS NOT NULL) ;; array_positions(array(1, l_linenumber, 1), 1) ;; CASE WHEN l_linenumber = 1 THEN [1, 2, 3] ELSE [1, 3] END
array_replace(a ARRAY<DOUBLE>, v DOUBLE, w DOUBLE) ARRAY<DOUBLE> = transform(a, x -> if(x <=> v, w, x)) ;; array_replace(array(l_quantity, 1), 1, 7) ;; [CASE WHEN l_quantity = 1 THEN 7 ELSE l_quantity END, 7]::DOUBLE[]
list_overlap(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) BOOLEAN = size(array_intersect(a, b)) > 0 ;; list_overlap(array(l_linenumber), array(1, 2)) ;; l_linenumber IN (1, 2)
set_union(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) ARRAY<DOUBLE> = array_union(a, b) ;; set_union(array(1), array(l_linenumber)) ;; (CASE WHEN l_linenumber = 1 THEN [1] ELSE [1, l_linenumber] END)::DOUBLE[]
set_intersection(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) ARRAY<DOUBLE> = array_intersect(a, b) ;; set_intersection(array(1, 2), array(l_linenumber)) ;; (CASE WHEN l_linenumber IN (1, 2) THEN [l_linenumber] ELSE [] END)::DOUBLE[]
set_difference(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) ARRAY<DOUBLE> = array_except(a, b) ;; set_difference(array(1, 2), array(l_linenumber)) ;; list_filter([1, 2], lambda x: x <> l_linenumber)::DOUBLE[]
set_unique(a ARRAY<DOUBLE>) ARRAY<DOUBLE> = array_distinct(a) ;; set_unique(array(l_tax, l_tax)) ;; [l_tax]
set_contains(a ARRAY<DOUBLE>, v DOUBLE) BOOLEAN = exists(a, x -> x <=> v) ;; set_contains(array(1, 2), l_linenumber) ;; l_linenumber IN (1, 2)
set_subset(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) BOOLEAN = size(array_except(a, b)) = 0 ;; set_subset(array(l_linenumber), array(1, 2, 3)) ;; l_linenumber IN (1, 2, 3)
set_disjoint(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) BOOLEAN = size(array_intersect(a, b)) = 0 ;; set_disjoint(array(l_linenumber), array(1)) ;; l_linenumber <> 1
set_sym_difference(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) ARRAY<DOUBLE> = concat(array_except(a, b), array_except(b, a)) ;; set_sym_difference(array(1), array(l_linenumber)) ;; (CASE WHEN l_linenumber = 1 THEN [] ELSE [1, l_linenumber] END)::DOUBLE[]
""")

VECTORS = parse("vector", r"""
vec_length(v ARRAY<FLOAT>) INT = size(v) ;; vec_length(embedding) ;; len(embedding)
vec_type(v ARRAY<FLOAT>) STRING = 'float32' ;; vec_type(embedding) ;; 'float32'
vec_to_json(v ARRAY<FLOAT>) STRING = to_json(v)
vec_distance_l1(a ARRAY<FLOAT>, b ARRAY<FLOAT>) DOUBLE = aggregate(zip_with(a, b, (x, y) -> abs(double(x) - double(y))), 0D, (s, x) -> s + x) ;; round(vec_distance_l1(embedding, reverse(embedding)), 5) ;; round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))), 5)
vec_distance_l2(a ARRAY<FLOAT>, b ARRAY<FLOAT>) DOUBLE = sqrt(aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x)) ;; round(vec_distance_l2(embedding, reverse(embedding)), 5) ;; round(sqrt(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 5)
vec_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) DOUBLE = aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x) ;; round(vec_dot(embedding, embedding), 5) ;; round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5)
vec_distance_cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) DOUBLE = coalesce(1D - try_divide(vec_dot(a, b), sqrt(vec_dot(a, a)) * sqrt(vec_dot(b, b))), double('NaN')) ;; round(vec_distance_cosine(embedding, reverse(embedding)), 5) ;; round(1 - list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5)
vec_add(a ARRAY<FLOAT>, b ARRAY<FLOAT>) ARRAY<FLOAT> = zip_with(a, b, (x, y) -> float(x + y)) ;; round(element_at(vec_add(embedding, embedding), 3), 5) ;; round(embedding[3] + embedding[3], 5)
vec_sub(a ARRAY<FLOAT>, b ARRAY<FLOAT>) ARRAY<FLOAT> = zip_with(a, b, (x, y) -> float(x - y)) ;; element_at(vec_sub(embedding, embedding), 3) ;; 0::FLOAT
vec_normalize(v ARRAY<FLOAT>) ARRAY<FLOAT> = element_at(transform(array(sqrt(vec_dot(v, v))), n -> transform(v, x -> float(try_divide(double(x), n)))), 1) ;; round(vec_dot(vec_normalize(embedding), vec_normalize(embedding)), 4) ;; 1.0::DOUBLE
vec_slice(v ARRAY<FLOAT>, lo INT, hi INT) ARRAY<FLOAT> = slice(v, least(greatest(if(lo < 0, lo + size(v), lo), 0), size(v)) + 1, greatest(least(greatest(if(hi < 0, hi + size(v), hi), 0), size(v)) - least(greatest(if(lo < 0, lo + size(v), lo), 0), size(v)), 0)) ;; size(vec_slice(embedding, 2, -2)) ;; len(embedding) - 4
vec_quantize_int8(v ARRAY<FLOAT>) ARRAY<INT> = element_at(transform(array(array_max(transform(v, y -> abs(double(y))))), m -> transform(v, x -> int(round(double(x) * 127 / m)))), 1) ;; array_max(transform(vec_quantize_int8(embedding), x -> abs(x))) ;; 127
vec_quantize_binary(v ARRAY<FLOAT>) STRING = array_join(transform(v, x -> if(x > 0, '1', '0')), '') ;; length(vec_quantize_binary(embedding)) ;; len(embedding)
minhash_jaccard(a ARRAY<BIGINT>, b ARRAY<BIGINT>) DOUBLE = aggregate(zip_with(a, b, (x, y) -> if(x = y, 1D, 0D)), 0D, (s, x) -> s + x) / size(a)
""")

FUNCTIONS = [*LISTS, *VECTORS]
