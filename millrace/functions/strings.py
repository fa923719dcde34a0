"""String functions: standard SQL names, extension string functions, letter case, sizes and number formats, regular expressions."""

from __future__ import annotations

import re
import unicodedata

from millrace.functions.registry import kernel, parse

STANDARD = parse("string", r"""
left = builtin ;; left(c_name, 5) ;; left(c_name, 5)
right = builtin ;; right(c_name, 5) ;; right(c_name, 5)
lpad = builtin ;; lpad(c_mktsegment, 12, '*') ;; lpad(c_mktsegment, 12, '*')
rpad = builtin ;; rpad(c_mktsegment, 12, '*') ;; rpad(c_mktsegment, 12, '*')
repeat = builtin ;; repeat(c_mktsegment, 2) ;; repeat(c_mktsegment, 2)
space = builtin ;; concat(space(3), c_mktsegment) ;; repeat(' ', 3) || c_mktsegment
translate = builtin ;; translate(c_name, 'Ce', 'xy') ;; translate(c_name, 'Ce', 'xy')
bit_length = builtin ;; bit_length(c_name) ;; bit_length(c_name)
octet_length = builtin ;; octet_length(c_name) ;; octet_length(encode(c_name))
char_length = builtin ;; char_length(c_name) ;; length(c_name)
character_length = builtin ;; character_length(c_name) ;; length(c_name)
ascii = builtin ;; ascii(c_mktsegment) ;; ascii(c_mktsegment)
greatest = builtin ;; greatest(c_name, c_mktsegment) ;; greatest(c_name, c_mktsegment)
least = builtin ;; least(c_name, c_mktsegment) ;; least(c_name, c_mktsegment)
reverse = builtin ;; reverse(c_name) ;; reverse(c_name)
lcase = builtin ;; lcase(c_name) ;; lower(c_name)
ucase = builtin ;; ucase(c_name) ;; upper(c_name)
locate = builtin ;; locate('0', c_name) ;; instr(c_name, '0')
split_part = builtin ;; split_part(c_name, '#', 2) ;; split_part(c_name, '#', 2)
concat_ws = builtin ;; concat_ws('-', c_name, c_mktsegment) ;; concat_ws('-', c_name, c_mktsegment)
btrim = builtin ;; btrim(c_name, 'C1') ;; trim(c_name, 'C1')
ltrim = builtin ;; ltrim('C', c_name) ;; ltrim(c_name, 'C')
rtrim = builtin ;; rtrim('1', c_name) ;; rtrim(c_name, '1')
starts_with(s STRING, p STRING) BOOLEAN = startswith(s, p) ;; starts_with(c_mktsegment, 'B') ;; starts_with(c_mktsegment, 'B')
ends_with(s STRING, p STRING) BOOLEAN = endswith(s, p) ;; ends_with(c_mktsegment, 'Y') ;; ends_with(c_mktsegment, 'Y')
startsWithUTF8(s STRING, p STRING) BOOLEAN = startswith(s, p)
endsWithUTF8(s STRING, p STRING) BOOLEAN = endswith(s, p)
to_hex(n BIGINT) STRING = lower(hex(n)) ;; to_hex(c_custkey) ;; lower(to_hex(c_custkey))
from_hex(s STRING) BINARY = unhex(s) ;; hex(from_hex(hex(c_name))) ;; hex(c_name)
to_bin(n BIGINT) STRING = bin(n) ;; to_bin(c_custkey) ;; to_binary(c_custkey)
to_oct(n BIGINT) STRING = conv(CAST(n AS STRING), 10, 8) ;; to_oct(c_custkey) ;; printf('%o', c_custkey)
to_ascii(s STRING) STRING = regexp_replace(s, '[^\\x00-\\x7F]', '') ;; to_ascii(concat(c_name, 'é')) ;; c_name
quote_ident(s STRING) STRING = concat('"', replace(s, '"', '""'), '"') ;; quote_ident(c_name) ;; '"' || c_name || '"'
quote_literal(s STRING) STRING = concat('\'', replace(s, '\'', '\'\''), '\'') ;; quote_literal(c_name) ;; '''' || c_name || ''''
quote_nullable(s STRING) STRING = coalesce(concat('\'', replace(s, '\'', '\'\''), '\''), 'NULL') ;; quote_nullable(nullif(c_mktsegment, 'BUILDING')) ;; CASE WHEN c_mktsegment = 'BUILDING' THEN 'NULL' ELSE '''' || c_mktsegment || '''' END
get_bit(n BIGINT, i INT) INT = CAST(getbit(n, i) AS INT) ;; get_bit(c_custkey, 1) ;; CAST((c_custkey >> 1) & 1 AS INTEGER)
set_bit(n BIGINT, i INT, v INT) BIGINT = if(v = 0, n & ~shiftleft(1L, i), n | shiftleft(1L, i)) ;; set_bit(c_custkey, 3, 1) ;; c_custkey | 8
get_byte(n BIGINT, i INT) INT = CAST(shiftrightunsigned(n, 8 * i) & 255L AS INT) ;; get_byte(c_custkey, 0) ;; CAST(c_custkey & 255 AS INTEGER)
set_byte(n BIGINT, i INT, v INT) BIGINT = (n & ~shiftleft(255L, 8 * i)) | shiftleft(CAST(v & 255 AS BIGINT), 8 * i) ;; set_byte(c_custkey, 1, 2) ;; (c_custkey & ~65280) | 512
unicode_chr(n INT) STRING = decode(encode(decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32'), 'UTF-8'), 'UTF-8') ;; unicode_chr(65 + CAST(c_custkey % 26 AS INT)) ;; chr(CAST(65 + c_custkey % 26 AS INTEGER))
lengthUTF8(s STRING) INT = char_length(s)
lowerUTF8(s STRING) STRING = lower(s)
upperUTF8(s STRING) STRING = upper(s)
toString(x STRING) STRING = x
empty(s STRING) INT = CAST(length(s) = 0 AS INT) ;; empty(c_name) ;; CAST(length(c_name) = 0 AS INTEGER)
notEmpty(s STRING) INT = CAST(length(s) > 0 AS INT) ;; notEmpty(c_name) ;; CAST(length(c_name) > 0 AS INTEGER)
replaceAll(s STRING, a STRING, b STRING) STRING = replace(s, a, b) ;; replaceAll(c_name, '0', '-') ;; replace(c_name, '0', '-')
positionUTF8(s STRING, p STRING) INT = instr(s, p) ;; positionUTF8(c_name, '#') ;; instr(c_name, '#')
std_initcap(s STRING) STRING = array_join(transform(sequence(1, greatest(length(s), 1)), i -> if(i = 1 OR substr(s, i - 1, 1) RLIKE '[\\s_-]', upper(substr(s, i, 1)), lower(substr(s, i, 1)))), '')
""")

EXTENSION = parse("string_ext", r"""
charindex(s STRING, needle STRING, start INT DEFAULT 1) INT = if(needle = '', 0, locate(needle, s, start)) ;; charindex(c_name, '0', 12) ;; CASE WHEN instr(substr(c_name, 12), '0') > 0 THEN instr(substr(c_name, 12), '0') + 11 ELSE 0 END
leftstr(s STRING, n INT) STRING = left(s, n) ;; leftstr(c_name, 4) ;; left(c_name, 4)
rightstr(s STRING, n INT) STRING = right(s, n) ;; rightstr(c_name, 4) ;; right(c_name, 4)
replicate(s STRING, n INT) STRING = repeat(s, n) ;; replicate(c_mktsegment, 3) ;; repeat(c_mktsegment, 3)
proper(s STRING) STRING = initcap(s) ;; proper(c_mktsegment) ;; upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))
padl(s STRING, n INT) STRING = if(length(s) >= n, s, lpad(s, n, ' ')) ;; padl(c_mktsegment, 9) ;; CASE WHEN length(c_mktsegment) >= 9 THEN c_mktsegment ELSE lpad(c_mktsegment, 9, ' ') END
padr(s STRING, n INT) STRING = if(length(s) >= n, s, rpad(s, n, ' ')) ;; padr(c_mktsegment, 9) ;; CASE WHEN length(c_mktsegment) >= 9 THEN c_mktsegment ELSE rpad(c_mktsegment, 9, ' ') END
padc(s STRING, n INT) STRING = if(length(s) >= n, s, concat(repeat(' ', (n - length(s)) div 2), s, repeat(' ', n - length(s) - (n - length(s)) div 2))) ;; padc(c_mktsegment, 13) ;; CASE WHEN length(c_mktsegment) >= 13 THEN c_mktsegment ELSE repeat(' ', (13 - length(c_mktsegment)) // 2) || c_mktsegment || repeat(' ', 13 - length(c_mktsegment) - (13 - length(c_mktsegment)) // 2) END
strfilter(s STRING, keep STRING) STRING = array_join(filter(split(s, ''), c -> instr(keep, c) > 0), '') ;; strfilter(c_mktsegment, 'AEIOU') ;; regexp_replace(c_mktsegment, '[^AEIOU]', '', 'g')
text_substring(s STRING, at INT, n INT DEFAULT 2147483647) STRING = substr(s, at, n) ;; text_substring(c_name, 3, 4) ;; substr(c_name, 3, 4)
text_slice(s STRING, a INT, b INT DEFAULT 2147483647) STRING = substr(s, greatest(if(a < 0, a + length(s), a - 1), 0) + 1, greatest(least(if(b < 0, b + length(s) + 1, b - 1), length(s)) - greatest(if(a < 0, a + length(s), a - 1), 0), 0))
text_left(s STRING, n INT) STRING = if(n < 0, substr(s, 1, greatest(length(s) + n, 0)), left(s, n)) ;; text_left(c_name, -3) ;; left(c_name, -3)
text_right(s STRING, n INT) STRING = if(n < 0, right(s, greatest(length(s) + n, 0)), right(s, n)) ;; text_right(c_name, -3) ;; right(c_name, -3)
text_index(s STRING, p STRING) INT = instr(s, p) ;; text_index(c_name, '0') ;; instr(c_name, '0')
strpos(s STRING, p STRING) INT = instr(s, p) ;; strpos(c_name, 'r') ;; strpos(c_name, 'r')
text_last_index(s STRING, p STRING) INT = if(instr(s, p) = 0, 0, length(s) - instr(reverse(s), reverse(p)) - length(p) + 2) ;; text_last_index(c_name, '0') ;; length(c_name) - instr(reverse(c_name), '0') + 1
text_contains(s STRING, p STRING) BOOLEAN = contains(s, p) ;; text_contains(c_name, '9') ;; contains(c_name, '9')
text_has_prefix(s STRING, p STRING) BOOLEAN = startswith(s, p) ;; text_has_prefix(c_mktsegment, 'F') ;; starts_with(c_mktsegment, 'F')
text_has_suffix(s STRING, p STRING) BOOLEAN = endswith(s, p) ;; text_has_suffix(c_name, '7') ;; ends_with(c_name, '7')
text_count(s STRING, p STRING) INT = if(length(p) = 0, 0, CAST((length(s) - length(replace(s, p, ''))) / length(p) AS INT)) ;; text_count(c_name, '0') ;; CAST(length(c_name) - length(replace(c_name, '0', '')) AS INTEGER)
text_like(s STRING, p STRING) BOOLEAN = s ILIKE p ;; text_like(c_mktsegment, 'b%') ;; c_mktsegment ILIKE 'b%'
text_split(s STRING, sep STRING, n INT) STRING = split_part(s, sep, n) ;; text_split(c_name, '#', 1) ;; split_part(c_name, '#', 1)
text_repeat(s STRING, n INT) STRING = repeat(s, n) ;; text_repeat(c_mktsegment, 2) ;; repeat(c_mktsegment, 2)
text_ltrim(s STRING, chars STRING DEFAULT ' ') STRING = ltrim(chars, s) ;; text_ltrim(c_name, 'Cu') ;; ltrim(c_name, 'Cu')
text_rtrim(s STRING, chars STRING DEFAULT ' ') STRING = rtrim(chars, s) ;; text_rtrim(c_name, '01') ;; rtrim(c_name, '01')
text_trim(s STRING, chars STRING DEFAULT ' ') STRING = btrim(s, chars) ;; text_trim(c_name, 'C1') ;; trim(c_name, 'C1')
text_lpad(s STRING, n INT, fill STRING DEFAULT ' ') STRING = lpad(s, n, fill) ;; text_lpad(c_mktsegment, 12, '.') ;; lpad(c_mktsegment, 12, '.')
text_rpad(s STRING, n INT, fill STRING DEFAULT ' ') STRING = rpad(s, n, fill) ;; text_rpad(c_mktsegment, 12, '.') ;; rpad(c_mktsegment, 12, '.')
text_upper(s STRING) STRING = upper(s) ;; text_upper(c_name) ;; upper(c_name)
text_lower(s STRING) STRING = lower(s) ;; text_lower(c_name) ;; lower(c_name)
text_title(s STRING) STRING = initcap(s) ;; text_title(c_mktsegment) ;; upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))
text_replace(s STRING, a STRING, b STRING) STRING = replace(s, a, b) ;; text_replace(c_name, '00', 'x') ;; replace(c_name, '00', 'x')
text_translate(s STRING, a STRING, b STRING) STRING = translate(s, a, b) ;; text_translate(c_name, '01', 'ab') ;; translate(c_name, '01', 'ab')
text_reverse(s STRING) STRING = reverse(s) ;; text_reverse(c_name) ;; reverse(c_name)
text_length(s STRING) INT = char_length(s) ;; text_length(c_name) ;; length(c_name)
text_size(s STRING) INT = octet_length(s) ;; text_size(c_name) ;; octet_length(encode(c_name))
text_bitsize(s STRING) INT = bit_length(s) ;; text_bitsize(c_name) ;; bit_length(c_name)
insert_text(s STRING, at INT, n INT, new STRING) STRING = overlay(s PLACING new FROM at FOR n) ;; insert_text(c_name, 2, 3, 'xy') ;; left(c_name, 1) || 'xy' || substr(c_name, 5)
string_split(s STRING, sep STRING) STRING = to_json(split(s, concat('\\Q', sep, '\\E'))) ;; string_split(c_name, '#') ;; '["' || replace(c_name, '#', '","') || '"]'
str_split_json(s STRING, sep STRING) STRING = to_json(split(s, concat('\\Q', sep, '\\E')))
""")

CASES = parse("case", r"""
case_words(s STRING) ARRAY<STRING> = filter(split(regexp_replace(regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '$1 $2'), '([A-Z]+)([A-Z][a-z])', '$1 $2'), '[^\\p{L}\\p{N}]+', ' '), ' '), w -> w <> '')
to_snake_case(s STRING) STRING = lower(array_join(case_words(s), '_')) ;; to_snake_case(p_type) ;; lower(replace(p_type, ' ', '_'))
to_kebab_case(s STRING) STRING = lower(array_join(case_words(s), '-')) ;; to_kebab_case(p_type) ;; lower(replace(p_type, ' ', '-'))
to_screaming_snake(s STRING) STRING = upper(array_join(case_words(s), '_')) ;; to_screaming_snake(p_type) ;; upper(replace(p_type, ' ', '_'))
to_screaming_kebab(s STRING) STRING = upper(array_join(case_words(s), '-')) ;; to_screaming_kebab(p_type) ;; upper(replace(p_type, ' ', '-'))
to_pascal_case(s STRING) STRING = array_join(transform(case_words(s), w -> initcap(w)), '')
to_camel_case(s STRING) STRING = array_join(transform(case_words(s), (w, i) -> if(i = 0, lower(w), initcap(w))), '')
to_title_case(s STRING) STRING = array_join(transform(case_words(s), w -> initcap(w)), ' ')
to_train_case(s STRING) STRING = array_join(transform(case_words(s), w -> initcap(w)), '-')
""")

NUMBERS = parse("number_format", r"""
size_unit(n DOUBLE, base DOUBLE) INT = if(n < base, 0, CAST(least(6D, floor(ln(n) / ln(base) + 1e-12)) AS INT))
size_text(x DOUBLE) STRING = if(round(x, 1) = floor(x), CAST(CAST(floor(x) AS BIGINT) AS STRING), CAST(round(x, 1) AS STRING))
humansize_bytes(n DOUBLE) STRING = concat(if(n < 0, '-', ''), size_text(abs(n) / pow(1000D, size_unit(abs(n), 1000D))), ' ', element_at(array('B', 'KB', 'MB', 'GB', 'TB', 'PB', 'EB'), size_unit(abs(n), 1000D) + 1))
humansize_ibytes(n DOUBLE) STRING = concat(if(n < 0, '-', ''), size_text(abs(n) / pow(1024D, size_unit(abs(n), 1024D))), ' ', element_at(array('B', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB', 'EiB'), size_unit(abs(n), 1024D) + 1))
humansize_parse_bytes(s STRING) BIGINT = CAST(round(try_cast(regexp_extract(trim(s), '^([0-9.]+)\\s*([A-Za-z]*)$', 1) AS DOUBLE) * CASE lower(regexp_extract(trim(s), '^([0-9.]+)\\s*([A-Za-z]*)$', 2)) WHEN '' THEN 1D WHEN 'b' THEN 1D WHEN 'byte' THEN 1D WHEN 'bytes' THEN 1D WHEN 'kb' THEN 1e3 WHEN 'mb' THEN 1e6 WHEN 'gb' THEN 1e9 WHEN 'tb' THEN 1e12 WHEN 'pb' THEN 1e15 WHEN 'kib' THEN 1024D WHEN 'mib' THEN 1048576D WHEN 'gib' THEN 1073741824D WHEN 'tib' THEN 1099511627776D END) AS BIGINT) ;; humansize_parse_bytes(concat(p_size, ' KB')) ;; CAST(p_size * 1000 AS BIGINT)
humansize_duration(n BIGINT) STRING = if(n = 0, '0s', regexp_extract(concat_ws(' ', if(n >= 86400, concat(n div 86400, 'd'), NULL), if(n % 86400 >= 3600, concat(n % 86400 div 3600, 'h'), NULL), if(n % 3600 >= 60, concat(n % 3600 div 60, 'm'), NULL), if(n % 60 > 0, concat(n % 60, 's'), NULL)), '^(\\S+( \\S+)?)', 1)) ;; humansize_duration(p_size * 60) ;; CASE WHEN p_size % 60 = 0 THEN '1h' ELSE p_size || 'm' END
humansize_parse_duration(s STRING) BIGINT = if(NOT s RLIKE '[0-9]\\s*[dhms]', NULL, aggregate(transform(regexp_extract_all(s, '([0-9]+\\s*[dhms])', 1), p -> CAST(regexp_extract(p, '([0-9]+)', 1) AS BIGINT) * CASE right(p, 1) WHEN 'd' THEN 86400L WHEN 'h' THEN 3600L WHEN 'm' THEN 60L ELSE 1L END), 0L, (a, b) -> a + b))
numfmt_commas(n DOUBLE, places INT) STRING = format_number(n, places) ;; numfmt_commas(p_retailprice, 2) ;; printf('%,.2f', p_retailprice)
numfmt_fixed(n DOUBLE, places INT) STRING = format_string(concat('%.', places, 'f'), n) ;; numfmt_fixed(p_retailprice, 1) ;; printf('%.1f', p_retailprice)
numfmt_ordinal(n BIGINT) STRING = concat(n, CASE WHEN abs(n) % 100 BETWEEN 11 AND 13 THEN 'th' WHEN abs(n) % 10 = 1 THEN 'st' WHEN abs(n) % 10 = 2 THEN 'nd' WHEN abs(n) % 10 = 3 THEN 'rd' ELSE 'th' END) ;; numfmt_ordinal(p_size) ;; p_size || CASE WHEN p_size % 100 IN (11, 12, 13) THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END
numfmt_scientific(n DOUBLE, digits INT) STRING = regexp_replace(regexp_replace(format_string(concat('%.', digits - 1, 'e'), n), 'e\\+0*', 'e'), 'e-0*', 'e-')
numfmt_percent(n DOUBLE, places INT) STRING = concat(format_string(concat('%.', places, 'f'), n * 100), '%') ;; numfmt_percent(p_size / 100D, 0) ;; p_size || '%'
numfmt_pad_left(s STRING, n INT, fill STRING) STRING = if(length(s) >= n, s, lpad(s, n, fill)) ;; numfmt_pad_left(CAST(p_size AS STRING), 5, '0') ;; lpad(CAST(p_size AS VARCHAR), 5, '0')
numfmt_group(n DOUBLE, sep STRING) STRING = replace(regexp_replace(format_string('%,.6f', n), '\\.?0+$', ''), ',', sep)
natsort_key(s STRING) STRING = array_join(transform(regexp_extract_all(lower(s), '([0-9]+|[^0-9]+)', 1), p -> if(p RLIKE '^[0-9]+$', lpad(ltrim('0', p), 20, '0'), p)), '') ;; natsort_key(p_brand) ;; regexp_replace(lower(p_brand), '([0-9]+)', '') || lpad(regexp_extract(p_brand, '[0-9]+'), 20, '0')
uint_key(s STRING) STRING = array_join(transform(regexp_extract_all(s, '([0-9]+|[^0-9]+)', 1), p -> if(p RLIKE '^[0-9]+$', lpad(ltrim('0', p), 20, '0'), p)), '') ;; uint_key(p_brand) ;; regexp_replace(p_brand, '[0-9]+', lpad(ltrim(regexp_extract(p_brand, '[0-9]+'), '0'), 20, '0'))
text_nocase_key(s STRING) STRING = lower(s) ;; text_nocase_key(p_brand) ;; lower(p_brand)
glob_match(p STRING, s STRING) BOOLEAN = s RLIKE concat('(?s)^', replace(replace(regexp_replace(regexp_replace(p, '([.+$(){}|\\\\])', '\\\\$1'), '(?<!\\[)\\^', '\\\\^'), '*', '.*'), '?', '.'), '$') ;; glob_match('B*d#[1-4]?', p_brand) ;; p_brand GLOB 'B*d#[1-4]?'
natsort_compare(a STRING, b STRING) INT = CASE WHEN natsort_key(a) < natsort_key(b) THEN -1 WHEN natsort_key(a) > natsort_key(b) THEN 1 WHEN length(a) <> length(b) THEN CAST(sign(length(a) - length(b)) AS INT) ELSE 0 END
natsort_less(a STRING, b STRING) INT = CAST(natsort_key(a) < natsort_key(b) AS INT)
ngrams_char(s STRING, n INT) STRING = if(s IS NULL OR n IS NULL, NULL, to_json(if(length(s) < n, CAST(array() AS ARRAY<STRING>), transform(sequence(1, greatest(length(s) - n + 1, 1)), i -> substr(s, i, n))))) ;; ngrams_char(left(p_brand, 3), 2) ;; '["' || left(p_brand, 2) || '","' || substr(p_brand, 2, 2) || '"]'
ngrams_word(s STRING, n INT) STRING = if(s IS NULL OR n IS NULL, NULL, to_json(if(size(split(trim(s), '\\s+')) < n OR trim(s) = '', CAST(array() AS ARRAY<STRING>), transform(sequence(1, greatest(size(split(trim(s), '\\s+')) - n + 1, 1)), i -> array_join(slice(split(trim(s), '\\s+'), i, n), ' ')))))
ngrams_count_char(s STRING, n INT) INT = if(s IS NULL OR n IS NULL, NULL, greatest(length(s) - n + 1, 0)) ;; ngrams_count_char(p_name, 3) ;; greatest(length(p_name) - 2, 0)
ngrams_count_word(s STRING, n INT) INT = if(s IS NULL OR n IS NULL, NULL, if(trim(s) = '', 0, greatest(size(split(trim(s), '\\s+')) - n + 1, 0))) ;; ngrams_count_word(p_type, 2) ;; greatest(len(string_split(p_type, ' ')) - 1, 0)
""")

REGEX = parse("regex", r"""
regexp_like = builtin ;; regexp_like(p_name, '[0-9]+$') ;; regexp_matches(p_name, '[0-9]+$')
regexp_substr = builtin ;; regexp_substr(p_brand, '[0-9]') ;; nullif(regexp_extract(p_brand, '[0-9]'), '')
regexp_replace = builtin ;; regexp_replace(p_brand, '[0-9]', 'x') ;; regexp_replace(p_brand, '[0-9]', 'x', 'g')
regexp_instr = builtin ;; regexp_instr(p_brand, '[0-9]') ;; CASE WHEN regexp_matches(p_brand, '[0-9]') THEN length(regexp_extract(p_brand, '^[^0-9]*')) + 1 ELSE 0 END
regexp_count = builtin ;; regexp_count(p_brand, '[0-9]') ;; len(regexp_extract_all(p_brand, '[0-9]'))
regexp_pattern(pattern STRING, s STRING) BOOLEAN = s RLIKE pattern ;; regexp_pattern('^B', p_brand) ;; regexp_matches(p_brand, '^B')
regexp_contains(s STRING, pattern STRING) BOOLEAN = s RLIKE pattern ;; regexp_contains(p_brand, '3') ;; regexp_matches(p_brand, '3')
regexp_first(s STRING, pattern STRING) STRING = regexp_substr(s, pattern) ;; regexp_first(p_brand, '[0-9]+') ;; nullif(regexp_extract(p_brand, '[0-9]+'), '')
regexp_match(s STRING, pattern STRING) STRING = regexp_substr(s, pattern)
regexp_matches(s STRING, pattern STRING) STRING = to_json(regexp_extract_all(s, pattern, 0)) ;; regexp_matches(p_brand, '[0-9]') ;; CAST(to_json(regexp_extract_all(p_brand, '[0-9]')) AS VARCHAR)
regexp_split_to_array(s STRING, pattern STRING) STRING = to_json(split(s, pattern)) ;; regexp_split_to_array(p_type, ' +') ;; CAST(to_json(regexp_split_to_array(p_type, ' +')) AS VARCHAR)
glob(pattern STRING, s STRING) BOOLEAN = s RLIKE concat('(?s)^', regexp_replace(regexp_replace(regexp_replace(pattern, '([.+^$(){}|\\\\])', '\\\\$1'), '\\*', '.*'), '\\?', '.'), '$') ;; glob('B*1?', p_brand) ;; p_brand GLOB 'B*1?'
""")


def slug(s: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", "-", plain.lower()).strip("-")


def graphemes(s: str) -> int:
    import regex

    return len(regex.findall(r"\X", s))


UNICODE = [
    *(kernel("unicode", f"unicode_{form.lower()}", "string", lambda s, form=form: unicodedata.normalize(form, s)) for form in ("NFC", "NFD", "NFKC", "NFKD")),
    kernel("unicode", "unicode_fold", "string", str.casefold),
    kernel("unicode", "text_casefold", "string", str.casefold),
    kernel("unicode", "unicode_strip_accents", "string", lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))),
    kernel("unicode", "unicode_slugify", "string", slug),
    kernel("unicode", "unicode_normalize_whitespace", "string", lambda s: " ".join(s.split())),
    kernel("unicode", "unicode_category", "string", lambda s: unicodedata.category(s[0]) if s else None),
    kernel("unicode", "unicode_grapheme_count", "long", graphemes),
]

FUNCTIONS = [*STANDARD, *EXTENSION, *CASES, *NUMBERS, *REGEX, *UNICODE]
