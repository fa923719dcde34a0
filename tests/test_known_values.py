"""Functions of the catalogue against values known from their standards, or worked out by other means."""

import base64
import bz2
import datetime
import gzip
import hashlib
import hmac
import json
import math
import statistics
import zlib

import pytest

from millrace.functions.registry import sql

D = datetime.datetime
ANY = object()

#: (call, value); a list or dict stands for JSON text.
CASES = [
    # text
    ("startsWithUTF8('grün', 'gr')", True), ("endsWithUTF8('grün', 'ün')", True), ("lengthUTF8('grün')", 4), ("lowerUTF8('GRÜN')", "grün"), ("upperUTF8('grün')", "GRÜN"),
    ("str_split_json('a,b,c', ',')", ["a", "b", "c"]), ("to_title_case('hello big world')", "Hello Big World"), ("natsort_compare('a2', 'a10')", -1),
    ("regexp_match('abc123', '[0-9]+')", ANY), ("numfmt_group(1234567.5, ' ')", "1 234 567.5"),
    ("unicode_nfc('e\\u0301')", "é"), ("length(unicode_nfd('\\u00e9'))", 2), ("unicode_nfkc('\\ufb01')", "fi"), ("unicode_nfkd('\\u00bd')", "1⁄2"), ("unicode_fold('Straße')", "strasse"), ("text_casefold('ẞ')", "ss"),
    ("unicode_strip_accents('Crème brûlée')", "Creme brulee"), ("unicode_normalize_whitespace('  a \\n b ')", "a b"), ("unicode_category('A')", "Lu"), ("unicode_grapheme_count('e\\u0301a')", 2),
    ("text_concat('a', 'b')", "ab"), ("text_join('-', 'a', 'b')", "a-b"), ("soundex('Robert')", "R163"),
    ("emoji_count('a😀b😀')", 2), ("emoji_strip('a😀b')", "ab"),
    # numbers
    ("nt_is_prime_exact(97)", 1), ("nt_is_prime_exact(91)", 0), ("nt_prev_prime(10)", 7), ("nt_divisors(12)", [1, 2, 3, 4, 6, 12]), ("nt_jacobi(2, 7)", 1), ("nt_jacobi(3, 7)", -1), ("nt_legendre(5, 11)", 1),
    ("math_lgamma(10D)", math.lgamma(10)), ("math_nextafter(1D, 2D)", math.nextafter(1, 2)), ("decimal_pow2(70)", str(2**70)),
    ("ieee754(3D, 4)", 48.0), ("ieee754_to_blob(1D)", bytes.fromhex("3ff0000000000000")), ("ieee754_from_blob(X'4000000000000000')", 2.0),
    ("la_zeros(1, 2)", [[0, 0]]), ("la_eye(2)", [[1, 0], [0, 1]]), ("la_transpose('[[1,2],[3,4]]')", [[1, 3], [2, 4]]), ("la_add('[[1]]', '[[2]]')", [[3]]), ("la_sub('[[1]]', '[[2]]')", [[-1]]), ("la_scale('[[1,2]]', 3D)", [[3, 6]]),
    ("la_rank('[[1,2],[2,4]]')", 1), ("la_trace('[[1,2],[3,4]]')", 5.0), ("la_shape('[[1,2,3]]')", [1, 3]),
    ("num_eval_polynomial('[1,2,3]', 2D)", 17.0), ("num_interp_linear('[[0,0],[10,100]]', 2.5D)", 25.0),
    ("minhash_jaccard(array(1L, 2L), array(1L, 3L))", 0.5), ("size_text(1536D)", ANY),
    ("bn_add(bn_from_text('99999999999999999999'), bn_from_int(1)) IS NOT NULL", True), ("bn_to_text(bn_add(bn_from_text('99999999999999999999'), bn_from_text('1')))", "100000000000000000000"),
    ("bn_to_text(bn_mul(bn_from_text('123456789012345678901'), bn_from_text('-2')))", "-246913578024691357802"), ("bn_to_text(bn_sub(bn_from_text('1'), bn_from_text('3')))", "-2"),
    ("bn_to_text(bn_modpow(bn_from_text('3'), bn_from_text('200'), bn_from_text('1000007')))", str(pow(3, 200, 1000007))), ("bn_to_text(bn_gcd(bn_from_text('84'), bn_from_text('30')))", "6"), ("bn_to_text(bn_abs(bn_from_text('-5')))", "5"),
    ("bn_cmp(bn_from_text('10'), bn_from_text('9'))", 1), ("bn_sign(bn_from_text('-10'))", -1), ("bn_bits(bn_from_text('255'))", 8), ("bn_to_int(bn_from_text('42'))", 42),
    ("decimal_add('0.1', '0.2')", "0.3"), ("decimal_sub('1', '0.9')", "0.1"), ("decimal_mul('2.5', '4')", "10.0"), ("decimal_add('1.5', '2.5')", "4.0"), ("decimal_sub('10.00', '3.25')", "6.75"),
    ("moving_average(array(1D, 2D, 3D, 4D), 2)", ANY),
    # dates
    ("chrono_months_between(TIMESTAMP'2024-03-15', TIMESTAMP'2024-01-15')", ANY), ("makedate(2024, 2, 29)", ANY), ("date_iso_week(TIMESTAMP'2021-01-03')", 53), ("date_iso_year(TIMESTAMP'2021-01-03')", 2020),
    ("date_business_days_between(TIMESTAMP'2024-01-01', TIMESTAMP'2024-01-08')", 5), ("timestamp_add(TIMESTAMP'2024-01-31', 1, 'months')", ANY), ("timestamp_diff(TIMESTAMP'2025-06-25', TIMESTAMP'2025-06-20', 'days')", 5),
    # identifiers
    ("upca_to_ean13('036000291452')", "0036000291452"), ("isin_check_digit('US037833100')", ANY), ("isin_country('US0378331005')", "US"), ("isin_nsin('US0378331005')", "037833100"), ("cusip_issuer('037833100')", "037833"), ("cusip_issue('037833100')", "10"),
    ("iban_normalize('gb82 west 1234 5698 7654 32')", "GB82WEST12345698765432"), ("iban_country('GB82WEST12345698765432')", "GB"), ("iban_check_digits('GB82WEST12345698765432')", "82"), ("iban_format('GB82WEST12345698765432')", "GB82 WEST 1234 5698 7654 32"),
    ("vin_wmi('1HGCM82633A004352')", "1HG"), ("vin_vds('1HGCM82633A004352')", "CM8263"), ("vin_vis('1HGCM82633A004352')", "3A004352"), ("bic_bank('DEUTDEFF500')", "DEUT"), ("bic_country('DEUTDEFF500')", "DE"), ("bic_location('DEUTDEFF500')", "FF"),
    ("container_owner('CSQU3054383')", "CSQ"), ("container_serial('CSQU3054383')", "305438"), ("container_category('CSQU3054383')", "U"),
    ("ssn_normalize('123-45-6789')", ANY), ("ssn_area('123-45-6789')", "123"), ("ssn_group('123-45-6789')", "45"), ("ssn_serial('123-45-6789')", "6789"),
    ("email_local('joe@example.com')", "joe"), ("email_domain('joe@example.com')", "example.com"), ("uuid_version('f47ac10b-58cc-4372-a567-0e02b2c3d479')", 4), ("uuid_nil()", "00000000-0000-0000-0000-000000000000"),
    ("semver_major('1.2.3-rc.1+b5')", 1), ("semver_minor('1.2.3-rc.1+b5')", 2), ("semver_patch('1.2.3-rc.1+b5')", 3), ("semver_pre('1.2.3-rc.1+b5')", "rc.1"), ("semver_build('1.2.3-rc.1+b5')", "b5"), ("semver_max('1.10.0', '1.9.9')", "1.10.0"), ("semver_validate('1.2')", ANY),
    # digests and codecs
    ("sha224('abc')", hashlib.sha224(b"abc").hexdigest()), ("sha384('abc')", hashlib.sha384(b"abc").hexdigest()), ("sha512('abc')", hashlib.sha512(b"abc").hexdigest()), ("sha3_224('abc')", hashlib.sha3_224(b"abc").hexdigest()), ("sha3_384('abc')", hashlib.sha3_384(b"abc").hexdigest()), ("sha3_512('abc')", hashlib.sha3_512(b"abc").hexdigest()),
    ("blake2s('abc')", hashlib.blake2s(b"abc").hexdigest()), ("hmac_sha256('key', 'msg')", hmac.new(b"key", b"msg", "sha256").hexdigest()), ("hmac_sha512('key', 'msg')", hmac.new(b"key", b"msg", "sha512").hexdigest()), ("sha1_hex('abc')", hashlib.sha1(b"abc").hexdigest()),
    ("crc64_xz('123456789')", 0x995DC9BBDF1939FA - (1 << 64)), ("crc64_ecma('123456789')", 0x6C40DF5F0B497347),
    ("html_decode_entities('&lt;a&gt; &amp; &eacute;')", "<a> & é"), ("html_encode_entities('<a> & b')", "&lt;a&gt; &amp; b"), ("shell_quote('it''s')", "'it'\"'\"'s'"),
    ("gzip_decompress(gzip_compress(CAST('hello' AS BINARY)))", b"hello"), ("zlib_decompress(zlib_compress(CAST('hello' AS BINARY)))", b"hello"), ("bzip2_decompress(bzip2_compress(CAST('hello' AS BINARY)))", b"hello"),
    (f"gzip_decompress(X'{gzip.compress(b'abc').hex()}')", b"abc"), (f"zlib_decompress(X'{zlib.compress(b'abc').hex()}')", b"abc"), (f"bzip2_decompress(X'{bz2.compress(b'abc').hex()}')", b"abc"),
    (f"base32_decode('{base64.b32encode(b'hello').decode()}')", ANY), ("color_red('#ff8000')", 255), ("color_green('#ff8000')", 128), ("color_blue('#ff8000')", 0), ("color_invert('#ff8000')", "#007fff"), ("color_luminance('#ffffff')", 1.0),
    # nets and places
    ("ip_family('192.168.1.1/24')", 4), ("ip_host('192.168.1.5/24')", "192.168.1.5"), ("ip_network('192.168.1.5/24')", "192.168.1.0"), ("ip_prefix_len('192.168.1.5/24')", 24), ("ip_contains('10.0.0.0/8', '10.2.3.4')", 1), ("ip_contains('10.0.0.0/8', '11.2.3.4')", 0), ("inet_same_family('10.0.0.1', '::1')", 0), ("is_ipv6('::1')", 1), ("is_ipv4_mapped('::ffff:1.2.3.4')", 1), ("inet6_ntoa(inet6_aton('2001:db8::1'))", "2001:db8::1"),
    ("url_join('http://a/b/c/d', '../g')", "http://a/b/g"), ("is_ipv4('1.2.3.4')", ANY),
    ("within_radius(0D, 0D, 0D, 0.5D, 60D)", ANY), ("idna_to_unicode('xn--mnchen-3ya')", "münchen"),
    # notations
    ("json_insert('{\"a\":1}', '$.b', 2)", {"a": 1, "b": 2}), ("json_replace('{\"a\":1}', '$.a', 2)", {"a": 2}), ("json_replace('{\"a\":1}', '$.b', 2)", {"a": 1}), ("json_quote('a\"b')", '"a\\"b"'), ("json_exists('{\"a\":1}', '$.a')", 1), ("json_array_append('{\"a\":[1]}', '$.a', 2)", {"a": [1, 2]}),
    ("toml_is_valid('a = 1')", 1), ("toml_is_valid('a = ')", 0), ("toml_get('[t]\\na = 5', 't.a')", ANY), ("xml_is_valid('<a><b/></a>')", 1), ("xml_is_valid('<a><b></a>')", 0), ("bencode_decode(bencode_encode('{\"a\":[1,\"x\"]}'))", {"a": [1, "x"]}), ("msgpack_decode(msgpack_encode('{\"a\":[1,true,null]}'))", {"a": [1, True, None]}), ("bencode_validate(CAST('i42e' AS BINARY))", 1), ("bencode_validate(CAST('i4' AS BINARY))", 0),
    ("sql_statement_count('SELECT 1; SELECT 2;')", 2), ("sql_statement_type('  insert into t values (1)')", "INSERT"), ("json5_is_valid('{a: 1,}')", 1),
    ("text_diff_summary('a\\nb', 'a\\nc')", ANY), ("split_sentences('One here. Two there! Three?')", ["One here.", "Two there!", "Three?"]), ("stem_porter('running')", "run"), ("stem_porter('caresses')", "caress"), ("stem_porter('ponies')", "poni"), ("stem_porter('relational')", "relat"),
    # arrays
    ("array_cat(array(1D), array(2D))", [1.0, 2.0]), ("array_concat(array(1D), array(2D))", [1.0, 2.0]), ("list_concat(array(1D), array(2D))", [1.0, 2.0]), ("array_length(array(1D, 2D))", 2), ("array_to_string(array('a', 'b'), '-')", "a-b"), ("array_reverse(array(1D, 2D))", [2.0, 1.0]), ("list_append(array(1D), 2D)", [1.0, 2.0]), ("list_prepend(0D, array(1D))", [0.0, 1.0]), ("list_indexof(array(5D, 6D), 6D)", 2), ("list_distinct(array(1D, 1D))", [1.0]), ("list_has(array(1D), 1D)", True), ("list_intersect(array(1D, 2D), array(2D))", [2.0]), ("array_sum(array(1D, NULL, 2D))", 3.0), ("array_product(array(2D, 3D))", 6.0), ("array_avg(array(1D, NULL, 2D))", 1.5), ("list_avg(CAST(array() AS ARRAY<DOUBLE>)) IS NULL", True), ("array_count(array(1D, NULL))", 1),
    ("rb_cardinality(array(1L, 2L))", 2), ("rb_contains(array(1L, 2L), 2L)", True), ("rb_intersection(array(1L, 2L), array(2L))", [2]), ("rb_difference(array(1L, 2L), array(2L))", [1]), ("minhash_merge(array(1L, 5L), array(2L, 3L))", [1, 3]),
    # statistics
    ("mc_bonferroni('[0.001,0.008,0.039,0.041,0.042]', 0.05D)", {"adjusted_alpha": 0.01, "reject_array": [1, 1, 0, 0, 0]}), ("json_array(1, 'a')", [1, "a"]),
    # values that the functions' families are defined by
    ("mc_holm('[0.039,0.001,0.041,0.008,0.042]', 0.05D)", {"sorted_indices": [1, 3, 0, 2, 4], "reject_array": [0, 1, 0, 1, 0]}), ("mc_bh_fdr('[0.001,0.008,0.039,0.041,0.042]', 0.05D)", {"threshold": 0.042, "reject_array": [1, 1, 1, 1, 1]}), ("mc_bonferroni('not json', 0.05D) IS NULL", True),
    ("doi_is_valid('10.1038.2/nphys1170')", 1), ("doi_normalize('DOI:10.1038/NPhys1170')", "10.1038/NPhys1170"), ("orcid_is_valid('https://orcid.org/0000-0002-1825-0097')", 1), ("isbn_is_valid(NULL) IS NULL", True), ("lccn_normalize('n78-890351')", "n78890351"), ("lccn_normalize('85-2')", "85000002"), ("lccn_is_valid('n78890351')", 1),
    ("cc_mask('4111-1111-1111-1111')", "XXXXXXXXXXXX1111"), ("cc_network('4111111111111111')", "Visa"), ("charindex('Hello, World!', 'l', 5)", 11), ("charindex('Hello', '')", 0), ("metaphone('Pittsburgh')", "PTSB"), ("humansize_duration(90061)", "1d 1h"), ("humansize_parse_bytes('500 bytes')", 500), ("humansize_parse_duration('garbage') IS NULL", True),
    ("iban_is_valid('XX00 1234 5678 9012 3456 78')", 0), ("iban_is_valid('GB82 WEST 1234 5698 7654 32')", 1), ("iban_is_valid('GB82 WEST 1234 5698 7654 3')", 0), ("json5_is_valid(NULL)", 0), ("toml_is_valid(NULL)", 0), ("yaml_is_valid(NULL)", 0), ("sitemap_is_valid('<rss><channel/></rss>')", 0), ("sitemap_is_valid(NULL)", 0),
    ("latlon_to_dms(-74.0060D, 'lon')", "74° 0' 21.60\" W"), ("latlon_to_ddm(-74.0060D, 'lon')", "74° 0.360' W"), ("latlon_to_dms(40.7128D, 'altitude') IS NULL", True), ("round(latlon_from_dms('-40.7128'), 4)", -40.7128), ("latlon_from_dms('not a coordinate') IS NULL", True), ("natsort_compare('1', '01')", -1), ("natsort_compare('APPLE', 'apple')", 0), ("ngrams_char(NULL, 2) IS NULL", True), ("ngrams_word('a b c', 2)", ["a b", "b c"]),
    ("num_integrate_simpson('[[1,0],[0,1]]') IS NULL", True), ("num_derive('[[0,0],[1,1]]', 5D) IS NULL", True), ("num_fit_polynomial('[[0,0],[1,1]]', 5) IS NULL", True), ("radix_to(-42, 16)", "-2A"), ("radix_to(1295, 36)", "ZZ"), ("radix_from('-2A', 16)", -42), ("radix_from('not hex', 16) IS NULL", True), ("radix_change('11111111', 2, 16)", "FF"), ("rb_cardinality(rb_from_range(10, 5))", 0), ("sentence_count('The U.S.A. is large. Canada too.')", 2),
    ("split_sentences_with_indices('Hi. Bye.')", [{"sentence": "Hi.", "start": 0, "end": 3}, {"sentence": "Bye.", "start": 4, "end": 8}]), ("sha1_hex(NULL) = sha1_hex('')", True), ("ssn_validate('078-05-1120')", 0), ("ssn_mask('123-45-6789')", "XXX-XX-6789"), ("tld_extract('   ') IS NULL", True), ("tointeger('0x2a')", 42), ("tointeger('42.0')", 42), ("conv_temperature(0D, 'C', 'foo') IS NULL", True), ("uuid_variant('550e8400-e29b-41d4-a716-446655440000')", "rfc4122"), ("uuid_v7_timestamp('550e8400-e29b-41d4-a716-446655440000') IS NULL", True), ("vat_normalize('1234') IS NULL", True),
    ("ua_os('Mozilla/5.0 (Macintosh; Intel Mac OS X 10.15; rv:120.0) Gecko/20100101 Firefox/120.0')", "Mac OSX"), ("ua_browser('') IS NULL", True), ("lower(hex(hkdf_sha256(X'0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b', NULL, NULL, 42)))", "8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d9d201395faa4b61a96c8"), ("hkdf_sha256(X'0b', X'00', X'f0', 0) IS NULL", True), ("hotp_verify('755224', 'this-is-not-base32!!!', 0)", 0), ("toml_keys('[server]\\nport = 8080\\nhost = \"x\"', 'server')", ["host", "port"]),
    ("aba_fed_region('021000021')", "New York"), ("pkce_challenge_s256('dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1gFWFOEjXk')", "E9Melhoa2OwvFrEMTJguCHaoeK1t8URWbuGJSstw-cM"), ("length(pkce_verifier(96))", 128), ("length(aead_random_key_256())", 32), ("length(aead_random_nonce_96())", 12), ("murmur3_32('hello')", 613153351), ("murmur3_32('')", 0), ("gamma(5)", 24.0),
    ("mann_whitney('[1,2,3,4]', '[5,6,7,8]')", ANY), ("get_json_object(ks_2samp('[1,2,3,4,5]', '[6,7,8,9,10]'), '$.D')", "1"), ("polyline_simplify_dp('[[0,0],[1,1],[2,2],[4,4]]', 0.001D)", [[0.0, 0.0], [4.0, 4.0]]), ("polyline_simplify_vw('[[5,2],[3,8],[6,20],[7,25],[10,10]]', 30D)", [[5.0, 2.0], [7.0, 25.0], [10.0, 10.0]]), ("polyline_simplify_vw('no', 1D) IS NULL", True),
    ("lower(hex(hkdf_sha256_extract(X'0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b', X'000102030405060708090a0b0c')))", "077709362c2e32df0ddc3f0dc47bba6390b6c73bb50f9c3122ec844ad7c2b3e5"), ("lower(hex(hkdf_sha256_expand(X'077709362c2e32df0ddc3f0dc47bba6390b6c73bb50f9c3122ec844ad7c2b3e5', X'f0f1f2f3f4f5f6f7f8f9', 42)))", "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"),
    # GLOB and keys
    ("glob_match('a*c', 'abbc')", True), ("glob_match('a?c', 'abbc')", False), ("glob_match('[a-c]x', 'bx')", True), ("glob_match('[^a-c]x', 'bx')", False), ("glob_match('a.c', 'abc')", False), ("uint_key('a2') < uint_key('a10')", True), ("text_nocase_key('AbC')", "abc"),
]


def shown(value, want):
    if isinstance(want, list | dict) and isinstance(value, str):
        return json.loads(value)
    return bytes(value) if isinstance(value, bytearray) else value


@pytest.mark.parametrize("at", range(0, len(CASES), 30))
def test_known(spark, at):
    some = CASES[at : at + 30]
    got = sql(spark, "SELECT " + ", ".join(f"{c} AS v{i}" for i, (c, _) in enumerate(some))).first()
    bad = []
    for (call, want), value in zip(some, got, strict=True):
        v = shown(value, want)
        if want is ANY:
            ok = value is not None
        elif isinstance(want, float):
            ok = v == pytest.approx(want, rel=1e-12)
        else:
            ok = v == want or (isinstance(want, int) and isinstance(v, bool | int) and int(v) == int(want))
        if not ok:
            bad.append((call, v, want))
    assert not bad


def test_statistics(spark):
    x, y = [2.1, 2.5, 3.6, 4.0, 4.4], [1.9, 2.0, 2.8, 3.1, 3.0]
    got = sql(spark, f"SELECT t_test_1samp('{x}', 3.0D) AS a, t_test_paired('{x}', '{y}') AS b, anova_f('[{x},{y}]') AS c").first()
    t = (statistics.mean(x) - 3) / (statistics.stdev(x) / math.sqrt(5))
    d = [p - q for p, q in zip(x, y, strict=True)]
    paired = statistics.mean(d) / (statistics.stdev(d) / math.sqrt(5))
    assert any(v == pytest.approx(t, rel=1e-9) for v in numbers(json.loads(got["a"]))) and any(v == pytest.approx(paired, rel=1e-9) for v in numbers(json.loads(got["b"])))


def numbers(v):
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, list):
        for x in v:
            yield from numbers(x)
    elif isinstance(v, int | float) and not isinstance(v, bool):
        yield v
