"""Known values of catalogue functions, in SQL."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions import json_text, text
from millrace.functions.codecs import base58_decode, base58_encode
from millrace.functions.geo import geohash_box, geohash_encode
from millrace.functions.mathematics import factors
from millrace.functions.registry import install, known, sql

VALUES = [
    ("humansize_bytes(0)", "0 B"),
    ("humansize_bytes(1500)", "1.5 KB"),
    ("humansize_ibytes(1536)", "1.5 KiB"),
    ("humansize_parse_bytes('1.5 KB')", 1500),
    ("humansize_parse_bytes('1.5 KiB')", 1536),
    ("humansize_duration(0)", "0s"),
    ("humansize_duration(90000)", "1d 1h"),
    ("humansize_parse_duration('1h 30m')", 5400),
    ("numfmt_commas(1234567.891, 2)", "1,234,567.89"),
    ("numfmt_ordinal(112)", "112th"),
    ("numfmt_ordinal(21)", "21st"),
    ("numfmt_percent(0.135, 1)", "13.5%"),
    ("numfmt_scientific(1234.5, 3)", "1.23e3"),
    ("numfmt_pad_left('42', 5, '0')", "00042"),
    ("to_snake_case('helloWorld again')", "hello_world_again"),
    ("to_camel_case('hello_world')", "helloWorld"),
    ("to_pascal_case('hello_world')", "HelloWorld"),
    ("to_train_case('hello world')", "Hello-World"),
    ("std_initcap('foo-bar baz_qux')", "Foo-Bar Baz_Qux"),
    ("unicode_chr(960)", "π"),
    ("natsort_less('file2', 'file10')", 1),
    ("ngrams_word('a b c', 2)", '["a b","b c"]'),
    ("text_slice('hello', 2, 4)", "el"),
    ("round(jaro('MARTHA', 'MARHTA'), 4)", 0.9444),
    ("round(jaro_winkler('MARTHA', 'MARHTA'), 4)", 0.9611),
    ("damerau_levenshtein('CA', 'ABC')", 2),
    ("levenshtein('CA', 'ABC')", 3),
    ("stem('relational')", "relat"),
    ("stem('hopping')", "hop"),
    ("sentiment_label('This is not good')", "negative"),
    ("sentence_count('Dr. No came. He left! Why?')", 3),
    ("isbn_is_valid('978-0-306-40615-7')", 1),
    ("isbn_normalize('0-306-40615-2')", "9780306406157"),
    ("issn_is_valid('0378-5955')", 1),
    ("orcid_is_valid('0000-0002-1825-0097')", 1),
    ("aba_validate('021000021')", 1),
    ("aba_validate('021000022')", 0),
    ("iban_is_valid('GB82 WEST 1234 5698 7654 32')", 1),
    ("iban_bban('DE89370400440532013000')", "370400440532013000"),
    ("cc_validate('4111 1111 1111 1111')", 1),
    ("cc_type('378282246310005')", "amex"),
    ("cusip_validate('037833100')", 1),
    ("isin_validate('US0378331005')", 1),
    ("cusip_to_isin('037833100')", "US0378331005"),
    ("lei_is_valid('529900T8BM49AURSDO55')", 1),
    ("vin_validate('1M8GDM9AXKP042788')", 1),
    ("container_validate('CSQU3054383')", 1),
    ("ean_validate('4006381333931')", 1),
    ("ean_check_digit('400638133393')", 1),
    ("bic_branch('DEUTDEFF')", "XXX"),
    ("ssn_validate('000-12-3456')", 0),
    ("roman_encode(1994)", "MCMXCIV"),
    ("roman_decode('XLIX')", 49),
    ("roman_validate('IIII')", 0),
    ("semver_compare('1.0.0-alpha.2', '1.0.0-alpha.10')", -1),
    ("semver_compare('1.0.0', '1.0.0-rc.1')", 1),
    ("sha3_256('test')", "36f028580bb02cc8272a9a020f4200e346e276ae664e45ee80745574e2f5ab80"),
    ("crc32('123456789')", 0xCBF43926),
    ("crc16('123456789')", 0xBB3D),
    ("crc32_bzip2('123456789')", 0xFC891918),
    ("xxh32('')", 0x02CC5D05),
    ("base32_encode('foobar')", "MZXW6YTBOI"),
    ("base58_encode('hello')", "Cn8eVZg"),
    ("morse_encode('SOS')", "... --- ..."),
    ("morse_decode('... --- ...')", "SOS"),
    ("escape_url('hello world')", "hello%20world"),
    ("html_unescape('&lt;b&gt;')", "<b>"),
    ("color_rgb_to_hex(255, 136, 0)", "#ff8800"),
    ("round(color_contrast_ratio('#000000', '#ffffff'), 1)", 21.0),
    ("ip_in_cidr('10.1.2.3', '10.0.0.0/8')", 1),
    ("ip_broadcast('192.168.1.0/24')", "192.168.1.255"),
    ("inet_ntoa(inet_aton('192.168.0.1'))", "192.168.0.1"),
    ("url_normalize('HTTP://Example.com:80')", "http://example.com/"),
    ("geohash_encode(57.64911, 10.40744, 11)", "u4pruydqqvj"),
    ("maidenhead_encode(48.1466, 11.6083, 3)", "JN58TD"),
    ("round(haversine(40.7128, -74.0060, 51.5074, -0.1278) / 1000)", 5570.0),
    ("iso_text(chrono_add(timestamp'2025-01-31', 1, 'months'))", "2025-02-28T00:00:00Z"),
    ("chrono_diff(timestamp'2025-06-25', timestamp'2025-06-20', 'days')", 5),
    ("chrono_diff(timestamp'2024-02-15 06:00:00', timestamp'2024-01-15 12:00:00', 'months')", 1),
    ("business_days_between(timestamp'2024-01-01', timestamp'2024-01-08')", 5),
    ("duration_parse('PT1H30M')", 5400),
    ("duration_parse('1d 3h')", 97200),
    ("cron_next('30 8 * * 1', '2024-01-01T08:30:00Z')", "2024-01-08T08:30:00Z"),
    ("nt_factorize(360)", '[{"prime":2,"power":3},{"prime":3,"power":2},{"prime":5,"power":1}]'),
    ("nt_is_prime(9223372036854775783)", 1),
    ("nt_totient(36)", 12),
    ("nt_modinv(3, 11)", 4),
    ("round(la_det('[[1,2],[3,4]]'), 9)", -2.0),
    ("la_mul('[[1,2],[3,4]]', '[[0,1],[1,0]]')", "[[2.0,1.0],[4.0,3.0]]"),
    ("la_inverse('[[1,2],[2,4]]')", None),
    ("round(num_integrate_simpson('[[0,0],[1,1],[2,4]]'), 6)", 2.666667),
    ("json_set('{\"a\":1}', '$.b', 'x')", '{"a":1,"b":"x"}'),
    ("json_remove('[1,2,3]', '$[1]')", "[1,3]"),
    ("json_patch('{\"a\":1,\"b\":2}', '{\"a\":null}')", '{"b":2}'),
    ("json_type('{\"a\":[1]}', '$.a')", "array"),
    ("template_render('Hi {{name}}{{#x}}!{{/x}}', '{\"name\":\"<A>\",\"x\":[1,2]}')", "Hi &lt;A&gt;!!"),
    ("unzorder2(zorder2(5, 7), 1)", 7),
    ("json5_parse('{a: 1, // x\n b: [0x10, +2, .5,], c: \\'q\\',}')", '{"a":1,"b":[16,2,0.5],"c":"q"}'),
    ("idna_to_ascii('bücher.example')", "xn--bcher-kva.example"),
    ("lower(hex(hkdf_sha256(unhex('0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b0b'), unhex('000102030405060708090a0b0c'), unhex('f0f1f2f3f4f5f6f7f8f9'), 42)))", "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"),
    ("utm_encode(40.7128, -74.006)", "18N 583959.37 4507351.00"),
    ("json_object('a', 1, 'b', 2)", '{"a":1,"b":2}'),
    ("array_slice(array(1, 2, 3, 4, 5), 2, 4)", [2.0, 3.0, 4.0]),
    ("unzorder(zorder(5, 7), 2, 0)", 5),
    ("string(aes_gcm_decrypt(binary('0123456789abcdef'), aes_gcm_encrypt(binary('0123456789abcdef'), binary('hi'), binary('123456789012')), binary('123456789012')))", "hi"),
    ("bar(10, 0, 10, 5)", "█████"),
    ("even(3)", 4.0),
    ("math_gamma(5)", 24.0),
    ("list_slice(array(1, 2, 3, 4, 5), -3, -1)", [3.0, 4.0, 5.0]),
    ("set_sym_difference(array(1, 2, 3), array(3, 4, 5))", [1.0, 2.0, 4.0, 5.0]),
]


@pytest.mark.parametrize(("call", "value"), VALUES, ids=[c for c, _ in VALUES])
def test_value(spark, call, value):
    got = sql(spark, f"SELECT {call} AS v").first()["v"]
    assert got == value


def test_all_install(spark):
    assert set(install(spark)) == set(known())


def test_null_in_null_out(spark):
    assert sql(spark, "SELECT jaro(NULL, 'x') AS a, json_set(NULL, '$.a', 'b') AS b, nt_gcd(NULL, 4L) AS c").first() == (None, None, None)


def test_domain_errors(spark):
    for call in ("math_sqrt(-1)", "math_log(0)", "math_factorial(21)"):
        with pytest.raises(Exception, match="argument"):
            sql(spark, f"SELECT {call} AS v").collect()


@given(st.binary(max_size=40))
def test_base58_round_trip(data):
    assert base58_decode(base58_encode(data)) == data


@given(st.integers(2, 10**12))
@settings(max_examples=60)
def test_factors_multiply_back(n):
    product = 1
    for p, k in factors(n).items():
        product *= p**k
    assert product == n


@given(st.floats(-89, 89), st.floats(-179, 179))
def test_geohash_holds_its_point(lat, lon):
    s, w, n, e = geohash_box(geohash_encode(lat, lon, 8))
    assert s <= lat <= n and w <= lon <= e


@given(st.text(max_size=12), st.text(max_size=12))
@settings(max_examples=80)
def test_string_distances(a, b):
    assert 0 <= text.jaro(a, b) <= 1
    assert text.damerau_levenshtein(a, b) == text.damerau_levenshtein(b, a) <= max(len(a), len(b))


def test_tests_of_hypotheses():
    got = json.loads(text.t_test([1, 2, 3, 4, 5], mu=2.0))
    assert got["df"] == 4 and abs(got["p"] - 0.2302) < 1e-3
    chi = json.loads(text.chi_square([16, 18, 16, 14, 12, 12], [16, 16, 16, 16, 16, 8], 5))
    assert abs(chi["chi2"] - 3.5) < 1e-9 and abs(chi["p"] - 0.6233876) < 1e-6
    five = "[0.001,0.008,0.039,0.041,0.042]"
    assert json.loads(text.rejected(five, 0.05, "bonferroni")) == {"adjusted_alpha": 0.01, "reject_array": [1, 1, 0, 0, 0]}
    assert json.loads(text.rejected("[0.039,0.001,0.041,0.008,0.042]", 0.05, "holm")) == {"sorted_indices": [1, 3, 0, 2, 4], "reject_array": [0, 1, 0, 1, 0]}
    assert json.loads(text.rejected(five, 0.05, "bh")) == {"threshold": 0.042, "reject_array": [1] * 5}
    assert text.rejected("[0.5,2]", 0.05, "by") is None


def test_json_paths():
    assert json_text.edit('{"a":[1,2]}', ["$.a[#]", 3], True, True) == '{"a":[1,2,3]}'
    assert json_text.edit('{"a":1}', ["$.a", 2], True, False) == '{"a":1}'
    assert json_text.remove('{"a":[1,2,3]}', "$.a[#-1]") == '{"a":[1,2]}'
