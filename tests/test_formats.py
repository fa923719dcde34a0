"""Known values of the format kernels."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.functions import formats as f
from millrace.functions.registry import sql

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(1 << 40), 1 << 40) | st.text(max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4), max_leaves=12)


@given(JSON)
def test_binary_notations_round_trip(x):
    assert f.uncbor(f.cbor(x)) == x
    assert f.unmsgpack(f.msgpack(x)) == x


@given(st.recursive(st.integers() | st.text(max_size=6), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=4), c, max_size=3), max_leaves=8))
def test_bencode_round_trips(x):
    assert f.bdecode(f.bencode(x)) == x


CARD = "BEGIN:VCARD\nVERSION:3.0\nFN:Ada L\nEMAIL;TYPE=work:a@x.org\nEMAIL:b@x.org\nEND:VCARD"
CALENDAR = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:One\n  more\nDTSTART:20240101T090000Z\nEND:VEVENT\nBEGIN:VTODO\nEND:VTODO\nEND:VCALENDAR"
GGA = "$GPGGA,123519,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,*47"
ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 2\n\nUser-agent: bot\nDisallow: /"
MAP = "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc>http://a/</loc></url><url><loc>http://b/</loc></url></urlset>"
CASES = [
    ("yaml_to_json", ["a: [1, two]"], '{"a":[1,"two"]}'),
    ("yaml_get", ["a:\n  b: 3", "a.b"], "3"),
    ("toml_to_json", ["[t]\nx = 1"], '{"t":{"x":1}}'),
    ("json_to_toml", ['{"x":1,"t":{"y":"z"}}'], 'x = 1\n[t]\ny = "z"'),
    ("ini_to_json", ["[a]\nk = v"], '{"a":{"k":"v"}}'),
    ("xml_to_json", ["<a x='1'><b>t</b><b>u</b></a>"], '{"a":{"@x":"1","b":["t","u"]}}'),
    ("yaml_is_valid", ["a: [1"], 0),
    ("vcard_fn", [CARD], "Ada L"),
    ("vcard_emails", [CARD], '["a@x.org","b@x.org"]'),
    ("ical_event_count", [CALENDAR], 1),
    ("ical_todo_count", [CALENDAR], 1),
    ("ical_summaries", [CALENDAR], '["One more"]'),
    ("mailto_to", ["mailto:a@x.org,b@x.org?subject=Hi%20you"], "a@x.org,b@x.org"),
    ("mailto_subject", ["mailto:a@x.org?subject=Hi%20you"], "Hi you"),
    ("mbox_message_count", ["From a\nSubject: x\n\nbody\nFrom b\nSubject: y\n\nmore\n"], 2),
    ("mbox_subjects", ["From a\nSubject: x\n\nbody\nFrom b\nSubject: y\n\nmore\n"], '["x","y"]'),
    ("nmea_checksum_ok", [GGA], 1),
    ("nmea_lat", [GGA], 48.1173),
    ("nmea_satellites", [GGA], 8),
    ("hotp_generate", ["GEZDGNBVGY3TQOJQGEZDGNBVGY3TQOJQ", 1], "287082"),
    ("totp_generate", ["GEZDGNBVGY3TQOJQGEZDGNBVGY3TQOJQ", 59, 30, 8], "94287082"),
    ("pkce_challenge", ["dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1gFWFOEjXk"], "E9Melhoa2OwvFrEMTJguCHaoeK1t8URWbuGJSstw-cM"),
    ("robots_is_allowed", [ROBOTS, "any", "http://x/private/a"], 0),
    ("robots_is_allowed", [ROBOTS, "any", "http://x/private/open/a"], 1),
    ("robots_is_allowed", [ROBOTS, "MyBot/1.0", "http://x/"], 0),
    ("robots_crawl_delay", [ROBOTS, "any"], 2.0),
    ("sitemap_urls", [MAP], '["http://a/","http://b/"]'),
    ("markdown_to_html", ["# T\n\nA **b** [c](d)\n\n- x\n- y"], '<h1>T</h1>\n<p>A <strong>b</strong> <a href="d">c</a></p>\n<ul><li>x</li><li>y</li></ul>'),
    ("bn_pow", ["2", 100], str(2**100)),
    ("bn_div", ["-7", "2"], "-3"),
    ("bn_mod", ["-7", "2"], "-1"),
    ("convolve", ["[1,2]", "[1,1]"], "[1,3,2]"),
    ("peak_detect", ["[0,3,0,1,0]", 2.0], "[1]"),
    ("sql_is_readonly", ["SELECT 1"], 1),
    ("sql_normalize", ["SELECT  'x', 12"], "select ?, ?"),
]


@pytest.mark.parametrize(("name", "arguments", "value"), CASES)
def test_kernel(name, arguments, value):
    assert {x.name: x for x in f.FUNCTIONS}[name].kernel(*arguments) == value


def test_tokens():
    t = f.jwt_encode('{"typ":"JWT"}', '{"sub":"1"}', "key", "HS256")
    k = {x.name: x.kernel for x in f.FUNCTIONS}
    assert k["jwt_verify"](t, "key", "HS256") == 1 and k["jwt_verify"](t, "no", "HS256") == 0
    assert json.loads(k["jwt_decode"](t)) == {"header": {"typ": "JWT", "alg": "HS256"}, "payload": {"sub": "1"}}


def test_in_sql(spark):
    got = sql(spark, "SELECT cbor_decode(cbor_encode('[1,2.5,\"x\"]')) AS a, string(zstd_decompress(zstd_compress(binary('abc')))) AS b, rb_to_array(rb_union(rb_from_array(array(3L, 1L)), rb_from_range(1L, 2L))) AS c, rms(array(3D, 4D)) AS d").first()
    assert tuple(got) == ('[1,2.5,"x"]', "abc", "[1,2,3]", pytest.approx(3.5355339))
