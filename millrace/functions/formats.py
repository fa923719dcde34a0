"""Kernels for text formats: data notations, binary notations, mail and calendar files, tokens, web files, Markdown; big
integers, bitmaps and signals.  What is malformed gives null (0 from a validity check)."""

from __future__ import annotations

import base64
import configparser
import email
import email.policy
import hashlib
import hmac
import html
import json
import math
import re
import struct
import time
import tomllib
import xml.etree.ElementTree as ET
from email.utils import parsedate_to_datetime
from urllib.parse import parse_qs, unquote, urlsplit

import numpy as np

from millrace.functions.registry import Function, kernel, parse


def dump(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False, default=str)


def quiet(f, otherwise=None):
    def run(*args):
        try:
            return f(*args)
        except Exception:
            return otherwise

    return run


def group(family: str, returns: str, **functions) -> list[Function]:
    return [kernel(family, n, returns, quiet(f)) for n, f in functions.items()]


def by_key(x):
    """Objects with their keys in order."""
    return {k: by_key(x[k]) for k in sorted(x)} if isinstance(x, dict) else [by_key(v) for v in x] if isinstance(x, list) else x


def yaml_text(s: str):
    if s is None:
        raise ValueError("null")
    return load_yaml(s)


def valid(f):
    return lambda *a: int(quiet(lambda *b: (f(*b), True)[1], False)(*a))


def at_path(node, path: str):
    for part in path.split(".") if path else []:
        node = node[int(part)] if isinstance(node, list) else node[part]
    return node


def load_yaml(s: str):
    import yaml

    return yaml.safe_load(s)


def dump_yaml(x) -> str:
    import yaml

    return yaml.safe_dump(x, sort_keys=False, allow_unicode=True)


def to_toml(x: dict, prefix: str = "") -> str:
    value = lambda v: "true" if v is True else "false" if v is False else json.dumps(v, ensure_ascii=False) if not isinstance(v, list) else "[" + ", ".join(map(value, v)) + "]"
    own = [f"{k} = {value(v)}" for k, v in x.items() if not isinstance(v, dict)]
    tables = [f"[{prefix}{k}]\n" + to_toml(v, f"{prefix}{k}.") for k, v in x.items() if isinstance(v, dict)]
    return "\n".join([*own, *tables])


def ini(s: str) -> dict:
    c = configparser.ConfigParser(interpolation=None)
    c.optionxform = str
    c.read_string(s)
    return {n: dict(c.items(n)) for n in c.sections()}


def from_ini(s: str) -> str:
    return "\n".join(f"[{n}]\n" + "\n".join(f"{k} = {v}" for k, v in kv.items()) for n, kv in json.loads(s).items())


def xml_tree(e: ET.Element):
    out: dict = {f"@{k}": v for k, v in e.attrib.items()}
    for child in e:
        tag = child.tag.rpartition("}")[2]
        made = xml_tree(child)
        out[tag] = [*(out[tag] if isinstance(out[tag], list) else [out[tag]]), made] if tag in out else made
    text = (e.text or "").strip()
    return out | ({"#text": text} if text else {}) if out else text


NOTATIONS = [
    *group("notation", "string", yaml_to_json=lambda s: dump(by_key(load_yaml(s))), json_to_yaml=lambda s: dump_yaml(json.loads(s)), yaml_get=lambda s, p: dump(at_path(load_yaml(s), p)), yaml_keys=lambda s, p="": dump(sorted(at_path(load_yaml(s), p)))),
    *group("notation", "string", toml_to_json=lambda s: dump(by_key(tomllib.loads(s))), json_to_toml=lambda s: to_toml(json.loads(s)), toml_get=lambda s, p: dump(at_path(tomllib.loads(s), p)), toml_keys=lambda s, p="": dump(sorted(at_path(tomllib.loads(s), p)))),
    *group("notation", "string", ini_to_json=lambda s: dump(ini(s)), json_to_ini=from_ini, xml_to_json=lambda s: (lambda e: dump({e.tag: xml_tree(e)}))(ET.fromstring(s))),
    *group("notation", "long", xml_is_valid=valid(ET.fromstring)),
    *(kernel("notation", f"{n}_is_valid", "long", valid(f), nulls=True) for n, f in (("yaml", yaml_text), ("toml", tomllib.loads))),
]


def bencode(x) -> bytes:
    if isinstance(x, bool) or x is None or isinstance(x, float):
        raise ValueError("bencode has integers, strings, lists and dictionaries")
    if isinstance(x, int):
        return b"i%de" % x
    if isinstance(x, str):
        return b"%d:%s" % (len(x.encode()), x.encode())
    if isinstance(x, list):
        return b"l" + b"".join(map(bencode, x)) + b"e"
    return b"d" + b"".join(bencode(k) + bencode(x[k]) for k in sorted(x)) + b"e"


def bdecode(b: bytes):
    def one(i):
        c = b[i : i + 1]
        if c == b"i":
            end = b.index(b"e", i)
            return int(b[i + 1 : end]), end + 1
        if c in (b"l", b"d"):
            items, i = [], i + 1
            while b[i : i + 1] != b"e":
                x, i = one(i)
                items.append(x)
            return (items if c == b"l" else dict(zip(items[::2], items[1::2], strict=True))), i + 1
        colon = b.index(b":", i)
        n = int(b[i:colon])
        if colon + 1 + n > len(b):
            raise ValueError("short")
        return b[colon + 1 : colon + 1 + n].decode(), colon + 1 + n

    x, end = one(0)
    if end != len(b):
        raise ValueError("left over")
    return x


def cbor(x) -> bytes:
    def head(major, n):
        for code, size, f in ((24, 1, ">B"), (25, 2, ">H"), (26, 4, ">I"), (27, 8, ">Q")):
            if n < 24:
                return bytes([major << 5 | n])
            if n < 1 << 8 * size:
                return bytes([major << 5 | code]) + struct.pack(f, n)
        raise ValueError("too large")

    if x is None or isinstance(x, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[x]
    if isinstance(x, int):
        return head(0, x) if x >= 0 else head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, str):
        return head(3, len(x.encode())) + x.encode()
    if isinstance(x, list):
        return head(4, len(x)) + b"".join(map(cbor, x))
    return head(5, len(x)) + b"".join(cbor(k) + cbor(v) for k, v in x.items())


def uncbor(b: bytes):
    def one(i):
        major, n = b[i] >> 5, b[i] & 31
        i += 1
        if major == 7:
            if n in (25, 26, 27):
                size = {25: 2, 26: 4, 27: 8}[n]
                return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[n], b[i : i + size])[0], i + size
            return {20: False, 21: True, 22: None, 23: None}[n], i
        if n >= 24:
            size = 1 << (n - 24)
            n, i = int.from_bytes(b[i : i + size], "big"), i + size
        if major < 2:
            return (n if major == 0 else -1 - n), i
        if major in (2, 3):
            return (b[i : i + n].decode() if major == 3 else b[i : i + n].hex()), i + n
        if major == 6:
            return one(i)
        items = []
        for _ in range(n * (major - 3)):
            x, i = one(i)
            items.append(x)
        return (items if major == 4 else dict(zip(map(str, items[::2]), items[1::2], strict=True))), i

    return one(0)[0]


def msgpack(x) -> bytes:
    if x is None or isinstance(x, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[x]
    if isinstance(x, int):
        if 0 <= x < 128:
            return bytes([x])
        if -32 <= x < 0:
            return struct.pack("b", x)
        for code, f, low, high in ((0xCC, ">B", 0, 1 << 8), (0xCD, ">H", 0, 1 << 16), (0xCE, ">I", 0, 1 << 32), (0xCF, ">Q", 0, 1 << 64), (0xD0, ">b", -(1 << 7), 0), (0xD1, ">h", -(1 << 15), 0), (0xD2, ">i", -(1 << 31), 0), (0xD3, ">q", -(1 << 63), 0)):
            if low <= x < high:
                return bytes([code]) + struct.pack(f, x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)

    def sized(n, fix, top, codes):
        if n < top:
            return bytes([fix | n])
        for code, f, high in codes:
            if n < high:
                return bytes([code]) + struct.pack(f, n)
        raise ValueError("too long")

    if isinstance(x, str):
        raw = x.encode()
        return sized(len(raw), 0xA0, 32, ((0xD9, ">B", 1 << 8), (0xDA, ">H", 1 << 16), (0xDB, ">I", 1 << 32))) + raw
    if isinstance(x, list):
        return sized(len(x), 0x90, 16, ((0xDC, ">H", 1 << 16), (0xDD, ">I", 1 << 32))) + b"".join(map(msgpack, x))
    return sized(len(x), 0x80, 16, ((0xDE, ">H", 1 << 16), (0xDF, ">I", 1 << 32))) + b"".join(msgpack(k) + msgpack(v) for k, v in x.items())


def unmsgpack(b: bytes):
    numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    lengths = {0xD9: ("s", 1), 0xDA: ("s", 2), 0xDB: ("s", 4), 0xDC: ("l", 2), 0xDD: ("l", 4), 0xDE: ("d", 2), 0xDF: ("d", 4), 0xC4: ("b", 1), 0xC5: ("b", 2), 0xC6: ("b", 4)}

    def one(i):
        c = b[i]
        i += 1
        if c < 0x80:
            return c, i
        if c >= 0xE0:
            return c - 256, i
        if c in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[c], i
        if c in numbers:
            size = struct.calcsize(numbers[c])
            return struct.unpack(numbers[c], b[i : i + size])[0], i + size
        if c in lengths:
            kind, size = lengths[c]
            n, i = int.from_bytes(b[i : i + size], "big"), i + size
        else:
            kind, n = ("d", c & 15) if c < 0x90 else ("l", c & 15) if c < 0xA0 else ("s", c & 31)
        if kind in "sb":
            return (b[i : i + n].decode() if kind == "s" else b[i : i + n].hex()), i + n
        items = []
        for _ in range(n * (2 if kind == "d" else 1)):
            x, i = one(i)
            items.append(x)
        return (items if kind == "l" else dict(zip(map(str, items[::2]), items[1::2], strict=True))), i

    return one(0)[0]


BINARY = [
    *group("binary", "binary", bencode_encode=lambda s: bencode(json.loads(s)), cbor_encode=lambda s: cbor(json.loads(s)), msgpack_encode=lambda s: msgpack(json.loads(s))),
    *group("binary", "string", bencode_decode=lambda b: dump(bdecode(bytes(b))), cbor_decode=lambda b: dump(uncbor(bytes(b))), msgpack_decode=lambda b: dump(unmsgpack(bytes(b)))),
    *group("binary", "long", bencode_validate=valid(lambda b: bdecode(bytes(b)))),
    *group("binary", "binary", zstd_compress=lambda b, level=3: __import__("zstandard").ZstdCompressor(level=level).compress(b.encode() if isinstance(b, str) else bytes(b)), zstd_decompress=lambda b: __import__("zstandard").ZstdDecompressor().decompressobj().decompress(bytes(b))),
]


def unfolded(s: str) -> list[tuple[str, dict, str]]:
    """(name, parameters, value) of the content lines of a vCard or a calendar."""
    out = []
    for line in re.sub(r"\r?\n[ \t]", "", s).splitlines():
        head, colon, value = line.partition(":")
        if colon:
            name, *params = head.split(";")
            out.append((name.rpartition(".")[2].upper(), dict((p.partition("=")[0].upper(), p.partition("=")[2]) for p in params), re.sub(r"\\([,;\\])", r"\1", value).replace("\\n", "\n")))
    return out


def first(s: str, name: str) -> str | None:
    return next((v for n, _, v in unfolded(s) if n == name), None)


def every(s: str, name: str) -> str:
    return dump([v for n, _, v in unfolded(s) if n == name])


def ical_items(s: str, kind: str) -> list[dict]:
    out, open_ = [], None
    for n, _, v in unfolded(s):
        if n == "BEGIN" and v.upper() == kind:
            open_ = {}
        elif n == "END" and v.upper() == kind and open_ is not None:
            out.append(open_)
            open_ = None
        elif open_ is not None:
            open_.setdefault(n, v)
    return out


def events(s: str) -> str:
    names = {"summary": "SUMMARY", "start": "DTSTART", "end": "DTEND", "location": "LOCATION", "uid": "UID"}
    return dump([{k: e.get(n) for k, n in names.items()} for e in ical_items(s, "VEVENT")])


def mails(s: str) -> list:
    parts = re.split(r"(?m)^From .*\n", s)[1:]
    return [email.message_from_string(p, policy=email.policy.default) for p in parts]


def mail_body(m) -> str:
    body = m.get_body(("plain", "html"))
    return body.get_content() if body else ""


def mailto(s: str) -> dict:
    u = urlsplit(s.strip())
    if u.scheme.lower() != "mailto":
        raise ValueError("no mailto")
    q = {k.lower(): v for k, v in parse_qs(u.query.replace("+", "%2B")).items()}
    return {"to": [unquote(x) for x in u.path.split(",") if x] + q.get("to", [])} | {k: q.get(k, []) for k in ("cc", "bcc", "subject", "body")}


def nmea(s: str) -> dict:
    body, _, check = s.strip().lstrip("$!").partition("*")
    f, kind = body.split(","), body.split(",")[0][2:]
    degrees = lambda v, side: round((int(float(v)) // 100 + float(v) % 100 / 60) * (-1 if side in "SW" else 1), 6) if v else None
    number = lambda v: float(v) if v else None
    out: dict = {"type": kind}
    if kind == "GGA":
        out |= {"lat": degrees(f[2], f[3]), "lng": degrees(f[4], f[5]), "time": f[1], "fix": int(f[6] or 0), "satellites": int(f[7] or 0)}
    elif kind == "RMC":
        d = f[9]
        out |= {"lat": degrees(f[3], f[4]), "lng": degrees(f[5], f[6]), "speed": number(f[7]), "course": number(f[8]), "time": f[1], "date": d}
        if d and f[1]:
            out["timestamp"] = f"20{d[4:6]}-{d[2:4]}-{d[:2]}T{f[1][:2]}:{f[1][2:4]}:{f[1][4:6]}Z"
    return out


def nmea_ok(s: str) -> int:
    body, star, check = s.strip().lstrip("$!").partition("*")
    x = 0
    for c in body:
        x ^= ord(c)
    return int(bool(star) and int(check[:2], 16) == x)


MESSAGES = [
    *group("vcard", "string", **{f"vcard_{k}": (lambda s, n=n: first(s, n)) for k, n in {"fn": "FN", "email": "EMAIL", "phone": "TEL", "title": "TITLE", "birthday": "BDAY", "url": "URL", "note": "NOTE", "version_in": "VERSION", "org": "ORG"}.items()}),
    *group("vcard", "string", vcard_emails=lambda s: every(s, "EMAIL"), vcard_phones=lambda s: every(s, "TEL"), vcard_addresses=lambda s: every(s, "ADR"), vcard_all=lambda s: dump({n: [v for m, _, v in unfolded(s) if m == n] for n, _, _ in unfolded(s) if n not in ("BEGIN", "END")})),
    *group("ical", "string", ical_events=events, ical_summaries=lambda s: dump([e.get("SUMMARY") for e in ical_items(s, "VEVENT")])),
    *group("ical", "long", ical_event_count=lambda s: len(ical_items(s, "VEVENT")), ical_todo_count=lambda s: len(ical_items(s, "VTODO")), ical_validate=lambda s: int(re.match(r"\s*BEGIN:VCALENDAR", s, re.I) is not None and re.search(r"END:VCALENDAR\s*$", s, re.I) is not None)),
    *group("mbox", "long", mbox_message_count=lambda s: len(mails(s))),
    *group("mbox", "string", mbox_subjects=lambda s: dump([m["subject"] for m in mails(s)]), mbox_subject_at=lambda s, i: mails(s)[i]["subject"], mbox_from_at=lambda s, i: mails(s)[i]["from"], mbox_body_at=lambda s, i: mail_body(mails(s)[i]), mbox_date_at=lambda s, i: parsedate_to_datetime(mails(s)[i]["date"]).astimezone(__import__("datetime").timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")),
    *group("mailto", "string", mailto_to=lambda s: ",".join(mailto(s)["to"]), mailto_subject=lambda s: mailto(s)["subject"][0], mailto_body=lambda s: mailto(s)["body"][0], mailto_cc=lambda s: mailto(s)["cc"][0], mailto_bcc=lambda s: mailto(s)["bcc"][0], mailto_recipients=lambda s: dump(mailto(s)["to"] + mailto(s)["cc"] + mailto(s)["bcc"])),
    *group("mailto", "long", mailto_validate=valid(lambda s: [1 for x in mailto(s)["to"] if "@" in x][0])),
    *group("nmea", "string", nmea_parse=lambda s: dump(nmea(s)), nmea_sentence_type=lambda s: nmea(s)["type"], nmea_timestamp=lambda s: nmea(s).get("timestamp")),
    *group("nmea", "double", nmea_lat=lambda s: nmea(s)["lat"], nmea_lng=lambda s: nmea(s)["lng"], nmea_speed_knots=lambda s: nmea(s)["speed"], nmea_course=lambda s: nmea(s)["course"]),
    *group("nmea", "long", nmea_fix_quality=lambda s: nmea(s)["fix"], nmea_satellites=lambda s: nmea(s)["satellites"], nmea_checksum_ok=nmea_ok),
]

b64 = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
unb64 = lambda s: base64.urlsafe_b64decode(s + "=" * (-len(s) % 4))


def jwt_sign(text: str, key: str, alg: str) -> str:
    return b64(hmac.new(key.encode(), text.encode(), {"HS256": "sha256", "HS384": "sha384", "HS512": "sha512"}[alg]).digest())


def jwt_encode(header: str, payload: str, key: str, alg: str) -> str:
    text = b64(dump(json.loads(header) | {"alg": alg}).encode()) + "." + b64(dump(json.loads(payload)).encode())
    return f"{text}.{jwt_sign(text, key, alg)}"


def hotp(secret: str, counter: int, digits: int = 6, algorithm: str = "sha1") -> str:
    key = base64.b32decode(secret.upper().replace(" ", "") + "=" * (-len(secret.replace(" ", "")) % 8))
    d = hmac.new(key, struct.pack(">Q", counter), algorithm).digest()
    at = d[-1] & 15
    return str((int.from_bytes(d[at : at + 4], "big") & 0x7FFFFFFF) % 10**digits).zfill(digits)


TOKENS = [
    *group("token", "string", jwt_encode=jwt_encode, jwt_header=lambda t: unb64(t.split(".")[0]).decode(), jwt_payload=lambda t: dump(by_key(json.loads(unb64(t.split(".")[1])))), jwt_decode=lambda t: dump(by_key({"header": json.loads(unb64(t.split(".")[0])), "payload": json.loads(unb64(t.split(".")[1]))}))),
    *group("token", "long", jwt_verify=lambda t, key, alg: int(hmac.compare_digest(t.rpartition(".")[2], jwt_sign(t.rpartition(".")[0], key, alg)))),
    *group("token", "string", hotp_generate=hotp, totp_generate=lambda s, at=None, period=30, digits=6: hotp(s, (int(time.time()) if at is None else at) // period, digits)),
    *group("token", "long", hotp_verify=lambda code, s, n: int(code == quiet(hotp, "")(s, n)), totp_verify=lambda code, s, at=None, period=30: int(any(code == quiet(hotp, "")(s, (int(time.time()) if at is None else at) // period + d) for d in (-1, 0, 1)))),
    *group("token", "string", pkce_challenge=lambda v: b64(hashlib.sha256(v.encode()).digest())),
]


def robots(s: str) -> list[tuple[set, list]]:
    """(agents, rules) by group; a rule is (allow, path)."""
    out: list = []
    fresh = False
    for line in s.splitlines():
        key, _, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if not fresh:
                out.append((set(), []))
            out[-1][0].add(value.lower())
            fresh = True
        elif out and key in ("allow", "disallow", "crawl-delay"):
            out[-1][1].append((key, value))
            fresh = False
    return out


def robots_rules(s: str, agent: str) -> list:
    found = robots(s)
    own = [r for agents, rules in found if any(a != "*" and a in agent.lower() for a in agents) for r in rules]
    named = any(a != "*" and a in agent.lower() for agents, _ in found for a in agents)
    return own if named else [r for agents, rules in found if "*" in agents for r in rules]


def robots_allowed(s: str, agent: str, url: str) -> int:
    u = urlsplit(url)
    path = (u.path or "/") + (f"?{u.query}" if u.query else "")
    best = (0, 1)
    for key, rule in robots_rules(s, agent):
        if key in ("allow", "disallow") and rule and re.match(re.escape(rule).replace(r"\*", ".*").replace(r"\$", "$"), path):
            best = max(best, (len(rule), int(key == "allow")))
    return best[1]


def sitemap(s: str, *kinds: str) -> list[dict]:
    return [{c.tag.rpartition("}")[2]: (c.text or "").strip() for c in e} for e in ET.fromstring(s) if e.tag.rpartition("}")[2] in (kinds or ("url", "sitemap"))]


def markdown(s: str) -> str:
    """Headings, paragraphs, lists, quotes, code, rules, emphasis, links and images."""

    def line(t):
        t = html.escape(t, quote=False)
        t = re.sub(r"`([^`]+)`", r"<code>\1</code>", t)
        t = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)\)", r'<img src="\2" alt="\1">', t)
        t = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', t)
        t = re.sub(r"\*\*(.+?)\*\*|__(.+?)__", lambda m: f"<strong>{m[1] or m[2]}</strong>", t)
        return re.sub(r"\*(.+?)\*|\b_(.+?)_\b", lambda m: f"<em>{m[1] or m[2]}</em>", t)

    out = []
    for block in re.split(r"\n\s*\n", re.sub(r"```\w*\n(.*?)```", lambda m: "\0" + m[1].replace("\n\n", "\n\1\n"), s.strip("\n"), flags=re.S)):
        rows = block.split("\n")
        if block.startswith("\0"):
            out.append(f"<pre><code>{html.escape(block[1:].replace(chr(1), ''), quote=False)}</code></pre>")
        elif m := re.match(r"(#{1,6})\s+(.*)", block):
            out.append(f"<h{len(m[1])}>{line(m[2].rstrip('# '))}</h{len(m[1])}>")
            if rest := "\n".join(rows[1:]).strip():
                out.append(markdown(rest))
        elif re.fullmatch(r"\s*([-*_])(\s*\1){2,}\s*", block):
            out.append("<hr>")
        elif all(re.match(r"\s*[-*+]\s+", r) for r in rows):
            out.append("<ul>" + "".join(f"<li>{line(re.sub(r'^\s*[-*+]\s+', '', r))}</li>" for r in rows) + "</ul>")
        elif all(re.match(r"\s*\d+[.)]\s+", r) for r in rows):
            out.append("<ol>" + "".join(f"<li>{line(re.sub(r'^\s*\d+[.)]\s+', '', r))}</li>" for r in rows) + "</ol>")
        elif all(r.startswith(">") for r in rows):
            out.append("<blockquote>" + markdown("\n".join(r[1:].lstrip() for r in rows)) + "</blockquote>")
        elif block.strip():
            out.append("<p>" + line("\n".join(r.strip() for r in rows)) + "</p>")
    return "\n".join(out)


WEB = [
    *group("robots", "long", robots_is_allowed=robots_allowed, sitemap_count=lambda s: len(sitemap(s))),
    kernel("robots", "sitemap_is_valid", "long", valid(lambda s: {"urlset": 1, "sitemapindex": 1}[ET.fromstring(s).tag.rpartition("}")[2]]), nulls=True),
    *group("robots", "double", robots_crawl_delay=lambda s, a: next(float(v) for k, v in robots_rules(s, a) if k == "crawl-delay")),
    *group("robots", "string", robots_sitemaps=lambda s: dump(re.findall(r"(?im)^\s*sitemap:\s*(\S+)", s)), sitemap_urls=lambda s: dump([u["loc"] for u in sitemap(s, "url")]), sitemap_full=lambda s: dump([{k: u.get(k) for k in ("loc", "lastmod", "changefreq", "priority")} for u in sitemap(s, "url")]), sitemap_index_locs=lambda s: dump([u["loc"] for u in sitemap(s, "sitemap")])),
    *group("markdown", "string", markdown_to_html=markdown, markdown_to_text=lambda s: html.unescape(re.sub(r"<[^>]+>", "", markdown(s))), markdown_extract_links=lambda s: dump([{"text": a, "url": b} for a, b in re.findall(r"(?<!!)\[([^\]]+)\]\(([^)\s]+)\)", s)]), markdown_extract_headings=lambda s: dump([{"level": len(a), "text": b.strip("# ")} for a, b in re.findall(r"(?m)^(#{1,6})\s+(.*)$", s)])),
    *group("sqltext", "string", sql_statement_type=lambda s: re.match(r"\s*(?:--[^\n]*\n|/\*.*?\*/|\s)*(\w+)", s, re.S)[1].upper(), sql_normalize=lambda s: re.sub(r"\s+", " ", re.sub(r"'(?:[^']|'')*'|\b\d+(?:\.\d+)?\b", "?", s)).strip().lower()),
    *group("sqltext", "long", sql_statement_count=lambda s: len([x for x in re.sub(r"'(?:[^']|'')*'", "", s).split(";") if x.strip()]), sql_is_readonly=lambda s: int(re.match(r"\s*(select|with|values|explain|show|describe)\b", s, re.I) is not None)),
]

BIG = [
    *group("bignum", "string", bn_from_text=lambda a: str(int(a)), bn_from_int=str, bn_add=lambda a, b: str(int(a) + int(b)), bn_sub=lambda a, b: str(int(a) - int(b)), bn_mul=lambda a, b: str(int(a) * int(b)), bn_pow=lambda a, n: str(int(a) ** n), bn_modpow=lambda a, e, m: str(pow(int(a), int(e), int(m))), bn_gcd=lambda a, b: str(math.gcd(int(a), int(b))), bn_abs=lambda a: str(abs(int(a))), bn_to_text=lambda a: a),
    *group("bignum", "string", bn_div=lambda a, b: str(abs(int(a)) // abs(int(b)) * (1 if (int(a) < 0) == (int(b) < 0) else -1)), bn_mod=lambda a, b: str(abs(int(a)) % abs(int(b)) * (-1 if int(a) < 0 else 1))),
    *group("bignum", "long", bn_cmp=lambda a, b: (int(a) > int(b)) - (int(a) < int(b)), bn_sign=lambda a: (int(a) > 0) - (int(a) < 0), bn_bits=lambda a: int(a).bit_length(), bn_to_int=lambda a: int(a) if -(1 << 63) <= int(a) < 1 << 63 else None),
]

BITMAPS = parse("bitmap", """
rb_from_array(a ARRAY<BIGINT>) ARRAY<BIGINT> = array_sort(array_distinct(a))
rb_from_range(lo BIGINT, hi BIGINT) ARRAY<BIGINT> = if(lo > hi, CAST(array() AS ARRAY<BIGINT>), sequence(lo, greatest(lo, hi)))
rb_to_array(a ARRAY<BIGINT>) STRING = to_json(a)
rb_cardinality(a ARRAY<BIGINT>) INT = size(a)
rb_contains(a ARRAY<BIGINT>, v BIGINT) INT = CAST(array_contains(a, v) AS INT)
rb_add(a ARRAY<BIGINT>, v BIGINT) ARRAY<BIGINT> = array_sort(array_union(a, array(v)))
rb_remove(a ARRAY<BIGINT>, v BIGINT) ARRAY<BIGINT> = array_remove(a, v)
rb_union(a ARRAY<BIGINT>, b ARRAY<BIGINT>) ARRAY<BIGINT> = array_sort(array_union(a, b))
rb_intersection(a ARRAY<BIGINT>, b ARRAY<BIGINT>) ARRAY<BIGINT> = array_sort(array_intersect(a, b))
rb_difference(a ARRAY<BIGINT>, b ARRAY<BIGINT>) ARRAY<BIGINT> = array_sort(array_except(a, b))
rb_symmetric_difference(a ARRAY<BIGINT>, b ARRAY<BIGINT>) ARRAY<BIGINT> = array_sort(array_union(array_except(a, b), array_except(b, a)))
rms(a ARRAY<DOUBLE>) DOUBLE = sqrt(aggregate(a, 0D, (s, x) -> s + x * x) / size(a))
moving_average(a ARRAY<DOUBLE>, w INT) ARRAY<DOUBLE> = if(size(a) < w, CAST(array() AS ARRAY<DOUBLE>), transform(sequence(1, greatest(size(a) - w + 1, 1)), i -> aggregate(slice(a, i, w), 0D, (s, x) -> s + x) / w))
phone_prefix_normalize(s STRING) STRING = concat(if(trim(s) LIKE '+%', '+', ''), regexp_replace(s, '[^0-9]', ''))
postcode_normalize(s STRING) STRING = upper(regexp_replace(trim(s), ' +', ' '))
postcode_validate_country(s STRING, c STRING) INT = CAST(CASE upper(c) WHEN 'US' THEN trim(s) RLIKE '^[0-9]{5}(-[0-9]{4})?$' WHEN 'GB' THEN upper(trim(s)) RLIKE '^[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}$' WHEN 'CA' THEN upper(trim(s)) RLIKE '^[A-Z][0-9][A-Z] ?[0-9][A-Z][0-9]$' WHEN 'NL' THEN upper(trim(s)) RLIKE '^[1-9][0-9]{3} ?[A-Z]{2}$' WHEN 'JP' THEN trim(s) RLIKE '^[0-9]{3}-[0-9]{4}$' ELSE trim(s) RLIKE '^[0-9]{5}$' END AS INT)
tld_extract(s STRING) STRING = nullif(lower(regexp_extract(rtrim('.', trim(s)), '([^.]+)$', 1)), '')
jsonpath_first(s STRING, path STRING) STRING = get_json_object(s, path)
jsonpath_exists(s STRING, path STRING) INT = CAST(get_json_object(s, path) IS NOT NULL AS INT)
""")


def low_pass(x, cutoff: float, rate: float, high: bool = False) -> list[float]:
    """A first-order filter; `high` gives what it takes away."""
    a, y, out = 1 / (1 + rate / (2 * math.pi * cutoff)), None, []
    for v in x:
        y = v if y is None else y + a * (v - y)
        out.append(v - y if high else y)
    return out


def window(x, kind: str) -> list[float]:
    return (np.asarray(x, float) * {"hann": np.hanning, "hamming": np.hamming, "blackman": np.blackman, "rect": np.ones}[kind](len(x))).tolist()


def peaks(x, prominence: float) -> list[int]:
    out = []
    for i in range(1, len(x) - 1):
        if x[i - 1] < x[i] >= x[i + 1]:
            left = next((j for j in range(i - 1, -1, -1) if x[j] > x[i]), -1)
            right = next((j for j in range(i + 1, len(x)) if x[j] > x[i]), len(x))
            if x[i] - max(min(x[left + 1 : i + 1]), min(x[i:right])) >= prominence:
                out.append(i)
    return out


J = json.loads
SIGNALS = [
    *group("signal", "string", filter_lowpass=lambda s, c, r: dump(low_pass(J(s), c, r)), filter_highpass=lambda s, c, r: dump(low_pass(J(s), c, r, True)), filter_bandpass=lambda s, lo, hi, r: dump(low_pass(low_pass(J(s), hi, r), lo, r, True)), convolve=lambda a, b: dump(np.convolve(J(a), J(b)).tolist()), autocorrelation=lambda s: (lambda x: dump([float((x[: len(x) - k] * x[k:]).sum() / (x * x).sum()) for k in range(len(x))]))(np.array(J(s), float) - np.mean(J(s))), peak_detect=lambda s, p: dump(peaks(J(s), p)), fft_phase=lambda s: dump([math.atan2(b, a) for a, b in J(s)]), fft_power_spectrum=lambda s: dump((np.abs(np.fft.rfft(J(s))) ** 2 / len(J(s))).tolist()), fft_window=lambda s, k: dump(window(J(s), k))),
    *group("random", "string", nanoid_n=lambda n: "".join(__import__("secrets").choice("_-0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n)), nanoid_alpha=lambda n, a: "".join(__import__("secrets").choice(a) for _ in range(n))),
    *group("random", "string", lorem_words_seeded=lambda n, seed: " ".join(__import__("random").Random(seed).choices("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split(), k=n))),
    *group("hash", "long", hash_distance=lambda a, b: sum((x ^ y).bit_count() for x, y in zip(bytes(a), bytes(b), strict=True))),
]

FUNCTIONS = [*NOTATIONS, *BINARY, *MESSAGES, *TOKENS, *WEB, *BIG, *BITMAPS, *SIGNALS]
