"""Phonetic codes, colours beyond hexadecimal, and identifiers made at random."""

from __future__ import annotations

import json
import os
import random
import re
import secrets
import time
import uuid
from html.parser import HTMLParser

from millrace.functions.registry import kernel, parse


def metaphone(word: str) -> str:
    """Lawrence Philips's Metaphone (1990), four letters and more."""
    w = re.sub(r"[^A-Z]", "", word.upper())
    w = re.sub(r"([ABD-Z])\1+", r"\1", w)
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[:1] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out, i, n = "", 0, len(w)
    at = lambda k: w[k] if 0 <= k < n else ""
    while i < n:
        c, step = w[i], 1
        if c in "AEIOU":
            out += c if i == 0 else ""
        elif c == "B":
            out += "" if i == n - 1 and at(i - 1) == "M" else "B"
        elif c == "C":
            if at(i - 1) == "S" and at(i + 1) in ("E", "I", "Y"):
                pass
            elif w[i : i + 3] == "CIA":
                out += "X"
            elif at(i + 1) == "H":
                out, step = out + ("K" if at(i - 1) == "S" else "X"), 2
            else:
                out += "S" if at(i + 1) in ("E", "I", "Y") and at(i + 1) else "K"
        elif c == "D":
            if at(i + 1) == "G" and at(i + 2) in ("E", "I", "Y") and at(i + 2):
                out, step = out + "J", 2
            else:
                out += "T"
        elif c == "G":
            if at(i + 1) == "H" and (i + 2 >= n or at(i + 2) not in "AEIOU"):
                step = 2
            elif at(i + 1) == "N" and i + 2 >= n or w[i:] == "GNED":
                pass
            else:
                out += "J" if at(i + 1) and at(i + 1) in "EIY" else "K"
        elif c == "H":
            out += "H" if at(i + 1) and at(i + 1) in "AEIOU" and at(i - 1) not in tuple("CGPST") else ""
        elif c == "K":
            out += "" if at(i - 1) == "C" else "K"
        elif c == "P":
            if at(i + 1) == "H":
                out, step = out + "F", 2
            else:
                out += "P"
        elif c == "Q":
            out += "K"
        elif c == "S":
            if at(i + 1) == "H":
                out, step = out + "X", 2
            else:
                out += "X" if w[i : i + 3] in ("SIO", "SIA") else "S"
        elif c == "T":
            if w[i : i + 3] in ("TIA", "TIO"):
                out += "X"
            elif at(i + 1) == "H":
                out, step = out + "0", 2
            elif w[i : i + 3] != "TCH":
                out += "T"
        elif c == "V":
            out += "F"
        elif c in "WY":
            out += c if at(i + 1) and at(i + 1) in "AEIOU" else ""
        elif c == "X":
            out += "KS"
        elif c == "Z":
            out += "S"
        else:
            out += c
        i += step
    return out


def caverphone(word: str) -> str:
    """Caverphone 2.0: ten letters, filled with 1."""
    w = re.sub(r"[^a-z]", "", word.lower())
    steps = [("e$", ""), ("^cough", "cou2f"), ("^rough", "rou2f"), ("^tough", "tou2f"), ("^enough", "enou2f"), ("^trough", "trou2f"), ("^gn", "2n"), ("mb$", "m2"), ("cq", "2q"), ("ci", "si"), ("ce", "se"), ("cy", "sy"), ("tch", "2ch"), ("[cqx]", "k"), ("v", "f"), ("dg", "2g"), ("tio", "sio"), ("tia", "sia"), ("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"), ("^[aeiou]", "A"), ("[aeiou]", "3"), ("j", "y"), ("^y3", "Y3"), ("^y", "A"), ("y", "3"), ("3gh3", "3kh3"), ("gh", "22"), ("g", "k"), ("s+", "S"), ("t+", "T"), ("p+", "P"), ("k+", "K"), ("f+", "F"), ("m+", "M"), ("n+", "N"), ("w3", "W3"), ("wh3", "Wh3"), ("w$", "3"), ("w", "2"), ("^h", "A"), ("h", "2"), ("r3", "R3"), ("r$", "3"), ("r", "2"), ("l3", "L3"), ("l$", "3"), ("l", "2"), ("2", ""), ("3$", "A"), ("3", "")]
    for a, b in steps:
        w = re.sub(a, b, w)
    return (w + "1" * 10)[:10]


def rgb(r: int, g: int, b: int) -> tuple:
    import colorsys

    return colorsys, r / 255, g / 255, b / 255


def to_hsl(r: int, g: int, b: int) -> str:
    m, *c = rgb(r, g, b)
    h, lightness, s = m.rgb_to_hls(*c)
    return json.dumps([round(h * 360, 2), round(s * 100, 2), round(lightness * 100, 2)], separators=(",", ":"))


def to_hsv(r: int, g: int, b: int) -> str:
    m, *c = rgb(r, g, b)
    h, s, v = m.rgb_to_hsv(*c)
    return json.dumps([round(h * 360, 2), round(s * 100, 2), round(v * 100, 2)], separators=(",", ":"))


def from_hsl(h: float, s: float, lightness: float) -> str:
    import colorsys

    return json.dumps([round(x * 255) for x in colorsys.hls_to_rgb(h / 360, lightness / 100, s / 100)], separators=(",", ":"))


def from_hsv(h: float, s: float, v: float) -> str:
    import colorsys

    return json.dumps([round(x * 255) for x in colorsys.hsv_to_rgb(h / 360, s / 100, v / 100)], separators=(",", ":"))


def uuid7() -> str:
    n = int(time.time() * 1000) << 80 | int.from_bytes(os.urandom(10), "big")
    return str(uuid.UUID(int=n & ~(0xF << 76) & ~(3 << 62) | 7 << 76 | 2 << 62))


class _Select(HTMLParser):
    """Text and attributes of the elements that `tag`, `.class`, `#id` or `tag.class` names."""

    def __init__(self, selector: str):
        super().__init__(convert_charrefs=True)
        m = re.fullmatch(r"([\w-]*)([.#][\w-]+)?", selector.strip())
        if not m:
            raise ValueError(f"no selector: {selector}")
        self.tag, self.mark = m[1].lower(), m[2] or ""
        self.open, self.found, self.attributes = [], [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        named = not self.mark or (self.mark[1:] in (a.get("class") or "").split() if self.mark[0] == "." else a.get("id") == self.mark[1:])
        if named and self.tag in ("", tag):
            self.found.append([])
            self.attributes.append(a)
            self.open.append([tag, len(self.found) - 1, 0])
        for o in self.open:
            o[2] += o[0] == tag

    def handle_endtag(self, tag):
        for o in self.open:
            o[2] -= o[0] == tag
        self.open = [o for o in self.open if o[2] > 0]

    def handle_data(self, data):
        for o in self.open:
            self.found[o[1]].append(data)


def select(source: str, selector: str) -> _Select:
    s = _Select(selector)
    s.feed(source)
    s.close()
    return s


FIRST, LAST, CITIES = "Ada Alan Grace Edsger Barbara Donald Frances Ken".split(), "Moss Rivera Chen Okafor Novak Silva Haas Lind".split(), "Ashford Brookfield Clearwater Dunmore Eastvale Fairview".split()
pick = random.choice
RANDOM = [
    ("fake_first_name", lambda: pick(FIRST)),
    ("fake_last_name", lambda: pick(LAST)),
    ("fake_name", lambda: f"{pick(FIRST)} {pick(LAST)}"),
    ("fake_email", lambda: f"{pick(FIRST).lower()}.{pick(LAST).lower()}@example.com"),
    ("fake_username", lambda: f"{pick(FIRST).lower()}{random.randrange(1000)}"),
    ("fake_city", lambda: pick(CITIES)),
    ("fake_ipv4", lambda: ".".join(str(random.randrange(256)) for _ in range(4))),
    ("fake_zip", lambda: f"{random.randrange(100000):05d}"),
    ("fake_password", lambda: secrets.token_urlsafe(12)),
    ("uuidv7", uuid7),
]

FUNCTIONS = [
    kernel("phonetic", "metaphone", "string", lambda s: metaphone(s)[:4]),
    kernel("phonetic", "caverphone", "string", caverphone),
    kernel("color", "color_rgb_to_hsl", "string", to_hsl),
    kernel("color", "color_rgb_to_hsv", "string", to_hsv),
    kernel("color", "color_hsl_to_rgb", "string", from_hsl),
    kernel("color", "color_hsv_to_rgb", "string", from_hsv),
    kernel("html", "html_get_text", "string", lambda s, q: "".join(select(s, q).found[0]).strip() if select(s, q).found else None),
    kernel("html", "html_all_text", "string", lambda s, q: json.dumps(["".join(x).strip() for x in select(s, q).found], ensure_ascii=False, separators=(",", ":"))),
    kernel("html", "html_get_attr", "string", lambda s, q, a: next((x.get(a) for x in select(s, q).attributes), None)),
    # Each row of the argument gets a value of its own; the argument itself is not used.
    *(kernel("random", name, "string", lambda _, f=f: f(), nulls=True) for name, f in RANDOM),
    *parse("identifier", """
snowflake_to_timestamp(n BIGINT) BIGINT = shiftright(n, 22) + 1288834974657L
uuid_v7_timestamp(u STRING) BIGINT = if(substr(u, 15, 1) = '7', CAST(conv(substr(replace(u, '-', ''), 1, 12), 16, 10) AS BIGINT), NULL)
cusip_is_private(s STRING) INT = CAST(substr(s, 7, 1) RLIKE '[0-9A-Z]' AND substr(s, 7, 2) RLIKE '^9[0-9]$' AS INT)
"""),
]
