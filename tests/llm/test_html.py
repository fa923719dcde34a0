import math
import random
import time

import pytest

from millrace.llm import html_text
from millrace.llm.html_text import extract, main_text

ARTICLE = "<article><h1>Title &amp; more</h1><p><b>Lead  in<br>two<br><p>Body text\n of the article &lt;b&gt;.</p><ul><li>one<li>two</ul></article>"
TEXT = "Title & more\n\nLead in two\n\nBody text of the article <b>.\n\none\n\ntwo"
LONG = "A sentence that is long enough to be the content of a page, with commas and words. " * 3

CASES = [
    (None, ""),
    ("", ""),
    ("   ", ""),
    ("just text &eacute;", "just text é"),
    (f"<html><head><title>no</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy</div>{ARTICLE}<footer>&copy; me</footer></body></html>", TEXT),
    (f"<body><nav>menu{ARTICLE}", ""),
    (f"<body>{ARTICLE}", TEXT),
    (f"<body><div id='comments'><p>{LONG}</p></div>{ARTICLE}<aside>side</aside><form><input value=x>ask</form>", TEXT),
    (f"<div class='page'><div class='menu'><a>a</a><a>b</a></div><div class='content'><p>{LONG}</p><p>short</p></div><div class='cookie-notice'>we use cookies</div></div>", f"{LONG.strip()}\n\nshort"),
    ("<article><p>a<!-- <p>no</p> -->b</p><table><tr><td>x<td>y</table></article>", "ab\n\nx\n\ny"),
    ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ("<article><p>unclosed <i>tag", "unclosed tag"),
    ("<article><section><p>" + LONG + "</p></section><section><p>Second.</p></section></article>", f"{LONG.strip()}\n\nSecond."),
    ("<nav><ul><li>only</ul></nav>", ""),
    (f"<body><div class='content has-sidebar'><p>{LONG}</p></div><p>x</p></body>", f"{LONG.strip()}\n\nx"),
    (f"<body><div class='post share-price'><p>{LONG}</p><p>Second.</p></div></body>", f"{LONG.strip()}\n\nSecond."),
    (f"<form id=f><input><div class=top><a href=a>One</a> <a href=b>Two</a></div><div><p>{LONG}</p></div><div class=ad>Buy</div></form>", LONG.strip()),
    (f"<article><h1>T</h1><p>{LONG}</p><section><h3>3 Comments</h3><ol><li>{LONG}</ol></section></article>", f"T\n\n{LONG.strip()}"),
    (f"<article><p>{LONG}</p><h2>Comments (2)</h2><ol><li>first</ol><div>second</div></article>", LONG.strip()),
    (f"<article><p>{LONG}</p><h2>Comments on the law</h2><p>They differ.</p></article>", f"{LONG.strip()}\n\nComments on the law\n\nThey differ."),
]

#: Pages without a tag or class that names a part: links and short lines around a text.
BARE = (
    "<body><div>" + "".join(f"<div><a href='/{i}'>Link number {i}</a> ({i})</div>" for i in range(9)) + "</div>"
    f"<div><div><h2>A title of the text</h2><p>{LONG}</p><p>{LONG}</p><p>Short end.</p></div></div>"
    "<div>" + "".join(f"<span><a href='/{i}'>More {i}</a>, </span>" for i in range(9)) + "</div></body>"
)
BARE_TEXT = f"A title of the text\n\n{LONG.strip()}\n\n{LONG.strip()}\n\nShort end."


@pytest.mark.parametrize(("source", "text"), CASES)
def test_page(source, text):
    assert extract(source) == text


def test_density_decides(monkeypatch):
    assert extract(BARE) == BARE_TEXT
    monkeypatch.setattr(html_text, "density", lambda *_: 0.0)
    assert extract(BARE) != BARE_TEXT


def plain_sums(page):
    """Composite text density and density sums by their definitions, node by node."""
    def below(i):
        return [i] + [k for c in page.items[i] if not isinstance(c, str) for k in below(c)]

    def is_link(i):
        return i > 0 and (page.tag[i] == "a" or is_link(page.parent[i]))

    def chars(nodes):
        return sum(len(" ".join(x.split())) for i in nodes for x in page.items[i] if isinstance(x, str))

    def measures(i):
        nodes = below(i)
        return chars(nodes), len(nodes) - 1, chars([k for k in nodes if is_link(k)]), sum(page.tag[k] == "a" for k in nodes[1:])

    c0, _, lc0, _ = measures(0)

    def ctd(i):
        c, t, lc, lt = measures(i)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + lc0 / max(c0, 1) * c + math.e)
        return c / max(t, 1) * math.log(max(1.0, c / max(lc, 1) * max(t, 1) / max(lt, 1))) / math.log(max(base, math.e))

    return [sum(ctd(c) for c in page.items[i] if not isinstance(c, str)) for i in range(len(page.tag))]


def test_the_core_is_the_plain_one(monkeypatch):
    rnd = random.Random(4)

    def made(depth):
        out = ""
        for _ in range(rnd.randrange(1, 5)):
            if depth and rnd.random() < 0.6:
                tag = rnd.choice(("div", "section", "p", "a", "b"))
                out += f"<{tag}>{made(depth - 1)}</{tag}>"
            else:
                out += " ".join(rnd.choices(("word", "a", "longer", "text"), k=rnd.randrange(1, 12))) + " "
        return out

    for _ in range(200):
        page = html_text.Page(f"<html><body>{made(5)}</body></html>")
        n = len(page.tag)
        linked = [False] * n
        for i in range(1, n):
            linked[i] = linked[page.parent[i]] or page.tag[i] == "a"
        counts = html_text.Counts(page, [True] * n, linked)
        sums = plain_sums(page)
        best = max((i for i in range(n) if page.tag[i] != "html"), key=lambda i: (round(sums[i], 9), -i))
        got = html_text.choose(page, [True] * n, counts, counts)
        up = best
        while page.tag[up] not in html_text.BLOCK and up:
            up = page.parent[up]
        path = [up]
        while path[-1]:
            path.append(page.parent[path[-1]])
        assert not sums[best] or got in path  # the core itself, or what its path to the body adds


def test_time_is_linear():
    began = time.time()
    for s in ("<div>" * 100_000, "<a " * 100_000, "<p><b><table><td>" + "<div>" * 30_000 + "</b>" * 30_000, '<a ">"' * 50_000, "<!" * 100_000 + ">", "<script>" + "</script " * 50_000, "<p>" * 100_000, "<" * 200_000):
        extract(s + "end")
    assert time.time() - began < 15


def test_deep_and_long():
    assert extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(extract("<article>" + "<p>word word word</p>" * 20000 + "</article>").split("\n\n")) == 20000


def test_frame(spark):
    df = spark.createDataFrame([(i, "u", s, 1) for i, (s, _) in enumerate(CASES)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in main_text(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(CASES)}
    assert main_text(df.limit(0)).count() == 0
