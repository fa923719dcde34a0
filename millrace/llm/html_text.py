"""Main text of web pages by composite text density (Sun, Song and Liao 2011).

A page is parsed to a tree by one pass of a tokenizer.  Every node gets its characters per tag, adjusted for links; a
node's density sum is that of its children's densities.  The node of the largest sum is the core of the text.  From it
the way up towards the body is followed: the least density on that path is the threshold, and a parent is taken while
what it adds is at least as dense (or while its markup says that it is the article).  Noise inside the chosen subtree
(navigation, headers, footers, sidebars, notices, adverts, forms, reader comments) then goes by tag, role, class and
heading; a class word alone never removes a node that holds most of the page's text.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame

from millrace.llm.common import append_columns

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
COMMENTS = re.compile(r"\W*\d*\W*(?:reader |user |leave an? )?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)\W*\d*\W*", re.I)

# Element names of the HTML standard, and words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption legend summary".split()) | {"table"}
INVISIBLE = frozenset("head script style noscript iframe textarea title button select option input svg canvas object embed template audio video map xmp noembed noframes".split())
DROPPED = frozenset("nav footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices disclaimer alert sidebar sidenav aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus respond replies share sharing social related recommended newsletter subscribe signup login popup modal overlay pagination pager widget toolbar skip".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LI = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "option": ("select",)}
SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot")}
REMARKS = frozenset("comment comments disqus respond replies".split())
TABLE = frozenset("td th tr table tbody thead tfoot".split())


class Page:
    """Nodes in document order: tag, parent, attributes (source text), and items: ints (nodes) and strings (text).

    Parsing takes time linear in the source, whatever its markup: each open tag's places on the stack are known.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.attributes, self.items = ["#root"], [-1], [""], [[]]
        self.stack, self.open_at = [0], defaultdict(list)
        at, end, pattern = 0, len(source), TAG
        while at < end:
            i = source.find("<", at)
            if i < 0:
                i = end
            if i > at:
                self.text(source[at:i])
            at = i
            if at == end:
                break
            if source.startswith("<!--", at):
                at = self.after(source, "-->", at + 4)
            elif source.startswith("<![CDATA[", at):
                stop = source.find("]]>", at)
                self.text(source[at + 9 : stop if stop >= 0 else end].replace("&", "&amp;"))
                at = stop + 3 if stop >= 0 else end
            elif source.startswith(("<!", "<?"), at):
                at = self.after(source, ">", at)
            elif not source[at + 1 : at + 3].lstrip("/")[:1].isalpha():
                self.text("<")
                at += 1
            else:
                m = pattern.match(source, at)
                if not m and pattern is TAG:
                    pattern = PLAIN_TAG  # quotes do not pair up to the end: from here on a tag ends at the next ">"
                    m = pattern.match(source, at)
                if m:
                    at = self.element(source, m)
                elif source.find(">", at) < 0:
                    self.text(source[at:])
                    at = end
                else:
                    self.text("<")
                    at += 1

    @staticmethod
    def after(source: str, mark: str, at: int) -> int:
        i = source.find(mark, at)
        return len(source) if i < 0 else i + len(mark)

    def element(self, source: str, m: re.Match) -> int:
        """Open or close what a tag says; where reading goes on."""
        tag, at = m[2].lower(), m.end()
        if m[1]:
            self.close(tag)
            return at
        self.open(tag, m[3])
        if tag in RAW and not m[3].endswith("/"):
            last = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            if tag not in INVISIBLE:
                self.text(source[at : last.start() if last else len(source)])
            self.close(tag)
            at = self.after(source, ">", last.end()) if last else len(source)
        return at

    def text(self, s: str) -> None:
        self.items[self.stack[-1]].append(s)

    def open(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self.close_within("p", ("button", "td", "th", "table", "object"))
        if tag in LI:
            for t in SAME.get(tag, (tag,)):
                self.close_within(t, LI[tag])
        elif tag in HEADINGS and self.tag[self.stack[-1]] in HEADINGS:
            self.cut(len(self.stack) - 1)
        n = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.attributes.append(attributes)
        self.items.append([])
        self.items[self.stack[-1]].append(n)
        if tag not in VOID:
            self.open_at[tag].append(len(self.stack))
            self.stack.append(n)

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.open_at[self.tag[self.stack.pop()]].pop()

    def place(self, *tags: str) -> int:
        """The highest place on the stack of an open element of these names; 0 for none."""
        return max((self.open_at[t][-1] for t in tags if self.open_at.get(t)), default=0)

    def close_within(self, tag: str, scope: tuple) -> None:
        i = self.place(tag)
        if i and i > self.place(*scope):
            self.cut(i)

    def close(self, tag: str) -> None:
        i = self.place(tag)
        if i and (tag in TABLE or i > self.place("td", "th", "table")):
            self.cut(i)

    def words(self, n: int) -> set[str]:
        out: set[str] = set()
        for m in ATTRIBUTE.finditer(self.attributes[n]):
            name = m[1].lower()
            if name in ("class", "id"):
                out.update(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", html.unescape(m[2] or m[3] or m[4] or "")).lower()))
            elif name == "role":
                out.add("role " + (m[2] or m[3] or m[4] or "").strip().lower())
            elif name in ("hidden", "aria-hidden") and (m[2] or m[3] or m[4] or name).lower() not in ("false", "until-found"):
                out.add("hidden")
        return out

    def noise(self, n: int, inside: bool, share: float) -> bool:
        """inside: below an article or main element, where a header may hold the article's own title; share: of the page's text."""
        tag = self.tag[n]
        if tag in DROPPED or tag == "header" and not inside or tag == "form" and share <= 0.5:
            return True
        if not self.attributes[n] or tag in ("html", "body", "article", "main"):
            return False
        words = self.words(n)
        if "hidden" in words or words & REMARKS or any(w.startswith("role ") and w[5:] in ROLES for w in words):
            return True
        return share <= 0.5 and bool(words & NOISE)

    def remarks(self) -> set[int]:
        """Roots of reader comments that a heading announces: its parent, or, below an article itself, all after it."""
        out = set()
        for n, tag in enumerate(self.tag):
            if tag in HEADINGS and COMMENTS.fullmatch(html.unescape("".join(x for x in self.items[n] if isinstance(x, str)))):
                p = self.parent[n]
                around = [x for x in self.items[p] if not isinstance(x, str) or x.strip()]
                if around[0] == n and self.tag[p] not in ("#root", "html", "body", "article", "main"):
                    out.add(p)
                else:
                    after = [x for x in around[around.index(n) :] if not isinstance(x, str)]
                    stop = next((k for k, x in enumerate(after[1:], 1) if self.tag[x] in HEADINGS), len(after))
                    out.update(after[:stop])
        return out


def density(c: float, t: float, lc: float, lt: float, body: float) -> float:
    """Composite text density: c, t are a node's characters and tags, lc, lt those of links; body is the page's link
    characters per character.  The base of the logarithm is the paper's, but e at least."""
    if not c:
        return 0.0
    t, lt, lc_or_1, rest = max(t, 1), max(lt, 1), max(lc, 1), max(c - lc, 1)
    base = math.log(c / rest * lc + body * c + math.e)
    return c / t * math.log(max(c / lc_or_1 * t / lt, 1.0)) / math.log(max(base, math.e))


class Counts:
    """Characters, tags, link characters and link tags of every node, over the nodes that `of` holds to be there."""

    def __init__(self, page: Page, of: list[bool], linked: list[bool]):
        n = len(page.tag)
        self.c, self.t, self.lc, self.lt = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            if not of[i]:
                continue
            own = sum(len(" ".join(x.split())) for x in page.items[i] if isinstance(x, str))
            self.c[i] += own
            self.lc[i] += own if linked[i] else 0
            if i:
                p = page.parent[i]
                self.c[p] += self.c[i]
                self.t[p] += self.t[i] + 1
                self.lc[p] += self.lc[i]
                self.lt[p] += self.lt[i] + (page.tag[i] == "a")

    def of(self, i: int) -> tuple[int, int, int, int]:
        return self.c[i], self.t[i], self.lc[i], self.lt[i]


def choose(page: Page, keep: list[bool], all_: Counts, kept: Counts) -> int:
    """The root of the main text: the kept node of the largest density sum, and what of the path to the body belongs to it."""
    n = len(page.tag)
    ratio = all_.lc[0] / max(all_.c[0], 1)
    dense = [density(*all_.of(i), ratio) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        if keep[i]:
            sums[page.parent[i]] += dense[i]
    body = next((i for i in range(n) if page.tag[i] == "body" and keep[i]), 0)
    best = max((i for i in range(n) if keep[i] and page.tag[i] != "html"), key=lambda i: (sums[i], -i))
    if not sums[best]:
        return body
    path = [best]
    while path[-1] not in (0, body):
        path.append(page.parent[path[-1]])
    threshold = min(dense[i] for i in path)
    article = next((i for i in path if page.tag[i] == "article"), next((i for i in path if page.tag[i] == "main"), None))
    for below, i in zip(path, path[1:], strict=False):
        more = [x - y for x, y in zip(kept.of(i), kept.of(below), strict=True)]
        if not more[0]:
            continue  # a mere wrapper: what lies above it decides
        # Nodes come in document order, so those of the path from the article down have numbers not under its own.
        if not (article is not None and i >= article) and density(*more, ratio) < threshold:
            break
        best = i
    while page.tag[best] not in BLOCK and best:
        best = page.parent[best]
    return best


def extract(source: str | None) -> str:
    """The main text of a page: blocks joined by two line feeds; empty for null, or a page without text."""
    if not source:
        return ""
    page = Page(source)
    n = len(page.tag)
    seen, inside, linked = [True] * n, [False] * n, [False] * n
    for i in range(1, n):
        p = page.parent[i]
        inside[i] = inside[p] or page.tag[i] in ("article", "main")
        linked[i] = linked[p] or page.tag[i] == "a"
        seen[i] = seen[p] and page.tag[i] not in INVISIBLE
    counts = Counts(page, seen, linked)
    if not counts.c[0]:
        return ""
    remarks, keep = page.remarks(), seen[:]
    for i in range(1, n):
        keep[i] = seen[i] and keep[page.parent[i]] and i not in remarks and not page.noise(i, inside[page.parent[i]], counts.c[i] / counts.c[0])
    top = choose(page, keep, counts, Counts(page, keep, linked))
    if not inside[top]:  # beside a text that no markup marks, a part of two links or more and nothing else is a menu
        for x in page.items[top]:
            if not isinstance(x, str) and counts.lt[x] > 1 and counts.lc[x] == counts.c[x]:
                keep[x] = False
    return blocks(page, top, keep)


def blocks(page: Page, top: int, keep: list[bool]) -> str:
    """The kept text below a node, by block; white space runs, line breaks included, become one space."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        if line := " ".join(html.unescape("".join(run)).split()):
            out.append(line)
        run.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif keep[x]:
            if page.tag[x] == "br":
                run.append(" ")
            elif page.tag[x] in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(page.items[x])
    flush()
    return "\n\n".join(out)


def main_text(df: DataFrame, source: str = "html") -> DataFrame:
    """df with `text` (the main text) and `n_chars` (its code points).

    Null and empty pages, and pages of noise alone, give an empty text.  A page without tags is one block.  Unclosed and
    misplaced tags are mended, as browsers do.  Other columns pass through; repeated rows are extracted alike.
    """
    at = [c for c in df.columns if c not in ("text", "n_chars")].index(source)

    def factory():
        def run(b):
            got = [extract(x) for x in b.column(at).to_pylist()]
            return [got, [len(t) for t in got]]

        return run

    return append_columns(df, {"text": "string", "n_chars": "long"}, factory)
