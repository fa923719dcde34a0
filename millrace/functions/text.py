"""Text analysis: string distances, phonetic codes, sentences, sentiment, differences, HTML, templates, tests of hypotheses."""

from __future__ import annotations

import difflib
import html
import json
import math
import re
from html.parser import HTMLParser

import numpy as np

from millrace.functions.registry import kernel, parse

EXPRESSIONS = parse("text", r"""
levenshtein = builtin ;; levenshtein(c_name, 'Customer#000000042') ;; levenshtein(c_name, 'Customer#000000042')
soundex = builtin
slug(s STRING) STRING = trim('-' FROM regexp_replace(lower(s), '[^a-z0-9]+', '-')) ;; slug(c_name) ;; lower(replace(c_name, '#', '-'))
script_of(s STRING) STRING = CASE WHEN s RLIKE '\\p{IsHan}' THEN 'Han' WHEN s RLIKE '\\p{IsCyrillic}' THEN 'Cyrillic' WHEN s RLIKE '\\p{IsArabic}' THEN 'Arabic' WHEN s RLIKE '\\p{IsGreek}' THEN 'Greek' WHEN s RLIKE '\\p{IsLatin}' THEN 'Latin' END ;; script_of(c_name) ;; 'Latin'
emoji_count(s STRING) INT = regexp_count(s, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]')
emoji_strip(s STRING) STRING = regexp_replace(s, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{200D}]', '')
emoji_extract(s STRING) STRING = to_json(regexp_extract_all(s, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}]', 0))
html_strip_tags(s STRING) STRING = regexp_replace(s, '<[^>]*>', '')
html_title(s STRING) STRING = nullif(trim(regexp_extract(s, '(?is)<title[^>]*>(.*?)</title>', 1)), '')
""")


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, pairs = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                pairs.append(c)
                break
    if not pairs:
        return 0.0
    others = [b[j] for j in range(len(b)) if used[j]]
    swapped = sum(x != y for x, y in zip(pairs, others, strict=True)) / 2
    m = len(pairs)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    j = jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j)


def damerau_levenshtein(a: str, b: str) -> int:
    """The true distance: text between two swapped characters may change too."""
    last: dict[str, int] = {}
    top = len(a) + len(b)
    d = [[top] * (len(b) + 2)] + [[top, *([i] if i else range(len(b) + 1)), *([0] * len(b) if i else [])] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        hit = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), hit
            cost = a[i - 1] != b[j - 1]
            if not cost:
                hit = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + i - k - 1 + 1 + j - m - 1)
        last[a[i - 1]] = i
    return d[len(a) + 1][len(b) + 1]


ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st vs etc e.g i.e inc ltd co no vol fig".split())


def sentence_spans(text: str) -> list[tuple[int, int]]:
    out, start = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*(?=\s|$)", text):
        before = re.search(r"([\w.]+)$", text[start : m.start()])
        initials = before and re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]", before[1]) and re.match(r"\s+[a-z]", text[m.end() :])
        if m[0].startswith(".") and before and (before[1].lower() in ABBREVIATIONS or initials):
            continue
        out.append((start, m.end()))
        start = m.end()
    out.append((start, len(text)))
    trimmed = [(a + len(text[a:b]) - len(text[a:b].lstrip()), b - len(text[a:b]) + len(text[a:b].rstrip())) for a, b in out]
    return [(a, b) for a, b in trimmed if a < b]


def sentences(text: str) -> list[str]:
    return [text[a:b] for a, b in sentence_spans(text)]


#: Words of plain polarity.
POSITIVE = frozenset("good great excellent amazing wonderful best love loved like happy joy beautiful awesome fantastic perfect nice brilliant superb delightful win".split())
NEGATIVE = frozenset("bad terrible awful horrible worst hate hated sad angry ugly poor disgusting pathetic stupid idiot trash worthless fail loser wrong".split())
BOOSTERS = {"very": 1.3, "really": 1.3, "extremely": 1.5, "slightly": 0.7, "somewhat": 0.8}
NEGATIONS = frozenset("not no never cannot can't don't isn't wasn't won't without".split())


def polarity(text: str) -> dict[str, float]:
    words = re.findall(r"[\w']+", text.lower())
    total = pos = neg = 0.0
    for i, w in enumerate(words):
        s = 1.0 if w in POSITIVE else -1.0 if w in NEGATIVE else 0.0
        if not s:
            continue
        before = words[max(0, i - 3) : i]
        for b in before[-1:]:
            s *= BOOSTERS.get(b, 1.0)
        if NEGATIONS & set(before):
            s *= -0.74
        total += 2 * s
        pos, neg = pos + max(s, 0.0), neg + max(-s, 0.0)
    n = max(len(words), 1)
    compound = total / math.sqrt(total * total + 15)
    pos, neg = min(pos / n, 1.0), min(neg / n, 1.0)
    return {"pos": round(pos, 4), "neu": round(max(0.0, 1 - pos - neg), 4), "neg": round(neg, 4), "compound": round(compound, 4)}


def porter(word: str) -> str:
    """Porter's stemmer (1980), by its five steps."""
    w = word.lower()
    if len(w) <= 2:
        return w
    cons = lambda s, i: s[i] not in "aeiou" and not (s[i] == "y" and i > 0 and cons(s, i - 1))
    form = lambda s: re.sub(r"(.)\1+", r"\1", "".join("c" if cons(s, i) else "v" for i in range(len(s))))
    measure = lambda s: form(s).count("vc")
    vowel = lambda s: "v" in form(s)
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and cons(s, len(s) - 1)
    cvc = lambda s: len(s) > 2 and cons(s, len(s) - 1) and not cons(s, len(s) - 2) and cons(s, len(s) - 3) and s[-1] not in "wxy"
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")) or (measure(w) == 1 and cvc(w)):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    steps = (
        "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble",
        "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:",
    )
    for table in steps:
        for pair in sorted(table.split(), key=lambda p: -len(p.split(":")[0])):
            end, new = pair.split(":")
            if w.endswith(end):
                if measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if measure(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.images, self.skip = [], [], [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "img":
            self.images.append({"src": a.get("src", ""), "alt": a.get("alt", "")})
        elif tag in ("p", "br", "div", "li", "h1", "h2", "h3", "tr"):
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def read_html(source: str) -> _Reader:
    r = _Reader()
    r.feed(source)
    r.close()
    return r


def html_to_text(source: str) -> str:
    lines = (" ".join(x.split()) for x in "".join(read_html(source).text).split("\n"))
    return "\n".join(x for x in lines if x)


def compact(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def line_changes(a: str, b: str) -> tuple[list[str], list[str]]:
    d = list(difflib.ndiff(a.splitlines(), b.splitlines()))
    return [x[2:] for x in d if x.startswith("+ ")], [x[2:] for x in d if x.startswith("- ")]


def template(source: str, context: str) -> str:
    """`{{a.b}}` is escaped, `{{{a}}}` is not; `{{#list}}...{{/list}}` repeats or tests, `{{^x}}` is its opposite."""

    def look(stack, name):
        if name == ".":
            return stack[-1]
        for c in reversed(stack):
            node = c
            for part in name.split("."):
                node = node.get(part) if isinstance(node, dict) else None
            if node is not None:
                return node
        return None

    def render(text, stack):
        block = re.compile(r"\{\{([#^])\s*([\w.]+)\s*\}\}(.*?)\{\{/\s*\2\s*\}\}", re.S)

        def section(m):
            v = look(stack, m[2])
            if m[1] == "^":
                return render(m[3], stack) if not v else ""
            return "".join(render(m[3], [*stack, x]) for x in v) if isinstance(v, list) else render(m[3], [*stack, v]) if v else ""

        text = block.sub(section, text)
        text = re.sub(r"\{\{\{\s*([\w.]+)\s*\}\}\}", lambda m: str(look(stack, m[1]) or ""), text)
        return re.sub(r"\{\{\s*([\w.]+)\s*\}\}", lambda m: html.escape(str("" if (v := look(stack, m[1])) is None else v)), text)

    return render(source, [json.loads(context)])


def beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or 1e-300)
        c = 1 + n / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def gamma_tail(a: float, x: float) -> float:
    """1 minus the regularised lower incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / 2, 0.5, df / (df + t * t))


def t_test(x, y=None, mu: float = 0.0, equal: bool = False) -> str:
    x = np.array(x, float)
    if y is None:
        t, df = (x.mean() - mu) / math.sqrt(x.var(ddof=1) / len(x)), len(x) - 1.0
    else:
        y = np.array(y, float)
        a, b = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
        if equal:
            df = len(x) + len(y) - 2.0
            pooled = ((len(x) - 1) * x.var(ddof=1) + (len(y) - 1) * y.var(ddof=1)) / df
            t = (x.mean() - y.mean()) / math.sqrt(pooled * (1 / len(x) + 1 / len(y)))
        else:
            df = (a + b) ** 2 / (a * a / (len(x) - 1) + b * b / (len(y) - 1))
            t = (x.mean() - y.mean()) / math.sqrt(a + b)
    return compact({"t": float(t), "df": float(df), "p": t_two_sided(float(t), float(df))})


def chi_square(observed, expected, df: int) -> str:
    o, e = np.array(observed, float).ravel(), np.array(expected, float).ravel()
    x = float(((o - e) ** 2 / e).sum())
    return compact({"chi2": x, "df": df, "p": gamma_tail(df / 2, x / 2)})


def independence(table: str) -> str:
    t = np.array(json.loads(table), float)
    if min(t.shape) < 2:
        return None
    return chi_square(t, np.outer(t.sum(1), t.sum(0)) / t.sum(), (t.shape[0] - 1) * (t.shape[1] - 1))


def anova(groups: str) -> str:
    g = [np.array(x, float) for x in json.loads(groups)]
    every = np.concatenate(g)
    between = sum(len(x) * (x.mean() - every.mean()) ** 2 for x in g)
    within = sum(((x - x.mean()) ** 2).sum() for x in g)
    a, b = len(g) - 1, len(every) - len(g)
    f = float(between / a / (within / b))
    return compact({"F": f, "df_between": a, "df_within": b, "p": beta_tail(b / 2, a / 2, b / (b + a * f))})


def rejected(p: str, alpha: float, method: str) -> str | None:
    """Which hypotheses are rejected at a level alpha for all: Bonferroni, Holm, Benjamini-Hochberg or Benjamini-Yekutieli."""
    x = np.array(json.loads(p), float)
    m, order = len(x), np.argsort(x, kind="stable")
    if not m or not 0 <= alpha <= 1 or not ((x >= 0) & (x <= 1)).all():
        return None
    short = lambda v: int(v) if v == int(v) else float(v)
    if method == "bonferroni":
        return compact({"adjusted_alpha": short(alpha / m), "reject_array": (x <= alpha / m).astype(int).tolist()})
    if method == "holm":
        passed = np.logical_and.accumulate(x[order] <= alpha / np.arange(m, 0, -1))
        out = np.zeros(m, int)
        out[order] = passed
        return compact({"sorted_indices": order.tolist(), "reject_array": out.tolist()})
    weight = sum(1 / i for i in range(1, m + 1)) if method == "by" else 1.0
    under = np.flatnonzero(x[order] <= np.arange(1, m + 1) * alpha / (m * weight))
    threshold = x[order][under[-1]] if len(under) else 0.0
    return compact({"threshold": short(threshold), "reject_array": ((x <= threshold) & bool(len(under))).astype(int).tolist()})


def tested(f):
    """A test's result, or null for what it is not defined for: text that is no list of numbers, too few values, no spread."""

    def run(*args):
        try:
            with np.errstate(all="raise"):
                return f(*args)
        except (ValueError, TypeError, IndexError, ArithmeticError):
            return None

    return run


J = json.loads
KERNELS = [
    kernel("fuzzy", "jaro", "double", jaro),
    kernel("fuzzy", "jaro_winkler", "double", jaro_winkler),
    kernel("fuzzy", "damerau_levenshtein", "long", damerau_levenshtein),
    kernel("fuzzy", "text_similarity", "double", lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()),
    kernel("nlp", "split_sentences", "string", lambda t: compact(sentences(t))),
    kernel("nlp", "sentence_count", "long", lambda t: len(sentences(t))),
    kernel("nlp", "split_sentences_with_indices", "string", lambda t: compact([{"sentence": t[a:b], "start": a, "end": b} for a, b in sentence_spans(t)])),
    kernel("nlp", "sentiment_score", "double", lambda t: polarity(t)["compound"]),
    kernel("nlp", "sentiment_label", "string", lambda t: "positive" if (c := polarity(t)["compound"]) >= 0.05 else "negative" if c <= -0.05 else "neutral"),
    kernel("nlp", "sentiment_breakdown", "string", lambda t: compact(polarity(t))),
    kernel("nlp", "sentiment_positive", "double", lambda t: polarity(t)["pos"]),
    kernel("nlp", "sentiment_negative", "double", lambda t: polarity(t)["neg"]),
    kernel("nlp", "sentiment_neutral", "double", lambda t: polarity(t)["neu"]),
    kernel("nlp", "stem", "string", porter),
    kernel("nlp", "stem_porter", "string", porter),
    kernel("nlp", "text_diff", "string", lambda a, b: "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm=""))),
    kernel("nlp", "text_diff_added", "string", lambda a, b: compact(line_changes(a, b)[0])),
    kernel("nlp", "text_diff_removed", "string", lambda a, b: compact(line_changes(a, b)[1])),
    kernel("nlp", "text_diff_summary", "string", lambda a, b: compact(dict(zip(("added", "removed"), map(len, line_changes(a, b)), strict=True)))),
    kernel("html", "html_to_text", "string", html_to_text),
    kernel("html", "html_links", "string", lambda s: compact(read_html(s).links)),
    kernel("html", "html_images", "string", lambda s: compact([dict(sorted(i.items())) for i in read_html(s).images])),
    kernel("template", "template_render", "string", template),
    kernel("hypothesis", "t_test_1samp", "string", tested(lambda x, mu: t_test(J(x), mu=float(mu)))),
    kernel("hypothesis", "t_test_2samp", "string", tested(lambda x, y, equal=0: t_test(J(x), J(y), equal=bool(equal)))),
    kernel("hypothesis", "t_test_paired", "string", tested(lambda x, y: t_test(np.array(J(x)) - np.array(J(y))))),
    kernel("hypothesis", "chi_sq_gof", "string", tested(lambda o, e: chi_square(J(o), J(e), len(J(o)) - 1))),
    kernel("hypothesis", "chi_sq_independence", "string", tested(independence)),
    kernel("hypothesis", "anova_f", "string", tested(anova)),
    *(kernel("hypothesis", f"mc_{n}", "string", tested(lambda p, alpha, m=m: rejected(p, float(alpha), m))) for n, m in (("bonferroni", "bonferroni"), ("holm", "holm"), ("bh_fdr", "bh"), ("by_fdr", "by"))),
]

FUNCTIONS = [*EXPRESSIONS, *KERNELS]
