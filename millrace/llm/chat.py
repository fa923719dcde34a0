"""Chat formatting with a template compiler.

The template language: text, `{{ expression }}`, and the blocks for / if / elif / else / set / generation.  Expressions
have names, `a.b` and `a['b']` (keys of mappings only), strings, integers, ==, !=, and, or, not, + (joins strings), and
filters `x | name`.  A template reaches nothing but its variables and the named filters: there are no calls and no
attributes of Python objects.  A source is parsed to a syntax tree, constants are folded, neighbouring texts joined, and
the tree is turned into Python closures.  Rendering is lazy: messages may be any iterator, and one turn at a time is held.
`generation` blocks mark the text that the loss covers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices

CHAT = "{% for m in messages %}### {{ m.role | name }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
TURN = re.compile(r"### ((?:[^\\#<:]++|\\.)*+): ((?:[^\\#<]++|\\.)*+)</turn>\n", re.S)


def escape(text: str) -> str:
    """A backslash before each backslash, # and <, without which no control string can arise."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")


def escape_name(text: str) -> str:
    return escape(text).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable] = {"escape": escape, "name": escape_name, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: object
    key: object


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Out:
    expr: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    tests: tuple  # of (expression, body)


@dataclass(frozen=True)
class Set:
    name: str
    expr: object


@dataclass(frozen=True)
class Generation:
    body: tuple


LEX = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.\[\]()+]))")


class Expression:
    """A parser by descent: or < and < not < == < + < filter < key < atom."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            if not (m := LEX.match(source, at)):
                raise TemplateError(f"not understood: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in words

    def take(self, *words: str) -> str:
        if words and not self.peek(*words) or self.at >= len(self.tokens):
            raise TemplateError(f"expected {' or '.join(words) or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        e = self.parse_or()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]!r}")
        return e

    def chain(self, words: tuple, below: Callable):
        e = below()
        while self.peek(*words):
            e = Op(self.take(), (e, below()))
        return e

    def parse_or(self):
        return self.chain(("or",), lambda: self.chain(("and",), self.parse_not))

    def parse_not(self):
        if self.peek("not"):
            self.take()
            return Op("not", (self.parse_not(),))
        return self.chain(("==", "!="), lambda: self.chain(("+",), self.parse_filter))

    def parse_filter(self):
        e = self.parse_atom()
        while self.peek("|", ".", "["):
            kind = self.take()
            if kind == "|":
                name = self.take()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                e = Filter(e, name)
            elif kind == ".":
                e = Key(e, Const(self.take()))
            else:
                e = Key(e, self.parse_or())
                self.take("]")
        return e

    def parse_atom(self):
        if self.peek("("):
            self.take()
            e = self.parse_or()
            self.take(")")
            return e
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1]))
        if kind == "int":
            return Const(int(word))
        if kind == "name":
            return Const({"true": True, "false": False}[word]) if word in ("true", "false") else Name(word)
        raise TemplateError(f"unexpected {word!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    at = 0

    def body(*ends: str) -> tuple[list, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            p = parts[at]
            at += 1
            if p.startswith("{{"):
                out.append(Out(Expression(p[2:-2]).whole()))
            elif p.startswith("{%"):
                tag = p[2:-2].strip()
                word, _, rest = tag.partition(" ")
                if word in ends:
                    return out, tag
                if word == "for":
                    if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
                        raise TemplateError(f"not a loop: {tag!r}")
                    inner, _ = body("endfor")
                    out.append(For(m[1], Expression(m[2]).whole(), tuple(inner)))
                elif word == "if":
                    tests, test = [], Expression(rest).whole()
                    while True:
                        inner, end = body("elif", "else", "endif")
                        tests.append((test, tuple(inner)))
                        if end == "endif":
                            break
                        if end == "else":
                            inner, _ = body("endif")
                            tests.append((Const(True), tuple(inner)))
                            break
                        test = Expression(end.partition(" ")[2]).whole()
                    out.append(If(tuple(tests)))
                elif word == "set":
                    name, _, value = rest.partition("=")
                    out.append(Set(name.strip(), Expression(value).whole()))
                elif word == "generation":
                    inner, _ = body("endgeneration")
                    out.append(Generation(tuple(inner)))
                else:
                    raise TemplateError(f"no block {word!r}")
            elif p:
                out.append(Out(Const(p)))
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return out, ""

    return tuple(body()[0])


def fold(node):
    """The same tree with constant expressions worked out, decided branches taken and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if out and isinstance(y, Out) and isinstance(out[-1], Out) and isinstance(y.expr, Const) and isinstance(out[-1].expr, Const):
                    out[-1] = Out(Const(text(out[-1].expr.value) + text(y.expr.value)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Out):
        return Out(fold(node.expr))
    if isinstance(node, Set):
        return Set(node.name, fold(node.expr))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        tests = []
        for test, inner in ((fold(t), fold(b)) for t, b in node.tests):
            if isinstance(test, Const) and not test.value:
                continue
            tests.append((test, inner))
            if isinstance(test, Const):
                break
        if not tests:
            return ()
        return tests[0][1] if isinstance(tests[0][0], Const) else If(tuple(tests))
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Key):
        return Key(fold(node.of), fold(node.key))
    if isinstance(node, Op):
        args = tuple(fold(a) for a in node.args)
        return Const(operate(node.kind, *(lambda v=a.value: v for a in args))) if all(isinstance(a, Const) for a in args) else Op(node.kind, args)
    return node


def text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def operate(kind: str, *args: Callable):
    if kind == "not":
        return not args[0]()
    if kind == "and":
        return args[0]() and args[1]()
    if kind == "or":
        return args[0]() or args[1]()
    a, b = args[0](), args[1]()
    if kind == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else text(a) + text(b)
    return (a == b) == (kind == "==")


def compile_expression(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Key):
        of, key = compile_expression(node.of), compile_expression(node.key)

        def look(env):
            held = of(env)
            return held.get(key(env)) if isinstance(held, Mapping) else None

        return look
    if isinstance(node, Filter):
        of, f = compile_expression(node.of), FILTERS[node.name]
        return lambda env: f(text(of(env)))
    args = [compile_expression(a) for a in node.args]
    return lambda env, k=node.kind: operate(k, *((lambda a=a: a(env)) for a in args))


def compile_body(nodes: tuple) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    """A closure that yields (text, under the loss mask) for a block."""
    steps = [compile_node(n) for n in nodes]

    def run(env, marked):
        for s in steps:
            yield from s(env, marked)

    return run


def compile_node(node) -> Callable:
    if isinstance(node, Out):
        expr = compile_expression(node.expr)
        return lambda env, marked: ((text(expr(env)), marked),)
    if isinstance(node, Set):
        expr = compile_expression(node.expr)

        def assign(env, marked):
            env[node.name] = expr(env)
            return ()

        return assign
    if isinstance(node, Generation):
        inner = compile_body(node.body)
        return lambda env, marked: inner(env, True)
    if isinstance(node, If):
        tests = [(compile_expression(t), compile_body(b)) for t, b in node.tests]

        def choose(env, marked):
            for test, inner in tests:
                if test(env):
                    yield from inner(env, marked)
                    return

        return choose
    over, inner = compile_expression(node.over), compile_body(node.body)

    def loop(env, marked):
        items = over(env)
        for i, item in enumerate(items if isinstance(items, Iterable) and not isinstance(items, str | Mapping) else ()):
            yield from inner(env | {node.name: item, "loop": {"index": i + 1, "index0": i, "first": not i}}, marked)

    return loop


class Template:
    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self.body = compile_body(self.tree)

    def segments(self, **variables) -> Iterator[tuple[str, bool]]:
        return self.body(variables, False)

    def render(self, **variables) -> tuple[str, list[tuple[int, int]]]:
        """The formatted text and the spans (start, end in code points) that generation blocks mark."""
        out, spans, n = [], [], 0
        for s, marked in self.segments(**variables):
            if marked and s:
                spans.append((n, n + len(s)))
            out.append(s)
            n += len(s)
        return "".join(out), spans


def read_back(segments: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the mask, formatted length) of each turn of CHAT's output, one turn held at a time."""
    held, masked = [], []
    for s, marked in segments:
        held.append(s)
        if marked:
            masked.append(unescape(s))
        if s.endswith("</turn>\n") and not marked:
            whole = "".join(held)
            if not (m := TURN.fullmatch(whole)):
                continue
            yield unescape(m[1]), unescape(m[2]), "".join(masked), len(whole)
            held, masked = [], []
    if "".join(held):
        raise TemplateError("the output ends inside a turn")


def _formatted(source: str):
    def run(batches):
        template = Template(source)
        rows = (r for b in slices(batches) for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        out: list[tuple] = []

        def batch():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for conv, turns in groupby(rows, key=lambda r: r[0]):
            n = chars = size = 0
            all_, loss = hashlib.sha256(), hashlib.sha256()
            messages = ({"role": r[1] or "", "text": r[2] or ""} for r in turns)
            for role, said, masked, length in read_back(template.segments(messages=messages)):
                n, chars, size = n + 1, chars + len(masked), size + length
                all_.update(f"{role}\n{said}\n".encode())
                loss.update(masked.encode())
            out.append((conv, n, all_.hexdigest(), chars, loss.hexdigest(), size))
            if len(out) >= 4096:
                yield batch()
                out = []
        if out:
            yield batch()

    return run


def render(df: DataFrame, template: str = CHAT, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, formatted, spans) by conversation, for those that fit in a row; spans are [start, end] pairs.

    Turns are ordered as in digests(); the output of one conversation is held whole.
    """

    def run(batches):
        t = Template(template)
        rows = (r for b in slices(batches) for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        for conv, turns in groupby(rows, key=lambda r: r[0]):
            out, spans = t.render(messages=({"role": r[1] or "", "text": r[2] or ""} for r in turns))
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([out]), pa.array([[list(s) for s in spans]], pa.list_(pa.list_(pa.int64())))], names=["conv_id", "formatted", "spans"])

    return ordered(df, conv_id).mapInArrow(run, "conv_id long, formatted string, spans array<array<long>>")


def ordered(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Each conversation in one partition, its turns in order.  The sort spills, so a long conversation needs no memory."""
    rows = df.select(F.col(conv_id).cast("long").alias("conv_id"), "role", "text", F.col("turn").alias("_turn"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text").select("conv_id", "role", "text")


def digests(df: DataFrame, template: str = CHAT, conv_id: str = "conv_id") -> DataFrame:
    """Format every conversation and read the output back: one row of digests per conversation (see _formatted).

    Turns are ordered by turn, ties by role and text, nulls first; repeated rows are turns of their own; null roles and
    texts are empty; rows of a null conv_id form one conversation.  A digest runs over a conversation from end to end,
    so its turns go through one task, streamed: what is held is one turn, however long the conversation.
    """
    return ordered(df, conv_id).mapInArrow(_formatted(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
