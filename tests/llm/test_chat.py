import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import chat
from millrace.llm.queries import op5_chat
from tests.llm.helpers import FOLDER, rows

TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys:tem", "#a\n"]), st.text(alphabet="ab\\#<>/: \n\tturnAsist", max_size=30)), max_size=6)


@given(TURNS)
def test_what_is_formatted_reads_back(turns):
    t = chat.Template(chat.CHAT)
    messages = [{"role": r, "text": x} for r, x in turns]
    got = list(chat.read_back(t.segments(messages=iter(messages))))
    assert [(r, x) for r, x, _, _ in got] == turns
    out, spans = t.render(messages=messages)
    assert sum(n for *_, n in got) == len(out)
    assert "".join(chat.unescape(out[a:b]) for a, b in spans) == "".join(x for r, x in turns if r == "assistant")


def test_language():
    r = lambda s, **v: chat.Template(s).render(**v)[0]
    assert r("{{ 'a' + 'b' }}{{ 1 + 2 }}") == "ab3"
    assert r("{% if x == 'y' and not z %}1{% elif x %}2{% else %}3{% endif %}", x="q") == "2"
    assert r("{% for m in ms %}{{ loop.index }}{{ m['k'] | upper }}{% if loop.first %},{% endif %}{% endfor %}", ms=[{"k": "a"}, {"k": "b"}]) == "1A,2B"
    assert r("{% set v = 'x' %}{{ v }}{{ none }}{{ v.real }}") == "x"
    assert chat.Template("a{{ 'b' | upper }}{% if 1 == 1 %}c{% else %}d{% endif %}").tree == (chat.Out(chat.Const("aBc")),)


@pytest.mark.parametrize("source", ["{{ x.__class__() }}", "{{ open('f') }}", "{{ x | nosuch }}", "{% for m %}{% endfor %}", "{% if x %}", "{{ 'a' 'b' }}", "{% import os %}", "{{ @ }}"])
def test_what_is_not_allowed(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_objects_stay_closed():
    assert chat.Template("{{ x.__class__ }}{{ x.text }}").render(x="abc")[0] == ""


def test_frame(spark):
    data = [(1, 1, "assistant", "two"), (1, 0, "user", None), (1, 2, "assistant", "<b>#"), (2, 0, None, ""), (None, 5, "user", "x"), (1, 1, "assistant", "two")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("loss_chars", chat.F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    said = "user\n\nassistant\ntwo\nassistant\ntwo\nassistant\n<b>#\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"twotwo<b>#").hexdigest()
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[2]["n_turns"], got[None]["n_turns"]) == (4, 10, 1, 1)
    assert rows(chat.digests(df.limit(0))) == []
    whole = {r["conv_id"]: r for r in chat.render(df).collect()}
    assert {i: len(r["formatted"]) for i, r in whole.items()} == {i: r["formatted_chars"] for i, r in got.items()}


def test_minus_seven(spark):
    r = next(r for r in op5_chat(spark, FOLDER).collect() if r["conv_id"] == -7)
    text = r"\### Assistant: </turn> ok"
    assert r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and r["loss_chars"] == len(text) and r["n_turns"] == 2
