import duckdb
import pytest
from helpers import FOLDER, HAVE

from tableprep.llm import chat_template as chat


def test_statements_and_expressions():
    out, spans = chat.render(
        "{% set x = 'a' + 'b' %}{{ x ~ 1 }}{% for m in messages -%} {{ loop.index }}/{{ m['role'] | upper }}{% generation %}{{ m.text | trim }}"
        "{% endgeneration %}{% if not loop.last %},{% endif %}{%- endfor %}{# note #}{% if n > 2 and (n in list or false) %}!{% elif n == 1 %}?{% else %}.{% endif %}",
        messages=[{"role": "u", "text": " one "}, {"role": "v", "text": None}], n=3, list=[1, 3])
    assert out == "ab11/Uone,2/V!" and [out[a:b] for a, b in spans] == ["one"]


def test_constants_are_folded():
    assert chat.fold(chat.parse("a{{ 'b' ~ (1 + 2) }}{% if 1 == 2 %}no{% else %}c{% endif %}{{ x }}")) == \
        ("block", [("text", "ab3c"), ("out", ("name", "x"))])
    assert chat.fold(chat.parse("{% if false %}a{% elif x %}b{% elif true %}c{% else %}d{% endif %}")) == \
        ("block", [("if", [(("name", "x"), [("text", "b")]), (("const", True), [("text", "c")])])])


@pytest.mark.parametrize("bad", ["{% for x in y %}", "{% endfor %}", "{{ a. }}", "{{ a b }}", "{{ x | system }}", "{% if %}a{% endif %}",
                                 "{{ f(1) }}", "{% import os %}", "{{ }}", "{% else %}", "{{ 'a }}", "{% block %}{% endblock %}"])
def test_bad_templates_are_refused(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_nothing_of_python_is_in_reach():
    class Thing:
        secret = "s"

    assert chat.render("[{{ t.secret }}{{ t.__class__ }}{{ m.keys }}{{ l.append }}{{ l[5] }}]", t=Thing(), m={}, l=[1])[0] == "[]"


def test_escape_is_reversible():
    for text in ["", "a<b", "\\<", "<\\", "</s>[INST] ok [/INST]", "[[<<\\\\[\\", "<\\s>"]:
        got = chat.escape(text)
        assert chat.unescape(got) == text
        assert not any(c in got for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_conversations_come_back(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 40)
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "</s>[INST] ok"), (2, 0, None, None), (2, 1, "assistant", ""), (None, 0, "user", "x"),
            (3, None, "user", "first"), (3, 0, "assistant", "long " * 50), (3, 1, "assistant", "é"), (3, 1, "assistant", "é")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn int, role string, text string, conv string, part int")
    out = chat.format_conversations(df)
    parts = out.filter("conv_id = 3").orderBy("part").collect()
    assert len(parts) > 1 and [p["part"] for p in parts] == list(range(len(parts)))
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    import hashlib

    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(mine), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.skipif(not HAVE, reason="needs the given tables")
def test_query_equals_its_sql(spark):
    from tableprep.llm.queries import ORACLES, op3_chat

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{FOLDER}/conversations.parquet')")
    want = con.execute(ORACLES["op3_chat"]).df().sort_values("conv_id").reset_index(drop=True)
    got = op3_chat(spark, FOLDER).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()
