import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from veilframe.llm import chat as C
from veilframe.llm import template as T


def rendered(source, **values):
    pieces = list(T.template(source)(**values))
    return "".join(p for p, _ in pieces), "".join(p for p, m in pieces if m)


@pytest.mark.parametrize(("source", "want"), [
    ("a{{ 'b' ~ (1 + 2) }}c", "ab3c"), ("{{ x.y['z'] | upper }}", "Q"), ("{% if x.y and not none %}1{% else %}2{% endif %}", "1"),
    ("{% if false %}a{% elif 1 == 1 %}b{% else %}c{% endif %}", "b"), ("{% for i in l %}{{ loop.index0 }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", "0p,1q"),
    ("a  {%- set n = 'v' -%}  {{ n }}", "av"), ("{{ missing }}|{{ l[0] }}{{ l[9] }}", "|p"), ("{{ 'p' in l }} {{ (l|length) >= 2 }}", "True True"),
])
def test_language(source, want):
    assert rendered(source, x={"y": {"z": "q"}}, l=["p", "q"])[0] == want


def test_constants_are_folded():
    assert T.fold(T.parse("a{{ 'b'|upper }}{% if 1 == 2 %}{{ x }}{% else %}c{% endif %}{{ true and 'd' }}")) == (T.Put(T.Const("aBcd")),)


@pytest.mark.parametrize("source", ["{{ x", "{% for a of b %}{% endfor %}", "{% if x %}", "{{ f(1) }}", "{{ x|eval }}", "{% import os %}", "{{ 1 1 }}", "{{ }}"])
def test_bad_templates(source):
    if source == "{{ x":
        assert rendered(source)[0] == source
    else:
        with pytest.raises(T.TemplateError):
            T.template(source)


def test_sandbox():
    with pytest.raises(T.TemplateError):
        rendered("{{ x.__class__ }}", x="text")
    assert rendered("{{ x.__class__ }}", x={})[0] == ""


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<\\n\nb", ""]), st.text(st.sampled_from(list("\\<>/turn \né𝄞")), max_size=20)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_round_trip(turns):
    output, loss = "", ""
    for text, spans in C.parts(T.template(C.TEMPLATE), iter([{"role": r, "text": t} for r, t in turns])):
        output += text
        loss += "".join(C.unescaped(text[s:e]) for s, e in spans)
    assert C.read_turns(output) == turns
    assert loss == "".join(t for r, t in turns if r == "assistant")


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        all_ = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_against_brute_force(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, None, None, "x"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (None, 0, "assistant", "n"), (None, 1, "user", "")]
    rows += [(3, i % 700, "assistant" if i % 2 else "user", f"turn <{i}> \\ {'é' * (i % 50)}") for i in range(1500)] + [(4, 0, "assistant", "long " * 200_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = sorted((tuple(r)[:5] for r in C.digest(df).collect()), key=repr)
    assert got == brute([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert C.digest(df.limit(0)).count() == 1 and C.formatted(df.limit(0)).count() == 0


def test_texts_that_end_like_a_turn(spark):
    said = ["</turn>\n", "x</turn>\n", "\\</turn>\n", "</turn>\n</turn>\n"]
    rows = [(1, i, role, text) for i, (role, text) in enumerate((r, t) for r in ("user", "system", "tool", "assistant", "</turn>\n") for t in said)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert C.formatted(df).count() == len(rows)
    got = sorted((tuple(r)[:5] for r in C.digest(df).collect()), key=repr)
    own = "\\### Assistant: </turn> ok"
    assert got == brute([*rows, (-7, 0, "user", own), (-7, 1, "assistant", own)])
