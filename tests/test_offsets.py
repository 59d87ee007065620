import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from veilframe.functions import offsets as O
from veilframe.operators import redact
from veilframe.sources import readers

CHARS = list("ab \t\n\x00\x7f") + ["​", "’", "…", "ﬃ", "१", " ", "½", "Ａ", "é", "\U0001d11e", " "]


def spec(text):
    """One character after the other: its form, then each of its characters unless too many of its kind stand before."""
    out = []
    for i, c in enumerate(text):
        form = O.FORMS.get(ord(c))
        for x in unicodedata.normalize("NFKC", c) if form is None else form:
            tail = "".join(y for y, _ in out)
            blanks = len(tail) - len(tail.rstrip(" \t"))
            lines = len(tail) - len(tail.rstrip("\n"))
            if not (x in " \t" and blanks >= 2 or x == "\n" and lines >= 3):
                out.append((x, i))
    return "".join(x for x, _ in out), [i for _, i in out]


@given(st.text(st.sampled_from(CHARS), max_size=25))
@settings(max_examples=400, deadline=None)
def test_against_single_steps(text):
    form, places = O.aligned(text)
    assert (form, list(range(len(text))) if places is None else places) == spec(text)


def test_spans(spark):
    df = spark.createDataFrame([(1, "a​b…c    d"), (2, "plain"), (3, None)], "doc_id long, text string")
    rows = O.normalised(df)
    span = lambda f, i, s, e: tuple(rows.where(f"doc_id = {i}").select(f(F.lit(s), F.lit(e), F.col("origin"))).first()[0])
    assert {r.doc_id: r.normalised for r in rows.collect()} == {1: "ab...c  d", 2: "plain", 3: ""}
    assert span(O.original_span, 1, 1, 5) == (2, 4) and span(O.original_span, 1, 8, 99) == (9, 10) and span(O.original_span, 2, 1, 3) == (1, 3)
    assert span(O.normal_span, 1, 1, 3) == (1, 2) and span(O.normal_span, 1, 0, 1) == (0, 1) and span(O.normal_span, 1, 3, 4) == (2, 3) and span(O.normal_span, 2, 1, 3) == (1, 3)


def test_cells(spark):
    df = spark.createDataFrame([(1, "a@b.com x", "10.0.0.1", 5), (2, None, "y", 6)], "id long, a string, b string, c int")
    got = sorted(map(tuple, redact.redact_cells(df, "id", ("a", "b"), ("email", "ip_address")).collect()))
    assert got == [(1, "[EMAIL] x", "[IP_ADDRESS]", 5), (2, None, "y", 6)]
    assert readers.require_columns(df, "a") is df
