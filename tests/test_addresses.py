"""E-mail addresses after the end of a sentence: entities by the registry's pattern, redaction of the address alone."""

from pyspark.sql import functions as F

from veilframe.operators import analytics, redact, scan
from veilframe.plans import detect

TEXTS = [(1, "us", "en", "And qui. le.93@mail.example, avec le.93@mail.example end"), (2, "us", "fr", "b. c@mail.example"), (3, "eu", "fr", "jo . doe@mail.example"), (4, "eu", "en", None)]


def documents(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, source string, lang string, text string")


def test_counts(spark):
    found = detect.detect(documents(spark), types=("email",))
    assert [tuple(r) for r in scan.counts(found).collect()] == [("email", 4)]
    assert {(r.doc_id, r.value) for r in found.collect()} == {(1, "qui.le.93@mail.example"), (1, "le.93@mail.example"), (2, "b.c@mail.example"), (3, "jo.doe@mail.example")}


def test_redaction_is_of_the_address(spark):
    docs = documents(spark)
    want = {1: "And qui. [EMAIL], avec [EMAIL] end", 2: "b. [EMAIL]", 3: "[EMAIL]", 4: None}
    e = scan.scan(docs, types=["email"])
    assert {r.doc_id: r.redacted for r in redact.redact_by_span(docs, e).collect()} == want
    assert {r.doc_id: r.redacted for r in redact.redact_texts(docs, ("email",)).collect()} == want
    assert {r.doc_id: r.redacted for r in redact.redact_originals(docs, ("email",)).collect()} == want | {4: ""}
    done = redact.redact_by_span(docs, e)
    assert redact.verify(done, e).collect() == []
    plain = docs.select("doc_id", F.col("text").alias("redacted"))
    assert sorted((r.doc_id, r.value) for r in redact.verify(plain, e.where("doc_id < 3")).collect()) == [(1, "le.93@mail.example"), (1, "le.93@mail.example"), (2, "c@mail.example")]


def test_distribution_by_source(spark):
    docs = documents(spark)
    found = detect.detect(docs, types=("email",)).join(docs.select("doc_id", "source"), "doc_id")
    assert sorted(tuple(r) for r in analytics.distribution(found, "source").collect()) == [("eu", "EMAIL", 1), ("us", "EMAIL", 3)]


def test_risk_by_language(spark):
    got = {r.lang: (r.total_entities, r.risk_score) for r in detect.risk_report(documents(spark), ["lang"], types=("email",)).collect()}
    assert got == {"en": (2, 0.3), "fr": (2, 0.3)}
