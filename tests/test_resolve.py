import itertools
import random

import pytest
from veilframe.operators import analytics, postprocess, redact, resolve, validate

SCHEMA = "doc_id long, pii_type string, value string, start int, end int, confidence double, source string, context string, ord int"


def match(doc, kind, value, start, end, confidence=1.0, source="regex", order=0):
    return (doc, kind, value, start, end, confidence, source, "", order)


def entity(doc, kind, value, start=0, end=1, confidence=0.9, sources=("regex",), sensitivity="Medium", order=0):
    return (doc, kind, value, start, end, confidence, list(sources), sensitivity, order)


ENTITY = "doc_id long, pii_type string, value string, start int, end int, confidence double, sources array<string>, sensitivity string, ord int"


def kept_spans(spans):
    """What remains of spans of one type, taken by start and longest first, once those within another are gone."""
    out = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not any(a <= s and b >= e for a, b in out):
            out.append((s, e))
    return sorted(out)


def test_containment_on_random_spans(spark):
    rng = random.Random(2)
    rows, by = [], {}
    for k in range(900):
        doc, kind, s = rng.randrange(20), rng.choice(["name", "city"]), rng.randrange(60)
        e = s + rng.randrange(1, 15)
        rows.append(match(doc, kind, f"v{k}", s, e, order=k))
        by.setdefault((doc, kind), []).append((s, e))
    rows.append(match(0, "name", "unknown", -1, -1))
    got = {}
    for r in resolve.uncontained(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r.doc_id, r.pii_type), []).append((r.start, r.end))
    assert (-1, -1) in got[(0, "name")]
    got[(0, "name")].remove((-1, -1))
    assert {k: sorted(v) for k, v in got.items()} == {k: kept_spans(v) for k, v in by.items()}


def test_phone_tails(spark):
    rows = [match(1, "phone", v, i * 20, i * 20 + 10, order=i) for i, v in enumerate(["+91 98765 43210", "9876543210", "3210", "98765", "9876543210"])] + [match(2, "phone", "9876543210", 0, 9)]
    got = sorted((r.doc_id, r.value) for r in resolve.without_phone_tails(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, "+91 98765 43210"), (1, "98765"), (2, "9876543210")]


def test_phone_tails_against_pairs(spark):
    rng = random.Random(4)
    rows = [match(rng.randrange(5), "phone", "".join(rng.choices("12", k=rng.randrange(1, 7))), k * 9, k * 9 + 5, order=k) for k in range(150)]
    want = sorted((d, v, o) for d, _, v, *_, o in rows if not any(d == d2 and len(v2) > len(v) and v2.endswith(v) for d2, _, v2, *_ in rows))
    got = sorted((r.doc_id, r.value, r.ord) for r in resolve.without_phone_tails(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == want


def test_fusion(spark):
    rows = [
        match(1, "email", "A@b.com", 0, 7, 0.9, "gliner"), match(1, "email", "a@B.com", 20, 27, 1.0, "regex"),
        match(1, "organization", "Acme", 0, 4, 0.6, "gliner"), match(1, "organization", "acme", 50, 54, 0.7, "qwen_ner"),
        match(1, "name", "RAM KUMAR EPIC\nx", 60, 70, 0.92), match(1, "aadhaar", "2345 6789 0123", 80, 94),
        match(1, "zzz", "q", 99, 100, 0.5, "new"),
    ]
    got = {r.pii_type: r for r in resolve.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["email"].value, got["email"].confidence, got["email"].sources, got["email"].start) == ("a@B.com", 1.0, ["gliner", "regex"], 20)
    assert (got["organization"].confidence, got["organization"].value, got["organization"].start) == (0.75, "Acme", 0)
    assert got["name"].value == "RAM KUMAR" and got["aadhaar"].value == "234567890123"
    assert (got["zzz"].sensitivity, got["aadhaar"].sensitivity) == ("Low", "Very High")


def test_grounding(spark):
    docs = spark.createDataFrame([(1, "Bhanderi\nAnkit lives at 2345 6789 0123")], "doc_id long, text string")
    rows = [match(1, "name", v, -1, -1, 0.8, "gliner", i) for i, v in enumerate(["bhanderi ankit", "Nobody", "234567890123", "Ankit"])] + [match(1, "name", "any", 0, 3)]
    got = sorted(r.value for r in resolve.grounded(spark.createDataFrame(rows, SCHEMA), docs).collect())
    assert got == ["234567890123", "Ankit", "any", "bhanderi ankit"]


@pytest.mark.parametrize(("kind", "value", "confidence", "sources", "reason"), [
    ("name", "Patient", 0.9, ["gliner"], "stopword"), ("name", "john", 0.9, ["gliner"], "lower case"), ("name", "Pratik", 0.9, ["gliner"], None), ("name", "we all went home", 0.9, ["gliner"], "sentence"),
    ("name", "john Smith", 0.9, ["regex"], None), ("name", "Overview of it", 0.9, ["gliner"], "heading"), ("name", "Ram\nKumar", 0.9, ["gliner"], "noise"), ("name", "x", 0.19, ["gliner"], "confidence"),
    ("father_name", "Ram 1234", 0.9, ["regex"], "noise"), ("organization", "V. Findings", 0.9, ["gliner"], "heading"), ("organization", "the one that we all know", 0.9, ["gliner"], "sentence"),
    ("diagnosis", "type 2 diabetes", 0.9, ["gliner"], None), ("diagnosis", "One Two Three Four Five", 0.9, ["gliner"], "not clinical"), ("email", "a@b.c", 0.49, ["regex"], "confidence"),
    ("city", "none provided", 0.9, ["llm"], "placeholder"), ("city", "Hindi", 0.9, ["llm"], "language name"), ("city", "a, b, c and d", 0.9, ["llm"], "list"), ("city", "none provided", 0.9, ["qwen_ner"], None),
    ("father_name", "A B C D E F", 0.9, ["regex"], "length"), ("name", "राम", 0.9, ["gliner"], "lower case"), ("name", "राम कुमार", 0.9, ["gliner"], None),
])
def test_reasons(spark, kind, value, confidence, sources, reason):
    df = spark.createDataFrame([entity(1, kind, value, confidence=confidence, sources=sources)], ENTITY)
    assert df.select(postprocess.drop_reason()).first()[0] == reason


def test_drugs(spark):
    rows = [entity(1, "treatment_history", " Humira", 0, 6, 0.8, order=1), entity(1, "organization", "adalimumab", 9, 19, 0.95, order=2), entity(2, "name", "Insulin", order=3), entity(2, "name", "Asha", order=4)]
    got = sorted((r.doc_id, r.pii_type, r.confidence, r.sensitivity, r.original_type, r.canonical_medication) for r in postprocess.post_process(spark.createDataFrame(rows, ENTITY)).collect())
    assert got == [(1, "medication", 0.95, "High", "organization", "Humira (adalimumab)"), (2, "medication", 0.9, "High", "name", "Insulin"), (2, "name", 0.9, "Medium", None, None)]


def test_risk_levels(spark):
    rows = [entity(1, "organization", "x"), *[entity(2, "email", str(i)) for i in range(3)], entity(3, "pan", "p"), entity(4, "pan", "p"), entity(4, "aadhaar", "a"), entity(5, "password", "p"), entity(6, "password", "p"), entity(6, "phone", "q")]
    got = {r.doc_id: (r.total_entities, r.risk_score, r.risk_level) for r in analytics.risk(analytics.distribution(spark.createDataFrame(rows, ENTITY), "doc_id"), "doc_id").collect()}
    assert got == {2: (3, 0.3, "LOW"), 3: (1, 0.8, "MEDIUM"), 4: (2, 0.825, "HIGH"), 5: (1, 1.0, "HIGH"), 6: (2, 0.7, "MEDIUM")}
    assert analytics.risk(analytics.distribution(spark.createDataFrame([], ENTITY))).first().risk_score == 0.0


def test_risk_between_two_figures_goes_up_in_any_order(spark):
    types = (("EMAIL", 6), ("IP_ADDRESS", 7), ("CREDIT_CARD", 41), ("PHONE", 26))  # 50.5 / 80 = 0.63125
    rows = [(i, kind, n) for i, order in enumerate(itertools.permutations(types)) for kind, n in order]
    got = analytics.risk(spark.createDataFrame(rows, "doc_id long, pii_type string, n long").coalesce(1), "doc_id").collect()
    assert {(r.total_entities, r.risk_score, r.risk_level) for r in got} == {(80, 0.6313, "MEDIUM")} and len(got) == 24


def test_primary_type_takes_the_first_on_ties(spark):
    rows = [entity(1, "b", "x", order=1), entity(1, "a", "y", order=2), entity(1, "b", "z", order=3), entity(1, "a", "w", order=4)]
    assert analytics.primary_type(spark.createDataFrame(rows, ENTITY), "doc_id").first().pii_type == "b"


@pytest.mark.parametrize(("mode", "kind", "value", "want"), [
    ("contextual", "email", "a@b.c", "[EMAIL]"), ("contextual", "zzz", "a", "[ZZZ]"), ("contextual", "password", "abc", "XXX"), ("partial", "phone", "98765 43210", "XXXXXX3210"), ("partial", "pan", "ABCDE1234F", "X" * 10),
    ("partial", "name", "Ram", "XXX"), ("full", "credit_card", "4111111111111111", "X" * 12 + "1111"), ("full", "name", "Ram", "XXX"), ("mask", "name", "Ram", "[PERSON_NAME]"), ("mask", "phone", "123", "XXX"), ("odd", "city", "Goa", "[CITY]"),
])
def test_replacements(spark, mode, kind, value, want):
    df = spark.createDataFrame([entity(1, kind, value)], ENTITY)
    assert df.select(redact.replacement(df.value, df.pii_type, mode)).first()[0] == want


def test_redaction_by_span_and_by_value(spark):
    text = "é call 98765 43210, mail a.b@c.com or b@c.com"
    docs = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string")
    at = lambda s: (text.index(s), text.index(s) + len(s))
    rows = [entity(1, "phone", "9876543210", *at("98765 43210"), order=0), entity(1, "email", "a.b@c.com", *at("a.b@c.com"), order=1), entity(1, "upi", "b@c", *at("b@c.com or"), order=2)]
    e = spark.createDataFrame(rows, ENTITY)
    got = {r.doc_id: r.redacted for r in redact.redact_by_span(docs, e).collect()}
    assert got == {1: "é call [PHONE_NUMBER], mail [UPI_ID] b@c.com", 2: "plain", 3: None}
    by_value = {r.doc_id: r.redacted for r in redact.redact_by_value(docs, redact.redaction_map(e)).collect()}
    assert by_value[1] == "é call 98765 43210, mail [EMAIL] or [UPI_ID].com"
    left = redact.verify(redact.redact_by_value(docs, redact.redaction_map(e)), e).collect()
    assert [r.value for r in left] == ["9876543210"]


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for k in range(300):
        s = rng.randrange(5000)
        rows.append(entity(k % 3, rng.choice("abc"), f"v{k}", s, s + rng.choice([1, 5, 300, 3000]), order=k))
    want = sorted((a[0], min(a[3], b[3]), max(a[4], b[4])) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[0] == b[0] and a[1] != b[1] and a[4] > b[3] and b[4] > a[3])
    assert sorted((r.doc_id, r.start, r.end) for r in validate.overlaps(spark.createDataFrame(rows, ENTITY)).collect()) == want


def test_checks(spark):
    docs = spark.createDataFrame([(1, "mail x@y.com and z@y.com, 4111 1111 1111 1111")], "doc_id long, text string")
    rows = [entity(1, "email", "x@y.com", 5, 12), entity(1, "pan", "ABC", 0, 3), entity(1, "credit_card", "4111111111111112"), entity(1, "name", "Ram"), entity(1, "aadhaar", "12")]
    e = spark.createDataFrame(rows, ENTITY)
    codes = sorted(r.code for r in validate.false_positives(e).collect())
    assert codes == ["FP_AADHAAR_DIGIT_COUNT", "FP_CC_LUHN_FAIL", "FP_PAN_FORMAT", "LOW_CONF_SINGLE_TOKEN_NAME"]
    assert sorted((r.pii_type, r.value) for r in validate.missed(e, docs).collect()) == [("aadhaar", "4111 1111 1111"), ("credit_card", "4111 1111 1111 1111"), ("email", "z@y.com")]
    assert sorted(r.value for r in validate.span_mismatches(e, docs).collect()) == ["12", "4111111111111112", "ABC", "Ram"]
    truth = spark.createDataFrame([(1, "email", "X@Y.com"), (1, "email", "q")], "doc_id long, pii_type string, value string")
    r = validate.scores(e.where("pii_type = 'email'"), truth).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (1, 0, 1, 1.0, 0.5, 0.6667)
    done = spark.createDataFrame([(1, "x@y.COM")], "doc_id long, value string")
    assert validate.coverage(e, done).first().coverage == pytest.approx(0.2)
    assert len(validate.unredacted(e, done).collect()) == 4
    report = validate.report(e, validate.false_positives(e)).first()
    assert (report.n_entities, report.n_warnings, report.passed) == (5, 3, True)
    assert not validate.report(e, validate.false_positives(e), strict=True).first().passed


def test_addresses_groups_and_samples(spark):
    rows = [entity(1, "address", "12 Road, Mumbai,", 9, 20, order=2), entity(1, "address", "Flat 4, Goa 400001", 1, 8, order=1), entity(1, "address", "12  road, mumbai", 30, 40, order=3), entity(1, "address", "AB"),
            entity(1, "pan", "ABCDE1234F", confidence=0.9, order=5), entity(1, "pan", "ABCDE1234G", confidence=0.95, order=6), entity(1, "nationality", "India")]
    e = spark.createDataFrame(rows, ENTITY)
    a = analytics.addresses(e).first()
    assert (a.full, a.postal_code, a.state, a.city) == ("Flat 4, Goa 400001, 12 Road, Mumbai", "400001", "Goa", "Mumbai")
    assert [(r.name, r.value) for r in analytics.groups(e).collect()] == [("pan_number", "ABCDE1234G")]
    assert {r.pii_type: r.samples for r in analytics.masked_samples(e).collect()}["pan"] == "ABCDE****F | ABCDE****G"


def test_normal_form(spark):
    from pyspark.sql import functions as F
    from veilframe.functions import text as T

    cases = {"a\x00b\x7f": "ab", "‘q’ – x…": "'q' - x...", "ﬁn": "fin", "١٢३４": "1234", "a    b\t\t\tc": "a  b\t\tc", "x\n\n\n\n\ny": "x\n\n\ny", "a​b": "ab", "Ａ½𝄞": "A½𝄞", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", T.normalise(F.col("t")).alias("n")).collect()} == cases
    assert df.select(T.clean_ocr(F.lit("a​!!!! ___ \t\t\t\tb"))).first()[0] == "a! ___ \tb"


def test_redaction_in_one_pass(spark):
    texts = ["é call +91 98765 43210, mail a.b@c.com and a.b@c.com!", "plain", None, "", "4111 1111 1111 1111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.redacted, r.n_spans) for r in redact.redact_texts(docs, ("email", "phone", "credit_card", "aadhaar", "corporate_email")).collect()}
    assert got == {0: ("é call [PHONE_NUMBER], mail [CORPORATE_EMAIL] and [CORPORATE_EMAIL]!", 3), 1: ("plain", 0), 2: (None, 0), 3: ("", 0), 4: ("[CARD_NUMBER]", 1)}


def test_one_pass_merges_as_the_table_does(spark):
    rng = random.Random(8)
    rows = [entity(k % 30, rng.choice("abc"), f"v{k}", s := rng.randrange(80), s + rng.randrange(1, 20), order=k) for k in range(300)]
    e = spark.createDataFrame(rows, ENTITY)
    from pyspark.sql import functions as F

    arrays = e.groupBy("doc_id").agg(redact.merged(F.collect_list(F.struct("pii_type", "value", "start", "end", "ord"))).alias("m"))
    got = sorted((r.doc_id, x.start, x.end) for r in arrays.collect() for x in r.m)
    assert got == sorted((r.doc_id, r.start, r.end) for r in redact.merged_spans(e).collect())
