"""Redacted files, spans in the text as given, whole answers, scores of a model's answers, languages, new patterns."""

import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from veilframe.functions import registry, scripts
from veilframe.operators import redact, resolve, scan, validate
from veilframe.plans import detect
from veilframe.sources import files, readers, sinks


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:r><w:t>mail jo.</w:t></w:r><w:r><w:t>doe@mail.example &amp; more</w:t></w:r></w:p><w:p><w:r><w:t>clean</w:t></w:r></w:p></w:body></w:document>'})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
XLSX = zipped({
    "xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="A" sheetId="1" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>contact</t></si><si><t>a@mail.example</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>4111111111111111</v></c></row></sheetData></worksheet>',
})


def test_redacted_files(spark):
    given = [
        ("/x/a.docx", DOCX), ("/x/b.xlsx", XLSX), ("/x/c.csv", "who,mail\nJo,jo＠mail.example\nAl,al@mail.example\n".encode()), ("/x/d.pdf", b"%PDF-1.4\n"), ("/x/e.docx", b"broken"),
        ("/x/f.csv", b""), ("/x/none", b"?"), ("/x/g.csv", None),
    ]
    rows = {r.filename: r for r in files.redacted_files(spark.createDataFrame(given, "path string, content binary"), ("email", "credit_card")).collect()}
    assert len(rows) == len(given)
    read = lambda name, items: "\n".join(t for _, t in items(base64.b64decode(rows[name].data_base64)))
    assert read("redacted_a.docx", readers.docx_items) == "mail [EMAIL] & more\n\nclean"
    book = read("redacted_b.xlsx", readers.xlsx_items)
    assert book == "contact | n\ncontact: [EMAIL] | n: [CARD_NUMBER]"
    assert base64.b64decode(rows["redacted_c.csv"].data_base64).decode() == "who,mail\nJo,[EMAIL]\nAl,[EMAIL]\n"
    assert rows["redacted_c.csv"].content_type == "text/csv" and rows["redacted_c.csv"].n_values == 2
    for name in ("redacted_d.pdf", "redacted_e.docx", "redacted_none"):
        assert rows[name].error and rows[name].data_base64 is None
    assert rows["redacted_f.csv"].error is None and rows["redacted_f.csv"].data_base64 == ""


def test_a_file_that_still_shows_a_value_has_no_data():
    shows = {"csv": lambda raw, pairs: raw}
    row = files.rewritten("/x/a.csv", b"a@b.example", {"a@b.example": "[EMAIL]"}, shows)
    assert row[4] is None and "still" in row[6]
    # a label may hold a value of another kind
    row = files.rewritten("/x/a.csv", b"MAIL, a@b.example", {"a@b.example": "[EMAIL]", "MAIL": "X"})
    assert base64.b64decode(row[4]) == b"X, [EMAIL]" and row[6] is None


@pytest.mark.parametrize("text", ["", "plain jo@mail.example", "a​b jo​@mail.example, ﬁx 4111 1111 1111 1111", "x    y jo@mail.example\n\n\n\n\nal@mail.example", "ﬁ ﬂ jo＠mail.example"])
def test_spans_are_places_in_the_text_as_given(spark, text):
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    for r in detect.detect(docs, types=("email", "credit_card"), original=True).collect():
        said = text[r.start : r.end].replace("​", "").replace("＠", "@").replace(" ", "")
        assert r.doc_id == 1 and said == r.value
    done = {r.doc_id: r for r in redact.redact_originals(docs, ("email",)).collect()}
    assert "mail.example" not in done[1].redacted and done[2].redacted == "" and done[2].n_spans == 0
    n = scan.original_scan(docs, types=("email",)).count()
    assert n == text.count("mail.example") == done[1].redacted.count("[EMAIL]")


def test_whole_answers(spark):
    docs = spark.createDataFrame([(1, "write a@mail.example or 10.0.0.1"), (2, "nothing"), (3, None)], "doc_id long, text string")
    entities = detect.detect(docs, types=("email", "ip_address"))
    said = {r.doc_id: json.loads(r.response) for r in sinks.full_responses(entities, docs).collect()}
    assert set(said) == {1, 2, 3}
    one = said[1]
    assert [(e["type"], e["value"], e["span"]["start"]) for e in one["entities"]] == [("email", "a@mail.example", 6), ("ip_address", "10.0.0.1", 24)]
    assert one["entity_groups"]["email"]["value"] == "a@mail.example" and one["redactions"] == {"map": {"a@mail.example": "[EMAIL]", "10.0.0.1": "[IP_ADDRESS]"}, "count": 2}
    assert one["confidence_scores"] == {"email": 1.0, "ip_address": 1.0} and one["validation_results"] == {"passed": True, "span_errors": 0}
    for k in (2, 3):
        assert said[k]["entities"] == [] and said[k]["redactions"] == {"map": {}, "count": 0} and said[k]["document_hints"]["contains_government_id"] is False
    failed = spark.createDataFrame([("/a", None), ("/b", "bad"), ("/b", "bad")], "path string, error string")
    assert [(r.path, json.loads(r.response)) for r in sinks.error_responses(failed).collect()] == [("/b", {"status": "error", "message": "bad"})]


def test_metadata_of_resolution(spark):
    rows = [(1, "email", "a@b.co", 0, 6, 1.0, "regex", "", 1), (1, "email", "A@b.co", 9, 15, 0.7, "gliner", "", 2), (1, "name", "Jo Doe", 20, 26, 0.9, "gliner", "", 3)]
    found = spark.createDataFrame(rows, "doc_id long, pii_type string, value string, start int, end int, confidence double, source string, context string, ord int")
    meta = {r.pii_type: r.metadata for r in resolve.resolve(found).collect()}
    assert (meta["email"].engine_count, meta["email"].matched_by, meta["email"].matched_pattern, meta["email"].matched_model) == (2, ["gliner", "regex"], "email", None)
    assert (meta["name"].matched_pattern, meta["name"].matched_model, meta["name"].grounded) == (None, "gliner", True)


def test_scores_of_answers(spark):
    docs = spark.createDataFrame([(1, "mail a@mail.example, pan ABCDE1234F"), (2, "x 10.0.0.1"), (3, None)], "doc_id long, text string")
    answers = spark.createDataFrame([(1, "email", "A@mail.example"), (1, "pan", "ABCDE12"), (1, "name", "Jo Doe"), (1, "name", " "), (3, "phone", "123")], "doc_id long, pii_type string, value string")
    got = {r.doc_id: tuple(r)[1:] for r in validate.answer_scores(answers, scan.scan(docs, types=("email", "pan")), docs).collect()}
    assert got == {1: (3, 1, 1, 1), 3: (1, 1, 1, 0)}


def test_a_short_number_is_no_part_of_a_longer_one(spark):
    docs = spark.createDataFrame([(1, "write to user298765@mail.example"), (2, "call 98765 now"), (3, "987650"), (4, "no 12-\n3."), (5, "98765, 298765")], "doc_id long, text string")
    answers = docs.selectExpr("doc_id", "'phone' AS pii_type", "CASE doc_id WHEN 4 THEN '12- 3' ELSE '98765' END AS value").union(spark.createDataFrame([(1, "phone", "298765"), (2, "name", "a\\E9")], "doc_id long, pii_type string, value string"))
    none = spark.createDataFrame([], "doc_id long, pii_type string, value string")
    got = {r.doc_id: (r.n_answers, r.hallucinations) for r in validate.answer_scores(answers, none, docs).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (1, 1), 4: (1, 0), 5: (1, 0)}


def test_languages(spark):
    texts = ["plain words", "नमस्ते दुनिया hello", "", "12 34", "привет мир"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", scripts.languages(scripts.profile(F.col("text"))).alias("x"), scripts.languages(scripts.profile(F.col("text")), F.lit("fr"))["primary_lang"].alias("told"))
    got = {r.i: (r.x.primary_lang, r.x.is_english, r.x.is_multilingual, r.x.script_langs, r.told) for r in rows.collect()}
    assert got == {0: ("en", True, False, ["en"], "fr"), 1: ("hi", False, True, ["hi", "en"], "hi"), 2: ("en", True, False, [], "fr"), 3: ("en", True, False, [], "fr"), 4: ("ru", False, False, ["ru"], "ru")}


def test_a_new_pattern(spark):
    before = registry.TYPES
    try:
        registry.register_pattern("ticket", r"\bTK-\d{4}\b", "High")
        docs = spark.createDataFrame([(1, "see TK-1234")], "doc_id long, text string")
        assert [(r.pii_type, r.value, r.sensitivity) for r in detect.detect(docs, types=("ticket",)).collect()] == [("ticket", "TK-1234", "High")]
    finally:
        registry.TYPES = before
        registry.BY_ID = {t.id: t for t in before}
        registry.PATTERN_TYPES = tuple(t for t in before if t.pattern)
        registry.SEMANTIC_ONLY = tuple(t.id for t in before if not t.pattern)


def test_sql_functions(spark):
    detect.register_sql(spark)
    one = spark.sql("SELECT mask_pii('phone', '+91 98765 43210') AS m, mask_pii('name', 'Jo Doe') AS n, redact_text('jo@mail.example on 10.0.0.1') AS r, redact_text(NULL) AS z").first()
    assert tuple(one) == ("98******10", "Jo***", "[EMAIL] on [IP_ADDRESS]", None)
    rows = spark.sql("SELECT * FROM detect_pii('jo@mail.example, card 4111 1111 1111 1112, 4111 1111 1111 1111')").collect()
    assert {(r.pii_type, r.value, r.start, r.end) for r in rows if r.pii_type in ("email", "credit_card")} == {("email", "jo@mail.example", 0, 15), ("credit_card", "4111111111111111", 43, 62)}
    spark.createDataFrame([(1, "a@mail.example"), (2, None), (3, "no")], "id long, text string").createOrReplaceTempView("said")
    assert [(r.id, r.value) for r in spark.sql("SELECT id, value FROM said, LATERAL detect_pii(text) WHERE pii_type = 'email'").collect()] == [(1, "a@mail.example")]
