import io
import random
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from veilframe.functions import scripts
from veilframe.operators import content
from veilframe.plans import detect
from veilframe.sources import ingestion, readers, sinks
from veilframe.streaming import streams


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", ".").replace("SL", "/"), data)
    return out.getvalue()


DOCX = archive(**{"wordSLdocument__xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tbl><w:p><w:r><w:t>Two a@b.com</w:t></w:r></w:p></w:body></w:document>'})
SQL = b"-- drop -- me\nCREATE TABLE IF NOT EXISTS `users` (id int, price decimal(3, 1), name varchar(9) DEFAULT '--x', PRIMARY KEY (id)); /* gone */\nCREATE PROCEDURE p1() BEGIN SELECT 1; END;"


def test_parsers():
    assert readers.parsed("/a/x.docx", DOCX) == [("/a/x.docx", "content", "One\n\nTwo a@b.com", None)]
    parts = {p: c for _, p, c, _ in readers.parsed("d.SQL", SQL)}
    assert set(parts) == {"full_sql", "table:users:id,price,name", "procedure:p1"}
    assert "drop" not in parts["full_sql"] and "gone" not in parts["full_sql"] and "'--x'" in parts["full_sql"]
    assert readers.parsed("x.rtf", rb"{\rtf1{\fonttbl{\f0 Arial;}}Caf\'e9 one\par two}")[0][2] == "Café one\n\ntwo"
    assert readers.parsed("x.xyz", b"")[0][3] == "No parser available"
    assert readers.parsed("x.docx", b"broken")[0][3].startswith("BadZipFile")


def test_archives():
    z = archive(a__sql=SQL, __MACOSX=b"x", b__docx=DOCX, __DS_Store=b"", c__txt=b"t")
    rows = readers.parsed("z.zip", z)
    assert [r[0] for r in rows if r[1] == "content"] == ["z.zip!b.docx"] and ("z.zip!c.txt", None, None, "No parser available") in rows
    assert not any("MACOSX" in r[0] or "DS_Store" in r[0] for r in rows)
    assert readers.parsed("z.zip", b"no")[0][3].startswith("unreadable archive")


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(DOCX)
    (tmp_path / "b.bin").write_bytes(b"?")
    got = readers.read_documents(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.error) for r in got.collect()) == [("a.docx", None), ("b.bin", "No parser available")]
    assert {r.status: r.n for r in sinks.run_status(got).collect()} == {"completed": 1, "failed": 1}


def test_sheets(spark):
    one, two = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, 3.5)], "a int, c double")
    got = readers.union_sheets({"s1": one, "s2": two})
    assert sorted(map(tuple, got.select("a", "b", "c", "__sheet__").collect())) == [(1, "x", None, "s1"), (2, None, 3.5, "s2")]


def test_ingestion(spark):
    rows = [("/x/Report.PDF", "the patient", 1), ("/x/a.csv", "", 1), ("/x/i.jpeg", "patient", 1), ("/x/.hid.csv", "", 1), ("/x/n.pptx", "", 1), ("/x/noext", "", 1), ("/x/big.sql", "", 200 << 20), ("/x/hospital.sql", "", 1)]
    got = {r.path.rsplit("/", 1)[1]: (r.parser, r.chunking, r.doc_type, r.error) for r in ingestion.plan(spark.createDataFrame(rows, "path string, snippet string, size long")).collect()}
    assert got == {"Report.PDF": ("pdf", "page", "medical", None), "a.csv": ("csv", "row", "structured", None), "i.jpeg": ("image", "full", "ocr_heavy", None), ".hid.csv": ("csv", "row", "structured", "hidden file"),
                   "n.pptx": ("pptx", "full", "generic", "No parser available"), "noext": (None, "full", "generic", "No parser available"), "big.sql": ("sql", "full", "generic", "too large"), "hospital.sql": ("sql", "full", "medical", None)}


@pytest.mark.parametrize(("text", "engine", "dominant"), [
    ("", "none", "latin"), ("one two three four five", "patterns", "latin"), ("one two three four five six", "latin", "latin"), ("राम घर गया और सो गया", "multilingual", "devanagari"),
    ("Он пошёл домой и лёг спать", "patterns", "cyrillic"), ("one two три четыре пять six", "latin", "latin"), ("αβγ δεζ ηθι κλμ νξο πρσ", "latin", "latin"), ("مرحبا one two three four five", "multilingual", "latin"),
])
def test_routes(spark, text, engine, dominant):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = detect.routed(df).first()
    assert (r.engine, r.profile.dominant_script) == (engine, dominant)
    assert df.select(scripts.language(F.lit("tamil"))).first()[0] == "ta"


def test_blocks_and_rows(spark):
    df = spark.createDataFrame([(1, "TITLE\n\nbody text\n\n\n a | b | c \n\nEnd:\n\n  "), (2, None)], "doc_id long, text string")
    blocks = content.paragraph_blocks(df)
    assert [(r.block_id, r.block_type, r.text) for r in blocks.orderBy("block_id").collect()] == [(0, "heading", "TITLE"), (1, "paragraph", "body text"), (2, "table", "a | b | c"), (3, "heading", "End:")]
    r = content.assembled(blocks).first()
    assert (r.full_text, r.n_blocks, r.has_tables) == ("TITLE\n\nbody text\n\na | b | c\n\nEnd:", 4, True)
    rows = spark.createDataFrame([(1, "x", None, " "), (2, None, None, None)], "k long, a string, b int, c string")
    assert [r.text for r in content.row_blocks(rows, "k", ["a", "b", "c"]).collect()] == ["a: x"]
    t = spark.createDataFrame([("12345678", "1234567890"), ("1234567", "1234567890"), (None, "o"), ("p", None)], "p string, o string")
    assert [r[0] for r in t.select(content.merged_text(t.p, t.o)).collect()] == ["12345678", "1234567890", "o", "p"]


def test_chunks(spark):
    text = "Sentence one is here. " * 200
    cut = content.windows(text, 300, 50)
    assert all(text[s : s + len(c)] == c and len(c) <= 300 for c, s in cut) and cut[-1][1] + len(cut[-1][0]) == len(text)
    assert all(a[1] < b[1] <= a[1] + len(a[0]) for a, b in zip(cut, cut[1:], strict=False))
    assert content.windows("x" * 1000, 300, 50)[1][1] == 250 and content.windows("short") == [("short", 0)]
    assert content.sentences("A b. C d. E f.", 10) == ["A b. C d.", "C d. E f."]
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert content.chunks(df, most=300, overlap=50).where("doc_id = 1").count() == len(cut)


def test_ocr(spark):
    docs = spark.createDataFrame([(1, "Name: Ram\nPAN ABCDE1234F\nend")], "doc_id long, text string")
    lines = spark.createDataFrame([(1, 0, "Name: Ram", 0, 0, 50, 10, 0.9), (1, 1, " PAN ABCDE1234F ", 0, 12, 90, 22, 0.5), (1, 2, "not there", 0, 0, 1, 1, 0.1)], "doc_id long, line_no int, text string, x0 int, y0 int, x1 int, y1 int, confidence double")
    placed = content.ocr_lines_placed(lines, docs)
    assert sorted((r.line_no, r.start, r.end) for r in placed.collect()) == [(0, 0, 9), (1, 10, 24)]
    e = spark.createDataFrame([(1, "pan", "ABCDE1234F", 14, 24, "High"), (1, "name", "Ram\nPAN", 6, 13, "Medium"), (1, "city", "q", 100, 101, "High")], "doc_id long, pii_type string, value string, start int, end int, sensitivity string")
    boxed = content.boxes(e, placed)
    assert {r.pii_type: (r.x0, r.y0, r.x1, r.y1) for r in boxed.collect()} == {"pan": (0, 12, 90, 22), "name": (-2, -2, 92, 24), "city": (None, None, None, None)}
    wrong = boxed.withColumn("value", F.when(F.col("pii_type") == "pan", "ZZZZZ").otherwise(F.col("value")))
    got = {r.code: r.n for r in content.alignment(wrong, lines, spark.createDataFrame([(1, 0.3)], "doc_id long, avg_confidence double")).collect()}
    assert got == {"missing_bbox": 1, "ocr_text_mismatch": 1, "manual_review_required": 1}
    q = content.ocr_quality(lines).first()
    assert (q.char_count, q.avg_confidence, q.review) == (25, 0.7, True)


def test_detect_with_a_model(spark):
    def engine(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(d, "Person", "Asha Rao", 0.9, s + t.index("Asha Rao"), s + t.index("Asha Rao") + 8) for d, _, s, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if "Asha Rao" in t]
            names = ["doc_id", "label", "text", "score", "start", "end"]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    detect.register_engine("test", engine)
    df = spark.createDataFrame([(1, "Please write to Asha Rao at a.rao@corp.com or 10.0.0.1 today"), (2, "")], "doc_id long, text string")
    got = sorted((r.pii_type, r.value, r.start) for r in detect.detect(df, engines={"latin": "test"}).collect())
    assert got == [("corporate_email", "a.rao@corp.com", 28), ("email", "a.rao@corp.com", 28), ("ip_address", "10.0.0.1", 46), ("name", "Asha Rao", 16)]
    assert {r.doc_id: r.redacted for r in detect.redacted(df, types=["email", "ip_address"]).collect()}[1] == "Please write to Asha Rao at [EMAIL] or [IP_ADDRESS] today"
    assert detect.risk_report(df).first().total_entities == 3


def test_a_model_that_fails(spark):
    def engine(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(3).to_pylist()
            if any("boom" in t for t in texts):
                raise RuntimeError("no answer")
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["Person"] * n), pa.array(["Asha Rao"] * n), pa.array([0.9] * n), pa.array([0] * n, pa.int32()), pa.array([8] * n, pa.int32())], ["doc_id", "label", "text", "score", "start", "end"])

    def never(batches):
        raise ValueError("no model here")

    detect.register_engine("fails", engine)
    detect.register_engine("never", never)
    df = spark.createDataFrame([(i, "Asha Rao went home" + " boom" * (i == 3)) for i in range(6)], "doc_id long, text string").repartition(6, "doc_id")
    got = {r.doc_id: (r.n_matches, r.error) for r in detect.engine_runs(df, "fails").collect()}
    assert got[3] == (0, "RuntimeError: no answer") and len(got) == 6
    assert 3 not in {r.doc_id for r in detect.model_matches(df, "fails").collect()}
    assert {(r.n_matches, r.error) for r in detect.engine_runs(df, "never").collect()} == {(0, "ValueError: no model here")}


def test_sql_functions(spark):
    detect.register_sql(spark)
    assert spark.sql("SELECT redact_text('to a@b.com now') AS t, mask_pii('name', 'Asha') AS m").first() == ("to [EMAIL] now", "As***")
    assert [r.pii_type for r in spark.sql("SELECT pii_type FROM detect_pii('at 10.0.0.1 ')").collect()] == ["ip_address"]


def test_saved_tables(spark, tmp_path):
    e = spark.createDataFrame([(1, "pan", "A", 0.5, "High", 0), (1, "pan", "B", 1.0, "High", 1)], "doc_id long, pii_type string, value string, confidence double, sensitivity string, ord int")
    scans = spark.createDataFrame([(1, "s", "c"), (2, "s", "c")], "doc_id long, name string, connector_id string")
    sinks.save(sinks.scan_tables(e, scans), str(tmp_path))
    columns = spark.read.parquet(f"{tmp_path}/column_scans")
    assert sorted((r.primary_pii_type or "", r.primary_pii_match_count) for r in columns.collect()) == [("", 0), ("pan", 2)]
    joined = spark.read.parquet(f"{tmp_path}/scan_anomalies").join(columns, "column_scan_id").first()
    assert (joined.match_count, joined.confidence_score) == (2, 0.75)
    assert "risk_level" in sinks.responses(e).first().response


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:10", "mail a@b.com"), (2, "2024-01-01 00:01:00", "10.0.0.1 and c@d.com"), (1, "2024-01-01 00:01:30", "mail a@b.com"), (3, "2024-01-01 01:00:00", "x@y.com")]
    spark.createDataFrame(rows, "doc_id long, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, ts timestamp, text string").parquet(f"{tmp_path}/in")
    found = streams.matches(stream, types=("email", "ip_address"))
    q = streams.risk_windows(found).writeStream.format("memory").queryName("risk").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.start), r.matches, r.risk_score) for r in spark.table("risk").collect()) == [("2024-01-01 00:00:00", 4, 0.275), ("2024-01-01 01:00:00", 1, 0.3)]
    seen = []
    q = streams.resolved_batches(found, lambda df, n: seen.extend(r.value for r in df.collect()), f"{tmp_path}/cp")
    q.awaitTermination()
    assert sorted(seen) == ["10.0.0.1", "a@b.com", "c@d.com", "x@y.com"]
    q = streams.distinct_documents(stream).writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 3


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_X", "."), text)
    return out.getvalue()


def xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="a"/><sheet name="Two" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>Jo </t></r><r><t>Doe</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>age</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>41</v></c></row><row/></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    return out.getvalue()


def pdf(text, deflated=True):
    body = zlib.compress(text) if deflated else text
    return b"%PDF-1.4\n1 0 obj\n<< /Length 9" + b" /Filter /FlateDecode" * deflated + b" >>\nstream\n" + body + b"\nendstream\nendobj\ntrailer\n<< >>\n%%EOF"


def test_workbooks_pdfs_and_tables():
    assert readers.xlsx_items(xlsx()) == [("sheet:One", "name | col_1 | age\nname: Jo Doe | col_1: TRUE | age: 41"), ("sheet:Two", "")]
    page = rb"BT /F1 12 Tf 10 20 Td (Mail \(me\)) Tj T* [(jo) -20 (@mail.example)] TJ 0 -14 Td <48690a> Tj (\351t\351) ' ET"
    for deflated in (True, False):
        assert readers.pdf_items(pdf(page, deflated)) == [("content", "Mail (me)\njo@mail.example\nHi\nété")]
    assert readers.csv_items("a;b\r\n1;é\r\n;\r\n3;\r\n".encode("cp1252")) == [("content", "a | b\na: 1 | b: é\na: 3")]
    assert readers.csv_items("a,b\n1,2\n".encode("utf-16")) == [("content", "a | b\na: 1 | b: 2")]
    assert readers.csv_items(b"") == [("content", "")] and readers.pdf_items(b"%PDF-1.4") == [("content", "")]


def test_broken_files_are_rows():
    whole = _zip(a_Xcsv="a,b\n1,2\n" * 50, b_Xcsv="x\ny\n")
    broken = bytearray(whole)
    at = whole.index(b"a.csv") + 5
    broken[at : at + 4] = b"\xff\xff\xff\xff"
    rows = list(readers.parsed("/x/t.zip", bytes(broken)))
    assert [(r[0], r[3] is None) for r in rows] == [("/x/t.zip!a.csv", False), ("/x/t.zip!b.csv", True)]
    assert list(readers.parsed("t.zip", b"PK"))[0][3].startswith("unreadable archive")
    assert [e for _, _, e in readers.members("t", whole, most=401)] == [None, "too large"]
    inner = whole
    for _ in range(8):
        inner = _zip(n_Xzip=inner)
    assert [r[3] for r in readers.parsed("t.zip", inner)] == ["nested too deeply"]
    for name, raw in (("a.pdf", b"nothing"), ("a.pdf", b"%PDF-1.4 /Encrypt 3 0 R"), ("a.xlsx", b"PK"), ("a.docx", b"")):
        assert all(r[3] for r in readers.parsed(name, raw))


def test_sql_comments_and_types():
    items = readers.sql_items(b"CREATE/*x*/TABLE t (id int, price decimal(3, 1) NOT NULL, PRIMARY KEY (id));")
    assert items[1][0] == "table:t:id,price" and readers.sql_columns(items[1][1]) == [("id", "int"), ("price", "decimal(3, 1)")]


def test_large_and_hidden_files_are_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers.ingestion, "MAX_BYTES", 20)
    (tmp_path / "a.csv").write_text("a\n1\n")
    (tmp_path / "b.csv").write_text("a\n" + "1\n" * 30)
    (tmp_path / "._c.csv").write_text("a\n1\n")
    got = {r.path.rsplit("/", 1)[-1]: r.error for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.csv"] is None and got["b.csv"] == "too large" and got.get("._c.csv", "hidden file") == "hidden file"


def test_line_search_goes_on_after_what_was_found(spark):
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    lines = spark.createDataFrame([(1, 0, "one two three FOUR FIVE", 0, 0, 9, 9), (1, 1, "four five", 0, 9, 9, 19)], "doc_id long, line_no int, text string, x0 int, y0 int, x1 int, y1 int")
    assert [(r.line_no, r.start) for r in content.ocr_lines_placed(lines, docs).orderBy("line_no").collect()] == [(0, 0), (1, 14)]


def test_sentences_against_the_rule():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices(["ab", " ", ". ", "! ", "\n", "longer words"], k=rng.randint(0, 60)))
        most, overlap = rng.randint(5, 60), rng.randint(0, 2)
        parts = [text[s:e] for s, e in content.sentence_spans(text)]
        got = content.sentences(text, most, overlap)
        if len(text) <= most or not parts:
            assert got == [text]
            continue
        at = 0
        for k, c in enumerate(got):
            n = next(n for n in range(1, len(parts) - at + 1) if " ".join(parts[at : at + n]) == c)
            assert len(c) <= most or n <= overlap + 1
            at += n - (overlap if k + 1 < len(got) else 0)
            at = max(at, 0)
        assert at == len(parts)


def test_rows_go_out_in_batches():
    """A batch for each row made the time that of the batches; a batch is bounded by rows and by characters."""
    schema = pa.schema([("a", pa.string()), ("n", pa.int32())])
    many = list(readers.batched(((str(i), i) for i in range(readers.BATCH_ROWS * 2 + 5)), schema))
    assert [b.num_rows for b in many] == [readers.BATCH_ROWS, readers.BATCH_ROWS, 5] and many[2].to_pylist()[-1] == {"a": str(readers.BATCH_ROWS * 2 + 4), "n": readers.BATCH_ROWS * 2 + 4}
    large = list(readers.batched((("x" * readers.BATCH_CHARS, None) for _ in range(3)), schema))
    assert [b.num_rows for b in large] == [1, 1, 1] and list(readers.batched(iter(()), schema)) == []
