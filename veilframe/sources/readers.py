"""Sources: Spark's own readers where they have the format, and documents in files through Arrow batches.

Every reader of documents gives (path, part, content, error): a file that can't be read is a row with an error, never a
failed job.
"""

from __future__ import annotations

import csv as csv_module
import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingestion

DOCUMENT = "path string, part string, content string, error string"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Archives within archives that are opened.
MOST_NESTED = 5
#: Rows of a batch, and characters that end one.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 22
ODT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"


def csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """With a schema no pass over the data is spent on guessing types; bad rows keep what can be read."""
    reader = spark.read.options(header=header, encoding=encoding, mode="PERMISSIVE")
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 8, **options: str) -> DataFrame:
    """A table over JDBC, read by ranges of a column in parallel where one is named."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.load()


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A stream of (key, text, ts); needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic}).load()
    return raw.select(F.col("key").cast("string"), F.col("value").cast("string").alias("text"), F.col("timestamp").alias("ts"))


def stripped_sql(text: str) -> str:
    """With a blank for each comment; what stands in quotes is no comment."""
    return re.sub(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`)|--[^\n]*|/\*.*?\*/", lambda m: m[1] or " ", text, flags=re.S)


def _balanced(text: str, at: int) -> int:
    """The end of the parentheses that open at ``at``."""
    depth, quote = 0, ""
    for k in range(at, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return k + 1
    return len(text)


def sql_columns(definition: str) -> list[tuple[str, str]]:
    """(name, type) of the columns of "(a int, b decimal(3, 1), primary key (a))"; a type is one word and its size."""
    body, parts, depth = definition[definition.find("(") + 1 : definition.rfind(")")], [""], 0
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    found = [re.match(r'\s*[`"\[]?([A-Za-z_]\w*)[`"\]]?\s*([A-Za-z_]\w*(?:\s*\([^)]*\))?)?', p) for p in parts]
    return [(m[1], m[2] or "") for m in found if m and m[1].upper() not in ("PRIMARY", "FOREIGN", "UNIQUE", "KEY", "CONSTRAINT", "INDEX", "CHECK")]


def sql_items(raw: bytes) -> list[tuple[str, str]]:
    """(part, content): the dump without comments, then its tables with their columns, then its procedures."""
    text = stripped_sql(raw.decode("utf-8", "replace"))
    out = [("full_sql", text)]
    for m in re.finditer(r'CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([`"\[\]\w.]+)\s*\(', text, re.I):
        definition = text[m.start() : _balanced(text, m.end() - 1)]
        out.append((f"table:{m[1].strip('`[]' + chr(34))}:{','.join(n for n, _ in sql_columns(definition))}", definition))
    heads = list(re.finditer(r'CREATE\s+(?:OR\s+REPLACE\s+)?(?:PROCEDURE|FUNCTION)\s+([`"\[\]\w.]+)', text, re.I))
    for m, after in zip(heads, [*heads[1:], None], strict=False):
        out.append((f"procedure:{m[1].strip('`[]' + chr(34))}", text[m.start() : after.start() if after else len(text)].strip()))
    return out


def docx_items(raw: bytes) -> list[tuple[str, str]]:
    """Paragraphs of the body, tables left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
    paragraphs = ["".join(t.text or "" for t in p.iter(f"{W}t")) for p in (body if body is not None else []) if p.tag == f"{W}p"]
    return [("content", "\n\n".join(p for p in paragraphs if p.strip()))]


def odt_items(raw: bytes) -> list[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ET.fromstring(z.read("content.xml"))
    return [("content", "\n\n".join(t for p in root.iter(f"{ODT}p") if (t := "".join(p.itertext())).strip()))]


def rtf_items(raw: bytes) -> list[tuple[str, str]]:
    """Text without control words and groups that aren't shown."""
    text = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", raw.decode("latin-1"))
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+)\s?\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\par[d]?\b ?", "\n\n", text)
    return [("content", re.sub(r"\n{3,}", "\n\n", re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", text)).strip())]


def decoded(raw: bytes) -> str:
    """A text by its byte order mark; else as UTF-8, or where that is not possible as the western code page."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(encoding, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def table_text(rows: list[list[str]]) -> str:
    """"a | b" of the header, then "a: 1 | b: 2" of each row, blank cells left out; a blank header is col_i."""
    if not rows:
        return ""
    head = [h.strip() or f"col_{i}" for i, h in enumerate(rows[0])]
    wide = [*head, *(f"col_{i}" for i in range(len(head), max(map(len, rows))))]
    lines = [" | ".join(f"{h}: {c}" for h, c in zip(wide, row, strict=False) if c.strip()) for row in rows[1:]]
    return "\n".join(x for x in (" | ".join(head), *lines) if x)


def csv_items(raw: bytes) -> list[tuple[str, str]]:
    """Rows by the separator that the first lines suggest, commas if they suggest none."""
    text = decoded(raw)
    try:
        dialect: type[csv_module.Dialect] | csv_module.Dialect = csv_module.Sniffer().sniff(text[:8192], ",;\t|")
    except csv_module.Error:
        dialect = csv_module.excel
    rows = [r for r in csv_module.reader(io.StringIO(text, newline=""), dialect) if any(c.strip() for c in r)]
    return [("content", table_text(rows))]


def _column(reference: str) -> int:
    """From 0: "A1" is 0, "AB7" is 27."""
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_items(raw: bytes) -> list[tuple[str, str]]:
    """A part for each sheet of a workbook, in its order: (sheet:name, rows as table_text)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in s.iter(f"{X}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{X}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{X}sheet"):
            target = targets.get(sheet.get(f"{R}id"), "")
            rows = []
            for row in ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{X}row"):
                cells: dict[int, str] = {}
                for c in row.iter(f"{X}c"):
                    kind, v = c.get("t"), c.find(f"{X}v")
                    said = v.text or "" if v is not None else ""
                    text = strings[int(said)] if kind == "s" and said else "".join(t.text or "" for t in c.iter(f"{X}t")) if kind == "inlineStr" else {"0": "FALSE", "1": "TRUE"}.get(said, said) if kind == "b" else said
                    cells[_column(c.get("r", "")) if c.get("r") else len(cells)] = text
                if any(x.strip() for x in cells.values()):
                    rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
            out.append((f"sheet:{sheet.get('name')}", table_text(rows)))
    return out


PDF_STRING = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>", re.S)
PDF_SHOWN = re.compile(rb"(\[(?:[^\]\(<]|" + PDF_STRING.pattern + rb")*\]|" + PDF_STRING.pattern + rb")\s*(?:TJ|Tj|'|\")|(T\*|\bTd\b|\bTD\b|\bTm\b|\bET\b)", re.S)
PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b"", b"\n": b""}


def _pdf_string(x: bytes) -> str:
    if x[:1] == b"<":
        body = bytes.fromhex(re.sub(rb"\s", b"", x[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", x[1:-1])) % 2))
    else:
        body = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else PDF_ESCAPES.get(m[1], m[1]), x[1:-1], flags=re.S)
    return body.decode("utf-16-be", "replace") if body[:2] == b"\xfe\xff" or len(body) > 1 and len(body) % 2 == 0 and not any(body[::2]) else body.decode("cp1252", "replace")


def pdf_items(raw: bytes) -> list[tuple[str, str]]:
    """The text layer: strings that content streams show, in their order, a line for each move of the pen.

    Streams are plain or deflated; glyphs are read by the western code page or as UTF-16, so fonts with a code of their own
    are left to a registered parser, as are scans. An encrypted file is an error.
    """
    if not raw.startswith(b"%PDF-"):
        raise ValueError("no PDF header")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", raw):
        raise ValueError("password required")
    pages = []
    for m in re.finditer(rb"<<((?:(?!endobj).)*?)>>\s*stream\r?\n", raw, re.S):
        end = raw.find(b"endstream", m.end())
        body = raw[m.end() : end if end >= 0 else len(raw)]
        if b"/FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body, ingestion.MAX_BYTES)
            except zlib.error:
                continue
        if b"/Subtype" in m[1] or not re.search(rb"\bBT\b", body):
            continue
        said = []
        for s in PDF_SHOWN.finditer(body):
            said.append("\n" if s[1] is None else "".join(_pdf_string(x[0]) for x in PDF_STRING.finditer(s[1])))
        pages.append(re.sub(r"\n{2,}", "\n", "".join(said)).strip())
    return [("content", "\n\n".join(p for p in pages if p))]


ITEMS: dict[str, Callable[[bytes], list[tuple[str, str]]]] = {
    "sql": sql_items, "docx": docx_items, "odt": odt_items, "rtf": rtf_items, "csv": csv_items, "xlsx": xlsx_items, "pdf": pdf_items,
}


def register_parser(parser: str, items: Callable[[bytes], list[tuple[str, str]]]) -> None:
    """Adds or replaces a parser (OCR, old office formats ... need libraries of their own): bytes to (part, content)."""
    ITEMS[parser] = items


def members(path: str, raw: bytes, password: bytes | None = None, most: int = ingestion.MAX_BYTES) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path!member, bytes, error) of an archive; files of systems and folders are left out.

    A member that can't be read is an error of its own. All members together may have ``most`` bytes; those beyond are errors.
    """
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except (zipfile.BadZipFile, ValueError, struct.error, NotImplementedError) as e:
        yield path, None, f"unreadable archive: {e}"
        return
    with archive as z:
        for i in z.infolist():
            name, base = f"{path}!{i.filename}", i.filename.rsplit("/", 1)[-1]
            if i.is_dir() or base.startswith(".") or "__MACOSX" in i.filename:
                continue
            if i.file_size > most:
                yield name, None, "too large"
            elif i.flag_bits & 1 and not password:
                yield name, None, "password required"
            else:
                try:
                    content = z.read(i, password)
                except Exception as e:  # checksums, lengths, compression: whatever is wrong with a member becomes its row
                    yield name, None, f"unreadable member: {type(e).__name__}: {e}"[:200]
                    continue
                most -= len(content)
                yield name, content, None


def parsed_rows(path: str, raw: bytes, items: dict | None = None, depth: int = 0) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    """Rows of DOCUMENT for one file, one after another."""
    dot = path.rfind(".")
    parser = ingestion.PARSERS.get(path[dot:].lower()) if dot >= 0 else None
    if parser == "zip":
        if depth == MOST_NESTED:
            yield path, None, None, "nested too deeply"
            return
        for p, b, e in members(path, raw):
            if b is None:
                yield p, None, None, e
            else:
                yield from parsed_rows(p, b, items, depth + 1)
        return
    call = (items or ITEMS).get(parser or "")
    if call is None:
        yield path, None, None, "No parser available"
        return
    try:
        found = call(raw)
    except Exception as e:  # whatever a broken file makes a parser raise becomes its row
        yield path, None, None, f"{type(e).__name__}: {e}"[:200]
        return
    yield from ((path, part, content, None) for part, content in found)


def parsed(path: str, raw: bytes, items: dict | None = None) -> list[tuple[str, str | None, str | None, str | None]]:
    return list(parsed_rows(path, raw, items))


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most BATCH_ROWS, and no more than the one row that takes a batch over BATCH_CHARS."""
    held: list[tuple] = []
    n = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == BATCH_ROWS or n >= BATCH_CHARS:
            yield batch()
            held, n = [], 0
    if held:
        yield batch()


def documents(files: DataFrame) -> DataFrame:
    """DOCUMENT rows of files (path, content) as Spark's binaryFile source gives them; a batch holds parts of files."""
    items = dict(ITEMS)
    schema = pa.schema([(n, pa.string()) for n in ("path", "part", "content", "error")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = ((path.as_py(), raw.as_py() or b"") for batch in batches for path, raw in zip(batch.column(0), batch.column(1), strict=True))
        return batched((row for path, raw in given for row in parsed_rows(path, raw, items)), schema)

    return files.select("path", "content").mapInArrow(run, DOCUMENT)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents below a path. Files above the size limit and hidden ones are not opened; each is a row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    error = F.when(ingestion.hidden(F.col("path")), "hidden file").when(F.col("length") > ingestion.MAX_BYTES, "too large")
    none = F.lit(None).cast("string")
    refused = files.where(error.isNotNull()).select("path", none.alias("part"), none.alias("content"), error.alias("error"))
    return documents(files.where(error.isNull())).unionByName(refused)


def union_sheets(sheets: dict[str, DataFrame]) -> DataFrame:
    """Sheets of a workbook as one table with __sheet__; a column that a sheet lacks is null there."""
    out: DataFrame | None = None
    for name, df in sheets.items():
        df = df.withColumn("__sheet__", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sheets")
    return out


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df if it has all the columns; else an error that names what is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
