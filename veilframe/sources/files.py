"""Redacted files: the values that patterns find in a file's parts are replaced in the file itself, whose form stays.

It fails closed: a file that can't be read, has no way to be rewritten, or still shows a value afterwards is a row with an
error and no data.
"""

from __future__ import annotations

import base64
import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import offsets
from ..operators import redact, scan
from . import ingestion, readers

# Media types by extension.
CONTENT_TYPES = {
    ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".csv": "text/csv", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png",
}
OTHER_TYPE = "application/octet-stream"
FILE = "path string, filename string, format string, content_type string, data_base64 string, n_values int, error string"

Pairs = dict[str, str]
NODE = re.compile(r"(?<=>)[^<>]+(?=<)")
CELL = re.compile(r"<c\b([^>]*[^/>]|)>(.*?)</c>", re.S)


def finder(pairs: Pairs) -> re.Pattern[str]:
    """The values, at one place the longest."""
    return re.compile("|".join(re.escape(v) for v in sorted(pairs, key=lambda v: (-len(v), v))))


def replaced(text: str, pairs: Pairs) -> str:
    return finder(pairs).sub(lambda m: pairs[m[0]], text) if pairs else text


def replaced_nodes(xml: str, pairs: Pairs) -> str:
    """A piece of XML whose text nodes are read as one text: a value that runs over several nodes is replaced in the first
    of them and taken out of the others."""
    nodes = list(NODE.finditer(xml))
    texts = [html.unescape(n[0]) for n in nodes]
    found = list(finder(pairs).finditer("".join(texts))) if pairs else []
    if not found:
        return xml
    out, last, at = [], 0, 0
    for node, text in zip(nodes, texts, strict=True):
        end, said, k = at + len(text), [], at
        for m in found:
            if m.end() <= at or m.start() >= end:
                continue
            said.append(text[k - at : max(m.start() - at, k - at)])
            if m.start() >= at:
                said.append(pairs[m[0]])
            k = min(m.end(), end)
        said.append(text[k - at :])
        out += [xml[last : node.start()], html.escape("".join(said), quote=False)]
        last, at = node.end(), end
    return "".join([*out, xml[last:]])


def replaced_xml(raw: bytes, pairs: Pairs, ends: str) -> bytes:
    """An XML part, piece by piece; ``ends`` is the tag at which a piece ends."""
    return ends.join(replaced_nodes(piece, pairs) for piece in raw.decode("utf-8").split(ends)).encode("utf-8")


def replaced_sheet(raw: bytes, pairs: Pairs) -> bytes:
    """Cells of a worksheet; a number of which a part is replaced becomes a text, and numbers of shared strings stay."""

    def cell(m: re.Match[str]) -> str:
        if re.search(r'\bt="s"', m[1]):
            return m[0]
        body = replaced_nodes(m[2], pairs)
        if body == m[2] or "<is>" in body:
            return f"<c{m[1]}>{body}</c>"
        kind = re.sub(r'\s*\bt="\w+"', "", m[1])
        return f'<c{kind} t="str">{body}</c>'

    return CELL.sub(cell, raw.decode("utf-8")).encode("utf-8")


def _word(name: str, raw: bytes, pairs: Pairs) -> bytes:
    return replaced_xml(raw, pairs, "</w:p>") if re.match(r"word/[^/]+\.xml$", name) else replaced_xml(raw, pairs, "</") if name.startswith("docProps/") and name.endswith(".xml") else raw


def _workbook(name: str, raw: bytes, pairs: Pairs) -> bytes:
    if name == "xl/sharedStrings.xml":
        return replaced_xml(raw, pairs, "</si>")
    if re.match(r"xl/worksheets/[^/]+\.xml$", name):
        return replaced_sheet(raw, pairs)
    return replaced_xml(raw, pairs, "</") if name.endswith(".xml") and name.startswith(("docProps/", "xl/comments")) else raw


def _odt(name: str, raw: bytes, pairs: Pairs) -> bytes:
    return replaced_xml(raw, pairs, "</text:p>") if name in ("content.xml", "meta.xml", "styles.xml") else raw


def _zipped(part: Callable[[str, bytes, Pairs], bytes]) -> Callable[[bytes, Pairs], bytes]:
    def run(raw: bytes, pairs: Pairs) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(raw)) as old, zipfile.ZipFile(out, "w") as new:
            for i in old.infolist():
                new.writestr(i, part(i.filename, old.read(i), pairs), i.compress_type)
        return out.getvalue()

    return run


def _plain(raw: bytes, pairs: Pairs) -> bytes:
    return replaced(readers.decoded(raw), pairs).encode("utf-8")


REWRITERS: dict[str, Callable[[bytes, Pairs], bytes]] = {"docx": _zipped(_word), "xlsx": _zipped(_workbook), "odt": _zipped(_odt), "csv": _plain, "sql": _plain}


def register_rewriter(parser: str, rewrite: Callable[[bytes, Pairs], bytes]) -> None:
    """Adds or replaces the way a format is rewritten (PDF and images need libraries of their own)."""
    REWRITERS[parser] = rewrite


def shown(items: list[tuple[str, str]], pairs: Pairs) -> list[str]:
    """Values that parts still hold, what replaced others left out."""
    text = "\n".join(content for _, content in items)
    for label in sorted(set(pairs.values()), key=len, reverse=True):
        text = text.replace(label, "\x00") if label else text
    return sorted({m[0] for m in finder(pairs).finditer(text)}) if pairs else []


def rewritten(path: str, raw: bytes, pairs: Pairs, rewriters: dict | None = None, items: dict | None = None) -> tuple:
    """A row of FILE."""
    name = re.split(r"[/\\]", path)[-1]
    ext = f".{name.rsplit('.', 1)[-1].lower()}" if "." in name else ""
    parser = ingestion.PARSERS.get(ext)
    head = (path, f"redacted_{name}", ext[1:], CONTENT_TYPES.get(ext, OTHER_TYPE))
    rewrite, read = (rewriters or REWRITERS).get(parser or ""), (items or readers.ITEMS).get(parser or "")
    if rewrite is None or read is None:
        return (*head, None, len(pairs), "no way to redact this format")
    try:
        done = rewrite(raw, pairs)
        left = shown(read(done), pairs)
    except Exception as e:  # whatever a broken file raises becomes its row
        return (*head, None, len(pairs), f"{type(e).__name__}: {e}"[:200])
    if left:
        return (*head, None, len(pairs), f"{len(left)} values can still be read")
    return (*head, base64.b64encode(done).decode("ascii"), len(pairs), None)


def replacements(parts: DataFrame, types: Sequence[str] | None = None, mode: str = "contextual") -> DataFrame:
    """(path, pairs, error) of DOCUMENT rows: each value as the file has it, with what replaces it; an error of any part."""
    keyed = parts.select(F.struct("path", "error").alias("doc_id"), "content")
    rows = offsets.normalised(keyed, "content").withColumn("_l", F.lower("normalised"))
    found = redact.merged(redact.proper(F.col("original"), scan.original_found(F.col("normalised"), F.col("_l"), F.col("origin"), types, use_nlp=False)))
    said = lambda s: F.substr("original", s["start"] + 1, s["end"] - s["start"])
    pairs = F.transform(found, lambda s: F.struct(said(s).alias("value"), redact.replacement(said(s), s["pii_type"], mode).alias("replacement")))
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("pairs"))))
    return rows.select("doc_id.*", pairs.alias("pairs")).groupBy("path").agg(every.alias("pairs"), F.max("error").alias("error"))


def redacted_files(files: DataFrame, types: Sequence[str] | None = None, mode: str = "contextual") -> DataFrame:
    """FILE rows of files (path, content), as Spark's binaryFile source gives them."""
    known = replacements(readers.documents(files), types, mode)
    rewriters, items = dict(REWRITERS), dict(readers.ITEMS)
    schema = pa.schema([(f.split()[0], pa.int32() if f.endswith(" int") else pa.string()) for f in FILE.split(", ")])

    def row(path: str, raw: bytes, pairs: list[dict] | None, error: str | None) -> tuple:
        done = rewritten(path, raw, {p["value"]: p["replacement"] for p in pairs or () if p["value"]}, rewriters, items)
        return (*done[:4], None, done[5], error) if error else done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (tuple(x.as_py() for x in given) for batch in batches for given in zip(*batch.columns, strict=True))
        return readers.batched((row(path, raw or b"", pairs, error) for path, raw, pairs, error in given), schema)

    return files.select("path", "content").join(known, "path", "left").select("path", "content", "pairs", "error").mapInArrow(run, FILE)
