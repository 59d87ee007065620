"""Content: rows and paragraphs as blocks, the text they make, chunks of it, and OCR lines beside it."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions import text as T
from . import resolve

MERGE_SHARE = 0.8
HEADING_CHARS = 80
#: Points around an entity's merged boxes.
BOX_MARGIN = 2
# Fixed value: what parts sentences.
SENTENCE_BREAK = re.compile(r"(?<=[.!?。])\s+|\n+")


def header_block(columns: Sequence[str]) -> str:
    return " | ".join(columns)


def row_text(columns: Sequence[str]) -> Column:
    """"name: value | name: value" of a row, blank and null cells left out."""
    cells = F.array(*[F.when(F.coalesce(T.stripped(F.col(f"`{c}`").cast("string")), F.lit("")) != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in columns])
    return F.array_join(F.filter(cells, lambda x: x.isNotNull()), " | ")


def row_blocks(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(doc_id, block_type, text): a block for each row that has a value."""
    return rows.select(F.col(key).alias("doc_id"), F.lit("cell").alias("block_type"), row_text(columns).alias("text")).where("text <> ''")


def merged_text(parser: Column, ocr: Column) -> Column:
    """The parser's text unless it is under 0.8 of the length of OCR's."""
    p, o = T.stripped(F.coalesce(parser, F.lit(""))), T.stripped(F.coalesce(ocr, F.lit("")))
    return F.when(o == "", p).when((p != "") & (F.length(p) >= F.length(o) * MERGE_SHARE), p).otherwise(o)


def block_type(text: Column) -> Column:
    """heading: short, and in capitals or with a colon at its end; table: two bars or more; else paragraph."""
    capitals = text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")
    bars = F.length(text) - F.length(F.replace(text, F.lit("|")))
    return F.when((F.length(text) < HEADING_CHARS) & (capitals | text.endswith(":")), "heading").when(bars >= 2, "table").otherwise("paragraph")


def paragraph_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, block_id, block_type, text): what stands between empty lines, blank parts left out, numbered from 0."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n{2,}"), T.stripped), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(parts).alias("block_id", "text")).select("doc_id", "block_id", block_type(F.col("text")).alias("block_type"), "text")


def assembled(blocks: DataFrame) -> DataFrame:
    """(doc_id, full_text, n_blocks, has_tables) of blocks in order of block_id."""
    ordered = F.array_sort(F.collect_list(F.struct("block_id", T.stripped(F.col("text")).alias("text"))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("full_text"), F.count("*").alias("n_blocks"), F.bool_or(F.col("block_type") == "table").alias("has_tables"))


def windows(text: str, most: int = 1200, overlap: int = 200) -> list[tuple[str, int]]:
    """(chunk, start): chunks of at most ``most`` characters, each beginning ``overlap`` before the end of the one before.

    All places to cut are known first: after full stops with a blank behind them, and, where a window has none, after line
    feeds. A window without either is cut at its end.
    """
    stops = [m.end() - 1 for m in re.finditer(r"\. ", text)]
    lines = [m.end() for m in re.finditer("\n", text)]
    spans, at = [], 0
    while at + most < len(text):
        full, line = (found[k - 1] if k else 0 for found, k in ((stops, bisect_right(stops, at + most - 1)), (lines, bisect_right(lines, at + most))))
        end = next((x for x in (full, line) if x > at + 1), at + most)
        spans.append((at, end))
        at = max(at + 1, end - overlap)
    return [(text[s:e], s) for s, e in [*spans, (at, len(text))]]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Where sentences stand that say something: they end at line feeds and at white space behind a full stop or its like."""
    edges = [0, *(x for m in SENTENCE_BREAK.finditer(text) for x in m.span()), len(text)]
    return [(s, e) for s, e in zip(edges[::2], edges[1::2], strict=True) if text[s:e].strip()]


def sentences(text: str, most: int = 1200, overlap: int = 1) -> list[str]:
    """Chunks of whole sentences, each beginning with the last ``overlap`` sentences of the one before.

    Sums of the sentences' lengths tell by bisection how far a chunk reaches; it has at least one sentence of its own.
    """
    spans = sentence_spans(text)
    if len(text) <= most or not spans:
        return [text]
    upto = [0, *accumulate(e - s + 1 for s, e in spans)]
    out, first, done = [], 0, 0
    while done < len(spans):
        done = max(bisect_right(upto, upto[first] + most) - 1, done + 1)
        out.append(" ".join(text[s:e] for s, e in spans[first:done]))
        first = max(first, done - overlap)
    return out


def chunks(docs: DataFrame, text: str = "text", most: int = 1200, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_id, start, text): where a chunk ends depends on the text before it, so chunks are cut in Python,
    batch by batch; ``start`` lets spans within a chunk be put back into the document."""
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [windows(t.as_py(), most, overlap) for t in batch.column(1)]
            of = pa.array([i for i, c in enumerate(cut) for _ in c], pa.int64())
            flat = [(k, s, t) for c in cut for k, (t, s) in enumerate(c)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array([k for k, *_ in flat], pa.int32()), pa.array([s for _, s, _ in flat], pa.int32()), pa.array([t for *_, t in flat], pa.string())], ["doc_id", "chunk_id", "start", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, chunk_id int, start int, text string")


def ocr_lines_placed(lines: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, text, start, end, box): where each OCR line stands, the search going on after the line before.

    lines: doc_id, line_no, text, x0, y0, x1, y1. A line that isn't found as a whole is looked for by its first three
    words, and the search goes on after these. The position depends on all lines before it, so a document's lines are folded
    in order.
    """
    line = F.struct("line_no", T.stripped(F.col("text")).alias("text"), F.struct("x0", "y0", "x1", "y1").alias("box"))
    per = lines.where(T.stripped(F.col("text")) != "").groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    rows = per.join(docs.select("doc_id", F.col(text).alias("_t")), "doc_id")
    kind = "struct<line_no:int,text:string,start:int,end:int,box:struct<x0:int,y0:int,x1:int,y1:int>>"

    def step(acc: Column, x: Column):
        whole = F.call_function("locate", x["text"], F.col("_t"), acc["at"] + 1)
        few = F.array_join(F.slice(T.words(x["text"]), 1, 3), " ")
        found = F.when(whole > 0, whole).otherwise(F.call_function("locate", few, F.col("_t"), acc["at"] + 1)) - 1
        row = F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"), found.alias("start"), (found + F.length(x["text"])).alias("end"), x["box"].alias("box"))
        read = found + F.length(F.when(whole > 0, x["text"]).otherwise(few))
        return {"at": F.when(found < 0, acc["at"]).otherwise(read)}, row, found >= 0

    placed = arrays.emitted(F.col("_lines"), {"at": F.lit(0)}, step, kind)
    return rows.select("doc_id", F.explode(placed).alias("x")).select("doc_id", "x.*")


def boxes(entities: DataFrame, placed: DataFrame) -> DataFrame:
    """entities with the box around the OCR lines that their span meets (bounds included), null without one."""
    lines = placed.select(F.col("doc_id").alias("_doc"), F.col("start").alias("_s"), F.col("end").alias("_e"), "box")
    met = entities.join(lines, (F.col("doc_id") == F.col("_doc")) & (F.col("start") <= F.col("_e")) & (F.col("end") >= F.col("_s")))
    n = F.count("*")
    edge = lambda f, c, m: (f(f"box.{c}") + F.when(n > 1, m).otherwise(0)).alias(c)
    keys = ["doc_id", "pii_type", "value", "start", "end"]
    merged = met.groupBy(*keys).agg(edge(F.min, "x0", -BOX_MARGIN), edge(F.min, "y0", -BOX_MARGIN), edge(F.max, "x1", BOX_MARGIN), edge(F.max, "y1", BOX_MARGIN))
    return entities.join(merged, keys, "left")


def alignment(entities: DataFrame, lines: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """(doc_id, code, n): sensitive entities without a box, with boxes over other text, and documents read badly.

    entities: doc_id, value, sensitivity, x0, y0, x1, y1; lines: doc_id, line_no, text, x0 to y1; quality: doc_id,
    avg_confidence.
    """
    rows = entities.where(resolve.rank(F.col("sensitivity")) >= 3)
    missing = rows.where("x0 is null").select("doc_id", F.lit("missing_bbox").alias("code"))
    over = lines.select(F.col("doc_id").alias("_doc"), "line_no", F.col("text").alias("_t"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    near = (F.col("doc_id") == F.col("_doc")) & (F.col("x0") <= F.col("_x1")) & (F.col("x1") >= F.col("_x0")) & (F.col("y0") <= F.col("_y1")) & (F.col("y1") >= F.col("_y0"))
    read = rows.where("x0 is not null").join(over, near).groupBy("doc_id", "value", "x0", "y0", "x1", "y1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_t"))), lambda x: x["_t"]), " ").alias("said"))
    number = T.digits(F.col("value"))
    same = T.identity_key(F.col("said")).contains(T.identity_key(F.col("value"))) | ((F.length(number) >= 6) & T.digits(F.col("said")).contains(number))
    found = missing.unionByName(read.where(~same).select("doc_id", F.lit("ocr_text_mismatch").alias("code")))
    if quality is not None:
        found = found.unionByName(quality.where("avg_confidence < 0.4").select("doc_id", F.lit("manual_review_required").alias("code")))
    return found.groupBy("doc_id", "code").agg(F.count("*").alias("n"))


def ocr_quality(lines: DataFrame) -> DataFrame:
    """(doc_id, char_count, avg_confidence, review) of doc_id, text, confidence; lines under 0.15 don't count."""
    per = lines.where("confidence >= 0.15").groupBy("doc_id").agg(F.sum(F.length("text")).alias("char_count"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))
    return per.withColumn("review", (F.col("char_count") < 50) | (F.col("avg_confidence") < 0.4))


def sentence_chunks(docs: DataFrame, text: str = "text", most: int = 1200, overlap: int = 1) -> DataFrame:
    """(doc_id, chunk_id, text): chunks of whole sentences."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [sentences(t.as_py() or "", most, overlap) for t in batch.column(1)]
            of = pa.array([i for i, c in enumerate(cut) for _ in c], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array([k for c in cut for k in range(len(c))], pa.int32()), pa.array([t for c in cut for t in c], pa.string())], ["doc_id", "chunk_id", "text"])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, chunk_id int, text string")


def page_count(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.max("page").alias("pages"))


def numbered(blocks: DataFrame, *order: str) -> DataFrame:
    """blocks with block_id, numbered in order within their document."""
    return blocks.withColumn("block_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)
