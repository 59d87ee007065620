"""The normal form with every compatibility form, and where each of its characters comes from.

text.normalise stays within Spark's expressions and leaves compatibility forms of several characters alone; this is the
whole form, in Arrow batches, with the offsets that lead spans back into the original.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import DIGIT_ZEROS, LONGER, PLAIN

DROPPED = dict.fromkeys((*range(9), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F, 0x200B, 0x200C, 0x200D, 0xFEFF), "")
FORMS = DROPPED | PLAIN | LONGER | {z + i: str(i) for z in DIGIT_ZEROS for i in range(10)}
#: A character that may change; all others stand for themselves.
MAY_CHANGE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\U0010ffff]")
TOO_MANY = re.compile(r"(?<=[ \t]{2})[ \t]+|(?<=\n{3})\n+")


def aligned(text: str) -> tuple[str, list[int] | None]:
    """(normal form, for each of its characters the place in text); None for the places if nothing changed."""
    if not MAY_CHANGE.search(text) and not TOO_MANY.search(text):
        return text, None
    parts, places, at = [], [], 0
    for m in MAY_CHANGE.finditer(text):
        form = FORMS.get(ord(m[0]))
        form = unicodedata.normalize("NFKC", m[0]) if form is None else form
        if form != m[0]:
            parts += [text[at : m.start()], form]
            places += [*range(at, m.start()), *[m.start()] * len(form)]
            at = m.end()
    form = "".join([*parts, text[at:]])
    places += range(at, len(text))
    cut = [m.span() for m in TOO_MANY.finditer(form)]
    for s, e in reversed(cut):
        form = form[:s] + form[e:]
        del places[s:e]
    return form, places if parts or cut else None


def normalised(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, normalised, origin, original): origin is null where the text is its own normal form."""
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("original"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [aligned(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.int32())), batch.column(1)], ["doc_id", "normalised", "origin", "original"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, normalised string, origin array<int>, original string")


def original_span(start: Column, end: Column, origin: Column) -> Column:
    """struct<start, end>: a span of the normal form in the original; a span beyond the text is cut to it."""
    last = F.size(origin) - 1
    within = lambda x: F.greatest(F.lit(0), F.least(x, last))
    moved = F.struct(F.get(origin, within(start)).alias("start"), (F.get(origin, within(end - 1)) + 1).alias("end"))
    return F.when(origin.isNull() | (F.size(origin) == 0), F.struct(start.alias("start"), end.alias("end"))).otherwise(moved)


def normal_span(start: Column, end: Column, origin: Column) -> Column:
    """struct<start, end>: a span of the original in the normal form. Origins rise, so a place is a count of smaller ones;
    a last character that became several ends after the first of them."""
    before = lambda x: F.size(F.filter(origin, lambda o: o < x))
    first, n = before(start), before(end)
    last = F.when(n == 0, 0).otherwise(before(F.get(origin, n - 1)) + 1)
    moved = F.struct(first.alias("start"), F.greatest(first, last).alias("end"))
    return F.when(origin.isNull(), F.struct(start.alias("start"), end.alias("end"))).otherwise(moved)
