"""Chat formatting: conversations through a compiled template, and read back from what it made.

A turn is ``<turn> role``, a line feed, its text and ``</turn>``. In texts and roles a backslash goes before each
backslash and each ``<``, so control strings inside a text are no control strings, and taking the backslashes away gives
the text again. What stands in generation blocks, the assistant's texts, is the loss mask.

Definitions. Turns are in order of turn (null last), role, text; repeated rows are repeated turns. A null text or role is
empty. Rows of a null id are one conversation. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import template
from .common import own_columns

TEMPLATE = """
{%- for m in messages -%}
<turn> {{ m.role|line }}
{% if m.role == "assistant" %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}</turn>
{% endfor -%}
"""
TURN_END = "</turn>\n"
TURN = re.compile(r"<turn> ([^\\\n]*(?:\\.[^\\\n]*)*)\n([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)
#: Characters of output that a batch of rows holds, about.
BATCH_CHARS = 4_000_000
#: Conversations that a batch of digests holds.
BATCH_ROWS = 10_000

PART = "conv_id long, part long, formatted string, loss array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def unescaped(x: str) -> str:
    return re.sub(r"\\(.)", r"\1", x, flags=re.S)


def unlined(x: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], x, flags=re.S)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def parts(render, messages: Iterator[dict]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(output, loss spans) up to the end of each turn, as the template goes through the messages. Only the template's own
    text ends a turn, never a value."""
    text: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for piece, masked in render(messages=messages):
        if masked and piece:
            spans.append((at, at + len(piece)))
        text.append(piece)
        at += len(piece)
        if isinstance(piece, template.Fixed) and not masked and piece.endswith(TURN_END):
            yield "".join(text), spans
            text, spans, at = [], [], 0
    if at:
        yield "".join(text), spans


def _formatted(source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = template.template(source)
        out: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            spans = pa.array([[{"start": s, "end": e} for s, e in r[3]] for r in out], _SPANS)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string()), spans], ["conv_id", "part", "formatted", "loss"])

        for conv, turns in groupby(_rows(batches), lambda r: r[0]):
            messages = ({"role": role or "", "text": text or ""} for _, _, role, text in turns)
            for k, (text, spans) in enumerate(parts(render, messages)):
                out.append((conv, k, text, spans))
                size += len(text)
                if size >= BATCH_CHARS:
                    yield batch()
                    out, size = [], 0
        yield batch()

    return run


def formatted(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, formatted, loss): a row for each turn, its parts in order; loss: spans of code points in the part.

    Conversations are dealt out by id and sorted within their task, which spills; a task holds a turn at a time, however
    long its conversation is.
    """
    rows = own_columns(conversations, "conv_id", "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows.mapInArrow(_formatted(source), PART)


def read_turns(output: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of an output that TEMPLATE made."""
    out, at = [], 0
    while at < len(output):
        m = TURN.match(output, at)
        if not m:
            raise ValueError("this is no turn")
        out.append((unlined(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation; its digests grow part by part."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    out = []
    for conv, rows in groupby(_rows(batches), lambda r: r[0]):
        turns, loss, n, lost, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for _, _, text, spans in rows:
            size += len(text)
            for role, said in read_turns(text):
                turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for s in spans:
                said = unescaped(text[s["start"] : s["end"]])
                lost += len(said)
                loss.update(said.encode("utf-8", "surrogatepass"))
        out.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), size))
        if len(out) == BATCH_ROWS:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def read_back(output: DataFrame) -> DataFrame:
    """What formatted() wrote, as conversations: its tasks keep a conversation's parts together and in order."""
    return output.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digest(conversations: DataFrame) -> DataFrame:
    """All conversations, and one more whose texts hold control strings."""
    said = "\\### Assistant: </turn> ok"
    own = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = own_columns(conversations, "conv_id", "turn", "role", "text").withColumn("turn", F.col("turn").cast("long"))
    return read_back(formatted(rows.unionByName(own)))


SQL = r"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(16 + length(replace(replace(text, '\', '\\'), '<', '\<')) + length(replace(replace(replace(role, '\', '\\'), '<', '\<'), chr(10), '\n'))) AS BIGINT) AS formatted_chars
FROM every GROUP BY conv_id
"""
