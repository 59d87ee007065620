"""Line dedup: hash every line of every document, count the documents of each hash, drop what recurs, reassemble.

Definitions. A text is split at line feeds; a null or empty text is one empty line. A line's key is the line without
ASCII white space at its ends, A-Z in lower case. A key of at least ``min_chars`` code points that at least ``min_docs``
distinct ids hold loses all its lines except in the smallest id holding it. All rows of one id count as one document,
so repeated rows lose nothing to each other. A row whose id is null neither keeps nor drops a line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, spread_join, written

MIN_CHARS, MIN_DOCS = 10, 2


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The 16-byte hash of each line's key, None for a key that is too short to be looked at."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(b" \t\n\v\f\r").lower()
        # a code point has 4 bytes at most, so longer keys needn't be decoded
        short = len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = {k for k in line_keys(text.as_py(), min_chars) if k}
                ids += [doc_id.as_py()] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return run


def _reassembled(min_chars: int, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lines, dropped = [], [], []
            for text, drop in zip(batch.column(extra), batch.column(extra + 1), strict=True):
                text = text.as_py() or ""
                drop = set(drop.as_py() or ())
                parts = text.split("\n")
                if drop:
                    parts = [p for p, k in zip(parts, line_keys(text, min_chars), strict=True) if k not in drop]
                kept.append("\n".join(parts))
                lines.append(text.count("\n") + 1)
                dropped.append(lines[-1] - len(parts))
            arrays = [*batch.columns[:extra], pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:extra], "kept_text", "n_lines", "n_dropped"])

    return run


def repeated_lines(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, keeper, n) of keys (key, doc_id): the keys that at least min_docs ids hold, the smallest of these and the rows.

    Partial sums come before the shuffle, so a line that all documents hold costs a row for each task. Two ids hold a key if
    its smallest id isn't its largest; more than two are counted by (key, id) first.
    """
    if min_docs > 2:
        keys = keys.distinct()
    found = keys.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    return found.where("keeper < last" if min_docs == 2 else F.col("n") >= min_docs).drop("last")


def lost_keys(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, _drop): the keys that a document loses, fewer than its lines. keys: a table."""
    common = written(repeated_lines(keys, min_docs), "common-lines")
    lost = spread_join(keys, common, "key", keys.count()).where(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("_drop"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns ``keep``, kept_text, n_lines, n_dropped), a row for each row of docs (doc_id, text, ...).

    An empty table gives an empty table. Lines are hashed once, to a table in the shared folder; only hashes and ids are
    shuffled for the count, and each text moves once, to meet the hashes that its document loses.
    """
    keys = own_columns(docs, "doc_id", "text").where("doc_id is not null").mapInArrow(_hashes(min_chars), "doc_id long, key binary")
    lost = lost_keys(written(keys, "line-keys"), min_docs)
    head = ["doc_id", *keep]
    joined = own_columns(docs, *head, "text").join(lost, "doc_id", "left").select(*head, "text", "_drop")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[: len(head)])
    return joined.mapInArrow(_reassembled(min_chars, len(head)), f"{kinds}, kept_text string, n_lines long, n_dropped long")


def digest(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH line AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), common AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, coalesce(k.doc_id <> c.keeper, false) AS gone FROM keyed k LEFT JOIN common c USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
