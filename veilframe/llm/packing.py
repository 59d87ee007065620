"""Best-fit packing by minimum bin slack: the fullest feasible combination of lengths fills each bin.

The lengths' histogram has at most ``capacity`` rows whatever the input, so the plan is made from it alone. A pattern is
the longest piece left and, by subset-sum over a bitset of reachable sums, the combination of lengths left that leaves
the least slack; it is used as often as all its lengths last, then removed. Each use empties at least one length down to
below its share of the pattern, so there are few patterns. Pieces find their place in the plan by their rank among pieces
of their length, counted in two steps (within a salted part of a length, then over its parts).

Definitions. A null or empty text is the closing id alone. Only a document of more than ``capacity`` ids is cut: its first
piece takes what is left over, the others are full and are sequences of their own. Repeated rows are packed as often as
they stand. No rows: no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import own_columns, written

CAPACITY, CLOSING = 1024, 2
#: Rows that one sorted part of a length has at least, about. A length of n rows has the square root of n parts at most, so
#: neither a part nor the list of a length's parts outgrows a task.
PART_ROWS = 250


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(path: str, capacity: int, closing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                number += 1
                ids = np.array([*tokens.ids(path, text.as_py() or ""), closing], "<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    for column, value in zip(rows, (doc_id.as_py(), k, start, length, zlib.crc32(ids[start : start + length].tobytes()), number), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "number"])

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length sum to the most that is at most room, by subset sums over a bitset.

    Bit s of a bitset is set if s is a sum of some of the pieces looked at so far; a length that is there often enters in
    parts of 1, 2, 4, ... pieces. The bitsets before each part lead back from the best sum to its combination.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << (length * part) & mask
            left -= part
            part *= 2
    best, found = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> best & 1:
            found[length] = found.get(length, 0) + part
            best -= length * part
    return found


@dataclass(frozen=True)
class Run:
    """A pattern's share of one length: the pieces of ranks first to first + each * times - 1, ``each`` to a sequence."""

    first: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[Run]], int]:
    """The runs of each length in order of rank, and the number of sequences."""
    left = {k: v for k, v in histogram.items() if v}
    runs: dict[int, list[Run]] = {k: [] for k in left}
    used, sequence = dict.fromkeys(left, 0), 0
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        pattern = fullest({k: v for k, v in rest.items() if v}, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in pattern.items()), 0
        for length, n in sorted(pattern.items(), reverse=True):
            runs[length].append(Run(used[length], sequence, n, offset))
            used[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return runs, sequence


def _placed(runs: dict[int, list[Run]]):
    tables = {k: np.array([(r.first, r.sequence, r.each, r.offset) for r in v], np.int64) for k, v in runs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                at, t = np.flatnonzero(length == k), tables[int(k)]
                row = t[np.searchsorted(t[:, 0], rank[at], side="right") - 1]
                past = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + past // row[:, 2]
                offset[at] = row[:, 3] + past % row[:, 2] * k
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, closing: int = CLOSING) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece of docs (doc_id, text, ...).

    Each text is encoded once; the pieces' ids, lengths and checksums go to a table in the shared folder. The driver gets
    the histogram of lengths: fewer than ``capacity`` rows.
    """
    pieces = own_columns(docs, "doc_id", "text").mapInArrow(_pieces(path or tokens.default_path(), capacity, closing), "doc_id long, piece int, start long, length long, ids_crc32 long, number long")
    pieces = written(pieces, "pack-pieces")
    short = pieces.where(F.col("length") < capacity)
    histogram = {r["length"]: r["n"] for r in short.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, sequences = plan(histogram, capacity)
    most = max(histogram.values(), default=1)
    parts = -(-most // max(PART_ROWS, math.isqrt(most)))
    # number, a row's place in the task that encoded it, keeps equal rows from meeting in one part
    short = short.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "number"), F.lit(parts)))
    before = short.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    placed = ranked.mapInArrow(_placed(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).drop("number").withColumn("sequence_id", F.monotonically_increasing_id() + sequences).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(full)
