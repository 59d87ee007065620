"""SimHash near-dedup over vantage-point trees.

A document's fingerprint has a bit set where over half of its shingles' hashes have it. Documents whose fingerprints
differ in at most ``radius`` bits are linked. Equal fingerprints are one point, so copies cost a point once. A tree of
vantage points, built from a bounded sample of points, parts the points into shards: within a node, points at most the
median distance from its vantage point go inside, the others outside. A point outside whose distance is within ``radius``
of the boundary may, by the triangle inequality, have partners inside, and visits the inside too; all other branches are
pruned. Each shard finds the pairs among its residents and between visitors and residents, by trees of its own, and
reports a spanning forest of them; components follow over all shards. No pair within ``radius`` is missed.

Definitions. Words are separated by ASCII white space, A-Z in lower case; a text of fewer words than a shingle is one
shingle, a text without words (or null) has fingerprint zero, which is linked like any other. A component's id is its
smallest doc_id; null ids are ignored there, and a component of none but null ids has a null id. Repeated rows are copies.
No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components
from .common import own_columns, spread_join, written

WORDS, RADIUS, SEED = 3, 2, 42
#: Residents of a shard, about; points of the sample for each shard; most shards that the driver plans. Beyond SHARD_ROWS
#: times MOST_SHARDS points a shard is dealt into parts, each pair of which is a task's.
SHARD_ROWS, SAMPLE_PER_SHARD, MOST_SHARDS = 2_000, 64, 1 << 15
#: Pairs that are compared outright rather than split further.
BLOCK = 1 << 17
NO_ID = (1 << 63) - 1


def shingles(text: str | None, words: int) -> list[bytes]:
    """All shingles, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    joined, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [joined[s:e] for s, e in zip(starts, ends[words - 1 :], strict=False)]


def hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles(text, words)], "<u8")


def fingerprint(h: np.ndarray) -> int:
    """The bits that over half of the hashes have, in blocks so that a long text's bits needn't fit in memory."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        block = h[k : k + (1 << 14)]
        votes += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


@dataclass(frozen=True)
class Node:
    """A vantage point with its median distance, or a shard."""

    shard: int = -1
    point: int = 0
    mu: int = 0
    inside: Node | None = None
    outside: Node | None = None


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def boundary(d: np.ndarray) -> int:
    """The distance up to which points are inside: as even a split as these distances allow."""
    counts = np.cumsum(np.bincount(d, minlength=65))
    return int(np.argmin(np.abs(counts - len(d) / 2)))


def tree(sample: np.ndarray, shards: int) -> Node:
    """A tree of at most ``shards`` leaves over the sample, the leaves numbered from 0."""
    rng, number = np.random.default_rng(7), iter(range(1 << 62))

    def grow(points: np.ndarray, leaves: int) -> Node:
        if leaves > 1 and len(points) > 1:
            vantage = points[rng.integers(len(points))]
            d = distance(points, vantage)
            mu = boundary(d)
            near = d <= mu
            if near.any() and not near.all():
                return Node(-1, int(vantage), mu, grow(points[near], leaves // 2), grow(points[~near], leaves - leaves // 2))
        return Node(next(number))

    return grow(sample, shards)


def visits(node: Node, points: np.ndarray, radius: int) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(shard, whether as residents, indices of points): a point resides in one shard and visits all it must query."""
    stack = [(node, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        n, at, home = stack.pop()
        if not len(at):
            continue
        if n.inside is None:
            yield n.shard, True, at[home]
            yield n.shard, False, at[~home]
            continue
        d = distance(points[at], np.uint64(n.point)).astype(np.int64)
        near = d <= n.mu
        # a resident of the outside visits the inside, so that a pair across the boundary is met once; visitors go both ways
        into, out = near | (d <= n.mu + radius), ~near | (~home & (d + radius > n.mu))
        stack.append((n.inside, at[into], (home & near)[into]))
        stack.append((n.outside, at[out], (home & ~near)[out]))


def _routed(node: Node, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = (batch.column(i).to_numpy() for i in (0, 1))
            for shard, home, at in visits(node, fp.view(np.uint64), radius):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard, np.int32)), pa.array(np.full(len(at), home)), pa.array(fp[at]), pa.array(rep[at])], ["shard", "home", "fp", "rep"])

    return run


def pairs(points: np.ndarray, home: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within radius, residents with residents and with visitors; by vantage points down to small blocks."""
    rng = np.random.default_rng(11)
    inner, guests = np.flatnonzero(home), np.flatnonzero(~home)
    stack = [(inner, None), (inner, guests)]
    while stack:
        a, b = stack.pop()
        if not len(a) or b is not None and not len(b):
            continue
        other = a if b is None else b
        small = len(a) * len(other) <= BLOCK
        if not small:
            vantage = points[a[rng.integers(len(a))]]
            d = distance(points[a], vantage).astype(np.int64)
            e = d if b is None else distance(points[b], vantage).astype(np.int64)
            mu = boundary(np.concatenate([d, e]))
            small = (d <= mu).all() and (e <= mu).all() or not ((d <= mu).any() or (e <= mu).any())
        if small:
            step = max(1, BLOCK // len(other))
            for k in range(0, len(a), step):
                i, j = np.nonzero(distance(points[a[k : k + step], None], points[other]) <= radius)
                i, j = a[k : k + step][i], other[j]
                if b is None:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield i, j
            continue
        a_in, b_in = d <= mu, e <= mu
        a_rim, b_rim = a_in & (d > mu - radius), b_in & (e > mu - radius)
        a_edge, b_edge = ~a_in & (d <= mu + radius), ~b_in & (e <= mu + radius)
        if b is None:
            stack += [(a[a_in], None), (a[~a_in], None), (a[a_rim], a[a_edge])]
        else:
            stack += [(a[a_in], b[b_in]), (a[~a_in], b[~b_in]), (a[a_rim], b[b_edge]), (a[a_edge], b[b_rim])]


def forest(points: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """For each point the smallest index it is linked to; pairs are folded into roots as they come."""
    n, held, size = len(points), [], 0
    root = np.arange(n)
    for i, j in pairs(points, home, radius):
        held.append((i, j))
        size += len(i)
        if size > 1 << 20:
            root, held, size = _folded(n, root, held), [], 0
    return _folded(n, root, held)


def _folded(n: int, root: np.ndarray, held: list) -> np.ndarray:
    a = np.concatenate([np.arange(n), *(i for i, _ in held)])
    b = np.concatenate([root, *(j for _, j in held)])
    return components.local_roots(n, a, b)


def _linked(radius: int):
    kind = pa.struct([("rep", pa.int64()), ("fp", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        fp, rep, home = (table.column(c).to_numpy() for c in ("fp", "rep", "home"))
        order = np.lexsort((fp, rep))
        fp, rep, home = fp[order], rep[order], home[order]
        root = forest(fp.view(np.uint64), home, radius)
        at = np.flatnonzero(root != np.arange(len(root)))
        node = lambda k: pa.StructArray.from_arrays([pa.array(rep[k]), pa.array(fp[k])], fields=list(kind))
        return pa.table({"a": node(at), "b": node(root[at])})

    return run


def near_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), structs of (rep, fp): spanning links between distinct points (fp, rep) at most radius apart, b the smaller.

    The driver sees about SAMPLE_PER_SHARD points for each of at most MOST_SHARDS shards: those whose hash a number divides.
    """
    n = points.count()
    shards = max(1, min(MOST_SHARDS, n // SHARD_ROWS))
    every = max(1, n // (shards * SAMPLE_PER_SHARD))
    sample = [r.fp for r in points.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).collect()] if shards > 1 else []
    node = tree(np.sort(np.array(sample, np.int64)).view(np.uint64), shards)
    routed = points.select("fp", "rep").mapInArrow(_routed(node, radius), "shard int, home boolean, fp long, rep long")
    parts = -(-n // (shards * 2 * SHARD_ROWS)) if shards == MOST_SHARDS else 1
    part, other = F.pmod(F.xxhash64("fp"), F.lit(parts)), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    if parts > 1:
        routed = routed.withColumn("other", other).withColumns({"i": F.least(part, "other"), "j": F.greatest(part, "other")})
    kind = "struct<rep: long, fp: long>"
    return routed.groupBy("shard", *(("i", "j") if parts > 1 else ())).applyInArrow(_linked(radius), f"a {kind}, b {kind}")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    return own_columns(docs, "doc_id", "text").mapInArrow(_prints(words), "doc_id long, fp long")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs (doc_id, text, ...).

    Texts are read once. Fingerprints, links and components are small tables in the shared folder.
    """
    prints = written(fingerprints(docs, words), "simhash-prints")
    points = written(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("rep"), F.count("*").alias("n")), "simhash-points")
    roots = components.roots(near_links(points, radius))
    roots = roots.select(F.col("a.fp").alias("fp"), F.col("b.rep").alias("root"))
    named = points.join(roots, "fp", "left").select("fp", "n", F.nullif(F.coalesce("root", "rep"), F.lit(NO_ID)).alias("component_id"))
    return spread_join(prints, named, "fp", prints.count()).select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return simhash_dedup(docs).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
