"""Near-duplicates by Jaccard similarity of shingle sets, with SimHash's vantage-point trees as one source of candidates.

At a similarity of 0.8 two 64-bit fingerprints differ in about ten bits, where no vantage point prunes (random pairs lie
at 32 +- 4, so a ring of radius 10 holds nearly all of them). The trees therefore give the pairs within ``RADIUS`` bits
(as groups that such pairs connect, each group being a bucket like those of the bands),
and min-wise bands, two sets meeting in one of BANDS buckets with a chance of 0.9996 at 0.8, give the rest. Every
candidate pair is decided by the exact similarity of the two whole texts.

Sets that are equal are one point. First each point of a bucket is compared with the bucket's smallest and largest. Buckets
whose points are then still of several components are open: there every pair across components is looked at. A pair goes
untested only where that can't change the result: within a component, or where sizes or parity bits (see ``parities``) prove
a similarity below the threshold. A round tests at most so many pairs for each point and cell of a bucket; rounds with ever
more go on until none was left out.

Definitions. Words are separated by ASCII white space, A-Z in lower case; a text of fewer words than a shingle is one
shingle; texts without words are equal. Rows that share an id are one document. A null id stands after all others, one for
each text (ids from 2^62 on are taken for that and come out as null). No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import components
from .common import HOT_SHARE, own_columns, spread_join, written
from .simhash_dedup import fingerprint, hashes, near_links

WORDS, SIMILARITY = 5, 0.8
NO_ID = 1 << 62
BANDS, ROWS = 20, 5
#: Points of a part of an open bucket, about; pairs of a point that the first round tests, and how these grow.
PART_ROWS, FIRST_PAIRS, GROWTH = 1_000, 8, 8


def ids() -> Column:
    return F.coalesce("doc_id", F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_ID)))


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2), rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(h: np.ndarray) -> list[int]:
    """The bucket of each band: a hash of its number and of its ROWS smallest values under as many orders of h."""
    mask, odd = _constants()
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), 1 << 11):
        least = np.minimum(least, ((h[k : k + (1 << 11), None] ^ mask) * odd).min(0))
    return [xxhash.xxh3_64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def parities(h: np.ndarray) -> bytes:
    """Of each cell, whether an odd number of the distinct values h falls there; 2 to 4 cells for each value, 64 at least.

    Where the parities of two sets differ in k cells the sets differ in at least k values. Folding the halves of a longer
    one by exclusive or gives the parities of half as many cells.
    """
    cells = max(64, 1 << (2 * len(h) - 1).bit_length()) if len(h) else 64
    return np.packbits(np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).tobytes()


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sets, sizes, bits, buckets = [], [], [], [], []
            for text in batch.column(1):
                h = hashes(text.as_py(), words)
                prints.append(fingerprint(h))
                h = np.unique(h)
                sets.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                bits.append(parities(h))
                buckets.append(bands(h))
            columns = [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "fp", "same", "size", "bits", "buckets"])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def _alike(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for k, (text, other) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                # rows come in order of b, and many points may be compared with one
                if last != (b[k], other.as_py()):
                    last = (b[k], other.as_py())
                    known = np.unique(hashes(last[1], words))
                if jaccard(np.unique(hashes(text.as_py(), words)), known) >= similarity:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["a", "b"])

    return run


def first_of_prints(points: DataFrame) -> DataFrame:
    """(fp, rep): the smallest point of each fingerprint."""
    return points.groupBy("fp").agg(F.min("rep").alias("rep"))


def candidates(points: DataFrame, near: DataFrame) -> DataFrame:
    """(a, b), b < a: pairs of points (rep, fp, buckets) for the first pass. near: spanning links of the trees."""
    placed = points.select("rep", F.explode("buckets").alias("bucket"))
    ends = placed.groupBy("bucket").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    met = placed.join(ends, "bucket").select("rep", F.explode(F.array("lo", "hi")).alias("other"))
    met = met.where(F.col("rep") != F.col("other")).select(F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b"))
    # points of one fingerprint, but not of one set, meet at its first
    equal = points.select("fp", "rep").join(first_of_prints(points).withColumnRenamed("rep", "first"), "fp").where("rep > first").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    return met.unionByName(near).unionByName(equal).where("a > b").distinct()


def with_groups(points: DataFrame, near: DataFrame) -> DataFrame:
    """points with one more bucket each: its group, whose fingerprints links of at most RADIUS bits connect.

    All pairs within the radius share their group. A group's number may be that of a band's bucket, which only adds pairs.
    """
    groups = components.roots(near).select(F.col("a").alias("rep"), F.col("b").alias("first"))
    groups = first_of_prints(points).join(groups, "rep", "left").select("fp", F.coalesce("first", "rep").alias("group"))
    return points.join(groups, "fp").withColumn("buckets", F.array_append("buckets", F.col("group"))).drop("group")


def possible(part: np.ndarray, root: np.ndarray, size: np.ndarray, bits: list[bytes], similarity: float, most: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(i, some j, whether there are more than these) for points i and j of different roots that may be alike, each pair
    once: within a part if there is one, across if there are two. At most ``most`` j for each i."""
    order = np.argsort(size, kind="stable")
    part, root, size = part[order], root[order], size[order]
    across = part.min() != part.max()
    width = np.array([len(bits[k]) for k in order])
    tables: dict[int, tuple[int, np.ndarray]] = {}
    for w in np.unique(width):
        lo, hi = np.searchsorted(width, [w, w + 1])
        tables[int(w)] = int(lo), np.frombuffer(b"".join(bits[k] for k in order[lo:hi]), np.uint64).reshape(hi - lo, -1)
    for w, (lo, own) in tables.items():
        # wider ones folded to this width; sizes ascend, so do widths
        wider = [(lo, own)]
        for v, (at, table) in tables.items():
            if v > w and size[at] * similarity <= size[lo + len(own) - 1]:
                wider.append((at, np.bitwise_xor.reduce(table.reshape(len(table), v // w, -1), 1)))
        for i in range(lo, lo + len(own)):
            end = int(np.searchsorted(size * similarity, size[i] + 1e-6, "right"))
            found = []
            for at, table in wider:
                j = np.arange(max(at, i + 1), min(end, at + len(table)))
                j = j[(root[j] != root[i]) & ((part[j] != part[i]) | (not across))]
                if len(j):
                    differ = np.bitwise_count(table[j - at] ^ own[i - lo]).sum(1, dtype=np.int64)
                    found.append(j[differ <= (1 - similarity) / (1 + similarity) * (size[i] + size[j]) + 1e-6])
            found = np.concatenate(found) if found else np.zeros(0, np.int64)
            if len(found):
                yield int(order[i]), order[found[:most]], len(found) > most


def _possible(similarity: float, most: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of each cell; they come one after another."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)] if len(key) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                rows = batch.slice(lo, hi - lo)
                if held and any(held[-1].column(k)[0] != rows.column(k)[0] for k in range(3)):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(rows)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches):
            part, rep, root, size = (cell.column(c).to_numpy() for c in ("part", "rep", "root", "size"))
            a, b = [], []
            for i, j, more in possible(part, root, size, cell.column("bits").to_pylist(), similarity, most):
                a += np.maximum(rep[i], rep[j]).tolist() + [int(rep[i])] * more
                b += np.minimum(rep[i], rep[j]).tolist() + [None] * more
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def rest(points: DataFrame, roots: DataFrame, similarity: float, most: int) -> DataFrame:
    """(a, b), b < a: pairs of points that share a bucket, have different roots (a, b) and may be alike. A null b says that
    a has more than these.

    A bucket's points are dealt into parts of about PART_ROWS; a cell, two parts or one, is what a task holds at a time.
    """
    rooted = points.join(roots.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = rooted.select("rep", "root", F.explode("buckets").alias("bucket"))
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.ceil(F.count("*") / PART_ROWS).alias("parts")).where("lo < hi").select("bucket", "parts")
    dealt = placed.join(open_, "bucket").withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "root")
    cells = dealt.join(points.select("rep", "size", "bits"), "rep").select("bucket", "i", "j", "part", "rep", "root", "size", "bits")
    cells = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return cells.mapInArrow(_possible(similarity, most), "a long, b long").distinct()


def with_text(rows: DataFrame, pairs: DataFrame, texts: DataFrame, side: str) -> DataFrame:
    """rows, one for each of pairs (a, b), with the text of one side: text_a or text_b.

    A point of more than its share of the pairs is dealt into parts, and its text goes to each; there are fewer than HOT_SHARE
    such points, and fewer than twice as many parts.
    """
    other = "b" if side == "a" else "a"
    hot = pairs.groupBy(side).agg(F.ceil(F.count("*") * HOT_SHARE / F.lit(max(1, pairs.count()))).cast("int").alias("_parts")).where("_parts > 1")
    hot = F.broadcast(written(hot, "similar-hubs"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, side, "left").withColumn("_part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("_parts")
    given = texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")).join(hot, side, "left")
    given = given.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(given, [side, "_part"]).drop("_part")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id, id, root), a row for each row of docs (doc_id, text, ...); a component's id is its smallest
    doc_id, null if it has none. id and root are the same with stand-ins for null."""
    texts = own_columns(docs, "doc_id", "text").select(ids().alias("id"), "text")
    rows = written(texts.mapInArrow(_sketches(words), "id long, fp long, same binary, size long, bits binary, buckets array<long>"), "similar-sketches")
    # size, bits and buckets are the set's; fingerprints count repeats, so equal sets may differ in theirs
    points = rows.groupBy("same").agg(F.min("id").alias("rep"), F.min("fp").alias("fp"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", "bits", "buckets")])
    points = written(points, "similar-points")

    def alike(pairs: DataFrame) -> DataFrame:
        met = with_text(with_text(pairs, pairs, texts, "a"), pairs, texts, "b").select("a", "b", "text_a", "text_b")
        return met.mapInArrow(_alike(words, similarity), "a long, b long")

    near = near_links(written(first_of_prints(points), "similar-prints")).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    near = written(near, "similar-near")
    roots = components.roots(alike(written(candidates(points, near), "similar-candidates")))
    grouped = with_groups(points, near)
    most, more = FIRST_PAIRS, True
    while more:
        pairs = written(rest(grouped, roots, similarity, most), "similar-rest")
        if pairs.take(1):
            roots = components.roots(roots.unionByName(alike(written(pairs.where("b is not null"), "similar-pairs"))))
        most, more = most * GROWTH, bool(pairs.where("b is null").take(1))
    named = points.select("same", "rep", "n").join(roots.withColumnRenamed("a", "rep"), "rep", "left").select("same", "n", F.coalesce("b", "rep").alias("root"))
    out = spread_join(rows.select("id", "same"), named, "same", rows.count())
    return out.select(*[F.when(F.col(c) < NO_ID, F.col(c)).alias(name) for c, name in (("id", "doc_id"), ("root", "component_id"))], "id", "root")


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest id (of rows that share it, the smallest text)."""
    kept = near_duplicates(docs, words, similarity).where("id = root").select(F.col("id").alias("_id")).distinct()
    rows = docs.withColumn("_id", ids()).join(kept, "_id")
    place = F.row_number().over(Window.partitionBy("_id").orderBy("text"))
    return rows.withColumn("_place", place).where("_place = 1").select(*docs.columns)
