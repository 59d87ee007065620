"""Document fingerprints: SimHash over weighted terms, and block tables that find near ones. Native only.

A term is a word in lower case; its weight is the square of its length, of 16 letters at most, so that a text's rare long
words count for more than its common short ones. Each term's 64-bit hash votes with its weight on every bit, and a bit is
set if over half the weight votes for it.

Definitions. A null text is empty; a text without words has fingerprint zero. Equal texts have equal fingerprints. In a text
of over 2^27 code points weights are divided by 16, rounded up, so that sums of them stay below 2^31. The next document of an
id is the next smaller id, of the smallest id the largest; null counts as smaller than any id. Where rows share an id, the
one with the smallest MD5 is the next document of others. Equal rows are one document, given back as often as it stands.
Searches are made for ids that 100 divides. No rows: no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, own_columns, written

#: Stands for a null id in order.
NO_ID = -(1 << 63)
LONGEST = 16
#: Code points of a text from which on weights are divided.
LONG_TEXT = 1 << 27
RADIUS, BLOCKS, SEARCH_EVERY = 3, 6, 100
#: Rows of one document that are given back at a time.
ROWS_AT_ONCE = 1_000
#: Two counters in a long, of bit j and bit j + 32; each holds sums of weights up to 2^31.
PAIR = (1 << 32) | 1


def weight(term: Column, chars: Column) -> Column:
    size = F.least(F.length(term), F.lit(LONGEST)).cast("long")
    return F.when(chars < LONG_TEXT, size * size).otherwise(F.shiftright(size * size + 15, 4))


def vote_sums(h: Column, w: Column) -> list[Column]:
    """33 sums: the weight of the hashes that have bit j, with that of bit j + 32 in the upper half; and all weight."""
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(PAIR)) * w).alias(f"v{j}") for j in range(32)] + [F.sum(w).alias("v32")]


def majority() -> Column:
    """The fingerprint from vote_sums."""
    out = F.lit(0).cast("long")
    for j in range(64):
        v = F.col(f"v{j % 32}")
        half = F.shiftrightunsigned(v, 32) if j >= 32 else v.bitwiseAND(F.lit((1 << 32) - 1))
        out = out.bitwiseOR(F.shiftleft((half * 2 > F.col("v32")).cast("long"), j))
    return out


def fingerprint(texts: DataFrame, *key: str) -> DataFrame:
    """(key, fp) of texts (key, text), one row for each key.

    Words are hashed and counted as they are split off, in one generated loop; a task sends a row for each key. What splits
    off before a first blank is a term without letters and weight, so no text goes without a row.
    """
    terms = texts.select(*key, F.length("text").alias("_n"), F.explode(F.split(F.lower("text"), rf"[{BLANK}]+", -1)).alias("term"))
    votes = terms.select(*key, F.xxhash64("term").alias("h"), weight(F.col("term"), F.col("_n")).alias("w"))
    return votes.groupBy(*key).agg(*vote_sums(F.col("h"), F.col("w"))).select(*key, majority().alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks as signed longs, one for each choice of blocks - radius of the blocks: two fingerprints that differ in at
    most radius bits agree on all blocks of at least one choice."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(ends, ends[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b, bits): all fingerprints b of prints (fp) within radius of each a of queries (fp), each pair once.

    Both sides are made distinct first, so copies cost one row; a table's buckets are joined by their blocks' bits.
    """
    masks = F.array(*[F.lit(m) for m in block_masks(radius, blocks)])

    def table(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("fp").alias(name)).distinct().select(name, F.posexplode(masks).alias("t", "m")).select(name, "t", F.col(name).bitwiseAND(F.col("m")).alias("bits_kept"))

    met = table(queries, "a").join(table(prints, "b"), ["t", "bits_kept"]).withColumn("x", F.col("a").bitwiseXOR(F.col("b")))
    first = F.array_position(F.transform(masks, lambda m: m.bitwiseAND(F.col("x")) == 0), True) == F.col("t") + 1
    return met.where((F.bit_count("x") <= radius) & first).select("a", "b", F.bit_count("x").alias("bits"))


def following(rows: DataFrame) -> DataFrame:
    """(k, tid, src, src_tid, want): for each distinct key k of rows (k, tid, n) and its smallest tid the next smaller key src
    (cyclic), the smallest tid of that, and a third of k's largest n.

    Keys alone are range-partitioned; within a partition a window gives the next key, and the partitions' largest keys,
    one row for each, close the gaps between them.
    """
    order = rows.repartitionByRange("k").groupBy("k").agg(F.max("n").alias("n"), F.min("tid").alias("tid")).withColumn("pid", F.spark_partition_id())
    order = written(order, "fingerprint-order")
    at = F.struct("k", "tid")
    heads = order.groupBy("pid").agg(F.max(at).alias("head"))
    every = Window.partitionBy()
    heads = heads.select("pid", F.coalesce(F.lag("head").over(every.orderBy("pid")), F.max("head").over(every)).alias("below"))
    inner = order.withColumn("src", F.lag(at).over(Window.partitionBy("pid").orderBy("k")))
    inner = inner.join(heads, "pid").withColumn("src", F.coalesce("src", "below"))
    return written(inner.select("k", "tid", F.col("src.k").alias("src"), F.col("src.tid").alias("src_tid"), F.floor(F.col("n") / 3).cast("int").alias("want")), "fingerprint-next")


def own_fingerprints(text: DataFrame) -> DataFrame:
    """(k, tid, n, fp, copies) of text (k, tid, text), one row for each text of an id; texts are read once and not moved."""
    rows = text.select("k", "tid", F.length("text").alias("n"), F.monotonically_increasing_id().alias("row"), "text")
    prints = fingerprint(rows, "k", "tid", "n", "row")
    return prints.groupBy("k", "tid", "n", "fp").agg(F.count("*").alias("copies"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(k, tid, n, fp, copies, edited_sha256, edited_fp, next_fp), one row for each text of an id of docs (doc_id, text, ...).

    The edited text has its last third replaced by the beginning of the next document. Each text is dealt out once, by id
    and MD5; of the next document only as much moves again as its predecessor needs.
    """
    text = own_columns(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.md5("text"))
    own = written(own_fingerprints(text), "fingerprints")
    wants = following(own)
    needed = wants.select(F.col("src").alias("k"), F.col("src_tid").alias("tid"), F.struct("k", "tid").alias("to"), "want")
    dealt = text.repartition("k", "tid")
    parts = dealt.join(needed, ["k", "tid"]).select("to.k", "to.tid", F.col("text").substr(F.lit(1), F.col("want")).alias("part"))
    if own.where("copies > 1").take(1):
        # equal rows: each text once, and what it gives to its predecessor once
        parts, dealt = parts.dropDuplicates(["k"]), dealt.dropDuplicates(["k", "tid"])
    if own.count() > wants.count():
        # ids of several texts: all of them end in the same
        parts = own.select("k", "tid").join(parts.drop("tid"), "k")
    both = dealt.join(parts, ["k", "tid"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    both = both.select("k", "tid", F.concat(F.col("text").substr(F.lit(1), n - third), F.col("part").substr(F.lit(1), third)).alias("text"))
    edited = fingerprint(both.withColumn("edited_sha256", F.sha2(F.encode("text", "UTF-8"), 256)), "k", "tid", "edited_sha256").withColumnRenamed("fp", "edited_fp")
    after = wants.join(own.select(F.col("k").alias("src"), F.col("tid").alias("src_tid"), F.col("fp").alias("next_fp")), ["src", "src_tid"]).select("k", "next_fp")
    return own.join(edited, ["k", "tid"]).join(after, "k")


def searched(found: DataFrame, every: int = SEARCH_EVERY) -> DataFrame:
    """(fp, n_near): for the fingerprint of each id that ``every`` divides, how many documents of found (k, fp, copies) have
    one within RADIUS, itself included; by the block tables, against all."""
    prints = written(found.groupBy("fp").agg(F.sum("copies").alias("n")), "fingerprint-prints")
    queries = found.where((F.col("k") % every == 0) & (F.col("k") != NO_ID)).select("fp").distinct()
    met = near(queries, prints).join(prints.withColumnRenamed("fp", "b"), "b")
    return met.groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n_near"))


def digest(docs: DataFrame) -> DataFrame:
    """n_near, of the ids that are searched for: other documents whose fingerprint is within RADIUS bits; null for others."""
    hex64 = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    found = written(edited_fingerprints(docs), "fingerprints-edited")
    is_query = (F.col("k") % SEARCH_EVERY == 0) & (F.col("k") != NO_ID)
    near_ones = found.where(is_query).join(searched(found), "fp")
    rows = near_ones.unionByName(found.where(~is_query).withColumn("n_near", F.lit(None).cast("long")))
    rows = rows.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(ROWS_AT_ONCE).cast("long"))))
    rows = rows.withColumn("_place", F.explode(F.sequence("_first", F.least(F.col("copies"), F.col("_first") + ROWS_AT_ONCE) - 1)))
    return rows.select(
        F.nullif("k", F.lit(NO_ID)).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        hex64("fp").alias("fingerprint"),
        hex64("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        (F.col("n_near") - 1).alias("n_near"),
    )
