"""Mixing sources to target weights: weighted sampling without replacement by Efraimidis and Spirakis, native only.

Each source gets a target from its weight; a target stops at ``max_epochs`` times the source's size, and what lies above
is shared again by weight among the others. A source first gives whole epochs of all its documents, then a fraction of
one: documents are ordered by their exponential keys -ln(u) / quality, their sizes summed in that order, and the words up
to the target taken, the last document's in part. u comes from a hash of the id, so reruns agree.

Definitions. A null text has size 0; a null source is a source of its own, last in order; a null id has a key like any
other id. Rows of the same source, id, size and quality are one group, ordered as one and counted; what the mix takes of it
goes to its rows one after another. Ties of keys go by id, then size. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, WORD, own_columns, written

WEIGHTS, SHARE, MAX_EPOCHS = (3, 1, 2), 1.5, 2
#: Groups that one sorted bucket of a source has, about; classes of quality that the buckets' borders tell apart.
BUCKET_ROWS, CLASSES = 2_000, 20
#: Rows of a group that are made at a time.
ROWS_AT_ONCE = 1_000
#: Stands for a null id where texts meet their numbers.
NO_ID = -(1 << 63)
#: Characters that clean prose has few of.
JUNK = r"[!$%&*#|]+"


def words_in(text: Column) -> Column:
    """The number of words, by what is left when each word becomes one letter and the blanks go."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w"), rf"[{BLANK}]+", "")).cast("long")


def quality(text: Column) -> Column:
    """From 0.05 to 1, lower the larger the share of junk characters in the text; 1 for an empty one."""
    text = F.coalesce(text, F.lit(""))
    clean = F.length(F.regexp_replace(text, JUNK, "")) / F.greatest(F.length(text), F.lit(1)).cast("double")
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), 1.0 - 4.0 * (1.0 - clean)))


def exponential_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u) / weight, u from the first 52 bits of the id's MD5."""
    u = (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(src, source_size, n_groups, classes, target), a row for each source of groups (src, size, w, n).

    classes: how many groups have each class of quality. A source is capped if, with all sources of a smaller cap per weight
    capped before it, its share still exceeds its cap. The table has one row per source, so ordering it as a whole is cheap.
    """
    of = F.greatest(F.lit(1), F.ceil(F.col("w") * CLASSES))
    per = sized.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_groups"), F.array(*[F.count_if(of == c) for c in range(1, CLASSES + 1)]).alias("classes"))
    every = Window.partitionBy()
    place = F.row_number().over(every.orderBy("src")) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_epochs).withColumn("all_size", F.sum("source_size").over(every))
    by_cap = every.orderBy((F.col("cap") / F.col("w")), "src")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest_w = F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("capped", F.col("cap").cast("double") * rest_w <= F.col("w") * (share * F.col("all_size") - before))
    cap_sum = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    w_sum = F.sum(F.when(~F.col("capped"), F.col("w"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * (share * F.col("all_size") - cap_sum) / w_sum)
    return per.select("src", "source_size", "n_groups", "classes", target.alias("target"))


def share_below(key: Column, classes: Column, n: Column) -> Column:
    """The share of a source's groups whose keys are expected below key: each class's exponential distribution, by its size."""
    terms = [F.get(classes, F.lit(c - 1)) * (1.0 - F.exp(-key * (c / CLASSES))) for c in range(1, CLASSES + 1)]
    return sum(terms[1:], terms[0]) / n


def source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col("source")))


def groups(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(src, source, doc_id, size, w, n, source_size, target, epochs, rest): a row for each group of equal rows; rest: the
    words that the last epoch takes of the group's rows together, or more.

    Texts are read once and never shuffled: sizes and keys go to a table in the shared folder, equal rows as one with their
    number. A source is split by ranges of its keys into buckets of about BUCKET_ROWS groups, so one source may hold any part
    of the rows; sizes are summed within buckets, and the buckets' sums over the source.
    """
    sized = own_columns(docs, "doc_id", "text", "source").select("doc_id", "source", source_key().alias("src"), words_in(F.col("text")).alias("size"), quality(F.col("text")).alias("w"))
    sized = sized.groupBy("doc_id", "source", "src", "size", "w").agg(F.count("*").alias("n"))
    sized = written(sized.withColumn("key", exponential_key(F.col("doc_id"), F.col("w"))), "mix-sizes")
    # as a table the targets have a known size: Spark broadcasts them if they are small, without dealing rows out by source
    rows = sized.join(written(targets(sized, weights, share, max_epochs), "mix-targets"), "src")
    rows = rows.withColumn("bucket", F.floor(F.ceil(F.col("n_groups") / BUCKET_ROWS) * share_below(F.col("key"), F.col("classes"), F.col("n_groups")))).drop("classes")
    size = F.col("size") * F.col("n")
    sums = rows.groupBy("src", "bucket").agg(F.sum(size).alias("bucket_size"))
    sums = sums.withColumn("before", F.sum("bucket_size").over(Window.partitionBy("src").orderBy("bucket")) - F.col("bucket_size")).select("src", "bucket", "before")
    run = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size", "w").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum(size).over(run)).join(sums, ["src", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target")) - epochs * F.col("source_size") - (F.col("before") + F.col("upto") - size)
    return rows.select("src", "source", "doc_id", "size", "w", "n", "source_size", "target", epochs.alias("epochs"), rest.cast("long").alias("rest"))


def taken(place: Column, within: str = "") -> Column:
    """The words that the mix takes of a group's row, by the row's place among them, from 0. within: the group's struct."""
    epochs, size, rest = (F.col(f"{within}{c}") for c in ("epochs", "size", "rest"))
    return epochs * size + F.greatest(F.lit(0), F.least(size, rest - place * size))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), a row for each row of docs (doc_id, text, source, ...)."""
    rows = groups(docs, weights, share, max_epochs)
    rows = rows.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(ROWS_AT_ONCE).cast("long"))))
    rows = rows.withColumn("_place", F.explode(F.sequence("_first", F.least(F.col("n"), F.col("_first") + ROWS_AT_ONCE) - 1)))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken(F.col("_place")).cast("long").alias("taken"))


def repeated(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of docs, each row as often as the mix takes it: taken / size, rounded, times.

    Only ids and numbers are sorted; each text meets the numbers of its group once.
    """
    keys = ["_id", "_src", "_size", "_w"]
    found = groups(docs).where("size > 0 and (epochs > 0 or rest > 0)")
    found = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("src").alias("_src"), F.col("size").alias("_size"), F.col("w").alias("_w"), F.struct("size", "n", "epochs", "rest").alias("_mix"))
    rows = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(NO_ID)), "_src": source_key(), "_size": words_in(F.col("text")), "_w": quality(F.col("text"))}).join(found, keys)
    # most groups have one row; the places of the others' rows go by their texts
    place = F.when(F.col("_mix.n") == 1, F.lit(0)).otherwise(F.row_number().over(Window.partitionBy(*keys).orderBy("text")) - 1)
    times = F.round(taken(place, "_mix.") / F.col("_size")).cast("int")
    return rows.withColumn("_times", times).where("_times > 0").select(*keep, F.explode(F.sequence(F.lit(1), "_times")).alias("_time")).select(*keep)


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0) / clean AS key FROM (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      CASE WHEN coalesce(text, '') = '' THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (1.0::DOUBLE -
        length(regexp_replace(text, '[!$%&*#|]+', '', 'g'))::DOUBLE / length(text)::DOUBLE)) END AS clean
    FROM documents)
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sized GROUP BY source
), cum AS (
  SELECT *, sum(source_size) OVER () AS all_size, 2 * source_size AS cap,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM per
), capped AS (
  SELECT *, cap::DOUBLE * rest_w::DOUBLE <= w * (1.5::DOUBLE * all_size::DOUBLE - cap_before::DOUBLE) AS capped FROM cum
), target AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE w * (1.5::DOUBLE * all_size::DOUBLE - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)::DOUBLE)
    / (sum(w) FILTER (WHERE NOT capped) OVER ())::DOUBLE END AS target FROM capped
), run AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size, s.clean ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)) AS BIGINT) AS taken FROM run
"""
