"""Entity resolution: from matches of any engines to one row for each thing found in a document.

Steps, in this order: grounding, containment of spans within a type, phones that are tails of longer ones, grouping by
key, canonical value, fused confidence, best span, sensitivity. All windows and groups are within a document and a type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import registry
from ..functions import text as T

# Trust in the engines, and types by the way their values are compared.
ENGINE_WEIGHTS = {"regex": 1.0, "gliner": 0.85, "qwen_ner": 0.78, "llm": 0.78}
OTHER_WEIGHT = 0.5
NUMERIC = ("aadhaar", "credit_card", "bank_account", "phone", "ssn")
ALPHANUMERIC = ("pan", "passport", "voter_id", "driving_license", "upi", "ifsc", "insurance_policy", "mrn", "employee_id")
TEXTUAL = ("email", "ip_address", "user_id")
PATTERN_FIRST = (
    "aadhaar", "pan", "passport", "voter_id", "driving_license", "ssn", "phone", "email", "ifsc", "bank_account", "upi", "credit_card", "mrn", "abha_number",
    "ip_address", "pincode", "cvv", "expiry", "blood_group", "insurance_policy", "insurance_account_number", "employee_id", "user_id", "password", "nhs_number", "iban",
)
BONUS = 0.05
ID_NOISE = r"(?Ui)\b(?:EPIC|VOTER|CARD|PAN|DOB|MALE|FEMALE|GOI|INDIA|ELECTION|COMMISSION|COMMISSIONER|\d{4,}|[A-Z]{3,}\d{4,})\b"

_KEY = ("doc_id", "pii_type")


def weight(source: Column) -> Column:
    out = F.when(source == "regex", ENGINE_WEIGHTS["regex"])
    for name, w in list(ENGINE_WEIGHTS.items())[1:]:
        out = out.when(source == name, w)
    return out.otherwise(OTHER_WEIGHT)


def holds(text: Column, value: Column) -> Column:
    """Whether a text holds a value: as it is, with white space collapsed, or by six digits or more; case doesn't count."""
    low, said, number = F.lower(T.stripped(value)), F.lower(text), T.digits(value)
    return said.contains(low) | T.one_space(said).contains(T.one_space(low)) | ((F.length(number) >= 6) & T.digits(text).contains(number))


def grounded(matches: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """matches without those of models whose value the document doesn't hold: as it is, with white space collapsed, or by
    six digits or more. Matches of patterns are not joined."""
    own = matches.where("source = 'regex'")
    held = holds(F.col("_text"), F.col("value"))
    models = matches.where("source <> 'regex'").join(docs.select("doc_id", F.col(text).alias("_text")), "doc_id").where(held)
    return own.unionByName(models.select(*matches.columns))


def uncontained(matches: DataFrame) -> DataFrame:
    """Without spans that lie within another of their type; of equal ones the first stays. Unknown spans stay.

    Sorted by start, longest first, a span is contained if an earlier one reaches its end: a running maximum decides.
    """
    order = Window.partitionBy(*_KEY, "_known").orderBy("start", F.col("end").desc(), "ord", "source", "value").rowsBetween(Window.unboundedPreceding, -1)
    rows = matches.withColumn("_known", (F.col("start") >= 0) & (F.col("end") >= 0)).withColumn("_reach", F.max("end").over(order))
    return rows.where(~F.col("_known") | F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_known", "_reach")


def without_phone_tails(matches: DataFrame) -> DataFrame:
    """Without phones whose digits end another, longer phone of the document.

    Reversed, a tail is a prefix, and in order of reversed digits a prefix stands right before what it begins: the next
    different value decides, without comparing pairs. Of equal values only the last sees it, so it is shared among them.
    """
    number = F.when(F.col("pii_type") == "phone", F.reverse(T.digits(F.col("value"))))
    after = F.lead("_r").over(Window.partitionBy(*_KEY).orderBy("_r"))
    rows = matches.withColumn("_r", number).withColumn("_after", after)
    rows = rows.withColumn("_next", F.max(F.when(F.col("_after") != F.col("_r"), F.col("_after"))).over(Window.partitionBy(*_KEY, "_r")))
    kept = F.col("_r").isNull() | F.col("_next").isNull() | ~F.col("_next").startswith(F.col("_r"))
    return rows.where(kept).drop("_r", "_after", "_next")


def key(pii_type: Column, value: Column) -> Column:
    """What makes two values of a type the same; an empty key gives way to the value's first 50 characters."""
    out = (
        F.when(pii_type.isin(*NUMERIC), T.digits(value))
        .when(pii_type.isin(*ALPHANUMERIC), F.upper(F.regexp_replace(value, r"(?U)[\s\-/]", "")))
        .when(pii_type.isin(*TEXTUAL), F.lower(T.stripped(value)))
        .otherwise(F.lower(T.stripped(T.one_space(value))))
    )
    return F.when(out == "", F.left(value, F.lit(50))).otherwise(out)


def clean_name(value: Column) -> Column:
    """The first line that says something (two if it is under three characters), without what stands on identity cards."""
    lines = F.filter(F.transform(F.split(value, r"[\n\r]+"), T.stripped), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    line = F.when((F.length(first) < 3) & (F.size(lines) > 1), F.array_join(F.slice(lines, 1, 2), " ")).otherwise(first)
    clean = T.stripped(F.regexp_replace(T.stripped(F.regexp_replace(line, ID_NOISE, "")), r"(?U)\s{2,}", " "))
    return F.when(F.size(lines) == 0, value).when(F.length(clean) >= 2, clean).otherwise(line)


def canonical(pii_type: Column, value: Column) -> Column:
    value, number = T.stripped(value), T.digits(value)
    return F.when(pii_type.isin(*NUMERIC) & (number != ""), number).when(pii_type.isin("name", "father_name"), clean_name(value)).otherwise(value)


def sensitivity(pii_type: Column) -> Column:
    """From the registry, Low for what it doesn't know. The registry has 52 rows, so it is a constant map."""
    table = F.create_map(*[F.lit(x) for t in registry.TYPES for x in (t.id, t.sensitivity)])
    return F.coalesce(F.element_at(table, pii_type), F.lit("Low"))


def rank(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in sum(registry.RANKS.items(), ())])
    return F.coalesce(F.element_at(table, level), F.lit(1))


def fused(matches: DataFrame) -> DataFrame:
    """entities: doc_id, pii_type, value, confidence, sources, start, end, context, sensitivity, n_matches, ord, metadata.

    metadata tells an auditor how a value came about: how many engines agree, which, and which one its span is from. One aggregate by document, type and key. Ties go to the match that comes first.
    """
    first = F.struct(-F.col("ord"), -F.col("start"), -F.col("end"))
    rows = matches.withColumn("_key", key(F.col("pii_type"), F.col("value"))).withColumn("_w", weight(F.col("source"))).withColumn("_re", F.col("source") == "regex")
    grouped = rows.groupBy(*_KEY, "_key").agg(
        F.max_by("value", F.struct("_re", F.length("value"), first)).alias("value"),
        F.max("confidence").alias("_best"),
        F.max_by("confidence", F.struct("_re", first)).alias("_first"),
        F.bool_or("_re").alias("_re"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.max_by(F.struct("start", "end", "context", "source"), F.struct("_w", first)).alias("_span"),
        F.count("*").alias("n_matches"),
        F.min(F.struct("ord", "start")).alias("_order"),
    )
    fuse = F.when(F.col("pii_type").isin(*PATTERN_FIRST) & F.col("_re"), F.round("_first", 4)).otherwise(F.round(F.col("_best") + BONUS * (F.size("sources") - 1), 4))
    said = F.col("_span.source")
    metadata = F.struct(
        F.size("sources").alias("engine_count"), F.lit(True).alias("grounded"), F.col("sources").alias("matched_by"), F.when(said == "regex", F.col("pii_type")).alias("matched_pattern"),
        F.when(said != "regex", said).alias("matched_model"),
    ).alias("metadata")
    return grouped.select(*_KEY, canonical(F.col("pii_type"), F.col("value")).alias("value"), F.least(fuse, F.lit(1.0)).alias("confidence"), "sources", "_span.start", "_span.end", "_span.context", sensitivity(F.col("pii_type")).alias("sensitivity"), "n_matches", F.col("_order.ord").alias("ord"), metadata)


def resolve(matches: DataFrame, docs: DataFrame | None = None, text: str = "text") -> DataFrame:
    """entities of matches; with docs, matches of models are grounded in them first."""
    rows = grounded(matches, docs, text) if docs is not None else matches
    # one shuffle by document serves all windows and groups that follow, here and in the filters
    return fused(without_phone_tails(uncontained(rows.repartition("doc_id"))))


def ordered(entities: DataFrame) -> DataFrame:
    """With place: an entity's number in its document, most sensitive and surest first."""
    order = Window.partitionBy("doc_id").orderBy(rank(F.col("sensitivity")).desc(), F.col("confidence").desc(), "ord", "start", "value")
    return entities.withColumn("place", F.row_number().over(order))


def capped(entities: DataFrame, most: int = 500) -> DataFrame:
    """At most ``most`` entities of each document, the surest; this limit is the feature."""
    order = Window.partitionBy("doc_id").orderBy(F.col("confidence").desc(), "ord", "start", "value")
    return entities.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
