"""Sinks: scans, their columns and anomalies as tables, run status, and answers as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics, postprocess, redact, validate

# Fixed value: fewer characters than this out of an image want a person's look.
LITTLE_TEXT = 100


def scan_tables(entities: DataFrame, scans: DataFrame) -> dict[str, DataFrame]:
    """scans, column_scans and scan_anomalies of entities (doc_id, ...) and scans (doc_id, name, connector_id).

    Keys are hashes of what they stand for, so that a run again gives the same keys without a counter.
    """
    key = F.xxhash64("connector_id", "name", "doc_id")
    s = scans.withColumn("scan_id", key)
    best = analytics.primary_type(entities, "doc_id").select("doc_id", F.col("pii_type").alias("primary_pii_type"), F.col("n").alias("primary_pii_match_count"))
    columns = s.join(best, "doc_id", "left").select(
        F.xxhash64("scan_id", F.lit("content")).alias("column_scan_id"), "scan_id", F.col("connector_id").alias("db_name"), F.lit("file").alias("table_name"), F.lit("content").alias("column_name"),
        F.lit(1).alias("total_rows"), "primary_pii_type", F.coalesce("primary_pii_match_count", F.lit(0)).alias("primary_pii_match_count"),
    )
    per = entities.groupBy("doc_id", "pii_type").agg(F.count("*").alias("match_count"), F.round(F.avg("confidence"), 4).alias("confidence_score"))
    anomalies = per.join(s.select("doc_id", "scan_id"), "doc_id").select(F.xxhash64("scan_id", "pii_type").alias("anomaly_id"), F.xxhash64("scan_id", F.lit("content")).alias("column_scan_id"), "pii_type", "match_count", "confidence_score")
    return {"scans": s.select("scan_id", "name", "connector_id"), "column_scans": columns, "scan_anomalies": anomalies}


def save(tables: dict[str, DataFrame], path: str, mode: str = "append") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def responses(entities: DataFrame) -> DataFrame:
    """(doc_id, response): a JSON answer for each document, without values: counts, risk and hints."""
    per = analytics.distribution(entities, "doc_id")
    counts = per.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pii_type", "n"))).alias("distribution"))
    out = analytics.risk(per, "doc_id").join(counts, "doc_id").join(analytics.hints(entities), "doc_id")
    return out.select("doc_id", F.to_json(F.struct("total_entities", "unique_types", "risk_score", "risk_level", "distribution", *analytics.HINTS)).alias("response"))


def full_responses(entities: DataFrame, docs: DataFrame, mode: str = "contextual") -> DataFrame:
    """(doc_id, response): the whole answer for each of docs (doc_id, text; filename, parser, pages where there are) as JSON,
    with values: entities fit for an answer, groups, addresses, hints, OCR, validation, redactions, confidence by type.

    A document without entities has an answer with empty parts. An answer is one document's, so its size is that of what was
    found in it. Everything is grouped by document, so one shuffle of the entities serves all parts; texts are read for
    their length and the span check only.
    """
    rows = entities.repartition("doc_id")
    clean = rows.where(postprocess.is_clean(F.col("pii_type"), F.col("value")))
    at = F.when(F.col("start") >= 0, F.struct("start", "end"))
    one = F.struct(F.col("ord"), F.col("start").alias("_s"), F.struct(F.col("pii_type").alias("type"), "value", F.round("confidence", 4).alias("confidence"), F.coalesce(F.get("sources", F.lit(0)), F.lit("unknown")).alias("source"), at.alias("span"), F.struct(F.size("sources").alias("engine_count"), F.lit(True).alias("grounded")).alias("audit")).alias("x"))
    listed = clean.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda e: e["x"]).alias("entities"))
    best = clean.groupBy("doc_id", "pii_type").agg(F.max("confidence").alias("c")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pii_type", F.round("c", 4).alias("c"))))).alias("confidence_scores"))
    groups = analytics.groups(rows).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct("value", "confidence"))))).alias("entity_groups"))
    places = analytics.addresses(rows).select("doc_id", F.struct("full", "city", "state", "postal_code").alias("address"))
    mapped = redact.redaction_map(rows, mode).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "replacement")))).alias("_map"))
    hints = analytics.hints(rows).select("doc_id", F.struct(*analytics.HINTS).alias("document_hints"))
    errors = validate.span_mismatches(rows, docs).groupBy("doc_id").agg(F.count("*").alias("_errors"))
    given = {c: (F.col(c) if c in docs.columns else F.lit(v)).alias(c) for c, v in (("filename", None), ("parser", "unknown"), ("page_count", 1))}
    out = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("_n"), *given.values())
    for part in (listed, best, groups, places, mapped, hints, errors):
        out = out.join(part, "doc_id", "left")
    none = F.struct(*[F.lit(False).alias(h) for h in analytics.HINTS])
    empty = lambda name, kind: F.coalesce(name, F.from_json(F.lit("{}" if kind.startswith("map") else "[]"), kind)).alias(name)
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    n = F.coalesce(F.col("_errors"), F.lit(0))
    response = F.struct(
        F.lit("success").alias("status"), F.struct("filename", F.col("doc_id").alias("scan_id"), "parser", "page_count").alias("document_metadata"),
        *[empty(c, kinds[c]) for c in ("entities", "entity_groups")], F.col("address"), F.coalesce("document_hints", none).alias("document_hints"),
        F.struct(F.col("parser").isin("image").alias("used"), F.struct(F.col("_n").alias("char_count"), ((F.col("parser") == "image") & (F.col("_n") < LITTLE_TEXT)).alias("manual_review_required")).alias("quality")).alias("ocr"),
        F.struct((n == 0).alias("passed"), n.alias("span_errors")).alias("validation_results"),
        F.struct(empty("_map", kinds["_map"]).alias("map"), F.coalesce(F.size("_map"), F.lit(0)).alias("count")).alias("redactions"), empty("confidence_scores", kinds["confidence_scores"]),
    )
    return out.select("doc_id", F.to_json(response).alias("response"))


def error_responses(failed: DataFrame) -> DataFrame:
    """(path, response) of documents that the readers give with an error."""
    return failed.where(F.col("error").isNotNull()).groupBy("path").agg(F.max("error").alias("error")).select("path", F.to_json(F.struct(F.lit("error").alias("status"), F.col("error").alias("message"))).alias("response"))


def run_status(parsed: DataFrame) -> DataFrame:
    """(status, n) of documents as the readers give them: completed, or failed with an error."""
    return parsed.groupBy(F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status")).agg(F.count_distinct("path").alias("n"))
