"""Roll-ups of entities: counts, primary types, risk, groups for an answer, addresses, hints, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import postprocess, resolve

# Weights of risk; types left out of it and those that are government ids; bounds of levels.
RISK_WEIGHTS = {"password": 1.0, "cvv": 0.95, "credit_card": 0.9, "aadhaar": 0.85, "pan": 0.8, "bank_account": 0.75, "phone": 0.4, "email": 0.3, "name": 0.2}
OTHER_WEIGHT = 0.2
EXCLUDED = ("ORGANIZATION",)
GOVERNMENT = ("AADHAAR", "PAN", "DRIVING_LICENSE", "PASSPORT", "VOTER_ID")
LOW, MEDIUM = 0.3, 0.7
# Names in answers and in reports; types that hint at a kind of document; states and cities of addresses.
ANSWER_NAMES = {"aadhaar": "aadhaar_number", "pan": "pan_number", "dob": "date_of_birth", "mrn": "medical_record_number"}
DISPLAY = {
    "name": "PERSON", "father_name": "FATHER_NAME", "organization": "ORG", "address": "ADDRESS", "pan": "PAN", "aadhaar": "AADHAAR", "voter_id": "VOTER_ID", "phone": "PHONE", "email": "EMAIL",
    "credit_card": "CREDIT_CARD", "dob": "DOB", "expiry": "EXPIRY", "cvv": "CVV", "gender": "GENDER",
}
HINTS = {
    "contains_government_id": ("aadhaar", "pan", "passport", "voter_id", "driving_license", "abha_number", "ssn"),
    "contains_medical_data": ("diagnosis", "prescription", "mrn", "allergies", "treatment_history", "blood_group", "immunization", "lab_test_results", "medication"),
    "contains_financial_data": ("bank_account", "ifsc", "credit_card", "upi", "annual_income", "credit_score"),
}
STATES = (
    "Gujarat", "Maharashtra", "Karnataka", "Tamil Nadu", "Telangana", "Kerala", "Rajasthan", "Uttar Pradesh", "Madhya Pradesh", "West Bengal", "Punjab", "Haryana",
    "Bihar", "Odisha", "Assam", "Jharkhand", "Uttarakhand", "Himachal Pradesh", "Goa", "Delhi", "Andhra Pradesh", "North Carolina", "California", "New York", "Texas", "Florida",
)
CITIES = (
    "rajkot", "morvi", "mumbai", "delhi", "bangalore", "bengaluru", "chennai", "hyderabad", "kolkata", "pune", "ahmedabad", "surat", "jaipur", "lucknow", "kanpur",
    "nagpur", "indore", "thane", "bhopal", "visakhapatnam", "patna",
)


def distribution(entities: DataFrame, *by: str) -> DataFrame:
    """(by, pii_type in upper case, n) without what risk leaves out."""
    rows = entities.withColumn("pii_type", F.upper("pii_type")).where(~F.col("pii_type").isin(*EXCLUDED))
    return rows.groupBy(*by, "pii_type").agg(F.count("*").alias("n"))


def _level(score: Column, ids: Column) -> Column:
    return F.when(ids >= 2, "HIGH").when(ids == 1, "MEDIUM").when(score <= LOW, "LOW").when(score <= MEDIUM, "MEDIUM").otherwise("HIGH")


def risk(distributed: DataFrame, *by: str) -> DataFrame:
    """(by, total_entities, unique_types, risk_score, risk_level) of a distribution; it adds up over files.

    Weights are added up as whole hundredths and the mean is rounded half up, so that a score between two figures is the
    same in whatever order its types come.
    """
    hundredths = postprocess.by_type(F.lower("pii_type"), {k: round(100 * w) for k, w in RISK_WEIGHTS.items()}, round(100 * OTHER_WEIGHT))
    total, n = F.sum(hundredths * F.col("n")), F.sum("n")
    out = distributed.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_entities"),
        F.count_distinct("pii_type").alias("unique_types"),
        F.coalesce(F.call_function("div", total * 200 + n, n * 2) / F.lit(10000.0), F.lit(0.0)).alias("risk_score"),
        F.coalesce(F.sum(F.when(F.col("pii_type").isin(*GOVERNMENT), F.col("n"))), F.lit(0)).alias("_ids"),
    )
    return out.withColumn("risk_level", _level(F.col("risk_score"), F.col("_ids"))).drop("_ids")


def primary_type(entities: DataFrame, *by: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(by, pii_type, n, score): the type of the largest rank x mean confidence x count; the first one on ties."""
    rows = entities.where(F.col("pii_type").isin(*allowed)) if allowed else entities
    per = rows.groupBy(*by, "pii_type").agg(F.count("*").alias("n"), F.round(F.max(resolve.rank(F.col("sensitivity"))) * F.sum("confidence"), 6).alias("score"), F.min("ord").alias("ord"))
    best = F.max_by(F.struct("pii_type", "n", "score"), F.struct("score", -F.col("ord"))).alias("x")
    return per.groupBy(*by).agg(best).select(*by, "x.*")


def confidence_by_type(entities: DataFrame, *by: str) -> DataFrame:
    return entities.groupBy(*by, "pii_type").agg(F.max("confidence").alias("confidence"))


def groups(entities: DataFrame) -> DataFrame:
    """(doc_id, name, value, confidence): the surest value of each type that is fit for an answer; addresses apart."""
    clean = entities.where(postprocess.is_clean(F.col("pii_type"), F.col("value"))).where("pii_type <> 'address'")
    best = clean.groupBy("doc_id", "pii_type").agg(F.max_by(F.struct("value", "confidence"), F.struct("confidence", -F.col("ord"), -F.col("start"))).alias("x"))
    name = postprocess.by_type(F.col("pii_type"), ANSWER_NAMES, None)
    return best.select("doc_id", F.coalesce(name, "pii_type").alias("name"), "x.value", F.round("x.confidence", 3).alias("confidence"))


def addresses(entities: DataFrame) -> DataFrame:
    """(doc_id, full, postal_code, state, city): the fragments in order, each once; the first state and city in list order."""
    clean = entities.where("pii_type = 'address'").where(postprocess.is_clean(F.col("pii_type"), F.col("value")) & (F.length("value") > 5))
    part = T.stripped(F.rtrim(T.stripped(F.col("value")), F.lit(",")))
    rows = clean.select("doc_id", part.alias("part"), F.lower(T.one_space(part)).alias("same"), F.when(F.col("start") >= 0, F.col("start")).otherwise(9999).alias("at"), "ord")
    first = rows.groupBy("doc_id", "same").agg(F.min(F.struct("at", "ord", "part")).alias("x"))
    full = first.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), ", ").alias("full"))
    low = F.lower("full")
    pick = lambda names: F.coalesce(*[F.when(low.contains(n.lower()), n) for n in names])
    return full.select("doc_id", "full", F.nullif(F.regexp_extract("full", r"(?U)\b(\d{6})\b", 1), F.lit("")).alias("postal_code"), pick(STATES).alias("state"), F.initcap(pick(sorted(CITIES))).alias("city"))


def hints(entities: DataFrame) -> DataFrame:
    return entities.groupBy("doc_id").agg(*[F.bool_or(F.col("pii_type").isin(*types)).alias(name) for name, types in HINTS.items()])


def masked_samples(entities: DataFrame, each: int = 2) -> DataFrame:
    """(doc_id, pii_type, samples): the first distinct masked values; this limit is the feature."""
    rows = entities.withColumn("masked", T.mask(F.col("pii_type"), F.col("value")))
    first = rows.groupBy("doc_id", "pii_type", "masked").agg(F.min(F.struct("ord", "start")).alias("_at"))
    n = F.row_number().over(Window.partitionBy("doc_id", "pii_type").orderBy("_at", "masked"))
    return first.withColumn("_n", n).where(F.col("_n") <= each).groupBy("doc_id", "pii_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "masked"))), lambda x: x["masked"]), " | ").alias("samples"))


def telemetry(runs: DataFrame) -> DataFrame:
    """(engine, runs, failed, matches, total_ms) of runs (engine, n_matches, duration_ms, error)."""
    return runs.groupBy("engine").agg(F.count("*").alias("runs"), F.count("error").alias("failed"), F.sum("n_matches").alias("matches"), F.round(F.sum("duration_ms"), 3).alias("total_ms"))


def column_rollup(findings: DataFrame, *by: str) -> DataFrame:
    """(by, field, primary type, n_types, n) of field_scan's rows: what a column mostly holds."""
    rows = findings.withColumn("sensitivity", resolve.sensitivity(F.col("pii_type")))
    best = primary_type(rows, *by, "field").withColumnRenamed("pii_type", "primary_type").withColumnRenamed("n", "primary_n")
    every = rows.groupBy(*by, "field").agg(F.count_distinct("pii_type").alias("n_types"), F.count("*").alias("n"))
    return every.join(best, [*by, "field"])


def display_type(pii_type: Column) -> Column:
    """A type's name in reports."""
    return F.coalesce(postprocess.by_type(pii_type, DISPLAY, None), F.upper(pii_type))


def masked_report(entities: DataFrame, each: int = 2) -> DataFrame:
    """(doc_id, pii_type, n, samples) by display name: what may be written out as CSV or JSON, without values."""
    n = entities.groupBy("doc_id", "pii_type").agg(F.count("*").alias("n"))
    return n.join(masked_samples(entities, each), ["doc_id", "pii_type"]).withColumn("pii_type", display_type(F.col("pii_type")))
