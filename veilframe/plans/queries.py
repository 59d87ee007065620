"""Queries over whole tables, one or more for each group of operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry, scripts
from ..functions import text as T
from ..operators import analytics, content, postprocess, redact, resolve, scan, validate
from ..sources import files as file_redaction
from ..sources import ingestion, readers, sinks
from . import detect
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Types that documents hold; the flagship and what follows from it work on these.
FOUND = ("email", "ip_address", "credit_card", "phone")


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


# --- scans: one query for each pattern, over all documents and the invented texts ---

#: Patterns with look-around as the SQL engine can say them, their value being the first group.
_NO_LOOK = {
    "aadhaar": r"(?:^|[^0-9])(\d{4}[\s.\-]*\d{4}[\s.\-]*\d{4}|\d{12})(?:$|[^0-9])",
    "ssn": r"(?i)\b((?:ssn|social\s*security\s*(?:number|no|num|#)?|s\.s\.n\.?|taxpayer\s*id)\s*[:\-#]?\s*[1-57-8]\d{2}[\s.\-]?(?:0[1-9]|[1-9]\d)[\s.\-]?\d{4})\b",
    "corporate_email": r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+\.(?:com|org|net|in|co\.in|gov\.in))",
    "phone": r"(\+\d{1,3}[\s\-.]?(?:\(0?\d{1,4}\)[\s\-.]?)?\d{3,5}[\s\-.]?\d{3,5}(?:[\s\-.]?\d{2,5})?|(?:phone|mobile|tel|ph|mob|contact)\s*[:\-]?\s*(?:\+\d{1,3}[\s\-.]?)?\d{3,5}[\s\-.]?\d{3,5}(?:[\s\-.]?\d{2,5})?|(?:\+91[\s\-.]?|0)?[6-9]\d{4}[\s\-.]?\d{5})(?:$|[^0-9])",
    "father_name": r"(?im)(?:(?:S|D|W|C)\/O\.?|Son\s+of|Daughter\s+of|Wife\s+of|Care\s+of|Father(?:'?s)?(?:\s*Name)?|\bPita\b|\bF\.?Name\b)\s*[:\-]?\s*([A-Z][A-Za-z \.]{2,40})(?:\n|\r|$)",
    "dob": r"(?im)(?:dob|d\.?o\.?b\.?|date\s*of\s*birth)\s*[:\-]?\s*(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4})",
    "address": r"(?i)\b((?:address|addr|residence)\s*[:\-]?\s*[A-Za-z0-9][A-Za-z0-9 ,./#\-]{8,300})(?:\n\n\n|$)",
    "gender": r"(?i)(?:^|[^A-Za-z])(?:(?:gender|sex)\s*[:\-\/]?\s*)?(MALE|FEMALE|TRANSGENDER|Non[\s\-]Binary|Other)(?:$|[^A-Za-z])",
    "allergies": r"(?im)\b(?:allerg(?:y|ies|ic\s*to))\s*[:\-]?\s*([A-Za-z][A-Za-z, ]{2,50})(?:\n|$|;|\|)",
}
_BARE = "regexp_replace(m, '\\s+', '', 'g')"
_ONLY = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = (
    f"length({_ONLY}) >= 13 AND list_sum(list_transform(range(1, length({_ONLY}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_ONLY}), i, 1) AS INT) "
    f"ELSE (CAST(substr(reverse({_ONLY}), i, 1) AS INT) * 2) // 10 + (CAST(substr(reverse({_ONLY}), i, 1) AS INT) * 2) % 10 END)) % 10 = 0"
)


def scan_sql(t: registry.PiiType) -> str:
    pattern = _NO_LOOK.get(t.id, t.pattern).replace("\\u20B9", "₹")
    group = 1 if t.id in _NO_LOOK or t.id in scan.FIRST_GROUP else 0
    value, where = "trim(m, ' ' || chr(9) || chr(10) || chr(13))", "true"
    if t.id in scan.DIGITS:
        value = _ONLY
        where = {"credit_card": LUHN, "phone": f"({_ONLY} LIKE '91%' OR length({_ONLY}) >= 10)"}.get(t.id, "true")
    elif t.id in scan.COMPACT:
        value = _BARE
    elif t.id == "email":
        value = _BARE
    elif t.id == "voter_id":
        value = "upper(regexp_extract(m, '[A-Za-z]{3}[0-9]{7}'))"
    elif t.id == "corporate_email":
        where = "NOT regexp_matches(m, '@(gmail|yahoo|hotmail|outlook|rediff|icloud|proton)[.]')"
    elif t.id == "upi":
        where = "NOT regexp_matches(m, '^[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')"
    elif t.id == "father_name":
        value = "rtrim(trim(m), '.')"
    text = pattern.replace("'", "''")
    found = f"SELECT doc_id, unnest(regexp_extract_all(text, '{text}', {group})) AS m FROM corpus"
    return f"WITH {X.CORPUS_SQL} SELECT doc_id, '{t.id}' AS pii_type, {value} AS value FROM ({found}) WHERE {where}"


def _add_scan(t: registry.PiiType) -> None:
    @query(scan_sql(t), f"scan_{t.id}")
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = scan.scan(X.corpus(spark, d), types=[t.id], use_nlp=False, names=False)
        # letters beyond ASCII as z, as the SQL has them
        return found.select("doc_id", "pii_type", F.regexp_replace("value", r"[^\x00-\x7F]", "z").alias("value"))


for _t in registry.PATTERN_TYPES:
    _add_scan(_t)


@query()
def scan_names_by_label(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(X.corpus(spark, d), types=["name"], use_nlp=False).select("doc_id", "value", "start", "end", "confidence")


def _found_sql() -> str:
    """matches of FOUND over documents alone, as CTEs: found(doc_id, pii_type, value)."""
    parts = []
    for t in FOUND:
        sql = scan_sql(registry.BY_ID[t])
        parts.append(sql[sql.index(" SELECT doc_id, '" + t) + 1 :].replace("FROM corpus", "FROM plain"))
    plain = "plain AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g') AS text FROM documents)"
    return f"{plain}, hits AS ({' UNION ALL '.join(parts)}), found AS (SELECT * FROM hits a WHERE pii_type <> 'phone' OR NOT EXISTS (SELECT 1 FROM hits b WHERE b.doc_id = a.doc_id AND b.pii_type = 'phone' AND length(b.value) > length(a.value) AND b.value LIKE '%' || a.value))"


FOUND_SQL = _found_sql()
_WEIGHT = "CASE lower(pii_type) " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in analytics.RISK_WEIGHTS.items()) + " ELSE 0.2::DOUBLE END"
_RANK = "CASE sensitivity WHEN 'Critical' THEN 6 WHEN 'Very High' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 ELSE 1 END"


def found(spark: SparkSession, d: str) -> DataFrame:
    return detect.detect(docs(spark, d), types=FOUND)


@query(f"WITH {FOUND_SQL} SELECT pii_type, count(*) AS n FROM (SELECT DISTINCT doc_id, pii_type, lower(value) AS value FROM found) GROUP BY pii_type")
def counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: detection, resolution and counts over all documents."""
    return scan.counts(found(spark, d))


@query(f"WITH {FOUND_SQL}, e AS (SELECT DISTINCT doc_id, pii_type, lower(value) AS value FROM found) SELECT source, upper(pii_type) AS pii_type, count(*) AS n FROM e JOIN documents USING (doc_id) GROUP BY ALL")
def distribution_by_source(spark: SparkSession, d: str) -> DataFrame:
    return analytics.distribution(found(spark, d).join(docs(spark, d).select("doc_id", "source"), "doc_id"), "source")


@query(f"""WITH {FOUND_SQL}, e AS (SELECT DISTINCT doc_id, pii_type, lower(value) AS value FROM found),
r AS (SELECT lang, count(*) AS total_entities, count(DISTINCT pii_type) AS unique_types, CAST(round(sum({_WEIGHT}) / count(*), 4) AS DOUBLE) AS risk_score FROM e JOIN documents USING (doc_id) GROUP BY lang)
SELECT *, CASE WHEN risk_score <= 0.3 THEN 'LOW' WHEN risk_score <= 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM r""")
def risk_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return detect.risk_report(docs(spark, d), ["lang"], types=FOUND)


# --- resolution, over as many matches as there are events ---

_KEY_SQL = "CASE pii_type WHEN 'phone' THEN regexp_replace(value, '[^0-9]', '', 'g') WHEN 'aadhaar' THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) END"
_WITHIN = """b.doc_id = a.doc_id AND b.pii_type = a.pii_type AND b."start" <= a."start" AND b."end" >= a."end" AND (b."start" < a."start" OR b."end" > a."end" OR b.ord < a.ord)"""
_KEPT = f"kept AS (SELECT a.* FROM matches a WHERE NOT EXISTS (SELECT 1 FROM matches b WHERE {_WITHIN}))"
_TAILS = f"""dig AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS dg FROM kept), apart AS (SELECT a.* FROM dig a WHERE pii_type <> 'phone' OR NOT EXISTS
(SELECT 1 FROM dig b WHERE b.doc_id = a.doc_id AND b.pii_type = 'phone' AND length(b.dg) > length(a.dg) AND b.dg LIKE '%' || a.dg))"""


@query(f"WITH {X.MATCHES_SQL}, {_KEPT} SELECT doc_id, pii_type, \"start\", \"end\", ord FROM kept")
def resolve_containment(spark: SparkSession, d: str) -> DataFrame:
    return resolve.uncontained(X.matches(spark, d)).select("doc_id", "pii_type", "start", "end", "ord")


@query(f"WITH {X.MATCHES_SQL}, kept AS (SELECT * FROM matches), {_TAILS} SELECT doc_id, value, ord FROM apart WHERE pii_type = 'phone'")
def resolve_phone_tails(spark: SparkSession, d: str) -> DataFrame:
    return resolve.without_phone_tails(X.matches(spark, d)).where("pii_type = 'phone'").select("doc_id", "value", "ord")


@query(f"WITH {X.MATCHES_SQL} SELECT doc_id, pii_type, {_KEY_SQL} AS k, count(*) AS n FROM matches GROUP BY ALL")
def resolve_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = X.matches(spark, d).withColumn("k", resolve.key(F.col("pii_type"), F.col("value")))
    return rows.groupBy("doc_id", "pii_type", "k").agg(F.count("*").alias("n"))


@query(f"""WITH {X.MATCHES_SQL}, {_KEPT}, {_TAILS}, g AS (SELECT doc_id, pii_type, {_KEY_SQL} AS k, count(*) AS n_matches, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS n_src,
max(confidence) AS best, bool_or(source = 'regex') AS re, arg_min(confidence, ord) FILTER (WHERE source = 'regex') AS first_re FROM apart GROUP BY ALL)
SELECT doc_id, pii_type, n_matches, sources, CAST(least(round(CASE WHEN pii_type IN ('phone', 'email', 'aadhaar') AND re THEN first_re ELSE best + 0.05::DOUBLE * (n_src - 1) END, 4), 1) AS DOUBLE) AS confidence FROM g""")
def fuse_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = resolve.resolve(X.matches(spark, d))
    return e.select("doc_id", "pii_type", "n_matches", F.array_join("sources", ",").alias("sources"), "confidence")


@query(f"""WITH {X.MATCHES_SQL}, {_KEPT}, {_TAILS}, r AS (SELECT *, {_KEY_SQL} AS k FROM apart),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pii_type, k ORDER BY (source = 'regex') DESC, length(value) DESC, ord) AS a, row_number() OVER (PARTITION BY doc_id, pii_type, k ORDER BY CASE source WHEN 'regex' THEN 1 WHEN 'gliner' THEN 0.85 ELSE 0.78 END DESC, ord) AS b FROM r)
SELECT x.doc_id, x.pii_type, CASE WHEN x.pii_type IN ('phone', 'aadhaar') THEN regexp_replace(x.value, '[^0-9]', '', 'g') ELSE trim(x.value) END AS value, y."start", y."end"
FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.pii_type = y.pii_type AND x.k = y.k AND x.a = 1 AND y.b = 1""")
def resolve_canonical_and_span(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(X.matches(spark, d)).select("doc_id", "pii_type", "value", "start", "end")


@query(f"WITH {X.ENTITIES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK} DESC, confidence DESC, ord, \"start\", value) AS place FROM entities) SELECT doc_id, ord, place FROM o")
def final_order(spark: SparkSession, d: str) -> DataFrame:
    return resolve.ordered(X.entities(spark, d)).select("doc_id", "ord", F.col("place").cast("long").alias("place"))


@query(f"WITH {X.ENTITIES_SQL} SELECT doc_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, ord) AS n FROM entities) WHERE n <= 20")
def topk_cap(spark: SparkSession, d: str) -> DataFrame:
    return resolve.capped(X.entities(spark, d), 20).select("doc_id", "ord")


@query(f"WITH {X.MATCHES_SQL}, t AS (SELECT doc_id, 'person 7 and firm  3 and user1@mail.example 23456789' AS said FROM documents) SELECT m.doc_id, m.ord FROM matches m WHERE source = 'regex' UNION ALL SELECT m.doc_id, m.ord FROM matches m JOIN t USING (doc_id) WHERE source <> 'regex' AND (contains(said, lower(trim(value))) OR contains(regexp_replace(said, '\\s+', ' ', 'g'), regexp_replace(lower(trim(value)), '\\s+', ' ', 'g')) OR (length(regexp_replace(value, '[^0-9]', '', 'g')) >= 6 AND contains(regexp_replace(said, '[^0-9]', '', 'g'), regexp_replace(value, '[^0-9]', '', 'g'))))")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    text = docs(spark, d).select("doc_id", F.lit("Person 7 and Firm  3 and user1@mail.example 23456789").alias("text"))
    return resolve.grounded(X.matches(spark, d), text).select("doc_id", "ord")


# --- filters ---


@query(f"WITH {X.ENTITIES_SQL} SELECT doc_id, ord FROM entities WHERE NOT (confidence < CASE pii_type WHEN 'name' THEN 0.2 WHEN 'organization' THEN 0.4 ELSE 0.5 END)")
def postprocess_confidence(spark: SparkSession, d: str) -> DataFrame:
    return postprocess.post_process(X.entities(spark, d)).select("doc_id", "ord")


_NAMES_SQL = "n AS (SELECT c_custkey AS doc_id, CASE c_custkey % 7 WHEN 0 THEN 'patient' WHEN 1 THEN 'john' WHEN 2 THEN 'John Smith' WHEN 3 THEN 'we went to the Market today' WHEN 4 THEN 'john Smith' WHEN 5 THEN 'Summary of things' ELSE 'Agent 1234' END AS value FROM customer)"


@query(f"WITH {_NAMES_SQL} SELECT doc_id, value, CASE value WHEN 'patient' THEN 'stopword' WHEN 'john' THEN 'lower case' WHEN 'we went to the Market today' THEN 'sentence' WHEN 'john Smith' THEN 'no capital' WHEN 'Summary of things' THEN 'heading' WHEN 'Agent 1234' THEN 'noise' END AS reason FROM n")
def postprocess_name_rules(spark: SparkSession, d: str) -> DataFrame:
    value = F.expr("CASE c_custkey % 7 WHEN 0 THEN 'patient' WHEN 1 THEN 'john' WHEN 2 THEN 'John Smith' WHEN 3 THEN 'we went to the Market today' WHEN 4 THEN 'john Smith' WHEN 5 THEN 'Summary of things' ELSE 'Agent 1234' END")
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), value.alias("value"), F.lit("name").alias("pii_type"), F.lit(0.9).alias("confidence"), F.array(F.lit("gliner")).alias("sources"))
    return rows.select("doc_id", "value", postprocess.drop_reason().alias("reason"))


@query("WITH n AS (SELECT o_custkey AS doc_id, o_orderkey AS k, ['Humira', 'adalimumab', 'METFORMIN', 'Aspirin'][o_orderkey % 4 + 1] AS value FROM orders), m AS (SELECT DISTINCT doc_id, CASE lower(value) WHEN 'metformin' THEN 'Metformin' ELSE 'Humira (adalimumab)' END AS drug FROM n WHERE value <> 'Aspirin') SELECT drug, count(*) AS n FROM m GROUP BY drug")
def drug_reclass(spark: SparkSession, d: str) -> DataFrame:
    value = F.element_at(F.array(*map(F.lit, ("Humira", "adalimumab", "METFORMIN", "Aspirin"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), value.alias("value"), F.lit("treatment_history").alias("pii_type"), F.lit(0.8).alias("confidence"), F.array(F.lit("gliner")).alias("sources"), F.lit("Critical").alias("sensitivity"), F.col("o_orderkey").cast("int").alias("ord"), F.lit(0).alias("start"))
    return postprocess.post_process(rows).where("pii_type = 'medication'").groupBy(F.col("canonical_medication").alias("drug")).agg(F.count("*").alias("n"))


# --- analytics ---


@query(f"WITH {X.ENTITIES_SQL} SELECT upper(pii_type) AS pii_type, count(*) AS n FROM entities WHERE pii_type <> 'organization' GROUP BY ALL")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    return analytics.distribution(X.entities(spark, d))


@query(f"""WITH {X.ENTITIES_SQL}, r AS (SELECT doc_id, count(*) AS total_entities, count(DISTINCT pii_type) AS unique_types, CAST(round(sum({_WEIGHT}) / count(*), 4) AS DOUBLE) AS risk_score, count(*) FILTER (WHERE pii_type = 'aadhaar') AS ids FROM entities WHERE pii_type <> 'organization' GROUP BY doc_id)
SELECT doc_id, total_entities, unique_types, risk_score, CASE WHEN ids >= 2 THEN 'HIGH' WHEN ids = 1 THEN 'MEDIUM' WHEN risk_score <= 0.3 THEN 'LOW' WHEN risk_score <= 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level FROM r""")
def risk_score_and_level(spark: SparkSession, d: str) -> DataFrame:
    return analytics.risk(analytics.distribution(X.entities(spark, d), "doc_id"), "doc_id")


@query(f"WITH {X.ENTITIES_SQL}, s AS (SELECT doc_id, pii_type, count(*) AS n, CAST(round(max({_RANK}) * sum(confidence), 6) AS DOUBLE) AS score, min(ord) AS o FROM entities GROUP BY ALL) SELECT doc_id, pii_type, n, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) AS k FROM s) WHERE k = 1")
def primary_type(spark: SparkSession, d: str) -> DataFrame:
    return analytics.primary_type(X.entities(spark, d), "doc_id")


@query(f"WITH {X.ENTITIES_SQL} SELECT doc_id, pii_type, max(confidence) AS confidence FROM entities GROUP BY ALL")
def confidence_by_type(spark: SparkSession, d: str) -> DataFrame:
    return analytics.confidence_by_type(X.entities(spark, d), "doc_id")


@query(f"WITH {X.ENTITIES_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pii_type ORDER BY confidence DESC, ord) AS k FROM entities) SELECT doc_id, CASE pii_type WHEN 'aadhaar' THEN 'aadhaar_number' ELSE pii_type END AS name, value, CAST(round(confidence, 3) AS DOUBLE) AS confidence FROM b WHERE k = 1")
def entity_groups(spark: SparkSession, d: str) -> DataFrame:
    return analytics.groups(X.entities(spark, d))


_HINTED = "CASE ord % 6 WHEN 0 THEN 'passport' WHEN 1 THEN 'diagnosis' WHEN 2 THEN 'upi' WHEN 3 THEN 'blood_group' ELSE pii_type END"


@query(f"WITH {X.ENTITIES_SQL}, t AS (SELECT doc_id, ord, {_HINTED} AS pii_type FROM entities) SELECT doc_id, bool_or(pii_type IN {analytics.HINTS['contains_government_id']}) AS contains_government_id, bool_or(pii_type IN {analytics.HINTS['contains_medical_data']}) AS contains_medical_data, bool_or(pii_type IN {analytics.HINTS['contains_financial_data']}) AS contains_financial_data FROM t GROUP BY doc_id")
def document_hints(spark: SparkSession, d: str) -> DataFrame:
    return analytics.hints(X.entities(spark, d).withColumn("pii_type", F.expr(_HINTED)))


@query("""WITH a AS (SELECT c_nationkey AS doc_id, c_custkey AS ord, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || ' Road 12, Mumbai,' ELSE c_mktsegment || ' road  12, mumbai 40000' || CAST(c_nationkey % 10 AS VARCHAR) || ' Delhi' END AS value FROM customer),
p AS (SELECT doc_id, ord, rtrim(value, ',') AS part, lower(regexp_replace(rtrim(value, ','), '\\s+', ' ', 'g')) AS same FROM a), f AS (SELECT doc_id, same, min(ord) AS o, arg_min(part, ord) AS part FROM p GROUP BY ALL), g AS (SELECT doc_id, string_agg(part, ', ' ORDER BY o) AS "full" FROM f GROUP BY doc_id)
SELECT doc_id, "full", nullif(regexp_extract("full", '\\b(\\d{6})\\b', 1), '') AS postal_code, CASE WHEN contains(lower("full"), 'delhi') THEN 'Delhi' END AS state, CASE WHEN contains(lower("full"), 'delhi') THEN 'Delhi' ELSE 'Mumbai' END AS city FROM g""")
def address_consolidation(spark: SparkSession, d: str) -> DataFrame:
    value = F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat(c_mktsegment, ' Road 12, Mumbai,') ELSE concat(c_mktsegment, ' road  12, mumbai 40000', CAST(c_nationkey % 10 AS STRING), ' Delhi') END")
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("doc_id"), F.lit("address").alias("pii_type"), value.alias("value"), F.col("c_custkey").cast("int").alias("start"), F.col("c_custkey").alias("ord"))
    return analytics.addresses(rows.withColumn("start", F.lit(-1)))


@query(f"""WITH {X.ENTITIES_SQL}, m AS (SELECT doc_id, pii_type, ord, CASE pii_type WHEN 'phone' THEN substr(right(regexp_replace(value, '[^0-9]', '', 'g'), 10), 1, 2) || '******' || right(value, 2) WHEN 'aadhaar' THEN left(value, 4) || ' **** ' || right(value, 4)
WHEN 'email' THEN left(value, 2) || '***@' || split_part(value, '@', 2) ELSE left(value, 2) || '***' END AS masked FROM entities), f AS (SELECT doc_id, pii_type, masked, min(ord) AS o FROM m GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pii_type ORDER BY o) AS n FROM f)
SELECT doc_id, pii_type, string_agg(masked, ' | ' ORDER BY n) AS samples FROM k WHERE n <= 2 GROUP BY ALL""")
def masked_samples(spark: SparkSession, d: str) -> DataFrame:
    return analytics.masked_samples(X.entities(spark, d).withColumn("start", F.lit(0)))


@query("SELECT event_type AS engine, count(*) AS runs, count(*) FILTER (WHERE event_id % 11 = 0) AS failed, CAST(sum(event_id % 5) AS BIGINT) AS matches, CAST(round(sum(value), 3) AS DOUBLE) AS total_ms FROM events GROUP BY ALL")
def engine_telemetry(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return analytics.telemetry(e.selectExpr("event_type AS engine", "event_id % 5 AS n_matches", "value AS duration_ms", "CASE WHEN event_id % 11 = 0 THEN 'failed' END AS error"))


# --- validation ---


@query(f"""WITH {X.ENTITIES_SQL} SELECT a.doc_id, a.pii_type || '+' || b.pii_type AS pii_type, least(a."start", b."start") AS "start", greatest(a."end", b."end") AS "end" FROM entities a JOIN entities b ON a.doc_id = b.doc_id AND a.pii_type <> b.pii_type AND a."end" > b."start" AND b."end" > a."start" AND a.ord < b.ord""")
def overlap_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return validate.overlaps(X.entities(spark, d)).select("doc_id", "pii_type", "start", "end")


@query(f"WITH {X.ENTITIES_SQL} SELECT doc_id, 'FP_AADHAAR_DIGIT_COUNT' AS code, value FROM (SELECT doc_id, pii_type, left(value, length(value) - ord % 2) AS value FROM entities) WHERE pii_type = 'aadhaar' AND length(regexp_replace(value, '[^0-9]', '', 'g')) <> 12")
def format_checks(spark: SparkSession, d: str) -> DataFrame:
    e = X.entities(spark, d).where("pii_type = 'aadhaar'").withColumn("value", F.left("value", F.length("value") - F.col("ord") % 2))
    return validate.false_positives(e).select("doc_id", "code", "value")


@query("""WITH plain AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g') AS text FROM documents), p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')) AS m FROM plain),
first AS (SELECT DISTINCT doc_id, m FROM p WHERE doc_id % 2 = 0) SELECT p.doc_id, p.m AS value FROM p WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.doc_id = p.doc_id AND (contains(lower(f.m), lower(p.m)) OR contains(lower(p.m), lower(f.m))))""")
def missed_entities(spark: SparkSession, d: str) -> DataFrame:
    """What the second look finds where the first one left out the documents of odd ids: their e-mail addresses."""
    rows = docs(spark, d)
    first = scan.scan(rows, types=["email"]).where("doc_id % 2 = 0")
    return validate.missed(first, rows).where("pii_type = 'email'").select("doc_id", "value")


@query(f"WITH {X.ENTITIES_SQL}, s AS (SELECT doc_id, value FROM entities WHERE pii_type <> 'organization'), r AS (SELECT DISTINCT doc_id, lower(value) AS v FROM entities WHERE ord % 2 = 0) SELECT s.doc_id, CAST(round(count(r.v) / count(*)::DOUBLE, 6) AS DOUBLE) AS coverage FROM s LEFT JOIN r ON s.doc_id = r.doc_id AND lower(s.value) = r.v GROUP BY s.doc_id")
def redaction_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = X.entities(spark, d)
    return validate.coverage(e, e.where("ord % 2 = 0")).select("doc_id", F.round("coverage", 6).alias("coverage"))


@query(f"""WITH {X.ENTITIES_SQL}, e AS (SELECT DISTINCT doc_id, pii_type, lower(value) AS v FROM entities WHERE ord % 3 > 0), g AS (SELECT DISTINCT doc_id, pii_type, lower(value) AS v FROM entities WHERE ord % 5 > 0),
n AS (SELECT doc_id, count(*) FILTER (WHERE e.v IS NOT NULL AND g.v IS NOT NULL) AS tp, count(*) FILTER (WHERE g.v IS NULL) AS fp, count(*) FILTER (WHERE e.v IS NULL) AS fn FROM e FULL OUTER JOIN g USING (doc_id, pii_type, v) GROUP BY doc_id)
SELECT doc_id, tp, fp, fn, CAST(round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 4) AS DOUBLE) AS "precision", CAST(round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 4) AS DOUBLE) AS recall FROM n""".replace("e.v IS NOT NULL AND g.v IS NOT NULL", "e.x = 1 AND g.x = 1").replace("g.v IS NULL", "g.x IS NULL").replace("e.v IS NULL", "e.x IS NULL").replace("lower(value) AS v FROM", "lower(value) AS v, 1 AS x FROM"))
def ground_truth_scores(spark: SparkSession, d: str) -> DataFrame:
    e = X.entities(spark, d)
    return validate.scores(e.where("ord % 3 > 0"), e.where("ord % 5 > 0"), "doc_id").drop("f1")


@query(f"WITH {X.ENTITIES_SQL} SELECT doc_id, count(*) AS n_entities, count(*) FILTER (WHERE pii_type = 'aadhaar' AND length(regexp_replace(value, '[^0-9]', '', 'g')) <> 12) AS n_warnings, true AS passed FROM entities GROUP BY doc_id")
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    e = X.entities(spark, d)
    return validate.report(e, validate.false_positives(e)).drop("n_infos")


# --- redaction ---


@query(f"WITH {X.ENTITIES_SQL} SELECT DISTINCT value, CASE pii_type WHEN 'phone' THEN repeat('X', length(regexp_replace(value, '[^0-9]', '', 'g')) - 4) || right(value, 4) WHEN 'aadhaar' THEN repeat('X', 8) || right(value, 4) ELSE repeat('X', length(value)) END AS replacement FROM entities")
def replacement_full(spark: SparkSession, d: str) -> DataFrame:
    return X.entities(spark, d).select("value", redact.replacement(F.col("value"), F.col("pii_type"), "full").alias("replacement")).distinct()


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]+(\\.[A-Za-z0-9\\-]+)*\\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS redacted FROM documents")
def redact_by_span(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", "text")
    return redact.redact_by_span(rows, scan.scan(rows, types=["email"])).select("doc_id", "redacted")


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]+(\\.[A-Za-z0-9\\-]+)*\\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS redacted FROM documents")
def redact_texts(spark: SparkSession, d: str) -> DataFrame:
    """The same in one pass."""
    return redact.redact_texts(docs(spark, d), ("email",)).select("doc_id", "redacted")


@query("SELECT o_orderkey AS doc_id, replace(replace('Order ' || o_orderpriority || ' by 98765 for ' || CAST(o_custkey AS VARCHAR) || ' and 98765', o_orderpriority, '[NOTE]'), '98765', 'X8765') AS redacted FROM orders")
def redact_by_value(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Order "), "o_orderpriority", F.lit(" by 98765 for "), F.col("o_custkey").cast("string"), F.lit(" and 98765")).alias("text"))
    mapped = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.struct(F.col("o_orderpriority").alias("value"), F.lit("[NOTE]").alias("replacement")), F.struct(F.lit("98765").alias("value"), F.lit("X8765").alias("replacement")))).alias("x")).select("doc_id", "x.value", "x.replacement")
    return redact.redact_by_value(rows, mapped).select("doc_id", "redacted")


@query("""WITH plain AS (SELECT doc_id, text FROM documents), p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]+(?:\\.[A-Za-z0-9\\-]+)*\\.[A-Za-z]{2,}')) AS value FROM plain)
SELECT doc_id, value, count(*) AS n FROM p WHERE doc_id % 3 = 0 GROUP BY ALL""")
def redaction_verified(spark: SparkSession, d: str) -> DataFrame:
    """Values of e-mail addresses that can still be read after a redaction that left out every third document."""
    rows = docs(spark, d).select("doc_id", "text")
    e = scan.scan(rows, types=["email"])
    left = redact.verify(redact.redact_by_span(rows, e.where("doc_id % 3 > 0")), e)
    return left.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


# --- text, scripts, content ---


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '([ \\t]{2})[ \\t]+', '\\1', 'g'), '(\\n{3})\\n+', '\\1', 'g') AS text FROM documents")
def normalise_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.normalise(F.col("text")).alias("text"))


_SCRIPT_SQL = "CASE WHEN letter = '' THEN NULL " + " ".join(f"WHEN regexp_matches(letter, '[\\x{{{lo:X}}}-\\x{{{hi:X}}}]') THEN '{name}'" for name, lo, hi, _ in scripts.SCRIPTS) + " ELSE 'latin' END"
_LANG_SQL = "CASE dominant_script " + " ".join(f"WHEN '{name}' THEN '{lang}'" for name, _, _, lang in scripts.SCRIPTS) + " ELSE 'en' END"


@query(f"""WITH {X.SPOKEN_SQL}, w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS word, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) AS nr FROM spoken), l AS (SELECT doc_id, nr, regexp_extract(word, '\\p{{L}}') AS letter FROM w), k AS (SELECT doc_id, nr, {_SCRIPT_SQL} AS script FROM l WHERE letter <> ''),
c AS (SELECT doc_id, script, count(*) AS n, min(nr) AS nr FROM k GROUP BY doc_id, script), t AS (SELECT doc_id, arg_max(script, (n, -nr)) AS dominant_script, max(n) / sum(n)::DOUBLE AS share, count(*) AS n_scripts, bool_or(script IN {scripts.INDIC}) AS has_indic, bool_or(script IN {scripts.ARABIC}) AS has_arabic, bool_or(script IN {scripts.CJK}) AS has_cjk FROM c GROUP BY doc_id)
SELECT doc_id, dominant_script, CAST(round(1 - share, 3) AS DOUBLE) AS mixed_ratio, CAST(n_scripts AS INT) AS n_scripts, has_indic, has_arabic, has_cjk, {_LANG_SQL} AS primary_lang, dominant_script = 'latin' AND CAST(round(1 - share, 3) AS DOUBLE) < 0.15 AS is_english FROM t""")
def script_profile(spark: SparkSession, d: str) -> DataFrame:
    """Of all documents, each with some words of another script put before it, as many as its id says."""
    rows = X.spoken(spark, d).withColumn("p", scripts.profile(F.col("text"))).withColumn("l", scripts.languages(F.col("p")))
    return rows.where("p.n_scripts > 0").select("doc_id", "p.dominant_script", "p.mixed_ratio", "p.n_scripts", "p.has_indic", "p.has_arabic", "p.has_cjk", "l.primary_lang", "l.is_english")


@query("SELECT CASE WHEN len(regexp_extract_all(text, '\\S+')) = 0 THEN 'none' WHEN len(regexp_extract_all(text, '\\S+')) < 6 THEN 'patterns' ELSE 'latin' END AS engine, count(*) AS n FROM documents GROUP BY ALL")
def engine_route(spark: SparkSession, d: str) -> DataFrame:
    return detect.routed(docs(spark, d)).groupBy("engine").agg(F.count("*").alias("n"))


_BLOCKS_SQL = "p AS (SELECT doc_id, unnest(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n{2,}')) AS t FROM documents), b AS (SELECT doc_id, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM p)"


@query(f"WITH {_BLOCKS_SQL} SELECT doc_id, CASE WHEN length(t) < 80 AND (upper(t) = t AND lower(t) <> t OR t LIKE '%:') THEN 'heading' WHEN length(t) - length(replace(t, '|', '')) >= 2 THEN 'table' ELSE 'paragraph' END AS block_type, count(*) AS n FROM b WHERE t <> '' GROUP BY ALL")
def paragraph_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return content.paragraph_blocks(rows).groupBy("doc_id", "block_type").agg(F.count("*").alias("n"))


@query(f"WITH {_BLOCKS_SQL} SELECT doc_id, count(*) AS n_blocks, CAST(sum(length(t)) + 2 * (count(*) - 1) AS BIGINT) AS chars FROM b WHERE t <> '' GROUP BY doc_id")
def assembled_text(spark: SparkSession, d: str) -> DataFrame:
    rows = docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return content.assembled(content.paragraph_blocks(rows)).select("doc_id", "n_blocks", F.length("full_text").cast("long").alias("chars"))


@query("SELECT c_custkey AS doc_id, 'c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment AS text FROM customer")
def row_serialise(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/customer.parquet").withColumn("empty", F.lit(" "))
    return content.row_blocks(rows, "c_custkey", ["c_name", "empty", "c_mktsegment"]).select("doc_id", "text")


@query("SELECT 'mail' AS field, 'email' AS primary_type, count(*) AS n FROM customer UNION ALL SELECT 'host', 'ip_address', count(*) FROM customer")
def column_scan(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@mail.example")).alias("mail"), F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 255).cast("string")).alias("host"), "c_mktsegment")
    found = scan.field_scan(c, "c_custkey", types=["email", "ip_address"])
    return analytics.column_rollup(found.withColumn("doc_id", F.col("c_custkey"))).select("field", "primary_type", "n")


_NAMES = "CASE page_id % 8 WHEN 0 THEN '/a/scan.PDF' WHEN 1 THEN '/a/rows.csv' WHEN 2 THEN '/a/patient_letter.docx' WHEN 3 THEN '/a/photo.jpeg' WHEN 4 THEN '/a/.hidden.pdf' WHEN 5 THEN '/a/deck.pptx' WHEN 6 THEN '/__MACOSX/x.csv' ELSE url END"


@query(f"""WITH f AS (SELECT page_id, {_NAMES} AS path, length(html) * (CASE WHEN page_id % 16 = 1 THEN 100000000 ELSE 1 END) AS size FROM pages), e AS (SELECT *, lower(regexp_extract(path, '[.][^./]+$')) AS extension FROM f),
k AS (SELECT *, page_id % 8 IN (1, 6) AS is_structured, page_id % 8 = 3 AS needs_ocr, page_id % 8 = 2 OR regexp_matches(lower(regexp_extract(path, '[^/]*$')), '\\b(patient|hospital|clinic|medical|health|doctor|glucose)\\b') AND page_id % 8 <> 2 AS medical FROM e)
SELECT page_id, extension, CASE WHEN extension = '.pdf' THEN 'page' WHEN extension = '.csv' THEN 'row' WHEN extension = '.docx' THEN 'paragraph' ELSE 'full' END AS chunking, is_structured, needs_ocr,
CASE WHEN page_id % 8 IN (4, 6) THEN 'hidden file' WHEN size > 104857600 THEN 'too large' WHEN extension IN ('.pdf', '.csv', '.docx', '.jpeg') THEN NULL ELSE 'No parser available' END AS error FROM k""")
def ingestion_plan(spark: SparkSession, d: str) -> DataFrame:
    """Pages under names of files of all kinds, every sixteenth far too large."""
    files = spark.read.parquet(f"{d}/pages.parquet").selectExpr("page_id", f"{_NAMES} AS path", "'' AS snippet", "length(html) * CASE WHEN page_id % 16 = 1 THEN 100000000L ELSE 1L END AS size")
    return ingestion.plan(files).select("page_id", "extension", "chunking", "is_structured", "needs_ocr", "error")


@query()
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks for models, whose ends depend on the text before them."""
    return content.chunks(docs(spark, d)).select("doc_id", "chunk_id", "start", F.length("text").alias("n"))


_DUMPED = "'CREATE TABLE t' || c_custkey || ' (id int, price decimal(3, 1), PRIMARY KEY (id))'"


@query(f"""SELECT '/x/' || c_custkey || '.sql' AS path, 'full_sql' AS part, ' ' || chr(10) || {_DUMPED} || ';' AS content, CAST(NULL AS VARCHAR) AS error FROM customer
UNION ALL SELECT '/x/' || c_custkey || '.sql', 'table:t' || c_custkey || ':id,price', {_DUMPED}, NULL FROM customer""")
def sql_dump_items(spark: SparkSession, d: str) -> DataFrame:
    """Tables and columns of SQL definitions made from customers."""
    # the table may be one row group, which would be one task for all the parsing
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey").repartition("c_custkey")
    dump = F.concat(F.lit("-- a table\nCREATE TABLE t"), F.col("c_custkey").cast("string"), F.lit(" (id int, price decimal(3, 1), PRIMARY KEY (id));"))
    return readers.documents(c.select(F.concat(F.lit("/x/"), F.col("c_custkey").cast("string"), F.lit(".sql")).alias("path"), F.encode(dump, "UTF-8").alias("content")))


@query(f"WITH {X.ENTITIES_SQL} SELECT pii_type, count(*) AS rows, CAST(sum(n) AS BIGINT) AS matches FROM (SELECT doc_id, pii_type, count(*) AS n FROM entities GROUP BY ALL) GROUP BY pii_type")
def persisted_anomalies(spark: SparkSession, d: str) -> DataFrame:
    e = X.entities(spark, d)
    scans = e.select("doc_id").distinct().withColumn("name", F.lit("scan")).withColumn("connector_id", F.lit("local"))
    tables = sinks.scan_tables(e, scans)
    return tables["scan_anomalies"].groupBy("pii_type").agg(F.count("*").alias("rows"), F.sum("match_count").alias("matches"))


@query()
def json_responses(spark: SparkSession, d: str) -> DataFrame:
    return sinks.responses(X.entities(spark, d))


@query("SELECT count(*) AS types, CAST(sum(CASE WHEN p THEN 1 ELSE 0 END) AS BIGINT) AS with_pattern, CAST(sum(r) AS BIGINT) AS ranks FROM (VALUES " + ", ".join(f"({str(bool(t.pattern)).lower()}, {t.rank})" for t in registry.TYPES) + ") v(p, r)")
def type_registry(spark: SparkSession, d: str) -> DataFrame:
    return registry.pii_types(spark).agg(F.count("*").alias("types"), F.count_if("has_pattern").alias("with_pattern"), F.sum("rank").alias("ranks"))


@query(f"WITH {X.ENTITIES_SQL} SELECT doc_id, CASE pii_type WHEN 'name' THEN 'PERSON' WHEN 'organization' THEN 'ORG' ELSE upper(pii_type) END AS pii_type, count(*) AS n FROM entities GROUP BY ALL")
def report_types(spark: SparkSession, d: str) -> DataFrame:
    return analytics.masked_report(X.entities(spark, d).withColumn("start", F.lit(0))).select("doc_id", "pii_type", "n")


@query("SELECT c_custkey, c_name, 'write to [EMAIL]' AS note FROM customer")
def redact_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", F.concat(F.lit("write to u"), F.col("c_custkey").cast("string"), F.lit("@mail.example")).alias("note"))
    return redact.redact_cells(rows, "c_custkey", ("note",), ("email",))


_MAIL = "[A-Za-z0-9._%+\\-]+\\x{200B}@\\x{200B}[A-Za-z0-9\\-]+(?:[.][A-Za-z0-9\\-]+)*[.][A-Za-z]{2,}"


@query(f"WITH z AS (SELECT doc_id, replace(text, '@', chr(8203) || '@' || chr(8203)) AS text FROM documents) SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS said FROM z")
def original_spans(spark: SparkSession, d: str) -> DataFrame:
    """What stands in the texts as given where their normal forms have e-mail addresses; the texts have zero-width spaces."""
    rows = docs(spark, d).select("doc_id", F.replace("text", F.lit("@"), F.lit("\u200b@\u200b")).alias("text"))
    found = scan.original_scan(rows, types=["email"]).select("doc_id", "start", "end")
    return found.join(rows, "doc_id").select("doc_id", T.address(F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))).alias("said"))


@query(f"WITH {X.ENTITIES_SQL}, v AS (SELECT DISTINCT value, pii_type, regexp_replace(value, '[^0-9]', '', 'g') AS number FROM entities), r AS (SELECT *, CASE WHEN length(number) > 4 THEN repeat('X', length(number) - 4) || right(number, 4) ELSE repeat('X', length(value)) END AS partial, "
    "CASE pii_type WHEN 'name' THEN '[PERSON_NAME]' WHEN 'phone' THEN '[PHONE_NUMBER]' WHEN 'aadhaar' THEN '[AADHAAR_NUMBER]' WHEN 'email' THEN '[EMAIL]' ELSE '[ORGANIZATION]' END AS contextual FROM v) "
    "SELECT value, pii_type, partial, contextual, CASE WHEN pii_type IN ('phone', 'aadhaar') THEN partial ELSE contextual END AS mask FROM r")
def replacement_modes(spark: SparkSession, d: str) -> DataFrame:
    rows = X.entities(spark, d).select("value", "pii_type").distinct()
    return rows.select("value", "pii_type", *[redact.replacement(F.col("value"), F.col("pii_type"), m).alias(m) for m in ("partial", "contextual", "mask")])


_MASKED = """CASE c_custkey % 8 WHEN 0 THEN 'pan' WHEN 1 THEN 'aadhaar' WHEN 2 THEN 'email' WHEN 3 THEN 'phone' WHEN 4 THEN 'credit_card' WHEN 5 THEN 'voter_id' WHEN 6 THEN 'dob' ELSE 'city' END AS pii_type,
CASE c_custkey % 8 WHEN 0 THEN 'ABCDE' || N4 || 'F' WHEN 1 THEN N4 || ' 5678 ' || N4 WHEN 2 THEN 'user' || N4 || '@mail.example' WHEN 3 THEN '+91 98765 4' || N4 WHEN 4 THEN '4111-1111 1111 ' || N4 WHEN 5 THEN 'ABC123' || N4 WHEN 6 THEN '01/02/' || N4 ELSE 'Town ' || N4 END AS value"""
_MASKED = _MASKED.replace("N4", "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')")


@query(f"WITH v AS (SELECT {_MASKED.replace('STRING', 'VARCHAR')}, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS n FROM customer) SELECT pii_type, value, CASE pii_type WHEN 'pan' THEN 'ABCDE****F' WHEN 'aadhaar' THEN n || ' **** ' || n WHEN 'email' THEN 'us***@mail.example' WHEN 'phone' THEN '98******' || right(n, 2) WHEN 'credit_card' THEN '4111 **** **** ' || n WHEN 'voter_id' THEN 'ABC****' || right(n, 3) WHEN 'dob' THEN '**/**/' || n ELSE 'To***' END AS masked FROM v")
def mask_values(spark: SparkSession, d: str) -> DataFrame:
    """All rules of masking, over values made from customers."""
    rows = spark.read.parquet(f"{d}/customer.parquet").selectExpr(*_MASKED.split(",\n"))
    return rows.select("pii_type", "value", T.mask(F.col("pii_type"), F.col("value")).alias("masked"))


@query(f"""WITH {X.ENTITIES_SQL}, n AS (SELECT doc_id, count(*) AS n_entities, count(DISTINCT value) AS n_redactions, count(DISTINCT pii_type) AS n_groups, max(confidence) AS best, arg_min(value, ord) AS first_value FROM entities GROUP BY doc_id)
SELECT doc_id, coalesce(n_entities, 0) AS n_entities, coalesce(n_redactions, 0) AS n_redactions, coalesce(n_groups, 0) AS n_groups, first_value, coalesce(length(text), 0) AS char_count FROM documents LEFT JOIN n USING (doc_id)""")
def full_responses(spark: SparkSession, d: str) -> DataFrame:
    """Counts and places of the whole JSON answers of all documents, read back from the JSON."""
    said = sinks.full_responses(X.entities(spark, d), docs(spark, d)).withColumn("x", F.from_json("response", "entities array<struct<value: string>>, entity_groups map<string, struct<value: string>>, redactions struct<count: long>, ocr struct<quality: struct<char_count: long>>"))
    return said.select("doc_id", F.size("x.entities").cast("long").alias("n_entities"), F.col("x.redactions.count").alias("n_redactions"), F.size("x.entity_groups").cast("long").alias("n_groups"), F.get("x.entities", F.lit(0))["value"].alias("first_value"), F.col("x.ocr.quality.char_count").alias("char_count"))


@query("""WITH a AS (SELECT c_custkey AS doc_id, 'user' || c_custkey || '@mail.example' AS value, c_custkey % 3 AS k FROM customer)
SELECT doc_id, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS n_answers, CASE k WHEN 1 THEN 1 ELSE 0 END AS hallucinations, CASE k WHEN 1 THEN 1 ELSE 0 END AS format_errors, CASE k WHEN 2 THEN 1 ELSE 0 END AS missing FROM a""")
def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """A model that gives an address right, or with a malformed number that the text doesn't hold, or not at all."""
    rows = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS doc_id", "concat('write to user', c_custkey, '@mail.example') AS text")
    right = rows.where("doc_id % 3 < 2").selectExpr("doc_id", "'email' AS pii_type", "concat('User', doc_id, '@mail.example') AS value")
    wrong = rows.where("doc_id % 3 = 1").selectExpr("doc_id", "'phone' AS pii_type", "'98765' AS value")
    return validate.answer_scores(right.unionByName(wrong), scan.scan(rows, types=["email"]), rows)


@query("SELECT c_custkey, 'csv' AS format, 'name,mail' || chr(10) || c_name || ',[EMAIL]' || chr(10) AS said, CAST(NULL AS VARCHAR) AS error FROM customer")
def redacted_files(spark: SparkSession, d: str) -> DataFrame:
    """CSV files made of customers, redacted as files and read back from what is given out."""
    text = F.concat(F.lit("name,mail\n"), "c_name", F.lit(",user"), F.col("c_custkey").cast("string"), F.lit("@mail.example\n"))
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name").repartition("c_custkey")
    given = c.select(F.concat(F.lit("/x/"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    done = file_redaction.redacted_files(given, ("email",))
    return done.select(F.regexp_extract("path", "([0-9]+)[.]csv", 1).cast("long").alias("c_custkey"), "format", F.decode(F.unbase64("data_base64"), "UTF-8").alias("said"), "error")
