"""Relations that queries and their SQL share: invented texts, and matches and entities made from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Invented texts, one or two for each type of the registry; ids are negative so that they don't meet documents'.
TEXTS = (
    "id 2345 6789 0123.", "bare 123456789012, not 1234567890123", "PAN abcde1234f x and ABCDE-1234-Z", "Passport No: A1234567", "EPIC no LDN2989101 and abc1234567", "MH01 2017 1234567",
    "SSN: 123-45-6789 and ssn 000-12-3456", "ABHA no: 12-3456-7890-1234", "card 4111 1111 1111 1111 or 4111 1111 1111 1112", "account no: 123456789012", "pay me.you@okaxis now",
    "ifsc HDFC0001234", "GB82 WEST 1234 5698 7654 32", "NHS no 943 476 5919", "exp 09/27", "CVV: 123", "annual income: $12,000 per annum", "CIBIL score: 750", "username: jo_doe", "password: hunter22",
    "S/O Ram Kumar\n", "DOB: 01/02/1990", "Gender: Female", "address: 12 Main Street, Town\n\n\n", "allergies: pollen, dust\n", "Age: 42 years", "marital status: single", "prescribed 5 mg/day", "booster dose",
    "type O+ve AB-x", "MRN: AB1234", "policy no: XY-12345", "emp id: E1234", "a@corp.com and b@gmail.com", "holds a PhD and B.Tech", "jo.doe@mail.example.com", "+91 98765 43210 or 9876543210 or phone: 020 7946 0958",
    "pin code: 400001", "weight: 70 kg", "height 180 cm", "lab report", "insurance member no: M-12345", "contact: reception desk", "10.0.0.1 and 999.1.1.1", "",
    "Full Name: John Smith\n1", "Elector's Name: Asha Rao\n",
)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): all documents and the invented texts."""
    own = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(own)


def _literal(text: str) -> str:
    parts = [f"'{p.replace(chr(39), chr(39) * 2)}'" for p in text.split("\n")]
    return " || chr(10) || ".join(parts)


#: The same relation; letters beyond ASCII are written z, which is a word's letter to the SQL engine's patterns too.
CORPUS_SQL = "corpus AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g') AS text FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {_literal(t)})" for i, t in enumerate(TEXTS)) + ") v(doc_id, text)))"

#: Words of other scripts, put before documents' texts.
WORDS = ("नमस्ते ", "வணக்கம் ", "مرحبا ", "你好 ", "Привет ", "שלום ", "안녕 ")
_SPOKEN = "concat(repeat(CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WORDS)) + " ELSE '' END, CAST(doc_id % 5 * doc_id % 400 AS INT)), text)"
SPOKEN_SQL = f"spoken AS (SELECT doc_id, {_SPOKEN} AS text FROM documents WHERE text IS NOT NULL)"


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents after none, some or many words of one of seven scripts."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").selectExpr("doc_id", f"{_SPOKEN} AS text")


# Columns of matches as SQL that both engines read.
_MATCHES = {
    "doc_id": "user_id",
    "pii_type": "CASE event_type WHEN 'view' THEN 'name' WHEN 'click' THEN 'phone' WHEN 'error' THEN 'aadhaar' WHEN 'signup' THEN 'email' ELSE 'organization' END",
    "value": "CASE event_type WHEN 'view' THEN concat('Person ', CAST(event_id % 40 AS STRING)) WHEN 'click' THEN concat(CASE WHEN event_id % 3 = 0 THEN '+91 ' ELSE '' END, CAST(9876500000 + event_id % 23 AS STRING)) "
    "WHEN 'error' THEN concat('2345 6789 ', CAST(1000 + event_id % 50 AS STRING)) WHEN 'signup' THEN concat('User', CAST(event_id % 30 AS STRING), '@Mail.example') ELSE concat('Firm  ', CAST(event_id % 20 AS STRING)) END",
    "start": "CAST(event_id * 7 % 900 AS INT)",
    "end": "CAST(event_id * 7 % 900 + 4 + event_id % 13 AS INT)",
    "confidence": "CASE WHEN event_id % 4 = 0 THEN CAST(0.3 AS DOUBLE) WHEN event_id % 4 = 1 THEN CAST(0.55 AS DOUBLE) WHEN event_id % 4 = 2 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.92 AS DOUBLE) END",
    "source": "CASE event_id % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'gliner' ELSE 'qwen_ner' END",
    "context": "''",
    "ord": "CAST(event_id AS INT)",
}


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of matches with as many rows as there are events: five types, three engines, many shared values and spans."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.selectExpr(*[f"{sql} AS `{name}`" for name, sql in _MATCHES.items()])


MATCHES_SQL = "matches AS (SELECT " + ", ".join(f'{sql.replace("STRING", "VARCHAR")} AS "{name}"' for name, sql in _MATCHES.items()) + " FROM events)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as entities: each on its own, with its type's sensitivity."""
    level = F.when(F.col("pii_type") == "aadhaar", "Very High").when(F.col("pii_type") == "email", "High").when(F.col("pii_type") == "organization", "Low").otherwise("Medium")
    return matches(spark, sf_dir).withColumn("sources", F.array("source")).withColumn("sensitivity", level)


ENTITIES_SQL = MATCHES_SQL + """, entities AS (SELECT *, CASE pii_type WHEN 'aadhaar' THEN 'Very High' WHEN 'email' THEN 'High' WHEN 'organization' THEN 'Low' ELSE 'Medium' END AS sensitivity FROM matches)"""
