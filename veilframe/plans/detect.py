"""The fixed plan of the engine: text to entities, and what is made of them."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import models, offsets, scripts
from ..functions import text as T
from ..functions.sqltext import to_sql
from ..operators import analytics, content, postprocess, redact, resolve, scan

Engine = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
ENGINES: dict[str, Engine] = {}
#: Types that the SQL function redact_text replaces: those whose form alone tells them.
SQL_REDACTED = ("email", "credit_card", "ip_address", "aadhaar", "pan", "iban", "ssn", "phone", "passport", "voter_id", "driving_license", "upi", "ifsc")
NER = "doc_id long, label string, text string, score double, start int, end int"


def register_engine(name: str, engine: Engine) -> None:
    """Adds a model: an iterator over Arrow batches (doc_id, chunk_id, start, text) to batches of NER. It is called once
    for each task, so a model loads once."""
    ENGINES[name] = engine


def normalised(docs: DataFrame, text: str = "text", ocr: bool = False) -> DataFrame:
    x = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(text, T.normalise(T.clean_ocr(x) if ocr else x))


def routed(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with profile (scripts) and engine (which model runs beside the patterns)."""
    out = docs.withColumn("profile", scripts.profile(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumn("engine", scripts.engine(F.coalesce(F.col(text), F.lit("")), F.col("profile")))


def guarded(engine: Engine, kind: pa.DataType) -> Engine:
    """The engine with one more column, error. Where it raises, the documents of the batch that it had in hand are rows with
    the error, and it is started again with what follows."""
    empty = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
    names = ["doc_id", "label", "text", "score", "start", "end", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held = iter(batches), []

        def fed() -> Iterator[pa.RecordBatch]:
            for batch in rest:
                held[:] = [batch]
                yield batch

        while True:
            held.clear()
            try:
                for out in engine(fed()):
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.string())], names)
                return
            except Exception as e:  # whatever a model raises becomes its documents' rows
                said = f"{type(e).__name__}: {e}"[:200]
            # what fails before it has taken a batch fails on the next one
            failed = held or list(itertools.islice(rest, 1))
            if not failed:
                return
            ids = pa.array(sorted(set(failed[0].column(0).to_pylist())), kind)
            yield pa.RecordBatch.from_arrays([ids, *(pa.nulls(len(ids), t) for t in empty), pa.array([said] * len(ids))], names)

    return run


def model_rows(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """What a registered engine says of the chunks of docs: NER and error."""
    chunks = content.chunks(docs, text)
    ids = chunks.schema["doc_id"].dataType
    return chunks.mapInArrow(guarded(ENGINES[name], to_arrow_type(ids)), NER.replace("doc_id long", f"doc_id {ids.simpleString()}") + ", error string")


def engine_runs(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """(doc_id, engine, n_matches, error), a row for each document of docs that a registered engine gave an answer or an error to."""
    rows = model_rows(docs, name, text).groupBy("doc_id").agg(F.count("label").alias("n_matches"), F.max("error").alias("error"))
    return rows.select("doc_id", F.lit(name).alias("engine"), "n_matches", "error")


def model_matches(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """matches of a registered engine over chunks of docs, spans put back into the documents, weak hits left out; documents
    that it fails on have none (see engine_runs)."""
    found = model_rows(docs, name, text).where("error is null").drop("error")
    found = found.join(docs.select("doc_id", T.ocr_like(F.coalesce(F.col(text), F.lit(""))).alias("_ocr")), "doc_id")
    rows = found.select("doc_id", models.label_type(F.col("label")).alias("pii_type"), T.stripped(F.col("text")).alias("value"), "start", "end", F.col("score").alias("confidence"), "_ocr").where("value <> ''")
    rows = rows.where(models.accepted(F.col("pii_type"), F.col("value"), F.col("confidence"), F.col("_ocr"), postprocess.STOPWORDS))
    # chunks overlap, so what stands in two of them is found twice
    return rows.groupBy("doc_id", "pii_type", "value", "start", "end").agg(F.max("confidence").alias("confidence")).select("*", F.lit(name).alias("source"), F.lit("").alias("context"), F.lit(1000).alias("ord"))


def asked(docs: DataFrame, engine: str = "qwen_ner", text: str = "text") -> DataFrame:
    """(doc_id, chunk_id, start, text, prompt): what a language model is to be asked; its answers go to models.answered."""
    chunks = content.chunks(docs, text, models.CHUNK_CHARS, models.CHUNK_OVERLAP)
    return chunks.withColumn("prompt", models.prompt(F.col("text"), engine))


def detect(docs: DataFrame, text: str = "text", types: Sequence[str] | None = None, use_nlp: bool = True, engines: dict[str, str] | None = None, most: int | None = None, clean: bool = True, original: bool = False) -> DataFrame:
    """entities of docs (doc_id, text): normal form, patterns, models by script, resolution, precision filters.

    types prunes the patterns before they run. engines: which registered engine serves ``latin`` and ``multilingual``.
    original: the normal form is the whole one, and spans are places in the text as it was given; values and contexts stay
    those of the normal form. It takes one pass of Python over the texts, which the plain way doesn't.
    """
    if original:
        return _original(docs.select("doc_id", F.col(text).alias("text")), types, use_nlp, engines, most)
    docs = normalised(docs.select("doc_id", F.col(text).alias("text"))) if clean else docs.select("doc_id", F.col(text).alias("text"))
    found = scan.scan(docs, types=types, use_nlp=use_nlp)
    if engines:
        by_engine = routed(docs)
        for kind, name in engines.items():
            found = found.unionByName(model_matches(by_engine.where(F.col("engine") == kind).select("doc_id", "text"), name))
        found = resolve.grounded(found, docs)
        found = found.where(F.col("pii_type").isin(*types)) if types else found
    entities = postprocess.post_process(resolve.resolve(found))
    return resolve.capped(entities, most) if most else entities


def _original(docs: DataFrame, types: Sequence[str] | None, use_nlp: bool, engines: dict[str, str] | None, most: int | None) -> DataFrame:
    found = scan.original_scan(docs, types=types, use_nlp=use_nlp)
    if engines:
        texts = offsets.normalised(docs)
        plain = texts.select("doc_id", F.col("normalised").alias("text"))
        by_engine, columns = routed(plain), found.columns
        for kind, name in engines.items():
            rows = resolve.grounded(model_matches(by_engine.where(F.col("engine") == kind).select("doc_id", "text"), name), plain)
            at = offsets.original_span(F.col("start"), F.col("end"), F.col("origin"))
            moved = rows.join(texts.select("doc_id", "origin"), "doc_id").withColumn("_at", at)
            found = found.unionByName(moved.withColumn("start", F.col("_at.start")).withColumn("end", F.col("_at.end")).select(*columns))
        found = found.where(F.col("pii_type").isin(*types)) if types else found
    entities = postprocess.post_process(resolve.resolve(found))
    return resolve.capped(entities, most) if most else entities


def redacted(docs: DataFrame, text: str = "text", mode: str = "contextual", types: Sequence[str] | None = None, original: bool = False) -> DataFrame:
    """(doc_id, redacted, n_spans): the normal form with every match replaced, in one pass over the texts; original: the text
    as it was given, with the same values replaced."""
    if original:
        return redact.redact_originals(docs.select("doc_id", F.col(text).alias("text")), types, mode)
    return redact.redact_texts(normalised(docs.select("doc_id", F.col(text).alias("text"))), types, mode)


def risk_report(docs: DataFrame, by: Sequence[str] = (), text: str = "text", types: Sequence[str] | None = None) -> DataFrame:
    """Risk of documents, or of what they are grouped by: the columns ``by`` of docs."""
    entities = detect(docs, text, types)
    if by:
        entities = entities.join(docs.select("doc_id", *by), "doc_id")
    return analytics.risk(analytics.distribution(entities, *(by or ("doc_id",))), *(by or ("doc_id",)))


def register_sql(spark: SparkSession) -> None:
    """SQL functions mask_pii(type, value), redact_text(text) and the table function detect_pii(text).

    Their bodies are the operators' own expressions: the same rules, within the JVM. They need a classic session.
    """
    t = F.coalesce(F.col("said"), F.lit(""))
    found = scan.found_in(t, F.lower(t), use_nlp=False)
    clean = redact.replaced_in(F.col("said"), redact.merged(redact.proper(t, scan.found_in(t, F.lower(t), SQL_REDACTED, use_nlp=False))))
    head = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{head} mask_pii(kind STRING, given STRING) RETURNS STRING RETURN {to_sql(T.mask(F.col('kind'), F.col('given')))}")
    spark.sql(f"{head} redact_text(said STRING) RETURNS STRING RETURN {to_sql(clean)}")
    spark.sql(
        f"{head} detect_pii(said STRING) RETURNS TABLE(pii_type STRING, value STRING, `start` INT, `end` INT) "
        f"RETURN SELECT x.pii_type, x.value, x.`start`, x.`end` FROM (SELECT explode({to_sql(found)}) AS x)"
    )
