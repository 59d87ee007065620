"""From raw documents to packed training sequences.

STAGES are (name, function) in order; a function takes (spark, docs, sf_dir), docs being what the stage before it wrote,
and returns a DataFrame. All but the last return the columns of documents. run() applies them to documents, each stage's
rows written to the shared folder and read back, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import line_dedup, mixing, packing, quality, similarity
from veilframe.llm.common import documents, own_columns, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A token sequence comes from a tokenizer file and integers of the plan, which SQL can't express.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose score for quality is below 0.5."""
    model = quality.train(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality(docs, model, COLUMNS).where("score >= 0.5").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur stay in their first document only."""
    out = line_dedup.line_dedup(docs, keep=("lang", "source")).select("doc_id", F.col("kept_text").alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 0.8 or more."""
    return similarity.one_of_each(own_columns(docs, *COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of the last one of a source the half decides."""
    return mixing.repeated(docs, COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = (
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
