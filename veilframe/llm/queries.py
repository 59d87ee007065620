"""The queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fingerprints, licenses, line_dedup, media, mixing, packing, pii, quality, simhash_dedup
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_line_dedup": lambda spark, d: line_dedup.digest(documents(spark, d)),
    "op2_quality_classifier": lambda spark, d: quality.digest(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op3_simhash_near_dedup": lambda spark, d: simhash_dedup.digest(documents(spark, d)),
    "op4_pii": lambda spark, d: pii.digest(documents(spark, d)),
    "op5_media_columns": lambda spark, d: media.digest(documents(spark, d)),
    "op6_mixing": lambda spark, d: mixing.digest(documents(spark, d)),
    "op7_chat_format": lambda spark, d: chat.digest(spark.read.parquet(f"{d}/conversations.parquet")),
    "op8_license_scan": lambda spark, d: licenses.digest(documents(spark, d)),
    "op9_document_fingerprints": lambda spark, d: fingerprints.digest(documents(spark, d)),
    "op10_best_fit_packing": lambda spark, d: packing.pack(documents(spark, d)),
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op4_pii": pii.SQL,
    "op6_mixing": mixing.SQL,
    "op7_chat_format": chat.SQL,
    "op8_license_scan": licenses.SQL,
}
