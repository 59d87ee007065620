"""Streams: the batch operators over Structured Streaming.

Detection keeps no state, so it is the same plan. Risk is rolled up over windows of event time behind a watermark, and
documents that come again within the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import postprocess, resolve, scan
from ..operators.analytics import OTHER_WEIGHT, RISK_WEIGHTS
from ..plans import detect as plan


def matches(stream: DataFrame, text: str = "text", types: tuple[str, ...] | None = None) -> DataFrame:
    """matches of a stream (doc_id, ts, text, ...) with ts: no state."""
    rows = plan.normalised(stream, text).withColumn("doc_id", F.struct("doc_id", "ts"))
    found = scan.scan(rows, text, types)
    return found.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.ts").alias("ts"), *[c for c in found.columns if c != "doc_id"])


def distinct_documents(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Without documents whose id came before within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id"])


def risk_windows(found: DataFrame, window: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, matches, documents, risk_score, worst): matches (doc_id, ts, pii_type) by windows of event time."""
    weight = postprocess.by_type(F.col("pii_type"), RISK_WEIGHTS, OTHER_WEIGHT)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    rolled = found.withWatermark("ts", late).groupBy(span.alias("w")).agg(
        F.count("*").alias("matches"), F.approx_count_distinct("doc_id").alias("documents"), F.round(F.avg(weight), 4).alias("risk_score"), F.max(resolve.rank(resolve.sensitivity(F.col("pii_type")))).alias("worst")
    )
    return rolled.select("w.start", "w.end", "matches", "documents", "risk_score", "worst")


def resolved_batches(found: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that resolves each batch's matches and hands entities to a sink, which sees a batch id so that it
    can write each batch once."""

    def each(batch: DataFrame, number: int) -> None:
        sink(postprocess.post_process(resolve.resolve(batch.drop("ts"))), number)

    return found.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
