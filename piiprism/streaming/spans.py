"""The recognizers on streams: they keep to their row, so a stream of documents needs no state for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import recognize, spans


def redacted(stream: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The stream's rows with personal data replaced; works in append mode."""
    return stream.withColumn("_spans", spans.merge(recognize.all_spans(F.col("text"), names))).withColumn("text", spans.redact(F.col("text"), F.col("_spans"))).drop("_spans")


def counts(stream: DataFrame, time: str, text: str, names: list[str], window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window, entity, n: hits in event-time windows; rows later than the watermark are left out (an extension)."""
    hit = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).select(time, F.explode(recognize.all_spans(F.col(text), names)).alias("s"))
    return hit.groupBy(F.window(time, window).alias("window"), F.col("s.entity").alias("entity")).agg(F.count("*").alias("n"))
