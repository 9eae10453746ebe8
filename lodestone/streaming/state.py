"""Counters of streams. threads has what is kept by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.conversation import request_metrics


def metrics_stream(requests: DataFrame) -> DataFrame:
    """The request counters of a stream; for output mode complete."""
    return request_metrics(requests)


def windowed_counts(events: DataFrame, at: str, every: str = "1 hour", late: str = "2 hours", by: str = "event_type") -> DataFrame:
    """Counts of tumbling windows; events later than late are left out. For output modes append and update."""
    return events.withWatermark(at, late).groupBy(F.window(at, every), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
