"""Fixed briefing windows over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aeroflow.operators.briefings import briefing_window


def closed_window_counts(events: DataFrame, stamp: str = "ts", kind: str = "event_type", value: str = "value", late: str = "8 hours") -> DataFrame:
    """Counts and sums by window and kind, told once, when the watermark has passed the window."""
    rows = events.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)
    counted = rows.groupBy(briefing_window(F.col(stamp)).alias("window"), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n", "total")
