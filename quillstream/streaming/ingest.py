"""Micro-batch ingest: late data by watermark, first arrival of each id, counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrivals(stream: DataFrame, ts: str, key: str, late: str = "3 days") -> DataFrame:
    """The first row of each key within the watermark; state older than it is dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def requests_by_window(stream: DataFrame, ts: str, client: str, width: str = "60 seconds", late: str = "60 seconds") -> DataFrame:
    """Requests of each client in fixed windows, as a rate limiter counts them."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, width), client).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), client, "n")
