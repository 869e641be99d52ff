"""Deliveries as a stream: elements arrive late and repeatedly; each is passed on once, and volumes are counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_deliveries(stream: DataFrame, within: str = "30 days") -> DataFrame:
    """Each (doc_id, page, idx) once among deliveries that arrive within the watermark; state older than that is dropped."""
    return stream.withWatermark("ingested_at", within).dropDuplicatesWithinWatermark(["doc_id", "page", "idx"])


def volumes(stream: DataFrame, window: str = "1 day", within: str = "30 days") -> DataFrame:
    """(day, kind, n, characters) of deliveries by event-time window."""
    by = stream.withWatermark("ingested_at", within).groupBy(F.window("ingested_at", window), "kind")
    return by.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("characters")).select(F.col("window.start").alias("day"), "kind", "n", "characters")
