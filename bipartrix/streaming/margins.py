"""Edges and margins kept up to date from a stream, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_edges(events: DataFrame, row: str, col: str) -> DataFrame:
    """(row_id, col_id, w): counts of pairs so far; for output modes update and complete."""
    return events.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).cast("string").alias("row_id"), F.col(col).cast("string").alias("col_id")).agg(F.count(F.lit(1)).cast("double").alias("w"))


def windowed_margin(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """(window_start, id, n): counts by tumbling window; events later than ``late`` are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), F.col(key).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("window_start"), "id", "n")
