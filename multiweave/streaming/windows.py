"""Event-time windows over a stream or a table, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(rows: DataFrame, at: str, late: str | None) -> DataFrame:
    rows = rows.withColumn(at, F.col(at).cast("timestamp"))
    return rows.withWatermark(at, late) if rows.isStreaming and late else rows


def tumbling(rows: DataFrame, *, at: str, size: str, keys: list[str], aggregates: list[Column], late: str | None = "10 minutes") -> DataFrame:
    w = _timed(rows, at, late).groupBy(F.window(at, size), *keys).agg(*aggregates)
    return w.withColumn("window_start", F.col("window.start")).withColumn("window_end", F.col("window.end")).drop("window")


def sliding(rows: DataFrame, *, at: str, size: str, step: str, keys: list[str], aggregates: list[Column], late: str | None = "10 minutes") -> DataFrame:
    w = _timed(rows, at, late).groupBy(F.window(at, size, step), *keys).agg(*aggregates)
    return w.withColumn("window_start", F.col("window.start")).withColumn("window_end", F.col("window.end")).drop("window")


def sessions(rows: DataFrame, *, at: str, gap: str, keys: list[str], aggregates: list[Column], late: str | None = "10 minutes") -> DataFrame:
    w = _timed(rows, at, late).groupBy(F.session_window(at, gap), *keys).agg(*aggregates)
    return w.withColumn("window_start", F.col("session_window.start")).withColumn("window_end", F.col("session_window.end")).drop("session_window")


def distinct(rows: DataFrame, *, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows with keys not seen before within the watermark."""
    timed = _timed(rows, at, late)
    return timed.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else timed.dropDuplicates(keys)
