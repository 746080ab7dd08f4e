"""Streaming adapters: the same column functions on readStream tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], *aggs, slide: str | None = None) -> DataFrame:
    """Aggregates in event-time windows with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *keys).agg(*aggs)


def sessions(stream: DataFrame, ts: str, gap: str, late: str, keys: list[str], *aggs) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(*aggs)
