"""Redaction of a stream. Scrubbing is stateless and row-wise, so the batch
operator runs unchanged under ``readStream``; only the category counts keep
state, bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scrub import Scrubber


def scrub_stream(stream: DataFrame, text: str, scrubber: Scrubber | None = None, report: str | None = "redactions") -> DataFrame:
    return (scrubber or Scrubber()).scrub(stream, text, report)


def category_counts(scrubbed: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes", report: str = "redactions") -> DataFrame:
    """Redactions by category and window of event time."""
    rows = scrubbed.withWatermark(time, late).select(F.col(time).alias("at"), F.explode(report).alias("r"))
    return rows.groupBy(F.window("at", window).alias("window"), F.col("r.category").alias("category")).count()
