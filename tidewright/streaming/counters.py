"""Profile counters over streams; the cleaners are projections and run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, ts: str, column: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, value, count, missing) for each window, for events that come no later than late."""
    c = F.col(f"`{column}`")
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, window), c.cast("string").alias("value"))
    return rows.agg(F.count("*").alias("count"), F.count_if(c.isNull()).alias("missing")).select(F.col("window.start").alias("start"), "value", "count", "missing")
