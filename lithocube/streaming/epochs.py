"""New epochs folded into running totals with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_totals(stream: DataFrame, delay: str = "3650 days") -> DataFrame:
    """A stream (station, layer, ts, value) -> totals for each station, layer and month; rows later than `delay` are left out."""
    return stream.withWatermark("ts", delay).groupBy("station", "layer", F.date_trunc("month", "ts").alias("month")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
