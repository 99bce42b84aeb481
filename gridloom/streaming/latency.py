"""Stage latencies over a stream of timings (ts, stage, ms): an extension, as structure operators need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(timings: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Count, mean and greatest per stage and window of event time; rows later than ``late`` are dropped."""
    return (
        timings.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "stage")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("most_ms"))
        .select("window.start", "window.end", "stage", "n", "mean_ms", "most_ms")
    )
