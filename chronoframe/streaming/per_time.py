"""Append-friendly operators on streams of samples: an extension, the batch forms are in ``operators``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.operators.scalars import combine


def aggregate_per_time(samples: DataFrame, how: str = "or", delay: str = "10 seconds") -> DataFrame:
    """Samples (``video_id, ts`` timestamp, ``y``) of equal times combined, once no more than ``delay`` late ones can come."""
    return samples.withWatermark("ts", delay).groupBy("video_id", "ts").agg(combine(F.col("y"), how).alias("y"))


def window_mean(samples: DataFrame, length: str, slide: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """The mean of each series over windows of time."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = samples.withWatermark("ts", delay).groupBy("video_id", "series", w.alias("w")).agg(F.avg("y").alias("mean"), F.count("*").alias("n"))
    return out.select("video_id", "series", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "n")
