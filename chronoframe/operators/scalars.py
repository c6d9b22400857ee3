"""Scalar series: clamping, combination, normalisation, decimation, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.operators.stretches import PARTS, SIZE, numbered, with_known

SERIES = ["video_id", "series"]


def scalar_threshold(scalars: DataFrame, min: float | None = None, max: float | None = None) -> DataFrame:
    """y below ``min`` becomes it, y from ``max`` on becomes it; a bound that is None or 0 is no bound."""
    y = F.col("y")
    if min:
        y = F.when(F.col("y") < min, F.lit(float(min))).otherwise(y)
    if max:
        y = F.when(F.col("y") >= max, F.lit(float(max))).otherwise(y)
    return scalars.withColumn("y", y)


def threshold_events(scalars: DataFrame, thr: float) -> DataFrame:
    return scalars.where(F.col("y") >= thr).select("video_id", "series", "time")


def resample_approx(scalars: DataFrame, target: int = 1024, size: int = SIZE, parts: int = PARTS) -> DataFrame:
    """Every 2^k-th sample of a series, so that about ``target`` are left."""
    step = F.pow(F.lit(2), F.greatest(F.ceil(F.log2("_n") - F.log2(F.lit(float(target)))), F.lit(0))).cast("long")
    return numbered(scalars, SERIES, ["time", "y"], size, parts).where(F.col("_i") % step == 0).select(*scalars.columns)


def combine(y: Column, how: str) -> Column:
    """Aggregate of probabilities: product (and), noisy or, or mean."""
    if how in ("prod", "and"):
        return F.product(y)
    if how == "or":
        return 1 - F.product(1 - y)
    return F.avg(y)


def aggregate_scalars(scalars: DataFrame, series: list[str], how: str = "prod", size: int = SIZE, parts: int = PARTS) -> DataFrame:
    """The series of a video combined on the time grid of the longest one (the first in ``series`` among equals).

    Each is interpolated linearly and flat outside its range: the bracketing samples come from windows over the union of
    grid and samples, not from a search; a long series is dealt into stretches, which hand on the last sample known.
    """
    rank = F.element_at(F.create_map(*[x for k, s in enumerate(series) for x in (F.lit(s), F.lit(k))]), F.col("series"))
    s = scalars.where(F.col("series").isin(series)).groupBy("video_id", "series", "time").agg(F.max("y").alias("y")).withColumn("_rank", rank)
    sizes = s.groupBy("video_id", "series", "_rank").agg(F.count("*").alias("_n"))
    longest = sizes.groupBy("video_id").agg(F.max_by("series", F.struct("_n", -F.col("_rank"))).alias("series"))
    grid = s.join(longest, ["video_id", "series"], "left_semi").select("video_id", "time")
    asked = grid.join(sizes.select("video_id", "series"), "video_id").withColumn("_grid", F.lit(1))
    both = asked.unionByName(s.select("video_id", "series", "time", F.lit(0).alias("_grid"), F.struct("time", "y").alias("at")), allowMissingColumns=True)
    long = not sizes.where(F.col("_n") * 2 > size).isEmpty()  # a series' samples and the grid, which is the longest one's
    both = with_known(both, SERIES, "time", "_grid", "at", size, parts, long).where("_grid = 1")
    a, b = F.coalesce("_last", "_next"), F.coalesce("_next", "_last")
    y = F.when(a["time"] == b["time"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col("time") - a["time"]) / (b["time"] - a["time"]))
    return both.withColumn("y", y).groupBy("video_id", "time").agg(combine(F.col("y"), how).alias("y"))


def aggregate_per_time(scalars: DataFrame, how: str = "or") -> DataFrame:
    """Samples of a video at equal times combined."""
    return scalars.groupBy("video_id", "time").agg(combine(F.col("y"), how).alias("y"))


def aggregate_list_per_time(scalars: DataFrame, how: str = "or") -> DataFrame:
    """The same for each series by itself, with its own times."""
    return scalars.groupBy("video_id", "series", "time").agg(combine(F.col("y"), how).alias("y"))


def _bounds(scalars: DataFrame) -> DataFrame:
    b = scalars.groupBy("video_id", "series").agg(F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    return scalars.join(b, ["video_id", "series"])


def min_max_norm(scalars: DataFrame, least_range: float = 0.01) -> DataFrame:
    s, span = _bounds(scalars), F.col("_hi") - F.col("_lo")
    return s.withColumn("y", F.when(span >= least_range, (F.col("y") - F.col("_lo")) / span).otherwise(F.col("y"))).drop("_lo", "_hi")


def invert_scalar(scalars: DataFrame) -> DataFrame:
    """1 - y, after min-max scaling if any y is outside [0, 1]; a flat series outside it gives null."""
    s, span = _bounds(scalars), F.col("_hi") - F.col("_lo")
    scaled = F.when(span > 0, (F.col("y") - F.col("_lo")) / span)
    return s.withColumn("y", 1 - F.when((F.col("_hi") > 1) | (F.col("_lo") < 0), scaled).otherwise(F.col("y"))).drop("_lo", "_hi")


def series_bounds(scalars: DataFrame) -> DataFrame:
    """The axis of a series: its maximum from 0 up, its minimum from -0.1 down."""
    return scalars.groupBy("video_id", "series").agg(F.greatest(F.lit(0.0), F.max("y")).alias("upper"), F.least(F.lit(-0.1), F.min("y")).alias("lower"))


def shot_density(shots: DataFrame, bandwidth: float = 10.0, fps: float = 10.0) -> DataFrame:
    """A Gaussian kernel density of shot starts on an even grid up to the last end, scaled to [0, 1].

    A start reaches nine bandwidths (beyond, the kernel adds less than 1e-17 of its peak), so each start is put on its own stretch of the grid only.
    """
    last = shots.groupBy("video_id").agg(F.max("end_s").alias("_end")).withColumn("_n", F.ceil(F.col("_end") * fps).cast("long") + 1)
    step = F.when(F.col("_n") > 1, F.col("_end") / (F.col("_n") - 1)).otherwise(F.lit(1.0))
    last = last.withColumn("_step", step)
    grid = last.select("video_id", "_step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("i"))
    reach = F.ceil(F.lit(9.0 * bandwidth) / F.col("_step")).cast("long")
    at = F.floor(F.col("start_s") / F.col("_step"))
    near = shots.join(last, "video_id").select("video_id", "start_s", "_step", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), at - reach), F.least(F.col("_n") - 1, at + reach + 1))).alias("i"))
    d = F.col("i") * F.col("_step") - F.col("start_s")
    raw = near.groupBy("video_id", "i").agg(F.sum(F.exp(-d * d / (2 * bandwidth * bandwidth))).alias("d"))
    y = grid.join(raw, ["video_id", "i"], "left").select("video_id", "i", (F.col("i") * F.col("_step")).alias("time"), F.coalesce("d", F.lit(0.0)).alias("d"))
    b = y.groupBy("video_id").agg(F.min("d").alias("_lo"), F.max("d").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return y.join(b, "video_id").select("video_id", "time", F.when(span > 0, (F.col("d") - F.col("_lo")) / span).otherwise(F.lit(0.0)).alias("y"))
