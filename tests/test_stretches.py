"""Long series dealt into stretches: the same results as one window over all of it, whatever the sizes."""

import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import scalars, shots, signal
from chronoframe.operators.stretches import numbered, over_rows, stretched, with_halo, with_known

SMALL = {"size": 7, "parts": 5}


@pytest.fixture(scope="module")
def points(spark):
    """One long series with ties, a short one, one row, and rows without a video; rows of nulls."""
    rnd = random.Random(2)
    rows = [(1, "a", float(rnd.randrange(60)), rnd.random()) for _ in range(200)]
    rows += [(1, "b", float(t), rnd.random()) for t in range(5)] + [(2, "a", 3.0, 0.5), (None, "a", 1.0, 0.1), (None, "a", 2.0, 0.2), (3, "a", None, 0.3), (3, "a", 1.0, 0.4)]
    return rows, spark.createDataFrame(rows, "video_id long, series string, time double, y double").repartition(3)


def ordered(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r[2:])
    low = lambda v: (v is not None, v)
    return {k: sorted(g, key=lambda r: (low(r[0]), low(r[1]))) for k, g in groups.items()}


def test_numbers_are_places_in_the_whole_series(points):
    rows, df = points
    for size, parts in ((7, 5), (1, 50), (10_000, 4)):
        got = {}
        for r in numbered(df, ["video_id", "series"], ["time", "y"], size, parts).collect():
            got.setdefault((r.video_id, r.series), {})[r._i] = (r.time, r.y)
            assert r._n == len(ordered(rows)[(r.video_id, r.series)])
        assert {k: [g[i] for i in range(len(g))] for k, g in got.items()} == ordered(rows)


def test_stretches_are_even_and_in_order(spark):
    df = spark.range(10_000).select(F.lit(1).alias("video_id"), (F.col("id") * F.col("id")).cast("double").alias("time"))
    got = stretched(df, ["video_id"], "time", 1000, 20).groupBy("_stretch").agg(F.count("*").alias("n"), F.min("time").alias("a"), F.max("time").alias("b")).orderBy("_stretch").collect()
    assert len(got) == 20 and max(r.n for r in got) < 800
    assert all(x.b < y.a for x, y in zip(got, got[1:], strict=False))


def test_halos_hold_the_neighbours_and_no_more(points):
    rows, df = points
    x = with_halo(numbered(df, ["video_id", "series"], ["time", "y"], **SMALL), 2, 3, 7)
    n = {k: len(g) for k, g in ordered(rows).items()}
    got = {}
    for r in x.collect():
        got.setdefault((r.video_id, r.series, r._chunk), []).append((r._i, r._own))
    for (v, s, c), found in got.items():
        wanted = [(i, 7 * c <= i < 7 * c + 7) for i in range(max(0, 7 * c - 2), min(n[(v, s)], 7 * c + 7 + 3))]
        assert sorted(found) == wanted


def test_windows_over_chunks_are_those_over_the_series(points):
    rows, df = points
    frame = lambda w: {"s": F.sum("y").over(w.rowsBetween(-9, 11)), "next": F.lead("y").over(w)}
    got = {}
    for r in over_rows(df, ["video_id", "series"], ["time", "y"], 9, 11, frame, **SMALL).collect():
        got.setdefault((r.video_id, r.series), []).append((r.time, r.y, r.s, r.next))
    for k, g in ordered(rows).items():
        y = [v for _, v in g]
        wanted = [(t, v, sum(y[max(0, i - 9) : i + 12]), y[i + 1] if i + 1 < len(y) else None) for i, (t, v) in enumerate(g)]
        for a, b in zip(sorted(got[k], key=lambda r: ((r[0] is not None, r[0]), r[1])), wanted, strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2]) and a[3] == b[3]


def test_last_known_values_are_handed_on(spark):
    rnd = random.Random(5)
    for known in (0.02, 0.5):
        rows = [(1, float(t), int(rnd.random() > known)) for t in range(150)] + [(2, 1.0, 1), (3, 1.0, 0), (3, 1.0, 1)]
        df = spark.createDataFrame([(v, t, g, None if g else t) for v, t, g in rows], "video_id long, time double, g int, at double")
        for r in with_known(df, ["video_id"], "time", "g", "at", **SMALL).collect():
            have = [t for v, t, g in rows if v == r.video_id and not g]
            assert r._last == max((t for t in have if t <= r.time), default=None)
            assert r._next == min((t for t in have if t >= r.time), default=None)


def test_operators_do_not_depend_on_the_stretches(spark, points):
    rows, df = points
    df = df.where("video_id is not null and time is not null")
    same = lambda f: (sorted(map(str, f(**SMALL).collect())), sorted(map(str, f().collect())))
    for f in (
        lambda **s: scalars.resample_approx(df, 16, **s),
        lambda **s: shots.row_batches(df.select("video_id", "time", F.xxhash64("y").alias("i")), 4, True, **s).select("video_id", "batch", "size", "time"),
        lambda **s: signal.audio_amplitude(spark.range(150).select(F.lit(1).alias("video_id"), F.col("id").alias("i"), F.sin("id").alias("y"), F.lit(10).alias("sr")), 64, **s),
    ):
        small, whole = same(f)
        assert small == whole and small
    once = df.dropDuplicates(["video_id", "series", "time"]).cache()
    for how in ("mean", "or", "prod"):
        small, whole = ([(r.video_id, r.time, r.y) for r in scalars.aggregate_scalars(once, ["a", "b"], how, **s).orderBy("video_id", "time").collect()] for s in (SMALL, {}))
        assert [r[:2] for r in small] == [r[:2] for r in whole] and np.allclose([r[2] for r in small], [r[2] for r in whole])
    small = {(r.video_id, r.series, r.time): r.y for r in shots.median_filter(once, 5, **SMALL).collect()}
    for (v, s), g in ordered([tuple(r) for r in once.collect()]).items():
        y = [0.0, 0.0, *[b for _, b in g], 0.0, 0.0]
        for i, (t, _) in enumerate(g):
            assert small[(v, s, t)] == statistics.median(y[i : i + 5])
    track = spark.createDataFrame([(1, k % 2, k, random.Random(k).random() - 0.4) for k in range(120)], "video_id long, track_id long, i long, score double")
    a, b = ({(r.track_id, r.is_speaking): (r.ratio, r.mean_score) for r in shots.active_speaker(track, **s).collect()} for s in (SMALL, {}))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_no_window_by_series_alone(spark):
    """Where a series is long, every window of these plans is over a stretch or a chunk."""
    df = spark.createDataFrame([(1, "a", 0.0, 0.5, 0, 0.1, 1)], "video_id long, series string, time double, y double, i long, score double, sr int").withColumn("track_id", F.lit(1))
    for out in (scalars.resample_approx(df, size=0), scalars.aggregate_scalars(df, ["a"], size=0), shots.median_filter(df, size=0.5), shots.active_speaker(df, size=0.5), shots.row_batches(df, 2, True, size=0), signal.audio_amplitude(df, size=0.5)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"Window \[.*?\], \[(.*?)\]", plan)
        assert windows and all("_stretch" in w or "_chunk" in w for w in windows), plan
