"""Folds over whole groups against the same work frame by frame and shot by shot; batches are cut inside groups."""

import random
import time

import numpy as np
import pytest

from chronoframe.operators import boxes, signal


@pytest.fixture
def small_batches(spark):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def overlap(a, b):
    w, h = (max(0.0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def test_tracks_of_many_shots(spark, small_batches, monkeypatch):
    monkeypatch.setattr(boxes, "PAIRS", 5)
    rnd = random.Random(1)
    rows = [(v, n, rnd.randrange(100) / 25, *(rnd.randrange(8) / 10 for _ in "xy"), *(0.2 + rnd.randrange(3) / 10 for _ in "wh")) for v in range(1, 5) for n in range(60)]
    shots = spark.createDataFrame([(v, 1, 0.0, 1.5 + v / 2) for v in range(1, 5)], "video_id long, segment_id long, start_s double, end_s double")
    got = boxes.track_faces(spark.createDataFrame(rows, "video_id long, id long, time double, x double, y double, w double, h double"), shots, iou=0.1)
    wanted = set()
    for v in range(1, 5):
        free = sorted((round(t * 25), n, b) for u, n, t, *b in rows if u == v and t < 1.5 + v / 2)
        number = 0
        while free:
            track = [free.pop(0)]
            for x in list(free):
                if 0 < x[0] - track[-1][0] <= 10 and overlap(track[-1][2], x[2]) > 0.1:
                    track.append(x)
                    free.remove(x)
            if len(track) > 1:
                wanted |= {(v, number, f, *map(float, b)) for f, _, b in track}
                number += 1
    found = {tuple(r) for r in got.select("video_id", "track", "frame", "x", "y", "w", "h").collect()}
    rounded = lambda rows: {tuple(round(x, 9) for x in r) for r in rows}
    assert len(wanted) > 100 and rounded(wanted) <= rounded(found)
    ends = {(v, t): [f for u, s, f, *_ in wanted if (u, s) == (v, t)] for v, t, *_ in wanted}
    assert len(found) == sum(max(f) - min(f) + 1 for f in ends.values())


def test_colours_of_many_frames(spark, small_batches):
    rnd = random.Random(2)
    px = [(1, f, *(rnd.randrange(4) * 60 for _ in "rgb")) for f in range(25) for _ in range(rnd.choice([1, 2, 3, 9, 40]))]
    got = signal.dominant_colors(spark.createDataFrame(px, "video_id long, frame_idx long, r int, g int, b int"), 4)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    for f in range(25):
        mine = [p[2:] for p in px if p[1] == f]
        x = np.array(sorted(set(mine), key=lambda p: (sum(p), p)), float)
        n = np.array([mine.count(tuple(p)) for p in x.astype(int).tolist()], float)
        c = x[np.linspace(0, len(x) - 1, min(4, len(x))).round().astype(int)]
        nearest = lambda c: ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)  # noqa: B023, E731
        for _ in range(10):
            own = nearest(c)
            new = np.array([np.average(x[own == j], axis=0, weights=n[own == j]) if (own == j).any() else c[j] for j in range(len(c))])
            if np.allclose(new, c):
                break
            c = new
        c = c[np.argsort(np.bincount(nearest(c), n, len(c)), kind="stable")] / 255
        assert [tuple(r) for r in got.where(f"frame_idx = {f}").orderBy("rank").select("r", "g", "b").collect()] == [tuple(p) for p in c.tolist()]


def test_lines_of_a_large_frame_are_few_steps_each(spark):
    """Words that later ones can't join any more are not looked at again: 20,000 words without neighbours take seconds."""
    words = spark.range(20_000).selectExpr("1L as video_id", "0D as time", "cast(id * 300 as double) as x", "cast(id * 20 as double) as y", "10D as w", "5D as h", "cast(id as string) as text")
    start = time.time()
    got = boxes.merge_lines(words)
    assert got.count() == 20_000 and time.time() - start < 20
