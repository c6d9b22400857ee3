"""Editing patterns against a walk from shot to shot."""

import random

from pyspark.sql import functions as F

from chronoframe.operators import shots


def walked(items, opens, follows, min_len):
    """From the first shot on: a run is taken as far as it goes, and the search goes on behind it."""
    found, i = [], 0
    while i + 2 < len(items):
        last = i
        if items[i] is not None and items[i + 1] is not None and opens(items[i], items[i + 1]):
            last = i + 1
            while last + 1 < len(items) and items[last + 1] is not None and follows(items, i, last + 1):
                last += 1
        if last > i and last - i + 1 >= min_len:
            found.append((i, last))
            i = last + 1
        else:
            i += 1
    return found


def alternates(items, i, k):
    return items[k] == items[k - 2]


def corpus(spark, make, columns, seed, videos=60):
    rnd = random.Random(seed)
    data = {v: [make(rnd) for _ in range(rnd.choice([0, 1, 2, 3, 4, 9, 25]))] for v in range(videos)}
    rows = [(v, 100 - k, float(k), k + 0.5) for v, items in data.items() for k in range(len(items))]
    facts = [(v, 100 - k, *x) for v, items in data.items() for k, x in enumerate(items) if x is not None]
    return data, spark.createDataFrame(rows, "video_id long, segment_id long, start_s double, end_s double"), spark.createDataFrame(facts, "video_id long, segment_id long, " + columns)


def got(df):
    assert df.columns == ["video_id", "first_shot", "last_shot", "start_s", "end_s"]
    rows = df.collect()
    assert all(r.start_s == r.first_shot and r.end_s == r.last_shot + 0.5 for r in rows)
    return sorted((r.video_id, r.first_shot, r.last_shot) for r in rows)


def test_alternating_patterns(spark):
    for seed, letters in ((1, "AB"), (2, "AABC")):
        make = lambda rnd, letters=letters: None if rnd.random() < 0.05 else (ord(rnd.choice(letters)), rnd.choice(["left", "left", "right"]))
        data, table, facts = corpus(spark, make, "cluster long, side string", seed)
        for min_len in (2, 3, 4):
            for f, opens, only in (
                (lambda n: shots.shot_reverse_shot(facts, table, n), lambda a, b: a != b, lambda x: x[:1]),
                (lambda n: shots.opposition(facts, table, n), lambda a, b: a[0] != b[0] and a[1] != b[1], lambda x: x),
                (lambda n: shots.frameshare(facts, table, n), lambda a, b: a[1] == b[1], lambda x: x),
            ):
                wanted = sorted((v, *r) for v, items in data.items() for r in walked([x and only(x) for x in items], opens, alternates, min_len))
                assert got(f(min_len)) == wanted
    assert wanted


def test_intensification(spark):
    data, table, facts = corpus(spark, lambda rnd: (float(rnd.randrange(5)),) if rnd.random() < 0.95 else (None,), "rank double", 3)
    for min_len in (2, 3, 4):
        wanted = sorted((v, *r) for v, items in data.items() for r in walked([None if x[0] is None else x for x in items], lambda a, b: b < a, lambda xs, i, k: xs[k] <= xs[k - 1], min_len))
        assert got(shots.intensification(facts, table, min_len)) == wanted and wanted


def test_no_python_in_the_plans(spark):
    _, table, facts = corpus(spark, lambda rnd: (1, "left"), "cluster long, side string", 4, 3)
    for out in (shots.shot_reverse_shot(facts, table), shots.opposition(facts, table), shots.frameshare(facts, table), shots.intensification(facts.withColumn("rank", F.lit(1.0)), table)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
