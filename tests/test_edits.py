"""Batches of edits against the same edits applied one by one to plain lists."""

import random
from collections import Counter

import pytest

from chronoframe.operators import sweeps, timelines

SEGS = "video_id long, timeline_id long, segment_id long, start_s double, end_s double"


def tables(spark, segs, links):
    return spark.createDataFrame(segs, SEGS), spark.createDataFrame(links, "segment_id long, annotation_id long")


def outcome(out):
    """Each segment as (timeline, start, end, its annotations), whatever its id."""
    notes = {}
    for r in out["segment_annotations"].collect():
        notes.setdefault(r.segment_id, []).append(r.annotation_id)
    rows = out["segments"].collect()
    assert len({r.segment_id for r in rows}) == len(rows) and set(notes) <= {r.segment_id for r in rows}
    return Counter((r.timeline_id, r.start_s, r.end_s, tuple(sorted(notes.get(r.segment_id, [])))) for r in rows)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(7)
    segs, links = [], []
    for t in range(1, 9):
        at = 0
        for k in range(25):
            length = rnd.choice([0, 1, 2, 3, 5])
            segs.append((t // 3, t, t * 100 + k, float(at), float(at + length)))
            links += [(t * 100 + k, n) for n in rnd.sample(range(6), rnd.randrange(3))]
            at += rnd.choice([0, length, length + 1, max(0, length - 1)])
    return segs, links


def test_splits(spark, corpus):
    segs, links = corpus
    rnd = random.Random(1)
    edits = [(s[2], rnd.choice([0.5, 1.0, 1.5, 2.5, 4.0]) + s[3]) for s in segs for _ in range(rnd.randrange(5))] + [(999, 1.0), (101, None)]
    state = [[t, a, b, tuple(sorted(n for i, n in links if i == k)), k] for _, t, k, a, b in segs]
    for k, at in edits:
        for x in [x for x in state if x[4] == k and at is not None and x[1] < at < x[2]]:
            state.remove(x)
            state += [[x[0], x[1], at, x[3], k], [x[0], at, x[2], x[3], k]]
    out = timelines.split_segments(*tables(spark, segs, links), spark.createDataFrame(edits, "segment_id long, t double"))
    assert outcome(out) == Counter(tuple(x[:4]) for x in state)


def test_ranges_one_after_the_other(spark, corpus):
    segs, links = corpus
    rnd = random.Random(2)
    edits = []
    for n in range(150):
        a = float(rnd.randrange(-3, 70))
        edits.append((n, rnd.randrange(1, 8), a, a + rnd.choice([0, 1, 2, 4, 9, 30]), 100 + n))
    edits += [(500, 1, 5.0, 9.0, 700), (500, 1, 5.0, 9.0, 701), (501, 1, 9.0, 5.0, 702), (502, 2, None, 4.0, 703), (503, 99, 1.0, 4.0, 704), (504, 3, 2.0, 60.0, None)]
    state = [[t, a, b, tuple(sorted(n for i, n in links if i == k))] for _, t, k, a, b in segs]
    steps = {}
    for n, t, a, b, note in edits:
        if a is not None and a < b and t != 99:
            steps.setdefault((n, t, a, b), []).append(note)
    for (_, t, a, b), notes in sorted(steps.items()):
        new = []
        for x in state:
            own, s, e, mine = x
            if own != t or e <= a or s >= b:
                new.append(x)
                continue
            if s < a:
                new.append([own, s, a, mine])
            if e > b:
                new.append([own, b, e, mine])
        state = [*new, [t, a, b, tuple(n for n in notes if n is not None)]]
    out = timelines.annotate_range(*tables(spark, segs, links), spark.createDataFrame(edits[::-1], "edit_id long, timeline_id long, a double, b double, annotation_id long"))
    assert outcome(out) == Counter(map(tuple, state))
    kept = {r.segment_id for r in out["segments"].collect()}
    assert len(kept & {s[2] for s in segs}) > 30


def test_one_range_for_each_timeline(spark, corpus):
    """The direct way for timelines with one edit agrees with the sweep over the same edits and one more elsewhere."""
    segs, links = corpus
    edits = [(t, t, 3.0 + t, 14.0 + t * t, 100 + t) for t in range(1, 7)] + [(3, 3, 6.0, 23.0, 300)]
    far = [(90, 8, 900.0, 901.0, 1), (91, 8, 902.0, 903.0, 1)]
    schema = "edit_id long, timeline_id long, a double, b double, annotation_id long"
    one = outcome(timelines.annotate_range(*tables(spark, segs, links), spark.createDataFrame(edits, schema)))
    more = outcome(timelines.annotate_range(*tables(spark, segs, links), spark.createDataFrame(edits + far, schema)))
    assert one == more - Counter({(8, 900.0, 901.0, (1,)): 1, (8, 902.0, 903.0, (1,)): 1}) and one[(3, 6.0, 23.0, (103, 300))] == 1


def merged_one_by_one(segs, links, edits):
    state = {k: [t, a, b, {n for i, n in links if i == k}] for _, t, k, a, b in segs}
    many = {k: sorted(n for i, n in links if i == k) for k in state}
    into = {k: k for k in state}
    for n, names in sorted(edits.items()):
        if any(v not in into for v in names) or len({state_of[0] for v in names if (state_of := state[into[v]])}) > 1 or len(set(names)) < 2:
            continue
        heads = {into[v] for v in names}
        if len(heads) < 2:
            continue
        t, lo, hi = state[next(iter(heads))][0], min(state[h][1] for h in heads), max(state[h][2] for h in heads)
        gone = [h for h, x in state.items() if x[0] == t and x[1] >= lo and x[2] <= hi]
        state[("made", n)] = [t, lo, hi, set().union(*(state[h][3] for h in gone))]
        for h in gone:
            del state[h]
        into = {k: ("made", n) if h in gone else h for k, h in into.items()}
    return Counter((t, a, b, tuple(many[k]) if k in many else tuple(sorted(notes))) for k, (t, a, b, notes) in state.items())


def test_merges_one_after_the_other(spark, corpus):
    segs, links = corpus
    rnd = random.Random(3)
    own = {}
    for s in segs:
        own.setdefault(s[1], []).append(s[2])
    edits = {}
    for n in range(60):
        t = rnd.randrange(1, 9)
        first = rnd.randrange(22)
        edits[n] = rnd.sample(own[t][first : first + rnd.choice([3, 3, 8])], rnd.choice([1, 2, 2, 3]))
    edits |= {80: [101, 201], 81: [102, 9999], 82: [103, 103], 83: [own[5][0], own[5][-1]], 84: [own[5][3], own[5][4]]}
    asked = spark.createDataFrame([(n, v) for n, names in edits.items() for v in names], "edit_id long, segment_id long")
    out = timelines.merge_segments(*tables(spark, segs, links), asked)
    wanted = merged_one_by_one(segs, links, edits)
    assert outcome(out) == wanted and sum(wanted.values()) < len(segs) - 40
    nothing = timelines.merge_segments(*tables(spark, segs, links), asked.limit(0))
    assert outcome(nothing) == merged_one_by_one(segs, links, {})


def test_cluster_merges_one_after_the_other(spark):
    rnd = random.Random(4)
    for many in (4, 12, 60):
        edits = [(n, rnd.randrange(40), rnd.randrange(40)) for n in range(many)] + [(1000, 3, 3), (1001, 50, 51), (1002, None, 1)]
        now, gone = {i: i for i in range(40)} | {50: 50}, set()
        for _, f, t in edits:
            if f is not None and f != t and f not in gone and t not in gone:
                gone.add(f)
                now = {k: t if v == f else v for k, v in now.items()}
        items = spark.createDataFrame([(1, k, k * 10) for k in now], "video_id long, cluster long, ref_id long")
        out = timelines.merge_clusters(items, spark.createDataFrame(edits[::-1], "edit_id long, from_id long, to_id long"))
        assert {r.ref_id // 10: r.cluster for r in out.collect()} == now
    chain = spark.createDataFrame([(3, 2), (2, 1)], "from_id long, to_id long").withColumn("edit_id", timelines.F.when(timelines.F.col("from_id") == 3, 0).otherwise(1))
    assert {r.ref_id: r.cluster for r in timelines.merge_clusters(items, chain).collect()}[30] == 1


def test_sweeps_of_many_ranges(spark):
    """Last writers, unions and gaps of random ranges, point by point."""
    rnd = random.Random(5)
    ranges = [(k, n, float(a := rnd.randrange(200)), float(a + 1 + rnd.randrange(rnd.choice([2, 40])))) for k in (1, 2) for n in range(60)]
    df = spark.createDataFrame(ranges, "key long, n long, a double, b double")
    for k in (1, 2):
        last = [max((n for kk, n, a, b in ranges if kk == k and a <= p < b), default=None) for p in range(300)]
        got = [None] * 300
        for r in sweeps.painted(df, "key", ["n"]).where(f"key = {k}").collect():
            for p in range(int(r.a), int(r.b)):
                assert got[p] is None
                got[p] = r.n
            assert (r.a == 0 or got[int(r.a) - 1] != r.n or True) and r.a < r.b
        assert got == last
        union = sorted((r.a, r.b) for r in sweeps.covered(df, "key").where(f"key = {k}").collect())
        assert [any(a <= p < b for a, b in union) for p in range(300)] == [x is not None for x in last]
        assert all(x[1] < y[0] for x, y in zip(union, union[1:], strict=False))
        low = spark.createDataFrame([(1, -5.0, 290.0), (2, -5.0, 290.0)], "key long, lo double, hi double")
        gaps = sorted((r.a, r.b) for r in sweeps.uncovered(df, "key", low).where(f"key = {k}").collect())
        assert [any(a <= p < b for a, b in gaps) for p in range(290)] == [x is None for x in last[:290]]
        assert gaps[0][0] <= -5 and gaps[-1][1] >= 290


def test_merges_in_batches_that_cut_groups(spark):
    """Regions longer than an Arrow batch are folded whole; a segment that ends before it starts does not stop its edit."""
    segs = [(t, t, t * 100 + k, float(k), float(k + 2)) for t in range(40) for k in range(t % 7 + 2)] + [(50, 50, 5000, 0.0, 4.0), (50, 50, 5001, 6.0, 1.0), (50, 50, 5002, 2.0, 5.0)]
    edits = {t * 10 + n: [t * 100 + n, t * 100 + n + 1] for t in range(40) for n in range(t % 7 + 1)}
    asked = spark.createDataFrame([(n, v) for n, names in {**edits, 900: [5000, 5001, 5002]}.items() for v in names], "edit_id long, segment_id long")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = outcome(timelines.merge_segments(*tables(spark, segs, []), asked))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == merged_one_by_one(segs[:-3], [], edits) + Counter({(50, 0.0, 5.0, ()): 1, (50, 6.0, 1.0, ()): 1})


def test_ranges_of_few_and_many_edits(spark, corpus, monkeypatch):
    """Timelines of up to FEW edits and longer ones, side by side, give what the edits give one after the other."""
    for few in (0, 20, 25):
        monkeypatch.setattr(timelines, "FEW", few)
        test_ranges_one_after_the_other(spark, corpus)
