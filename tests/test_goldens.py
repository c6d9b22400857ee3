"""Small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from chronoframe import functions as fn
from chronoframe.operators import boxes, clusters, graphs, joins, scalars, shots, signal, timelines, vectors
from chronoframe.sources import io


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def segs(spark, *spans):
    return table(spark, "video_id long, segment_id long, start_s double, end_s double", *[(1, k + 1, float(a), float(b)) for k, (a, b) in enumerate(spans)])


def series(spark, **named):
    return table(spark, "video_id long, series string, time double, y double", *[(1, n, float(t), float(y)) for n, points in named.items() for t, y in points])


def rows(df, *cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_detect_shots(spark):
    def found(flags):
        df = table(spark, "video_id long, i long, p double", *[(1, i, 1.0 if f else 0.0) for i, f in enumerate(flags)])
        return rows(shots.detect_shots(df, 0.5, 1.0), "start_s", "end_s")

    assert found([0, 0, 1, 0, 0, 1, 1, 0]) == [(0, 2), (3, 5), (7, 7)]
    assert found([1, 0, 0]) == [(1, 2)] and found([1, 1, 1, 1]) == [(0, 3)]


def test_speaker_turns(spark):
    s = table(spark, "video_id long, segment_id long, start_s double, end_s double, speaker string, text string",
              (1, 1, 0.0, 1.0, "A", "a"), (1, 2, 1.0, 2.0, "A", "b"), (1, 3, 2.005, 3.0, "B", "c"), (1, 4, 3.5, 4.0, "A", "d"), (2, 1, 0.0, 1.0, None, "x"))
    out = shots.speaker_turns(s)
    assert rows(out.where("video_id = 1"), "speaker", "start_s", "end_s", "text") == [("A", 0, 2, "a b"), ("A", 3.5, 4, "d"), ("B", 2.01, 3, "c")]
    assert rows(out.where("video_id = 2"), "speaker") == [("Unknown",)]


def test_aggregate_scalars(spark):
    s = series(spark, s1=[(0, 0), (1, 1), (2, 0)], s2=[(0, 0.5), (2, 0.5)])
    for how, want in (("prod", [0, 0.5, 0]), ("or", [0.5, 1, 0.5]), ("mean", [0.25, 0.75, 0.25])):
        assert [y for _, y in rows(scalars.aggregate_scalars(s, ["s1", "s2"], how), "time", "y")] == want
    s = series(spark, a=[(0, 0.5), (0, 0.5), (1, 0.2)])
    for how, want in (("or", [0.75, 0.2]), ("prod", [0.25, 0.2]), ("mean", [0.5, 0.2])):
        assert [y for _, y in rows(scalars.aggregate_per_time(s, how), "time", "y")] == want


def test_annotate_shots(spark):
    s = segs(spark, (0, 2), (2, 4), (4, 6))
    p = series(spark, X=[(0, 0.9), (1, 0.2), (2, 0.9), (3, 0.6)], Y=[(0, 0.1), (1, 0.4), (2, 0.1), (3, 0.6)])
    assert rows(shots.annotate_shots(s, p), "segment_id", "label") == [(1, "Y"), (2, "X")]
    assert rows(shots.annotate_shots_scalar(s, p.where("series = 'X'")), "segment_id", "mean") == [(1, 0.666667), (2, 0.75)]
    assert rows(shots.segment_agg(s, p.where("series = 'X'"), "mean", 0.0), "segment_id", "value")[2] == (3, 0.0)


def test_bounds_and_plan(spark):
    s, p = segs(spark, (0, 1), (1, 1), (0, 5000)), series(spark, X=[(0, 1), (0.5, 1), (1, 1), (5000, 1)])
    count = lambda b: {r.segment_id: r.n for r in joins.interval_join(p, s, b).groupBy("segment_id").agg(F.count("*").alias("n")).collect()}
    assert count("closed") == {1: 3, 2: 1, 3: 4} and count("half_open") == {1: 2, 3: 3} and count("open") == {1: 1, 3: 2}
    plan = joins.interval_join(p, s, "closed")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scalar_changes(spark):
    y = lambda df: [v for _, v in rows(df, "time", "y")]
    flat, wide, unit = series(spark, a=[(0, 0.5), (1, 0.505)]), series(spark, a=[(0, 0), (1, 2), (2, 4)]), series(spark, a=[(0, 0.2), (1, 0.8)])
    assert y(scalars.min_max_norm(flat)) == [0.5, 0.505] and y(scalars.min_max_norm(wide)) == [0, 0.5, 1]
    assert y(scalars.invert_scalar(wide)) == [1, 0.5, 0] and y(scalars.invert_scalar(unit)) == [0.8, 0.2]
    assert y(scalars.invert_scalar(scalars.invert_scalar(unit))) == y(unit)
    assert y(scalars.scalar_threshold(wide, 1, 3)) == [1, 2, 3] and y(scalars.scalar_threshold(wide, 0, None)) == [0, 2, 4]
    many = series(spark, a=[(k, 0) for k in range(3000)])
    assert scalars.resample_approx(many, 1024).count() == 750


def test_sample_frames_and_thumbnails(spark):
    f = table(spark, "video_id long, time double", *[(1, k / 2) for k in range(6)])
    s = segs(spark, (0, 1), (1, 2))
    assert [t for _, t in rows(joins.sample_frames(f, s), "segment_id", "time")] == [0.5, 1.5]
    both = joins.sample_frames(f, s, True, False, True)
    assert rows(both, "segment_id", "part", "time") == [(1, "end", 1.0), (1, "start", 0.0), (2, "end", 2.0), (2, "start", 1.5)]


def test_timeline_tree_has_no_bound(spark):
    t = table(spark, "video_id long, timeline_id long, parent_id long, ord int", *[(1, k, k - 1 if k else None, k % 3) for k in range(36)], (2, 7, None, 5), (2, 8, 7, 1), (2, 9, 7, 0), (3, 1, None, 0), (3, 1, 2, 0), (3, 2, 1, 0))
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        got = joins.timeline_tree(t).collect()
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", before)
    path = {(r.video_id, r.timeline_id): (r.depth, [tuple(p) for p in r.path]) for r in got}
    assert len(got) == 41 and path[1, 35] == (35, [(k % 3, k) for k in range(36)])
    assert path[2, 8] == (1, [(5, 7), (1, 8)]) and path[2, 9] == (1, [(5, 7), (0, 9)]) and path[3, 2] == (1, [(0, 1), (0, 2)])
    assert joins.timeline_tree(t.limit(0)).count() == 0


def test_neighbours(spark):
    s = segs(spark, (0, 1), (1, 2), (1, 3), (5, 6))
    assert rows(joins.neighbours(s), "segment_id", "previous_id", "next_id")[1:3] == [(2, 1, 4), (3, 1, 4)]


def test_sampling_of_members(spark):
    for n, k, want in ((5, 3, [0, 2, 4]), (6, 4, [0, 2, 3, 5]), (4, 3, [0, 2, 3]), (6, 3, [0, 2, 5]), (1, 3, [0])):
        c = table(spark, "video_id long, id long, size long, position long", *[(1, i, n, i) for i in range(n)])
        assert [i for (i,) in rows(clusters.sample_members(c, k).where("is_sample"), "id")] == want


def test_clustering_chains(spark):
    import math

    e = table(spark, "video_id long, id long, embedding array<float>", *[(1, k, [math.cos(math.radians(d)), math.sin(math.radians(d))]) for k, d in enumerate((0, 40, 80, 180))])
    want = [(0, 0, 3), (1, 0, 3), (2, 0, 3), (3, 1, 1)]
    assert rows(clusters.cluster_single_linkage(e, 0.25), "id", "cluster_rank", "size") == want == rows(clusters.cluster_dbscan(e, 0.25), "id", "cluster_rank", "size")
    assert rows(clusters.cluster_single_linkage(e, 0.7, metric="euclidean"), "id", "cluster_rank", "size") == want


def test_cosine_over_time(spark):
    t = table(spark, "video_id long, time double, embedding array<float>", (1, 0.0, [1.0, 0.0]), (1, 0.0, [-1.0, 0.0]), (1, 1.0, [0.0, 1.0]))
    q = table(spark, "embedding array<float>", ([1.0, 0.0],))
    assert rows(vectors.cosine_over_time(t, q), "time", "y") == [(0, 1), (1, 0.5)]
    assert rows(vectors.cosine_over_time(t, q, normalize=1), "time", "y") == [(0, 1), (1, 0)]


def test_merge_topk(spark):
    c = table(spark, "video_id long, segment_id long, chunk long, label string, prob double",
              *[(1, 1, k, n, p) for k, d in enumerate(({"a": 0.5, "b": 0.3, "c": 0.1}, {"a": 0.2, "d": 0.6, "b": 0.1})) for n, p in d.items()])
    assert rows(vectors.merge_topk(c), "rank", "label", "prob") == [(1, "a", 0.388889), (2, "d", 0.333333), (3, "b", 0.222222)]


def test_word_cloud_and_edges(spark):
    t, stop = table(spark, "text string", ("The cat, the Cat.",)), table(spark, "word string", ("the",))
    assert rows(graphs.word_cloud(t, stop), "word", "n", "size") == [("cat", 2, 100.0)]
    e, s = series(spark, A=[(0.5, 0), (2.5, 0)], B=[(2.2, 0)]), segs(spark, (0, 1), (2, 3))
    assert rows(graphs.node_counts(e, s, True, 1), "series", "n") == [("A", 2), ("B", 1)]
    assert rows(graphs.constellation_edges(e, s, True, 1), "a", "b", "n") == [("A", "B", 1)] and graphs.constellation_edges(e, None, False, 1).count() == 0


@pytest.mark.parametrize("name", ["reverse", "opposition", "frameshare"])
def test_patterns(spark, name):
    s = segs(spark, *[(k, k + 1) for k in range(5)])
    if name == "reverse":
        f = table(spark, "video_id long, segment_id long, cluster long", *[(1, k + 1, c) for k, c in enumerate((1, 2, 1, 2, 3))])
        assert rows(shots.shot_reverse_shot(f, s), "first_shot", "last_shot") == [(0, 3)]
    else:
        sides = ("left", "right", "left") if name == "opposition" else ("left",) * 3
        f = table(spark, "video_id long, segment_id long, cluster long, side string", *[(1, k + 1, c, sides[k]) for k, c in enumerate((1, 2, 1))])
        run = shots.opposition if name == "opposition" else shots.frameshare
        assert rows(run(f, s), "first_shot", "last_shot") == [(0, 2)]


def test_intensification(spark):
    order = {n: k for k, n in enumerate(fn.SHOT_SIZES)}
    names = ("Long Shot", "Full Shot", "Medium Shot", "Medium Shot", "Close-Up", "Full Shot")
    s = segs(spark, *[(k, k + 1) for k in range(6)])
    r = table(spark, "video_id long, segment_id long, rank double", *[(1, k + 1, float(order[n])) for k, n in enumerate(names)])
    assert rows(shots.intensification(r, s), "first_shot", "last_shot") == [(0, 4)]


def test_durations_and_chunks(spark):
    s = segs(spark, (0, 2), (3, 4))
    v = table(spark, "video_id long, duration double", (1, 10.0))
    assert rows(shots.segment_durations(s, v), "duration", "no_gap") == [(1, 7), (2, 3)]
    c = shots.chunk_segments(segs(spark, (0, 0.4), (0, 10), (0, 25)))
    assert rows(c, "segment_id", "chunk_start", "chunk_end") == [(1, 0, 1), (2, 0, 10), (3, 0, 10), (3, 10, 20)]


def test_nms_and_lines(spark):
    b = table(spark, "video_id long, time double, id long, score double, x1 double, y1 double, x2 double, y2 double", (1, 0.0, 1, 0.9, 0.0, 0.0, 9.0, 9.0), (1, 0.0, 2, 0.8, 1.0, 1.0, 10.0, 10.0), (1, 0.0, 3, 0.7, 20.0, 20.0, 29.0, 29.0))
    assert rows(boxes.nms(b, 0.4), "id") == [(1,), (3,)]
    w = table(spark, "video_id long, time double, x double, y double, w double, h double, text string",
              (1, 0.0, 0.0, 0.0, 50.0, 10.0, "a"), (1, 0.0, 60.0, 2.0, 50.0, 10.0, "b"), (1, 0.0, 0.0, 14.0, 50.0, 10.0, "c"), (1, 0.0, 400.0, 0.0, 20.0, 10.0, "far"))
    assert [t for _, t in rows(boxes.merge_lines(w), "block", "text")] == ["a b c", "far"]


def test_tracks(spark):
    b = table(spark, "video_id long, id long, time double, x double, y double, w double, h double", *[(1, k, f / 25, 0.1 + f / 1000, 0.1, 0.2, 0.2) for k, f in enumerate((0, 1, 4))], (1, 9, 0.0, 0.7, 0.7, 0.1, 0.1))
    out = boxes.track_faces(b, segs(spark, (0, 2)))
    assert rows(out, "track", "frame", "x") == [(0, k, round(0.1 + k / 1000, 6)) for k in range(5)]


def test_times(spark):
    t = table(spark, "s double", (3661.05,), (0.9996,))
    assert [r[0] for r in t.select(fn.iso_time(F.col("s"))).collect()] == ["01:01:01.50", "00:00:00.1000"]
    assert [r[0] for r in t.select(fn.timecode(F.col("s"))).collect()] == ["01:01:01.050", "00:00:00.1000"]
    d = table(spark, "s double", (3600.0,), (65.9,), (3725.0,), (0.2,))
    assert [r[0] for r in d.select(fn.display_time(F.col("s"))).collect()] == ["1 h ", "1 min 5 sec", "1 h 2 min 5 sec", ""]


def test_colors(spark):
    one = spark.range(1)
    got = one.select(fn.prob_to_hex(F.lit(0.2)), F.round(fn.luminance(F.lit("#ffffff")), 9), fn.linear_map(F.lit(2.0), 0.0, 1.0), fn.linear_map(F.lit(-1.0), 0.0, 1.0), fn.closest_color(F.lit(250), F.lit(2), F.lit(3))).first()
    assert tuple(got) == ("#ecd4d2", 1.0, "#ae1313", "#ffffff", "Red")


def test_edits(spark):
    s = table(spark, "video_id long, timeline_id long, segment_id long, start_s double, end_s double", (1, 5, 1, 0.0, 10.0))
    links = table(spark, "segment_id long, annotation_id long", (1, 77))
    out = timelines.annotate_range(s, links, table(spark, "timeline_id long, a double, b double, annotation_id long", (5, 3.0, 6.0, 88)))
    named = out["segments"].join(out["segment_annotations"], "segment_id")
    assert rows(named, "start_s", "end_s", "annotation_id") == [(0, 3, 77), (3, 6, 88), (6, 10, 77)]
    cut = timelines.split_segments(s, links, table(spark, "segment_id long, t double", (1, 4.0)))
    assert rows(cut["segments"], "start_s", "end_s") == [(0, 4), (4, 10)] and cut["segment_annotations"].count() == 2
    edit = cut["segments"].select(F.lit(1).cast("long").alias("edit_id"), "segment_id")
    back = timelines.merge_segments(cut["segments"], cut["segment_annotations"], edit)
    assert rows(back["segments"], "start_s", "end_s") == [(0, 10)] and back["segment_annotations"].count() == 1


def test_entities(spark):
    m = table(spark, "seg_id long, start_c int, end_c int, text string, type string", (1, 10, 15, "Paris", "LOC"), (1, 30, 33, "Bob", "PER"), (1, 40, 41, "X", "ORG"))
    c = table(spark, "seg_id long, ch_from int, ch_to int, page_rank double, wd_id string, wd_label string", (1, 8, 17, 0.5, "Q1", "p"), (1, 10, 15, 0.2, "Q2", "p"), (1, 10, 30, 0.9, "Q3", "p"), (1, 30, 33, 1e-5, "Q4", "b"))
    out = joins.link_entities(m, c, table(spark, "surface string, wd_id string", ("Nobody", "Q9")))
    assert rows(out, "text", "wd_id") == [("Bob", "unk"), ("Paris", "Q1")]
    b = table(spark, "wd_id string, ord int, is_person boolean, notable boolean, is_place boolean", ("Q1", 1, True, True, False), ("Q1", 0, False, False, True))
    kinds = joins.resolve_entity_types(out, b, table(spark, "wd_id string", ("Q8",)), table(spark, "wd_id string", ("Q7",)))
    assert rows(kinds, "text", "resolved") == [("Bob", "LPER"), ("Paris", "LOC")]
    kept = table(spark, "text string, type string, wd_id string, wd_label string", ("a", "PER", "Q5", "Ann Lee"), ("b", "PER", "Q5", "Ann"), ("c", "LOC", "Q6", "x"), ("d", "MISC", "unk", "unk"), ("e", "ORG", "unk", "unk"))
    kinds = joins.resolve_entity_types(kept, b, table(spark, "wd_id string", ("Q8",)), table(spark, "wd_id string", ("Q7",)))
    assert rows(kinds, "text", "resolved") == [("a", "EPER"), ("b", "LPER"), ("c", "LOC"), ("d", "MISC"), ("e", "ORG")]


def test_eaf_and_flatten(spark, tmp_path):
    (tmp_path / "a.eaf").write_text("""<?xml version="1.0"?><ANNOTATION_DOCUMENT><TIME_ORDER><TIME_SLOT TIME_SLOT_ID="t1" TIME_VALUE="0"/><TIME_SLOT TIME_SLOT_ID="t2" TIME_VALUE="1500"/></TIME_ORDER>
      <TIER TIER_ID="x"><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a1" TIME_SLOT_REF1="t1" TIME_SLOT_REF2="t2"><ANNOTATION_VALUE>hi</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER></ANNOTATION_DOCUMENT>""")
    got = io.read_eaf(spark, str(tmp_path / "a.eaf"))
    assert rows(got["segments"], "name", "start_s", "end_s") == [("x", 0, 1.5)] and rows(got["labels"], "label") == [("hi",)]
    nested = spark.range(1).select(F.struct(F.struct(F.lit(1).alias("c")).alias("b"), F.lit(2).alias("d")).alias("a"))
    assert fn.flatten(nested).columns == ["a.b.c", "a.d"] and fn.unflatten(fn.flatten(nested)).first().a.b.c == 1


def test_save_and_load(spark, tmp_path):
    t = table(spark, "segment_id long, annotation_id long", (1, 2))
    io.save(t, str(tmp_path), "segment_annotations")
    assert rows(io.load(spark, str(tmp_path), "segment_annotations"), "segment_id", "annotation_id") == [(1, 2)]
    v = table(spark, "owner_id int, video_id long, fps double, duration double", (7, 2, 25.0, 9.0), (8, 1, 25.0, 5.0), (8, 3, None, 1.0))
    for by_video in (False, True):
        io.save(v, str(tmp_path), "videos", by_video=by_video)
        back = io.load(spark, str(tmp_path), "videos")
        assert back.columns == ["video_id", "owner_id", "duration", "fps"]
        assert rows(back, "video_id", "owner_id", "duration") == [(1, 8, 5), (2, 7, 9), (3, 8, 1)]
    assert (tmp_path / "videos" / "video_id=2").is_dir()
    with pytest.raises(KeyError):
        io.load(spark, str(tmp_path), "nothing")


def test_linking_pairs_link_as_all_pairs_do(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    x = [(v, v * 1000 + i, [float(y) for y in p]) for v in (1, 2) for i, p in enumerate(rnd.normal(size=(60, 3)))]
    x += [(2, 5000 + i, [0.0, 1.0, 0.0]) for i in range(40)] + [(2, 6000, None), (2, 6001, [1.0, 0.0])]  # copies, no vector, another length
    e = table(spark, "video_id long, id long, embedding array<float>", *x)

    def components(t, metric):
        own = {r[1]: r[1] for r in x}
        rows_ = [(v, i, np.array(p, np.float32).astype(float)) for v, i, p in x if p is not None]
        for _ in range(len(x)):
            was = dict(own)
            for v, i, p in rows_:
                for w, j, q in rows_:
                    if v == w and len(p) == len(q):
                        far = 1 - p @ q / np.linalg.norm(p) / np.linalg.norm(q) if metric == "cosine" else np.linalg.norm(p - q)
                        if far <= t:
                            own[i] = min(own[i], own[j])
            if own == was:
                return own

    for t, metric in ((0.02, "cosine"), (0.3, "euclidean")):
        pairs = clusters.linking_pairs(e, t, metric, block=16)
        got = clusters.label_components(e, pairs).collect()
        assert {r.id: r.component for r in got} == components(t, metric)
    assert clusters.linking_pairs(e, 0.02).where("a >= 5000").count() < 40


def test_spectrogram_finds_the_tone(spark):
    import math

    s = spark.createDataFrame([(1, i, math.sin(2 * math.pi * 4 * i / 32), 32) for i in range(128)], "video_id long, i long, y double, sr int")
    mid = signal.spectrogram(s, 32).where("frame = 8").first()
    assert max(range(17), key=lambda k: mid.bins[k]) == 4 and max(mid.bins) <= 0 and min(mid.bins) >= -80


def test_spectrogram_against_numpy(spark):
    import numpy as np

    rnd = np.random.default_rng(1)
    want, data = {}, []
    for v, n in ((1, 100), (2, 37)):
        y = rnd.normal(size=n)
        data += [(v, i, float(q), 32) for i, q in enumerate(y)]
        size, hop, half = 16, 4, 8
        pad = np.concatenate([np.zeros(half), y, np.zeros(size)])
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        mags = [np.abs(np.fft.rfft(pad[f * hop : f * hop + size] * w)) for f in range(n // hop + 1)]
        top = max(m.max() for m in mags)
        for f, m in enumerate(mags):
            want[v, f] = np.maximum(-80, 20 * np.log10(np.maximum(m, 1e-10) / top))
    s = spark.createDataFrame(data, "video_id long, i long, y double, sr int")
    got = {(r.video_id, r.frame): r.bins for r in signal.spectrogram(s, 16).collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_equal_sums_are_ties(spark):
    """0.1 + 0.2 + 0.3 is 0.3 + 0.3, in whatever order it is added up: the first label wins."""
    c = table(spark, "video_id long, segment_id long, chunk long, label string, prob double", *[(1, 1, k, n, p) for n, ps in (("b", (0.1, 0.2, 0.3)), ("a", (0.0, 0.3, 0.3))) for k, p in enumerate(ps)]).coalesce(1)
    assert rows(vectors.merge_topk(c), "rank", "label", "prob") == [(1, "a", 0.5), (2, "b", 0.5)]
    assert rows(vectors.chunk_mean_label(c), "label", "prob") == [("a", 0.2)]


def test_sides_do_not_depend_on_the_order_of_rows(spark):
    faces = [(1, n, 0.5, *box, 3) for n, box in enumerate(((0.0, 0.0, 0.1, 0.2), (0.0, 0.0, 0.1, 0.22), (0.0, 0.0, 0.1, 0.23), (0.5, 0.0, 0.1, 0.65)))]
    for some in (faces, faces[::-1]):
        f = table(spark, "video_id long, face_id long, time double, x double, y double, w double, h double, cluster long", *some).coalesce(1)
        assert rows(shots.shot_sides(f, segs(spark, (0, 2))), "cluster", "side") == [(3, "left")]
