"""Shots: detection, annotation, durations, speaker turns, and editing patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoframe.operators.joins import interval_join
from chronoframe.operators.stretches import PARTS, SIZE, numbered, over_rows

SHOT = ["video_id", "segment_id"]


def _by_video():
    return W.partitionBy("video_id")


def annotate_shots(shots: DataFrame, scalars: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per shot the series of the largest mean inside it; means that are 0 or not over the threshold don't count, ties go to the first series."""
    hit = interval_join(scalars, shots, "open")
    mean = hit.groupBy(*SHOT, "series").agg(F.avg("y").alias("mean")).where((F.col("mean") > threshold) & (F.col("mean") != 0))
    best = mean.withColumn("_r", F.row_number().over(W.partitionBy(*SHOT).orderBy(F.desc("mean"), "series"))).where("_r = 1")
    return best.select(*SHOT, F.col("series").alias("label"), "mean")


def annotate_shots_scalar(shots: DataFrame, scalars: DataFrame) -> DataFrame:
    """The mean of the samples of each shot that has any."""
    return interval_join(scalars, shots, "closed").groupBy(*SHOT).agg(F.avg("y").alias("mean"))


def segment_agg(shots: DataFrame, scalars: DataFrame, how: str = "mean", empty: float | None = None, digits: int | None = None) -> DataFrame:
    """Maximum, minimum or mean per segment; segments without samples get ``empty``, or are left out if it is None."""
    fn = {"mean": F.avg, "max": F.max, "min": F.min}[how]
    out = interval_join(scalars, shots, "closed", how="inner" if empty is None else "left").groupBy(*SHOT).agg(fn("y").alias("value"))
    if empty is not None:
        out = out.withColumn("value", F.coalesce("value", F.lit(float(empty))))
    return out if digits is None else out.withColumn("value", F.bround("value", digits))


def scalar_annotation_style(annos: DataFrame) -> DataFrame:
    """The mean to three digits, and its place between the least and the largest of the video."""
    lo, hi = F.min("mean").over(_by_video()), F.max("mean").over(_by_video())
    light = F.when(hi > lo, (F.col("mean") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return annos.select(*SHOT, F.bround("mean", 3).alias("shown"), light.alias("lightness"))


def face_sizes(bboxes: DataFrame, reduction: str = "max") -> DataFrame:
    fn = F.max if reduction == "max" else F.avg
    return bboxes.groupBy("video_id", "time").agg(fn(F.col("w") * F.col("h")).alias("y"))


def face_size_labels(bboxes: DataFrame, shots: DataFrame, shot_labels: DataFrame) -> DataFrame:
    """A shot's label where a face is in it, else "None"."""
    seen = interval_join(bboxes.select("video_id", "time"), shots, "half_open").select(*SHOT).distinct().withColumn("_seen", F.lit(True))
    return shots.join(shot_labels, SHOT, "left").join(seen, SHOT, "left").select(*SHOT, F.when(F.col("_seen"), F.col("label")).otherwise("None").alias("label"))


def collect_labels(shots: DataFrame, timed_text: DataFrame) -> DataFrame:
    """The texts of each shot in the order of their times; an empty list where there is none."""
    hit = interval_join(timed_text, shots, "closed", how="left")
    return hit.groupBy(*SHOT).agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("time", "text")))), lambda x: x["text"]).alias("labels"))


def detect_shots(frame_probs: DataFrame, thr: float = 0.5, fps: float = 25.0) -> DataFrame:
    """Scenes between transitions (p > thr): from the first frame without one to the next frame with one; the last runs to the end.

    A video of transitions only is one scene of all frames.
    """
    w = _by_video().orderBy("i")
    f = frame_probs.select("video_id", "i", (F.col("p") > thr).alias("cut"))
    f = f.withColumn("opens", ~F.col("cut") & F.coalesce(F.lag("cut").over(w), F.lit(True)))
    f = f.withColumn("scene", F.sum(F.col("opens").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    f = f.withColumn("closes", F.col("cut") & ~F.coalesce(F.lag("cut").over(w), F.lit(True)))
    found = f.where("scene > 0 and (not cut or closes)").groupBy("video_id", "scene").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    whole = f.groupBy("video_id").agg(F.max("scene").alias("scenes"), F.max("i").alias("last")).where("scenes = 0").select("video_id", F.lit(1).cast("long").alias("scene"), F.lit(0).cast("long").alias("first"), "last")
    return found.unionByName(whole).select("video_id", F.col("scene").cast("long").alias("segment_id"), (F.col("first") / fps).alias("start_s"), (F.col("last") / fps).alias("end_s"))


def speaker_turns(segs: DataFrame, gap: float = 0.01) -> DataFrame:
    """Consecutive segments of one speaker joined; a turn starts at least ``gap`` after the one before."""
    w = _by_video().orderBy("start_s", "segment_id")
    s = segs.withColumn("speaker", F.coalesce("speaker", F.lit("Unknown")))
    s = s.withColumn("_new", F.coalesce((F.col("speaker") != F.lag("speaker").over(w)).cast("int"), F.lit(1)))
    s = s.withColumn("turn", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    key = F.struct("start_s", "segment_id")
    t = s.groupBy("video_id", "turn").agg(
        F.first("speaker").alias("speaker"), F.min("start_s").alias("start_s"), F.max_by("end_s", key).alias("end_s"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_s", "segment_id", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    before = F.lag("end_s").over(_by_video().orderBy("turn"))
    return t.withColumn("start_s", F.when(F.col("start_s") - before <= gap, before + gap).otherwise(F.col("start_s")))


def active_speaker(scores: DataFrame, least_ratio: float = 0.6, size: int = SIZE, parts: int = PARTS) -> DataFrame:
    """Scores smoothed over five rows; a track speaks if more than ``least_ratio`` of its frames score 0 or more."""
    smooth = lambda w: {"_s": F.avg("score").over(w.rowsBetween(-2, 2))}
    t = over_rows(scores, ["video_id", "track_id"], ["i"], 2, 2, smooth, size, parts).groupBy("video_id", "track_id").agg(F.avg((F.col("_s") >= 0).cast("double")).alias("ratio"), F.avg("_s").alias("mean_score"))
    return t.withColumn("is_speaking", F.col("ratio") > least_ratio)


def multi_scale_mean(scores: DataFrame) -> DataFrame:
    """The mean over scales of each position, with -5 where a scale is shorter than the longest."""
    scales = scores.select("video_id", "scale").distinct()
    grid = scores.select("video_id", "i").distinct().join(scales, "video_id")
    return grid.join(scores, ["video_id", "scale", "i"], "left").groupBy("video_id", "i").agg(F.bround(F.avg(F.coalesce("score", F.lit(-5.0))), 1).alias("score"))


def median_filter(series: DataFrame, k: int = 13, size: int = SIZE, parts: int = PARTS) -> DataFrame:
    """The median of k neighbours, zeros beyond the ends."""
    half = k // 2

    def median(w) -> dict:
        own = F.collect_list("y").over(w.rowsBetween(-half, half))
        padded = F.concat(own, F.array_repeat(F.lit(0.0), F.lit(k) - F.size(own)))
        return {"y": F.element_at(F.array_sort(padded), half + 1)}

    return over_rows(series, ["video_id", "series"], ["time"], half, half, median, size, parts).select(*series.columns)


def frame_windows(frames: DataFrame, size: int = 100, stride: int = 50, pad: int = 25) -> DataFrame:
    """Overlapping windows of frame numbers: ``video_id, window, slot, i, kept``; edges are repeated, the centre is kept."""
    n = frames.groupBy("video_id").agg((F.max("i") + 1).alias("n"))
    w = n.select("video_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / stride) - 1)).alias("window"))
    w = w.select("video_id", "n", "window", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    at = F.col("window") * stride + F.col("slot") - pad
    i = F.greatest(F.lit(0), F.least(at, F.col("n") - 1))
    kept = (F.col("slot") >= pad) & (F.col("slot") < pad + stride) & (at < F.col("n"))
    return w.select("video_id", "window", "slot", i.cast("long").alias("i"), kept.alias("kept"))


def row_batches(frames: DataFrame, n: int, keep_tail: bool, size: int = SIZE, parts: int = PARTS) -> DataFrame:
    """Runs of n frames: with their mean time and no incomplete tail, or with the time of their start and the tail."""
    f = numbered(frames, ["video_id"], ["time", "i"], size, parts).withColumn("batch", F.floor(F.col("_i") / n))
    b = f.groupBy("video_id", "batch").agg(F.count("*").alias("size"), (F.min("time") if keep_tail else F.avg("time")).alias("time"))
    return b if keep_tail else b.where(F.col("size") == n)


def segment_durations(segs: DataFrame, videos: DataFrame) -> DataFrame:
    """Lengths, and lengths up to the next segment (for the last one: the video's end)."""
    nxt = F.lead("start_s").over(_by_video().orderBy("start_s", "segment_id"))
    s = segs.withColumn("_next", nxt).join(videos.select("video_id", F.col("duration").alias("_d")), "video_id", "left")
    return s.select(*SHOT, (F.col("end_s") - F.col("start_s")).alias("duration"), (F.coalesce("_next", "_d") - F.col("start_s")).alias("no_gap"))


def chunk_segments(segs: DataFrame, max_len: float = 10.0, min_len: float = 1.0) -> DataFrame:
    """Segments as chunks: short ones are padded, long ones are cut into whole chunks and lose their tail."""
    length = F.col("end_s") - F.col("start_s")
    n = F.when(length > max_len, F.floor(length / max_len)).otherwise(F.lit(1).cast("long"))
    s = segs.withColumn("_len", length).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    start = F.col("start_s") + F.col("chunk") * max_len
    end = F.when(F.col("_len") > max_len, start + max_len).otherwise(F.col("start_s") + F.greatest(F.col("_len"), F.lit(min_len)))
    return s.select(*SHOT, "chunk", start.alias("chunk_start"), end.alias("chunk_end"))


def frames_to_annotations(strings: DataFrame, fps: float) -> DataFrame:
    return strings.select("video_id", F.col("time").alias("start_s"), (F.col("time") + 1 / fps).alias("end_s"), F.array("text").alias("labels"))


def fill_chunk_bounds(chunks: DataFrame, videos: DataFrame) -> DataFrame:
    c = chunks.join(videos.select("video_id", F.col("duration").alias("_d")), "video_id", "left")
    return c.withColumn("start_s", F.coalesce("start_s", F.lit(0.0))).withColumn("end_s", F.coalesce("end_s", "_d")).drop("_d")


def shot_sides(face_facts: DataFrame, shots: DataFrame) -> DataFrame:
    """The half of the picture that each cluster's faces overlap more in a shot: left if strictly more, else right.

    The faces are added up in the order of their ids, so that sums which all but agree do not depend on how rows are dealt.
    """
    def iou(x0: float):
        ox = F.greatest(F.lit(0.0), F.least(F.col("x") + F.col("w"), F.lit(x0 + 0.5)) - F.greatest(F.col("x"), F.lit(x0)))
        oy = F.greatest(F.lit(0.0), F.least(F.col("y") + F.col("h"), F.lit(1.0)) - F.greatest(F.col("y"), F.lit(0.0)))
        union = F.col("w") * F.col("h") + 0.5 - ox * oy
        return F.when(union > 0, ox * oy / union).otherwise(F.lit(0.0))

    added = lambda c: F.aggregate(F.filter(f"_f.{c}", lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)
    faces = F.sort_array(F.collect_list(F.struct("face_id", iou(0.0).alias("l"), iou(0.5).alias("r"))))  # one cluster's in one shot
    s = interval_join(face_facts, shots, "open").groupBy(*SHOT, "cluster").agg(faces.alias("_f"))
    s = s.withColumn("_l", added("l")).withColumn("_r", added("r"))
    return s.select(*SHOT, "cluster", F.when(F.col("_l") > F.col("_r"), "left").otherwise("right").alias("side"))


def _pairs(shots: DataFrame, facts: DataFrame, cols: list[str]) -> DataFrame:
    """Shots by their place ``i`` in the video (of ``n``) with their facts as ``x``, and ``x1``, ``x2`` of the two before; null where there is none."""
    rows = shots.select(*SHOT, "start_s", "end_s").join(facts.select(*SHOT, *cols), SHOT, "left")
    whole = F.when(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols)), F.struct(*cols))
    w = _by_video().orderBy("start_s", "segment_id")
    rows = rows.select("video_id", "start_s", "end_s", whole.alias("x"), F.row_number().over(w).alias("i"), F.count("*").over(_by_video()).alias("n"), F.col("segment_id"))
    return rows.select("video_id", "start_s", "end_s", "x", (F.col("i") - 1).alias("i"), "n", F.lag("x").over(w).alias("x1"), F.lag("x", 2).over(w).alias("x2"))


def _islands(pairs: DataFrame, apart, **agg) -> DataFrame:
    """Neighbouring pairs of shots, a new island where ``apart`` holds (or there is no pair before): ``first, last`` shots, ``n``, and ``agg``."""
    w = _by_video().orderBy("i")
    p = pairs.withColumn("_new", F.coalesce((F.lag("i").over(w) != F.col("i") - 1) | apart, F.lit(True)).cast("int"))
    p = p.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return p.groupBy("video_id", "_island").agg((F.min("i") - 1).alias("first"), F.max("i").alias("last"), F.max("n").alias("n"), *[f.alias(k) for k, f in agg.items()]).drop("_island")


def _named(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``video_id, first_shot, last_shot, start_s, end_s``"""
    at = lambda c, t: pairs.select("video_id", F.col("i").alias(c), t)
    return runs.select("video_id", F.col("first").cast("int").alias("first_shot"), F.col("last").cast("int").alias("last_shot")).join(at("first_shot", "start_s"), ["video_id", "first_shot"]).join(at("last_shot", "end_s"), ["video_id", "last_shot"]).select("video_id", "first_shot", "last_shot", "start_s", "end_s")


def _alternating(shots: DataFrame, facts: DataFrame, cols: list[str], opens, min_len: int) -> DataFrame:
    """Runs a b a b ... of shots where ``opens(a, b)``, chosen from the first to the last so that none overlap.

    Islands of pairs that go on (a shot equals the last but one) are the longest runs; the next island shares one shot with
    the one before at most, and loses it where that one is chosen. That changes the choice only for an island that is just
    long enough, so among neighbours of that kind every other one is chosen: it is told by their distance from an island
    whose choice is sure. A run that ends with the video has three shots or more, as it starts before the last two.
    """
    p = _pairs(shots, facts, cols)
    x = p.where("x is not null and x1 is not null")
    runs = _islands(x, ~F.coalesce(F.col("x") == F.col("x2"), F.lit(False)), opens=F.max_by(opens(F.col("x1"), F.col("x")), -F.col("i")))
    w = _by_video().orderBy("first")
    need = F.when(F.col("last") == F.col("n") - 1, F.lit(max(min_len, 3))).otherwise(F.lit(min_len))
    spare = F.col("last") - F.col("first") + 1 - need
    r = runs.withColumn("_touch", F.coalesce(F.lag("last").over(w) == F.col("first"), F.lit(False))).withColumn("_spare", spare)
    r = r.withColumn("_sure", (~(F.col("opens") & F.col("_touch") & (F.col("_spare") == 0))).cast("int"))
    r = r.withColumn("_group", F.sum("_sure").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = W.partitionBy("video_id", "_group").orderBy("first")
    chosen = F.first(F.col("opens") & (F.col("_spare") >= 0)).over(g) == (F.row_number().over(g) % 2 == 1)
    r = r.withColumn("_chosen", chosen)
    r = r.withColumn("first", F.col("first") + (F.col("_touch") & F.coalesce(F.lag("_chosen").over(w), F.lit(False))).cast("int"))
    return _named(r.where("_chosen"), p)


def single_faces(facts: DataFrame, sides: bool = False) -> DataFrame:
    """Shots with exactly one cluster, and it (with the side where asked)."""
    agg = [F.countDistinct("cluster").alias("_n"), F.min("cluster").cast("double").alias("cluster")] + ([F.min("side").alias("side")] if sides else [])
    return facts.groupBy(*SHOT).agg(*agg).where("_n = 1").drop("_n")


def shot_reverse_shot(shot_faces: DataFrame, shots: DataFrame, min_len: int = 4) -> DataFrame:
    """Two clusters, each alone in its shots, that alternate."""
    return _alternating(shots, single_faces(shot_faces), ["cluster"], lambda a, b: a["cluster"] != b["cluster"], min_len)


def opposition(sides: DataFrame, shots: DataFrame, min_len: int = 3) -> DataFrame:
    """As before, and the two are on different sides."""
    return _alternating(shots, single_faces(sides, True), ["cluster", "side"], lambda a, b: (a["cluster"] != b["cluster"]) & (a["side"] != b["side"]), min_len)


def frameshare(sides: DataFrame, shots: DataFrame, min_len: int = 3) -> DataFrame:
    """Two persons, who may be one, alternate on the same side."""
    return _alternating(shots, single_faces(sides, True), ["cluster", "side"], lambda a, b: a["side"] == b["side"], min_len)


def intensification(ranks: DataFrame, shots: DataFrame, min_len: int = 3) -> DataFrame:
    """Shot sizes (larger ranks are wider) that drop and then never rise; shots without a rank are left out, null ranks break a run.

    Islands of pairs that do not rise never overlap; a run begins with its island's first drop.
    """
    known = shots.join(ranks.select(*SHOT), SHOT, "left_semi")
    p = _pairs(known, ranks.select(*SHOT, "rank"), ["rank"])
    rank, before = F.col("x")["rank"], F.col("x1")["rank"]
    runs = _islands(p.where(rank <= before), F.lit(False), drop=F.min(F.when(rank < before, F.col("i") - 1)))
    runs = runs.where((F.col("last") - F.col("drop") + 1 >= F.lit(max(min_len, 2))) & (F.col("drop") < F.col("n") - 2))
    return _named(runs.withColumn("first", F.col("drop")), p)
