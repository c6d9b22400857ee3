"""Joins in time: points in segments, overlapping segments, nearest frames, neighbours, hierarchies and copies."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoframe.sources.written import shared_dir

#: bounds → residual condition of a time and a segment
BOUNDS = {
    "open": lambda t, s, e: (t > s) & (t < e),
    "closed": lambda t, s, e: (t >= s) & (t <= e),
    "half_open": lambda t, s, e: (t >= s) & (t < e),
}
LEAST_LEVEL = -10


def _level(start: Column, end: Column) -> Column:
    """The power of two (of seconds) that is at least the segment's length, so that it touches two bins at most."""
    return F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(F.greatest(end - start, F.lit(1e-6))))).cast("int")


def _binned(segs: DataFrame) -> DataFrame:
    s = segs.withColumn("_level", _level(F.col("start_s"), F.col("end_s")))
    width = F.pow(F.lit(2.0), F.col("_level"))
    return s.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_s") / width), F.floor(F.greatest("end_s", "start_s") / width))))


def interval_join(points: DataFrame, segs: DataFrame, bounds: str, how: str = "inner", time: str = "time") -> DataFrame:
    """Points of a video inside its segments; ``how="left"`` also keeps segments without points.

    ``points`` has ``video_id`` and ``time``, ``segs`` has ``video_id, segment_id, start_s, end_s``; other columns come
    along (names other than video_id must differ). Segments are put into bins of about their own length, so that the join
    is an equi-join on (video, level, bin) whatever the lengths; a point looks only at the levels that its video has.
    """
    binned = _binned(segs)
    levels = binned.select("video_id", "_level").distinct()
    p = points.join(levels, "video_id").withColumn("_bin", F.floor(F.col(time) / F.pow(F.lit(2.0), F.col("_level"))))
    hit = p.join(binned, ["video_id", "_level", "_bin"]).where(BOUNDS[bounds](F.col(time), F.col("start_s"), F.col("end_s"))).drop("_level", "_bin")
    if how == "inner":
        return hit
    own = ["video_id", "segment_id"]
    return hit.unionByName(segs.join(hit.select(*own).distinct(), own, "left_anti"), allowMissingColumns=True)


def overlap_join(a: DataFrame, b: DataFrame, strict: bool) -> DataFrame:
    """Pairs of overlapping segments of a video: ``video_id, a_id, b_id``; strict asks for a positive overlap."""
    left = a.select("video_id", F.col("segment_id").alias("a_id"), "start_s", "end_s")
    right = b.select("video_id", F.col("segment_id").alias("b_id"), "start_s", "end_s")
    # the longer of a pair decides the level: either one's bins are looked up at the levels of the other
    def at_levels(x: DataFrame, levels: DataFrame, names: tuple[str, str]) -> DataFrame:
        width = F.pow(F.lit(2.0), F.col("_level"))
        rows = x.withColumn(f"{names[0]}_level", _level(F.col("start_s"), F.col("end_s"))).join(levels, "video_id").where(F.col("_level") >= F.col(f"{names[0]}_level"))
        rows = rows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_s") / width), F.floor(F.greatest("end_s", "start_s") / width))))
        return rows.withColumnsRenamed({"start_s": names[0], "end_s": names[1]})

    levels = left.unionByName(right.withColumnRenamed("b_id", "a_id")).select("video_id", _level(F.col("start_s"), F.col("end_s")).alias("_level")).distinct()
    x, y = at_levels(left, levels, ("as_", "ae")), at_levels(right, levels, ("bs", "be"))
    both = x.join(y, ["video_id", "_level", "_bin"])
    ok = (F.least("ae", "be") - F.greatest("as_", "bs") > 0) if strict else ((F.col("as_") <= F.col("be")) & (F.col("bs") <= F.col("ae")))
    # each pair once: at the level of the longer one, in the bin where the later one starts
    once = (F.col("_level") == F.greatest("as__level", "bs_level")) & (F.col("_bin") == F.floor(F.greatest("as_", "bs") / F.pow(F.lit(2.0), F.col("_level"))))
    return both.where(once & ok).select("video_id", "a_id", "b_id")


def sample_frames(frames: DataFrame, shots: DataFrame, start: bool = False, middle: bool = True, end: bool = False) -> DataFrame:
    """Nearest frames of each shot: ``video_id, segment_id, part, time``.

    A frame belongs to the last shot that it doesn't lie behind: the shots are left one at a time, at the first frame at
    or after their end, and that frame still counts for the shot that it ends. Ties go to the earlier frame.
    """
    # the k-th shot (from 0) takes the frames after the one that ended the shot before, up to the first at its own end
    ends = shots.select("video_id", "segment_id", "start_s", "end_s", F.row_number().over(W.partitionBy("video_id").orderBy("start_s", "segment_id")).alias("_k"))
    f = frames.select("video_id", "time").distinct()
    rank = W.partitionBy("video_id").orderBy("time")
    f = f.withColumn("_i", F.row_number().over(rank))
    # first frame at or after each end, and one frame at least for each shot that is left
    closing = f.unionByName(ends.select("video_id", F.col("end_s").alias("time"), "_k"), allowMissingColumns=True)
    after = W.partitionBy("video_id").orderBy(F.col("time"), F.col("_k").isNotNull().desc()).rowsBetween(W.currentRow, W.unboundedFollowing)
    closing = closing.withColumn("_first", F.coalesce(F.first("_i", ignorenulls=True).over(after), F.lit(1 << 40))).where("_k is not null")
    running = W.partitionBy("video_id").orderBy("_k").rowsBetween(W.unboundedPreceding, W.currentRow)
    closing = closing.withColumn("_to", F.max(F.col("_first") - F.col("_k")).over(running) + F.col("_k"))
    span = closing.select("video_id", "_k", "_to", F.lag("_to", 1, 0).over(W.partitionBy("video_id").orderBy("_k")).alias("_from"))
    spans = ends.join(span, ["video_id", "_k"]).select("video_id", "segment_id", "start_s", "end_s", (F.col("_from") + 1).alias("_a"), F.col("_to").alias("_b"))
    renamed = spans.select("video_id", "segment_id", F.col("_a").cast("double").alias("start_s"), F.col("_b").cast("double").alias("end_s"), F.col("start_s").alias("s"), F.col("end_s").alias("e"))
    hit = interval_join(f.withColumn("_pos", F.col("_i").cast("double")), renamed, "closed", time="_pos")
    parts = []
    if start:
        parts.append(("start", F.col("time") >= F.col("s"), F.struct(F.abs(F.col("time") - F.col("s")), "time")))
    if middle:
        parts.append(("middle", F.lit(True), F.struct(F.abs(F.col("time") - (F.col("s") + F.col("e")) / 2), "time")))
    if end:
        parts.append(("end", F.col("time") <= F.col("e"), F.struct(F.abs(F.col("time") - F.col("e")), "time")))
    best = hit.groupBy("video_id", "segment_id").agg(*[F.min_by("time", F.when(ok, nearest)).alias(name) for name, ok, nearest in parts])
    found = F.array(*[F.struct(F.lit(name).alias("part"), F.col(name).alias("time")) for name, _, _ in parts])
    return best.select("video_id", "segment_id", F.inline(found)).where("time is not null")


def neighbours(segs: DataFrame) -> DataFrame:
    """``video_id, segment_id, previous_id, next_id``: the largest end not after my start; the smallest end among later starts.

    Ties go to the smaller id. Running extrema over starts and ends, no self-join.
    """
    marks = segs.select("video_id", F.col("end_s").alias("t"), F.lit(0).alias("o"), F.struct("end_s", (-F.col("segment_id")).alias("i")).alias("ended"), F.lit(None).cast("long").alias("ask")).unionByName(
        segs.select("video_id", F.col("start_s").alias("t"), F.lit(1).alias("o"), F.col("segment_id").alias("ask")), allowMissingColumns=True
    )
    back = W.partitionBy("video_id").orderBy("t", "o").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = marks.withColumn("p", F.max("ended").over(back)).where("ask is not null").select("video_id", F.col("ask").alias("segment_id"), (-F.col("p.i")).alias("previous_id"))
    later = segs.select("video_id", F.col("start_s").alias("t"), F.lit(1).alias("o"), F.struct("end_s", F.col("segment_id").alias("i")).alias("begun"), F.lit(None).cast("long").alias("ask")).unionByName(
        segs.select("video_id", F.col("end_s").alias("t"), F.lit(0).alias("o"), F.col("segment_id").alias("ask")), allowMissingColumns=True
    )
    ahead = W.partitionBy("video_id").orderBy("t", "o").rowsBetween(W.currentRow, W.unboundedFollowing)
    after = later.withColumn("n", F.min("begun").over(ahead)).where("ask is not null").select("video_id", F.col("ask").alias("segment_id"), F.col("n.i").alias("next_id"))
    return before.join(after, ["video_id", "segment_id"])


def frame_faces(frames: DataFrame, kps: DataFrame) -> DataFrame:
    """Frames and what was found at exactly their time, to the microsecond."""
    key = lambda df: df.withColumn("_us", F.round(F.col("time") * 1e6).cast("long"))
    return key(frames).join(key(kps).drop("time"), ["video_id", "_us"]).drop("_us")


def zip_by_order(a: DataFrame, b: DataFrame, a_order: str, b_order: str, key: str = "video_id") -> DataFrame:
    """The n-th row of ``a`` with the n-th row of ``b`` of the same key; what is over in the longer one is left out."""
    x = a.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(a_order)))
    y = b.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(b_order)))
    return x.join(y, [key, "position"])


def shot_thumbnails(shots: DataFrame, frames: DataFrame, dt: float) -> DataFrame:
    """Indices of the first, middle and last thumbnail of each shot, and their frames (null where there is none)."""
    n = frames.groupBy("video_id").agg(F.count("*").alias("_n"))
    s = shots.join(n, "video_id", "left")
    mid = (F.col("start_s") + F.col("end_s")) / 2 / dt
    s = s.select(
        "video_id", "segment_id",
        F.least(F.ceil(F.col("start_s") / dt), F.col("_n") - 1).alias("first_i"),
        F.floor(mid + 0.5).alias("middle_i"),
        F.floor(F.col("end_s") / dt).alias("last_i"),
    )
    for part in ("first", "middle", "last"):
        f = frames.select("video_id", F.col("i").alias(f"{part}_i"), F.col("frame_id").alias(f"{part}_frame"))
        s = s.join(f, ["video_id", f"{part}_i"], "left")
    return s


def face_facts(faces: DataFrame, embeddings: DataFrame, bboxes: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per face: its time, box and cluster."""
    t = embeddings.select("video_id", F.col("ref_id").alias("face_id"), "time")
    b = bboxes.select("video_id", F.col("ref_id").alias("face_id"), "x", "y", "w", "h")
    c = clusters.select("video_id", F.col("ref_id").alias("face_id"), "cluster")
    own = ["video_id", "face_id"]
    return faces.select("video_id", F.col("id").alias("face_id")).join(t, own).join(b, own).join(c, own)


def link_entities(mentions: DataFrame, candidates: DataFrame, fallback: DataFrame, slack: int = 2, least_rank: float = 1e-4) -> DataFrame:
    """The candidate of the highest rank whose span lies in the mention's, give or take ``slack`` characters.

    Only mentions of the four types and two characters; without a candidate the surface text is looked up, else "unk". The
    label is that of the candidate, for those looked up the surface text.
    """
    m = mentions.where(F.col("type").isin("PER", "ORG", "LOC", "MISC") & (F.length("text") >= 2))
    c = candidates.where(F.col("page_rank") >= least_rank)
    hit = m.join(c, "seg_id").where((F.col("ch_from") >= F.col("start_c") - slack) & (F.col("ch_to") <= F.col("end_c") + slack))
    own = ["seg_id", "start_c", "end_c"]
    best = hit.groupBy(*own).agg(F.max_by(F.struct("wd_id", "wd_label"), F.struct("page_rank", -F.col("ch_from"))).alias("_best"))
    looked = fallback.groupBy("surface").agg(F.min("wd_id").alias("_fb"))
    out = m.join(best, own, "left").join(looked, m["text"] == looked["surface"], "left")
    label = F.coalesce("_best.wd_label", F.when(F.col("_best").isNull() & F.col("_fb").isNotNull(), F.col("text")), F.lit("unk"))
    return out.select("seg_id", "start_c", "end_c", "text", "type", F.coalesce("_best.wd_id", "_fb", F.lit("unk")).alias("wd_id"), label.alias("wd_label"))


def resolve_entity_types(entities: DataFrame, bindings: DataFrame, orgs: DataFrame, events: DataFrame) -> DataFrame:
    """The first of an entity's bindings that tells a type decides: EVENT before ORG before PER before LOC within it.

    ``bindings``: ``wd_id, ord, is_person, notable, is_place``; a person is EPER if any binding of the entity is notable,
    else LPER. Without such a binding linked entities keep their type (but PER: EPER if the label has several words, else
    LPER), unlinked persons are LPER and unlinked others keep ORG and LOC, else MISC.
    """
    o, e = orgs.select("wd_id").distinct().withColumn("_org", F.lit(True)), events.select("wd_id").distinct().withColumn("_evt", F.lit(True))
    b = bindings.join(o, "wd_id", "left").join(e, "wd_id", "left")
    tells = F.when(F.col("_evt"), "EVENT").when(F.col("_org"), "ORG").when(F.col("is_person"), "PER").when(F.col("is_place"), "LOC")
    b = b.withColumn("_kind", tells).groupBy("wd_id").agg(F.min_by("_kind", F.when(F.col("_kind").isNotNull(), F.col("ord"))).alias("_kind"), F.max("notable").alias("_not"))
    x = entities.join(b, "wd_id", "left")
    person, several = F.col("type") == "PER", F.size(F.split(F.trim("wd_label"), r"\s+")) > 1
    kind = (
        F.when(F.col("_kind") == "PER", F.when(F.col("_not"), "EPER").otherwise("LPER")).when(F.col("_kind").isNotNull(), F.col("_kind"))
        .when(F.col("wd_id") != "unk", F.when(person, F.when(several, "EPER").otherwise("LPER")).otherwise(F.col("type")))
        .when(person, "LPER").when(F.col("type").isin("ORG", "LOC"), F.col("type")).otherwise("MISC")
    )
    return x.select(*entities.columns, kind.alias("resolved"))


def timeline_tree(timelines: DataFrame) -> DataFrame:
    """``video_id, timeline_id, depth, path``: children below parents, siblings by their order, whatever the rows or levels.

    The tree is walked level by level with ordinary joins; each level is written to the folder that all executors share. A
    row whose id its own path has already (ids that are used twice in a circle) isn't followed.
    """
    spark = timelines.sparkSession
    top, paths = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}", []
    step = F.array(F.struct("ord", "timeline_id"))
    level = timelines.where("parent_id is null").select("video_id", "timeline_id", F.lit(0).alias("depth"), step.alias("path"))
    below = timelines.where("parent_id is not null").select("video_id", "timeline_id", F.col("parent_id").alias("_parent"), step.alias("_step"))
    while True:
        paths.append(f"{top}/{len(paths)}")
        level.write.parquet(paths[-1])
        last = spark.read.schema(level.schema).parquet(paths[-1])
        if last.isEmpty():
            return spark.read.schema(last.schema).parquet(*paths)
        above = last.select("video_id", F.col("timeline_id").alias("_parent"), "depth", "path")
        met = below.join(above, ["video_id", "_parent"]).where(~F.array_contains(F.col("path.timeline_id"), F.col("timeline_id")))
        level = met.select("video_id", "timeline_id", (F.col("depth") + 1).alias("depth"), F.concat("path", "_step").alias("path"))


def clone_videos(tables: dict[str, DataFrame], requests: DataFrame) -> dict[str, DataFrame]:
    """Copies of a video's rows for each request (video_id, target_id); ids are made anew from the old id and the target.

    Only runs that are done are copied, and of results, timelines and segments what belongs to them.
    """
    new = lambda c: F.xxhash64(F.col(c), F.col("target_id"))
    out = {}
    keys = {"runs": ["run_id"], "results": ["result_id", "run_id"], "timelines": ["timeline_id", "parent_id", "result_id"], "segments": ["segment_id", "timeline_id"]}
    for name, df in tables.items():
        rows = df.where("status = 'DONE'") if name == "runs" else df
        rows = rows.join(requests.select("video_id", "target_id"), "video_id")
        if name == "results" and "runs" in tables:
            rows = rows.join(tables["runs"].where("status = 'DONE'").select("video_id", "run_id"), ["video_id", "run_id"], "left_semi")
        for c in keys.get(name, []):
            if c in df.columns:
                rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), new(c)))
        out[name] = rows.withColumn("video_id", F.col("target_id")).drop("target_id").select(*df.columns)
    return out


def duplicate_timeline(timelines: DataFrame, segs: DataFrame, links: DataFrame, timeline_id: int, with_annotations: bool = True) -> dict[str, DataFrame]:
    """A timeline once more, with its segments and, if wanted, their annotations."""
    new = lambda c: F.xxhash64(F.col(c), F.lit("copy"))
    own = segs.where(F.col("timeline_id") == timeline_id)
    copied = links.join(own.select("segment_id"), "segment_id", "left_semi") if with_annotations else links.limit(0)
    return {
        "timelines": timelines.where(F.col("timeline_id") == timeline_id).withColumn("timeline_id", new("timeline_id")),
        "segments": own.withColumn("segment_id", new("segment_id")).withColumn("timeline_id", new("timeline_id")),
        "segment_annotations": copied.withColumn("segment_id", new("segment_id")),
    }


def orphaned_data(data: DataFrame, results: DataFrame) -> DataFrame:
    """Data that no result refers to."""
    return data.join(results.select("data_id"), "data_id", "left_anti")
