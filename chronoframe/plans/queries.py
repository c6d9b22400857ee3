"""One query per operator over the supplied tables. Doubles are rounded to nine digits so that engines can be compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe import functions as fn
from chronoframe.operators import boxes, clusters, graphs, joins, scalars, shots, signal, timelines, vectors
from chronoframe.sources import adapters as a
from chronoframe.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__.removeprefix("q_")] = f
    return f


def r9(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


def events_of(s, d):
    return a.scalars(s, d).select("video_id", "series", "time")


# joins in time

@query
def q_interval_join(s, d):
    return joins.interval_join(a.scalars(s, d), a.segments(s, d), "half_open").groupBy("video_id", "segment_id").agg(F.count("*").alias("n"), F.round(F.sum("y"), 9).alias("total"))


@query
def q_overlap_join(s, d):
    return joins.overlap_join(a.segments(s, d), a.segments(s, d, "purchase"), True)


@query
def q_sample_frames(s, d):
    return joins.sample_frames(a.scalars(s, d), a.segments(s, d), True, True, True)


@query
def q_neighbours(s, d):
    return joins.neighbours(a.segments(s, d))


@query
def q_frame_faces(s, d):
    kps = a.bboxes(s, d).select("video_id", "id", "time", "det_score")
    return joins.frame_faces(a.scalars(s, d).select("video_id", "series", "time"), kps).select("video_id", "series", "time", "id")


@query
def q_zip_by_order(s, d):
    x = a.segments(s, d).select("video_id", F.col("start_s").alias("a_start"))
    y = a.segments(s, d, "purchase").select("video_id", F.col("start_s").alias("b_start"))
    return joins.zip_by_order(x, y, "a_start", "b_start")


@query
def q_shot_thumbnails(s, d):
    f = a.frame_probs(s, d).select("video_id", "i", (F.col("video_id") * 1_000_000 + F.col("i")).alias("frame_id"))
    return joins.shot_thumbnails(a.segments(s, d), f, 86_400.0)


@query
def q_face_facts(s, d):
    b = a.bboxes(s, d)
    return joins.face_facts(b.select("video_id", "id"), b.select("video_id", "ref_id", "time"), b, a.clusters(s, d))


@query
def q_timeline_tree(s, d):
    t = joins.timeline_tree(parts(s, d)).select("video_id", "timeline_id", "depth", F.array_join(F.transform("path", lambda p: p["ord"].cast("string")), "/").alias("path"))
    return t


def parts(s, d) -> DataFrame:
    """Lines of an order as a tree of timelines: line n hangs below line n // 2."""
    l = a.table(s, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").cast("long").alias("timeline_id"), (F.col("l_partkey") % 10).cast("int").alias("ord"))
    return l.withColumn("parent_id", F.when(F.col("timeline_id") > 1, F.floor(F.col("timeline_id") / 2)))


@query
def q_clone_videos(s, d):
    wanted = a.videos(s, d).select("video_id", (F.col("video_id") + 1_000_000_000).alias("target_id"))
    out = joins.clone_videos({"runs": a.runs(s, d)}, wanted)["runs"]
    return out.groupBy("video_id").agg(F.count("*").alias("runs"), F.countDistinct("run_id").alias("ids"))


@query
def q_orphaned_data(s, d):
    return joins.orphaned_data(a.table(s, d, "part").select(F.col("p_partkey").alias("data_id")), a.table(s, d, "lineitem").select(F.col("l_suppkey").alias("data_id")))


# scalars

@query
def q_scalar_threshold(s, d):
    return r9(scalars.scalar_threshold(a.scalars(s, d), 0.1, 0.7), "y")


@query
def q_threshold_events(s, d):
    return scalars.threshold_events(a.scalars(s, d), 0.9)


@query
def q_resample_approx(s, d):
    return r9(scalars.resample_approx(a.scalars(s, d), 8), "y")


@query
def q_aggregate_scalars(s, d):
    return r9(scalars.aggregate_scalars(a.scalars(s, d), ["click", "view", "purchase"], "prod"), "y")


@query
def q_aggregate_scalars_or(s, d):
    return r9(scalars.aggregate_scalars(a.scalars(s, d), ["click", "view", "purchase"], "or"), "y")


@query
def q_aggregate_per_time(s, d):
    return r9(scalars.aggregate_per_time(a.scalars(s, d).withColumn("time", F.floor(F.col("time") / 3600).cast("double"))), "y")


@query
def q_aggregate_list_per_time(s, d):
    return r9(scalars.aggregate_list_per_time(a.scalars(s, d).withColumn("time", F.floor(F.col("time") / 86400).cast("double")), "mean"), "y")


@query
def q_min_max_norm(s, d):
    return r9(scalars.min_max_norm(a.scalars(s, d)), "y")


@query
def q_invert_scalar(s, d):
    return r9(scalars.invert_scalar(a.scalars(s, d).withColumn("y", F.col("y") * 2)), "y")


@query
def q_series_bounds(s, d):
    return r9(scalars.series_bounds(a.scalars(s, d)), "upper", "lower")


@query
def q_shot_density(s, d):
    hours = a.segments(s, d).select("video_id", "segment_id", (F.col("start_s") / 3600).alias("start_s"), (F.col("end_s") / 3600).alias("end_s"))
    return r9(scalars.shot_density(hours, 24.0, 0.25), "time", "y")


# shots

@query
def q_annotate_shots(s, d):
    return r9(shots.annotate_shots(a.segments(s, d), a.scalars(s, d)), "mean")


@query
def q_annotate_shots_scalar(s, d):
    return r9(shots.annotate_shots_scalar(a.segments(s, d), a.scalars(s, d)), "mean")


@query
def q_segment_agg(s, d):
    return r9(shots.segment_agg(a.segments(s, d), a.scalars(s, d).where("series = 'view'"), "max", 0.0), "value")


@query
def q_scalar_annotation_style(s, d):
    out = shots.scalar_annotation_style(shots.annotate_shots_scalar(a.segments(s, d), a.scalars(s, d)))
    return r9(out.drop("shown"), "lightness")


@query
def q_face_sizes(s, d):
    return r9(shots.face_sizes(a.bboxes(s, d)), "y")


@query
def q_face_size_labels(s, d):
    seg = a.segments(s, d)
    labels = seg.select("video_id", "segment_id", F.concat(F.lit("size"), F.col("segment_id") % 5).alias("label"))
    return shots.face_size_labels(shots_quality(s, d), seg, labels)


def shots_quality(s, d):
    return boxes.quality_filter(a.bboxes(s, d))


@query
def q_quality_filter(s, d):
    return shots_quality(s, d).select("video_id", "id", "time")


@query
def q_collect_labels(s, d):
    seg = a.segments(s, d)
    out = shots.collect_labels(seg, a.scalars(s, d).where("series = 'view'").select("video_id", "time", F.concat(F.lit("v"), F.floor(F.col("y") * 10)).alias("text")))
    return out.withColumn("labels", F.array_join("labels", ","))


@query
def q_detect_shots(s, d):
    return shots.detect_shots(a.frame_probs(s, d), 0.5, 25.0)


@query
def q_speaker_turns(s, d):
    return r9(shots.speaker_turns(a.transcripts(s, d)), "start_s", "end_s")


@query
def q_active_speaker(s, d):
    f = a.frame_probs(s, d).select("video_id", F.lit(0).alias("track_id"), "i", (F.col("p") - 0.4).alias("score"))
    return r9(shots.active_speaker(f), "ratio", "mean_score")


@query
def q_multi_scale_mean(s, d):
    f = a.scalars(s, d).select("video_id", F.col("series").alias("scale"), "time", "y")
    from pyspark.sql import Window as W

    f = f.withColumn("i", (F.row_number().over(W.partitionBy("video_id", "scale").orderBy("time", "y")) - 1).cast("long"))
    return shots.multi_scale_mean(f.select("video_id", "scale", "i", F.floor(F.col("y") * 8).cast("double").alias("score")))


@query
def q_median_filter(s, d):
    return r9(shots.median_filter(a.frame_probs(s, d).select("video_id", F.lit("x").alias("series"), F.col("i").cast("double").alias("time"), F.col("p").alias("y")), 13), "y")


@query
def q_frame_windows(s, d):
    return shots.frame_windows(a.frame_probs(s, d)).where("kept").groupBy("video_id", "window").agg(F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))


@query
def q_row_batches(s, d):
    return r9(shots.row_batches(a.frame_probs(s, d).withColumn("time", F.col("i") / 5.0), 8, True), "time")


@query
def q_segment_durations(s, d):
    v = a.segments(s, d).groupBy("video_id").agg((F.max("end_s") + 10).alias("duration"))
    return r9(shots.segment_durations(a.segments(s, d), v), "duration", "no_gap")


@query
def q_chunk_segments(s, d):
    seg = a.segments(s, d).withColumn("end_s", F.col("start_s") + (F.col("end_s") - F.col("start_s")) / 10_000)
    return r9(shots.chunk_segments(seg), "chunk_start", "chunk_end")


@query
def q_fill_chunk_bounds(s, d):
    c = a.transcripts(s, d).select("video_id", "segment_id", F.when(F.col("segment_id") > 0, F.col("start_s")).alias("start_s"), F.when(F.col("speaker") == "user", F.col("end_s")).alias("end_s"))
    return r9(shots.fill_chunk_bounds(c, a.videos(s, d)), "start_s", "end_s")


@query
def q_frames_to_annotations(s, d):
    f = a.scalars(s, d).select("video_id", "time", F.col("series").alias("text"))
    return r9(shots.frames_to_annotations(f, 4.0).withColumn("labels", F.array_join("labels", ",")), "start_s", "end_s")


def facts(s, d):
    b = a.bboxes(s, d)
    return joins.face_facts(b.select("video_id", "id"), b.select("video_id", "ref_id", "time"), b, a.clusters(s, d))


@query
def q_shot_sides(s, d):
    return shots.shot_sides(facts(s, d), a.segments(s, d))


@query
def q_shot_reverse_shot(s, d):
    inside = joins.interval_join(a.clusters(s, d), a.segments(s, d), "open").select("video_id", "segment_id", (F.col("cluster") % 2).alias("cluster"))
    first = inside.groupBy("video_id", "segment_id").agg(F.min("cluster").alias("cluster"))
    return shots.shot_reverse_shot(first, a.segments(s, d), 3)


@query
def q_opposition(s, d):
    return shots.opposition(shots.shot_sides(facts(s, d), a.segments(s, d)), a.segments(s, d), 2)


@query
def q_frameshare(s, d):
    return shots.frameshare(shots.shot_sides(facts(s, d), a.segments(s, d)), a.segments(s, d), 2)


@query
def q_intensification(s, d):
    ranks = a.segments(s, d).select("video_id", "segment_id", (F.col("segment_id") * 4 % 5).cast("double").alias("rank"))
    return shots.intensification(ranks, a.segments(s, d))


# vectors and clusters

def asked(s, d, k=3):
    """The query vectors: those of the first rows."""
    return a.embeddings(s, d).where(F.col("id") < k).select("embedding")


@query
def q_cosine_over_time(s, d):
    return r9(vectors.cosine_over_time(a.embeddings(s, d), asked(s, d), normalize=1), "y")


@query
def q_prompt_probs(s, d):
    return r9(vectors.prompt_probs(a.embeddings(s, d), asked(s, d)), "y")


@query
def q_concept_probs(s, d):
    c = a.embeddings(s, d).where("id < 4").select(F.concat(F.lit("c"), F.col("id")).alias("name"), "embedding")
    return r9(vectors.concept_probs(a.embeddings(s, d), c, 10.0), "y")


@query
def q_identify(s, d):
    return r9(vectors.identify(a.embeddings(s, d), asked(s, d, 1)), "y")


@query
def q_element_mean(s, d):
    m = vectors.element_mean(a.embeddings(s, d), ["label"])
    return m.select("label", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.round("v", 9))


def events_as_probs(s, d):
    """Events as class probabilities of chunks: a chunk is an hour."""
    e = a.scalars(s, d).select("video_id", F.floor(F.col("time") / 864_000).alias("segment_id"), F.floor(F.col("time") / 86_400).alias("chunk"), F.col("series").alias("label"), F.col("y").alias("prob"))
    return e.groupBy("video_id", "segment_id", "chunk", "label").agg(F.max("prob").alias("prob"))


@query
def q_merge_topk(s, d):
    return r9(vectors.merge_topk(events_as_probs(s, d)), "prob")


@query
def q_chunk_mean_label(s, d):
    return r9(vectors.chunk_mean_label(events_as_probs(s, d)), "prob")


@query
def q_rollup_probs(s, d):
    p = a.scalars(s, d).groupBy("video_id", F.col("series").alias("label")).agg(F.avg("y").alias("prob")).withColumn("id", F.col("video_id"))
    m = p.select(F.col("label").alias("leaf")).distinct().withColumn("level", F.lit("coarse")).withColumn("parent", F.explode(F.array(F.lit("all"), F.substring("leaf", 1, 1)))).withColumn("weight", F.when(F.col("parent") == "all", 1.0).otherwise(3.0))
    return r9(vectors.rollup_probs(p, m), "prob")


@query
def q_sentiment_label(s, d):
    classes = ["click", "purchase", "view"]
    out = vectors.sentiment_label(events_as_probs(s, d).where(F.col("label").isin(classes)), classes)
    return out.select("video_id", "segment_id", "label", F.round(F.array_max("probs"), 9).alias("top"))


@query
def q_tag_vector(s, d):
    t = a.scalars(s, d).select("video_id", F.lit(0).alias("segment_id"), F.col("series").alias("tag"))
    out = vectors.tag_vector(t, {"click": 0, "view": 1, "purchase": 2}, 3, 4)
    return out.withColumn("counts", F.array_join(F.transform("counts", lambda x: x.cast("string")), ","))


@query
def q_cluster_single_linkage(s, d):
    return clusters.cluster_single_linkage(a.embeddings(s, d), 0.7, 3)


@query
def q_top_clusters(s, d):
    return clusters.top_clusters(clusters.cluster_dbscan(a.embeddings(s, d), 0.7), 2).select("video_id", "id", "cluster_rank", "size")


@query
def q_preview_items(s, d):
    return clusters.preview_items(a.clusters(s, d)).select("video_id", "cluster", "ref_id")


@query
def q_latest_clustering(s, d):
    runs = a.runs(s, d).withColumn("type", F.lit("cluster")).withColumn("date", F.col("run_id"))
    c = a.table(s, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").cast("long").alias("run_id"), (F.col("l_partkey") % 3).alias("cluster"))
    return clusters.latest_clustering(runs, c, "cluster")


# boxes

@query
def q_face_size_filter(s, d):
    b = a.bboxes(s, d)
    return boxes.face_size_filter(b, b.select("video_id", "id"), 0.2)["faces"]


@query
def q_nms(s, d):
    b = a.bboxes(s, d)
    px = b.select("video_id", F.floor(F.col("time") / 86_400).cast("double").alias("time"), "id", F.col("det_score").alias("score"), (F.col("x") * 100).alias("x1"), (F.col("y") * 100).alias("y1"), ((F.col("x") + F.col("w")) * 100).alias("x2"), ((F.col("y") + F.col("h")) * 100).alias("y2"))
    return boxes.nms(px, 0.2)


@query
def q_normalise_boxes(s, d):
    b = a.bboxes(s, d).select("video_id", "id", "time", (F.col("x") * 100 - 5).alias("x1"), (F.col("y") * 100 - 5).alias("y1"), ((F.col("x") + F.col("w")) * 100).alias("x2"), ((F.col("y") + F.col("h")) * 100).alias("y2"))
    return r9(boxes.normalise_boxes(b, 100.0, 100.0), "x", "y", "w", "h")


@query
def q_track_faces(s, d):
    b = a.bboxes(s, d).withColumn("time", F.floor(F.col("time") / 86_400) / 25.0)
    seg = a.segments(s, d).select("video_id", "segment_id", (F.floor(F.col("start_s") / 86_400) / 25.0).alias("start_s"), (F.ceil(F.col("end_s") / 86_400) / 25.0 + 1).alias("end_s"))
    return r9(boxes.track_faces(b, seg, iou=0.05), "x", "y", "w", "h")


@query
def q_merge_lines(s, d):
    b = a.bboxes(s, d).select("video_id", F.floor(F.col("time") / 604_800).cast("double").alias("time"), *[(F.col(c) * 1000).alias(c) for c in "xywh"], F.col("id").cast("string").alias("text"))
    return r9(boxes.merge_lines(b), "x", "y", "w", "h")


# graphs and counts

@query
def q_node_counts(s, d):
    return graphs.node_counts(events_of(s, d), a.segments(s, d), True, 1)


@query
def q_constellation_edges(s, d):
    return graphs.constellation_edges(events_of(s, d), a.segments(s, d), True, 1)


@query
def q_constellation_edges_by_time(s, d):
    e = events_of(s, d).withColumn("time", F.floor(F.col("time") / 86_400).cast("double"))
    return graphs.constellation_edges(e, None, False, 1)


@query
def q_person_graph(s, d):
    return graphs.person_graph(a.clusters(s, d), a.segments(s, d))["edges"]


@query
def q_cluster_items_by_shot(s, d):
    out = graphs.cluster_items_by_shot(a.clusters(s, d), a.segments(s, d))
    return out.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@query
def q_segments_by_second(s, d):
    seg = a.segments(s, d).select("video_id", "segment_id", (F.col("start_s") / 3600).alias("start_s"), (F.col("end_s") / 3600).alias("end_s"))
    return graphs.segments_by_second(seg).groupBy("video_id", "second").agg(F.count("*").alias("n"))


@query
def q_annotations_by_second(s, d):
    seg = a.segments(s, d).select("video_id", "segment_id", (F.col("start_s") / 3600).alias("start_s"), (F.col("end_s") / 3600).alias("end_s"))
    return graphs.annotations_by_second(seg).groupBy("video_id", "second").agg(F.count("*").alias("n"))


@query
def q_usage_stats(s, d):
    users = a.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return graphs.usage_stats(users, a.videos(s, d), a.runs(s, d), [1, 2, 3])


@query
def q_video_progress(s, d):
    return r9(graphs.video_progress(a.videos(s, d), a.runs(s, d)), "progress")


@query
def q_timeline_counts(s, d):
    return graphs.timeline_counts(parts(s, d))


@query
def q_exclude_names(s, d):
    n = a.table(s, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    return graphs.exclude_names(n, n.where("n_regionkey = 1")).select("name")


@query
def q_unordered_pairs(s, d):
    return graphs.unordered_pairs(a.scalars(s, d), "video_id", "series")


@query
def q_word_cloud(s, d):
    stop = a.table(s, d, "nation").select(F.lower("n_name").alias("word")).union(s.sql("select explode(array('the', 'die', 'and', 'und', 'la'))"))
    return r9(graphs.word_cloud(a.table(s, d, "documents").select("text"), stop), "size")


def notes(s, d):
    """Parts as annotations of orders: (annotation_id, name, category_id), links, categories, and segments."""
    l = a.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    segs = l.select(F.col("l_orderkey").alias("video_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("segment_id"), F.col("l_orderkey").alias("timeline_id"), (F.col("l_linenumber") * 10.0).alias("start_s"), (F.col("l_linenumber") * 10.0 + F.col("l_partkey") % 20).alias("end_s"))
    links = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("segment_id"), (F.col("l_partkey") % 50).alias("annotation_id"))
    dim = s.range(50).select(F.col("id").alias("annotation_id"), F.concat(F.lit("note"), F.col("id")).alias("name"), F.when(F.col("id") % 3 < 2, F.col("id") % 3).alias("category_id"))
    cats = s.range(2).select(F.col("id").alias("category_id"), F.when(F.col("id") == 0, "Transcript").otherwise("Mood").alias("category_name"))
    return segs, links, dim, cats


@query
def q_transcript_segments(s, d):
    return graphs.transcript_segments(*notes(s, d))


@query
def q_non_transcripts(s, d):
    segs, links, dim, cats = notes(s, d)
    return links.join(graphs.non_transcripts(dim, cats), "annotation_id").groupBy("name").agg(F.count("*").alias("n"))


@query
def q_search_transcripts(s, d):
    return graphs.search_transcripts(a.transcripts(s, d), "Tion").select("video_id", "segment_id")


# timelines and their edits

@query
def q_annotation_cells(s, d):
    return timelines.annotation_cells(*notes(s, d))


@query
def q_annotation_cells_by_target(s, d):
    segs, *rest = notes(s, d)
    target = segs.where("segment_id % 2 = 1").withColumn("start_s", F.col("start_s") + 4).withColumn("end_s", F.col("end_s") + 9)
    return timelines.annotation_cells(segs, *rest, target=target)


@query
def q_overlap_join_closed(s, d):
    segs = notes(s, d)[0]
    return joins.overlap_join(segs, segs.withColumn("start_s", F.col("end_s")).withColumn("end_s", F.col("end_s") + 10), strict=False)


@query
def q_split_segments(s, d):
    segs, links, _, _ = notes(s, d)
    out = timelines.split_segments(segs, links, segs.where("segment_id % 3 = 0").select("segment_id", (F.col("start_s") + 4).alias("t")))["segments"]
    return out.select("video_id", "start_s", "end_s")


@query
def q_merge_segments(s, d):
    segs, links, _, _ = notes(s, d)
    out = timelines.merge_segments(segs, links, segs.where("segment_id % 10 <= 2 and video_id % 2 = 0").select(F.col("video_id").alias("edit_id"), "segment_id"))
    return out["segments"].select("video_id", "start_s", "end_s")


@query
def q_annotate_range(s, d):
    segs, links, _, _ = notes(s, d)
    edits = segs.select("timeline_id").distinct().select("timeline_id", F.lit(12.0).alias("a"), F.lit(25.0).alias("b"), F.lit(1).cast("long").alias("annotation_id"))
    return timelines.annotate_range(segs, links, edits)["segments"].select("video_id", "start_s", "end_s")


@query
def q_split_segments_often(s, d):
    """Three cuts of every third segment, one of them beyond short segments, and their annotations."""
    segs, links, _, _ = notes(s, d)
    cuts = segs.where("segment_id % 3 = 0").select("segment_id", F.explode(F.array(*[F.col("start_s") + k for k in (9, 4, 7)])).alias("t"))
    out = timelines.split_segments(segs, links, cuts)
    return out["segments"].join(out["segment_annotations"], "segment_id").select("video_id", "start_s", "end_s", "annotation_id")


@query
def q_merge_segments_in_order(s, d):
    """Two merges of a timeline that share a segment: the second one merges what the first one made."""
    segs, links, _, _ = notes(s, d)
    line = F.col("segment_id") % 10
    edits = [segs.where(line.isin(*lines)).select((F.col("timeline_id") * 2 + k).alias("edit_id"), "segment_id") for k, lines in enumerate(((1, 3), (3, 5)))]
    out = timelines.merge_segments(segs, links, edits[1].unionByName(edits[0]))
    return out["segments"].join(out["segment_annotations"].distinct(), "segment_id").select("video_id", "start_s", "end_s", "annotation_id")


@query
def q_annotate_ranges(s, d):
    """Overlapping ranges written over a timeline one after the other, two annotations each."""
    segs, links, _, _ = notes(s, d)
    edits = segs.where("segment_id % 4 < 2").select("timeline_id", F.col("segment_id").alias("edit_id"), (F.col("start_s") + 1).alias("a"), (F.col("start_s") + 1 + F.col("segment_id") % 37).alias("b"), F.explode(F.array(F.lit(100).cast("long"), 200 + F.col("segment_id") % 10)).alias("annotation_id"))
    out = timelines.annotate_range(segs, links, edits)
    return out["segments"].join(out["segment_annotations"], "segment_id").select("video_id", "start_s", "end_s", "annotation_id")


@query
def q_merge_clusters_in_order(s, d):
    c = a.clusters(s, d).select("video_id", "cluster", "ref_id")
    edits = s.createDataFrame([(4, 1, 1), (2, 2, 1), (3, 3, 0), (1, 3, 2)], "edit_id long, from_id long, to_id long")
    return timelines.merge_clusters(c, edits).groupBy("video_id", "cluster").agg(F.count("*").alias("n"))


@query
def q_replace_annotations(s, d):
    _, links, dim, _ = notes(s, d)
    edits = links.where("segment_id % 5 = 0").select("segment_id", F.lit("note4").alias("name"), F.lit(1).cast("long").alias("category_id"))
    return timelines.replace_annotations(links, dim, edits)["segment_annotations"].groupBy("annotation_id").agg(F.count("*").alias("n"))


@query
def q_toggle_annotations(s, d):
    _, links, _, _ = notes(s, d)
    edits = links.where("segment_id % 4 = 0").withColumn("annotation_id", F.when(F.col("segment_id") % 8 == 0, F.lit(7).cast("long")).otherwise(F.col("annotation_id")))
    return timelines.toggle_annotations(links, edits)


@query
def q_merge_clusters(s, d):
    c = a.clusters(s, d).select("video_id", "cluster", "ref_id")
    edits = s.range(1).select(F.lit(3).cast("long").alias("from_id"), F.lit(1).cast("long").alias("to_id"))
    return timelines.merge_clusters(c, edits).groupBy("video_id", "cluster").agg(F.count("*").alias("n"))


@query
def q_delete_items(s, d):
    c = a.clusters(s, d).select("video_id", "cluster", "ref_id")
    return timelines.delete_items(c, c.where("ref_id % 3 = 0")).groupBy("video_id").agg(F.count("*").alias("n"))


@query
def q_new_timeline(s, d):
    return r9(timelines.new_timeline(a.videos(s, d), "notes")["segments"].select("video_id", "start_s", "end_s"), "end_s")


@query
def q_annotations_to_timeline(s, d):
    n = a.segments(s, d).select("video_id", F.concat(F.lit("tier"), F.col("segment_id") % 2).alias("name"), "start_s", "end_s", F.array(F.concat(F.lit("l"), F.col("segment_id") % 7)).alias("labels"))
    out = timelines.annotations_to_timeline(n, "Mood")
    return out["segments"].join(out["timelines"], ["video_id", "timeline_id"]).groupBy("video_id", "name").agg(F.count("*").alias("n"))


@query
def q_reorder_timelines(s, d):
    order = parts(s, d).groupBy("video_id").agg(F.array(F.max("timeline_id")).alias("ids"))
    return timelines.reorder_timelines(parts(s, d), order).select("video_id", "timeline_id", "ord")


@query
def q_next_timeline(s, d):
    return timelines.next_timeline(parts(s, d))


@query
def q_segments_at(s, d):
    return timelines.segments_at(a.segments(s, d), 604_800.0).select("video_id", "segment_id")


@query
def q_affected_segments(s, d):
    seg = a.segments(s, d).select((F.col("video_id") * 10_000 + F.col("segment_id")).alias("segment_id"), "start_s")
    return timelines.affected_segments(seg.where("start_s < 1e6"), seg.where("start_s > 5e5"))


# signal

def signal_of(s, d):
    """Values of a series as samples."""
    return a.frame_probs(s, d).select("video_id", "i", (F.col("p") - 0.5).alias("y"), F.lit(16).alias("sr"))


@query
def q_audio_rms(s, d):
    return r9(signal.audio_rms(signal_of(s, d), 4, 16), "time", "y")


@query
def q_audio_amplitude(s, d):
    return r9(signal.audio_amplitude(signal_of(s, d), 64), "time", "y")


@query
def q_spectrogram(s, d):
    out = signal.spectrogram(signal_of(s, d), 16)
    return r9(out.select("video_id", "frame", "time", F.posexplode("bins").alias("bin", "db")), "time", "db")


def pixels_of(s, d):
    l = a.table(s, d, "lineitem")
    return l.select((F.col("l_orderkey") % 50).alias("video_id"), F.col("l_orderkey").alias("frame_idx"), (F.col("l_partkey") * 7 % 256).cast("int").alias("r"), (F.col("l_suppkey") * 11 % 256).cast("int").alias("g"), (F.col("l_linenumber") * 31 % 256).cast("int").alias("b"))


@query
def q_frame_brightness(s, d):
    return r9(signal.frame_brightness(pixels_of(s, d)), "y")


@query
def q_dominant_colors(s, d):
    return r9(signal.dominant_colors(pixels_of(s, d), 1), *"rgb")


@query
def q_dominant_colors_k(s, d):
    return r9(signal.dominant_colors(pixels_of(s, d), 2), *"rgb")


# functions

@query
def q_time_formats(s, d):
    t = F.col("time") / 7
    return a.scalars(s, d).select("video_id", "time", fn.iso_time(t).alias("iso"), fn.display_time(t).alias("shown"), fn.timecode(t).alias("code")).distinct()


@query
def q_colors(s, d):
    p = pixels_of(s, d).select("r", "g", "b").distinct()
    return p.select("r", "g", "b", fn.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"), fn.prob_to_hex(F.col("r") / 255.0).alias("prob_hex"), fn.closest_color(*map(F.col, "rgb")).alias("name"))


@query
def q_luminance(s, d):
    p = pixels_of(s, d).select("r", "g", "b").distinct().withColumn("hex", fn.rgb_to_hex(*map(F.col, "rgb")))
    return p.select("hex", F.round(fn.luminance(F.col("hex")), 9).alias("luminance"), fn.label_color(F.col("hex")).rlike("^#[7-9a-f][0-9a-f][7-9a-f][0-9a-f][7-9a-f][0-9a-f]$").alias("bright"))


@query
def q_linear_map(s, d):
    return a.scalars(s, d).select("y").distinct().select("y", fn.linear_map(F.col("y"), 0.2, 0.8).alias("hex"))


@query
def q_snake_case(s, d):
    n = a.table(s, d, "nation").select(F.regexp_replace(F.initcap(F.lower("n_name")), " ", "").alias("camel"))
    return n.select("camel", fn.snake_case(F.col("camel")).alias("snake"))


@query
def q_truncate_label(s, d):
    return a.table(s, d, "documents").select("doc_id", fn.truncate_label(F.col("text"), 100).alias("label"))


@query
def q_box_iou(s, d):
    b = a.bboxes(s, d)
    from pyspark.sql import Window as W

    w = W.partitionBy("video_id").orderBy("time", "id")
    box = F.struct("x", "y", "w", "h")
    return r9(b.select("video_id", "id", box.alias("b"), F.lag(box).over(w).alias("p")).where("p is not null").select("video_id", "id", fn.iou_xywh(F.col("p"), F.col("b")).alias("iou")), "iou")


# exports

def steps(s, d):
    """The scalars in steps of 1/64: their sums are exact, and their texts are the same everywhere."""
    return a.scalars(s, d).withColumn("y", F.floor(F.col("y") * 64) / 64)


def elan_rows(s, d, agg):
    seg = a.segments(s, d)
    cells = seg.select("video_id", F.lit("notes").alias("tier"), "segment_id", "start_s", "end_s", F.when(F.col("segment_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    return io.export_elan_rows(seg, steps(s, d), cells, agg)


@query
def q_export_elan_rows(s, d):
    return elan_rows(s, d, "mean")


@query
def q_export_elan_rows_max(s, d):
    return elan_rows(s, d, "max")


@query
def q_export_elan_rows_min(s, d):
    return elan_rows(s, d, "min")


@query
def q_export_scalar(s, d):
    return r9(io.export_scalar(a.scalars(s, d), "view"), "data")


@query
def q_export_many(s, d):
    return r9(io.export_many(a.videos(s, d), [1, 2, 3], [7, 32]), "duration")


@query
def q_export_individual(s, d):
    seg = a.segments(s, d)
    n = seg.select("video_id", F.lit("tier").alias("name"), "start_s", "end_s", F.array(F.concat(F.lit("l"), F.col("segment_id"))).alias("labels"))
    return io.export_individual(steps(s, d), n).select("video_id", "timeline", "start_s", "value")


@query
def q_dedupe_by_content(s, d):
    return io.dedupe_by_content(a.table(s, d, "documents").select("doc_id", "text"), "text", "doc_id")["mapping"]


# further compositions

@query
def q_cluster_to_scalar(s, d):
    e = a.embeddings(s, d)
    c = e.select((F.col("id") % 5).alias("cluster"), F.col("id").alias("ref_id"), (F.col("id") % 2 == 0).alias("is_sample"))
    return r9(vectors.cluster_to_scalar(c, e, 1, e), "y")


@query
def q_prob_timelines(s, d):
    classes = ["click", "purchase", "view"]
    return vectors.prob_timelines(vectors.sentiment_label(events_as_probs(s, d).where(F.col("label").isin(classes)).withColumn("prob", F.floor(F.col("prob") * 16) / 16), classes), classes)


@query
def q_first_chunk_label(s, d):
    return r9(vectors.first_chunk_label(first_chunks(s, d)), "prob")


def first_chunks(s, d):
    p = events_as_probs(s, d)
    return p.join(p.groupBy("video_id", "segment_id").agg(F.min("chunk").alias("_c")), ["video_id", "segment_id"]).withColumn("chunk", F.col("chunk") - F.col("_c")).drop("_c")


@query
def q_cluster_places(s, d):
    e = a.embeddings(s, d)
    return clusters.cluster_places(e, e.select("video_id", "id", F.concat(F.lit("place"), "label").alias("place")), 0.7).groupBy("video_id", "cluster_rank").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("place").alias("place"))


@query
def q_face_clustering(s, d):
    e = a.embeddings(s, d).withColumn("ref_id", F.col("id"))
    b = e.select("video_id", "id", "ref_id", ((F.col("id") % 20) / 40.0).alias("h"))
    return clusters.face_clustering(b, b.select("video_id", "id"), e, 0.7, 3).select("video_id", "name", "id", "time")


@query
def q_place_clustering(s, d):
    e = a.embeddings(s, d)
    return clusters.place_clustering(e.select("video_id", "time").distinct(), e, 0.7, 3).select("video_id", "name", "id", "time")


def mentions(s, d):
    i = a.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("u"))
    start = F.col("l_linenumber") * 10
    kind = F.element_at(F.array(*map(F.lit, ("PER", "ORG", "LOC", "MISC", "DATE"))), (F.col("p") % 5 + 1).cast("int"))
    m = i.select(F.col("l_orderkey").alias("seg_id"), start.cast("int").alias("start_c"), (start + 5).cast("int").alias("end_c"), F.concat(F.lit("p"), F.col("p") % 50).alias("text"), kind.alias("type"))
    at = start + F.col("u") % 7 - 3
    c = i.where("p % 3 > 0").select(F.col("l_orderkey").alias("seg_id"), at.cast("int").alias("ch_from"), (at + 4).cast("int").alias("ch_to"), ((F.col("p") % 1000) / 100000.0).alias("page_rank"), F.concat(F.lit("Q"), F.col("u") % 100).alias("wd_id"), F.when(F.col("p") % 2 == 0, "one").otherwise("two words").alias("wd_label"))
    f = s.range(25).select(F.concat(F.lit("p"), F.col("id")).alias("surface"), F.concat(F.lit("F"), F.col("id")).alias("wd_id"))
    return m, c, f


@query
def q_link_entities(s, d):
    return joins.link_entities(*mentions(s, d))


@query
def q_resolve_entity_types(s, d):
    linked = joins.link_entities(*mentions(s, d))
    n = F.substring("wd_id", 2, 9).cast("int")
    ids = s.range(100).select(F.concat(F.lit("Q"), "id").alias("wd_id"))
    b = ids.crossJoin(F.broadcast(s.range(2))).select("wd_id", F.col("id").alias("ord"), ((n % 4 == 0) & (F.col("id") == 1)).alias("is_person"), (n % 8 == 0).alias("notable"), ((n % 3 == 0) & (F.col("id") == 0)).alias("is_place"))
    out = joins.resolve_entity_types(linked, b, ids.where(n % 10 == 1), ids.where(n % 10 == 2))
    return out.groupBy("type", "resolved").agg(F.count("*").alias("n"))


@query
def q_move_items(s, d):
    c = a.clusters(s, d).select("video_id", "cluster", "ref_id")
    return timelines.move_items(c, c.where("ref_id % 3 = 0").select("ref_id", F.lit(0).cast("long").alias("cluster"))).groupBy("video_id", "cluster").agg(F.count("*").alias("n"))


@query
def q_to_documents(s, d):
    data = a.table(s, d, "events").select(F.col("user_id").cast("string").alias("data_id"), F.col("event_id").cast("double").alias("time"), F.floor("value").alias("y"))
    results = a.table(s, d, "customer").select(F.col("c_custkey").alias("result_id"), F.lit("scalar").alias("type"), F.col("c_custkey").cast("string").alias("data_id"))
    out = io.to_documents(results, data.withColumn("time", F.col("time").cast("long")))
    return out.select("result_id", F.get_json_object("json", "$.data[0].time").cast("long").alias("first_time"), F.length("json").cast("long").alias("chars"))


@query
def q_export_merged(s, d):
    seg = a.segments(s, d)
    cells = seg.select("video_id", "segment_id", F.lit("notes").alias("name"), F.concat(F.lit("n"), F.col("segment_id") % 3).alias("value"))
    names = s.createDataFrame([("notes", "annotation")], "name string, type string")
    v = seg.groupBy("video_id").agg((F.max("end_s") + 10).alias("duration"))
    return io.export_merged(seg, names, a.scalars(s, d), cells, ["notes"], v).select("video_id", "segment_id", "#", "start_s_iso", F.round("duration", 9).alias("duration"), F.round("gap_duration", 9).alias("gap_duration"), "notes")


@query
def q_export_bundle(s, d):
    seg = a.segments(s, d)
    results = a.runs(s, d).select("video_id", "run_id", "status", F.when(F.col("run_id") % 2 == 0, F.concat(F.lit("d"), F.col("video_id") % 100)).alias("data_id"))
    return io.export_bundle(seg, seg, seg.select("video_id", "segment_id"), results, results)["data_ids"]


@query
def q_softmax(s, d):
    e = a.embeddings(s, d).select("id", F.slice(F.col("embedding"), 1, 3).alias("v"))
    p = fn.softmax_t(F.transform("v", lambda x: x.cast("double")), 0.1)
    return e.select("id", *[F.round(p[k], 9).alias(f"p{k}") for k in range(3)])


@query
def q_label_map(s, d):
    return a.scalars(s, d).select("video_id", fn.map_label(F.col("series"), {"click": "Click", "view": "View"}).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query
def q_clean_ocr_text(s, d):
    t = F.concat(F.lit("a <img>"), F.col("region.r_name"), F.lit("</img> b<watermark>x</watermark>"), F.col("region.r_name"))
    return a.table(s, d, "region").alias("region").select("r_regionkey", fn.clean_ocr_text(t).alias("text"))
