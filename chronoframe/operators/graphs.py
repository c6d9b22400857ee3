"""Counts and co-occurrence graphs over shots and times, usage statistics, words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoframe.operators.joins import interval_join


def _places(events: DataFrame, shots: DataFrame | None, by_shot: bool) -> DataFrame:
    """(video, series, place): the shots that hold a timestamp of the series, or its timestamps."""
    if by_shot:
        return interval_join(events, shots, "closed").select("video_id", "series", F.col("segment_id").cast("double").alias("place")).distinct()
    return events.select("video_id", "series", F.col("time").alias("place"))


def node_counts(events: DataFrame, shots: DataFrame | None, by_shot: bool, min_node: int = 3) -> DataFrame:
    return _places(events, shots, by_shot).groupBy("video_id", "series").agg(F.count("*").alias("n")).where(F.col("n") >= min_node)


def constellation_edges(events: DataFrame, shots: DataFrame | None, by_shot: bool, min_edge: int = 3) -> DataFrame:
    """Unordered pairs of series of a video and the number of places of the first that the second has too."""
    p = _places(events, shots, by_shot)
    a = p.groupBy("video_id", "place", F.col("series").alias("a")).agg(F.count("*").alias("_n"))
    b = p.select("video_id", "place", F.col("series").alias("b")).distinct()
    return a.join(b, ["video_id", "place"]).where("a < b").groupBy("video_id", "a", "b").agg(F.sum("_n").alias("n")).where(F.col("n") >= min_edge)


def person_graph(clusters: DataFrame, shots: DataFrame, by_shot: bool = True, min_size: int = 0, min_rel: int = 0) -> dict[str, DataFrame]:
    """Clusters of at least ``min_size`` members as nodes; edges where they meet more than ``min_rel`` times."""
    sizes = clusters.groupBy("video_id", "cluster").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    own = clusters.join(sizes.select("video_id", "cluster"), ["video_id", "cluster"], "left_semi").select("video_id", F.col("cluster").cast("string").alias("series"), "time")
    return {"nodes": sizes, "edges": constellation_edges(own, shots, by_shot, min_rel + 1)}


def cluster_items_by_shot(clusters: DataFrame, shots: DataFrame, n: int = 5) -> DataFrame:
    """The first n items of each cluster in each shot, bounds and times to whole seconds, end excluded."""
    second = lambda c: F.floor(F.col(c) + 0.5).cast("double")
    s = shots.select("video_id", "segment_id", second("start_s").alias("start_s"), second("end_s").alias("end_s"))
    hit = interval_join(clusters.withColumn("time", second("time")), s, "half_open")
    items = F.transform(F.sort_array(F.collect_list(F.struct("time", "ref_id"))), lambda x: x["ref_id"])
    return hit.groupBy("video_id", "segment_id", "cluster").agg(F.count("*").alias("n"), F.slice(items, 1, n).alias("items"))


def segments_by_second(segs: DataFrame) -> DataFrame:
    first, last = F.floor("start_s"), F.ceil("end_s") - 1
    return segs.where(last >= first).select("video_id", F.explode(F.sequence(F.floor("start_s"), F.ceil("end_s") - 1)).alias("second"), "segment_id")


def annotations_by_second(segs: DataFrame) -> DataFrame:
    """Whole seconds t with start <= t < end."""
    s = segs.withColumn("_a", F.ceil("start_s")).withColumn("_b", F.ceil("end_s") - 1).where("_b >= _a")
    return s.select("video_id", F.explode(F.sequence("_a", "_b")).alias("second"), "segment_id")


def usage_stats(users: DataFrame, videos: DataFrame, runs: DataFrame, blacklist: list[int] | None = None) -> DataFrame:
    """One row of totals: users, all and by number of videos; their videos, all, by length and by number of runs."""
    u = users.where(~F.col("user_id").isin(blacklist)) if blacklist else users
    v = videos.join(u.select(F.col("user_id").alias("owner_id")), "owner_id", "left_semi")
    r = runs.join(v.select("video_id"), "video_id", "left_semi")
    per_user = v.groupBy("owner_id").agg(F.count("*").alias("n"))
    per_video = r.groupBy("video_id").agg(F.count("*").alias("n"))
    owners = u.select(F.col("user_id").alias("owner_id")).join(per_user, "owner_id", "left")
    totals = owners.agg(F.count("*").alias("users_all"), *[F.count_if(F.col("n") >= k).alias(f"users_{k}") for k in (5, 10, 50)])
    lengths = v.agg(F.count("*").alias("videos_all"), *[F.count_if(F.col("duration") >= k * 60).alias(f"videos_{k}min") for k in (10, 60)], F.round(F.sum("duration") / 60, 3).alias("minutes"))
    counts = per_video.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("runs"), *[F.count_if(F.col("n") >= k).alias(f"videos_{k}runs") for k in (5, 10, 20)])
    # three one-row tables side by side
    key = F.lit(0).alias("_k")
    return totals.withColumn("_k", F.lit(0)).join(lengths.withColumn("_k", F.lit(0)), "_k").join(counts.select("*", key), "_k").drop("_k")


def video_progress(videos: DataFrame, runs: DataFrame) -> DataFrame:
    """Percent of a video's runs that neither run nor wait; null without runs."""
    r = runs.groupBy("video_id").agg((100.0 * F.count_if(~F.col("status").isin("RUNNING", "QUEUED")) / F.count("*")).alias("progress"))
    return videos.select("video_id").join(r, "video_id", "left")


def timeline_counts(timelines: DataFrame) -> DataFrame:
    return timelines.groupBy("video_id").agg(F.count("*").alias("n"))


def exclude_names(df: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    return df.join(names.select(column), column, "left_anti")


def unordered_pairs(df: DataFrame, group: str, key: str) -> DataFrame:
    """Each pair of different keys of a group once."""
    d = df.select(group, key).distinct()
    return d.select(group, F.col(key).alias("a")).join(d.select(group, F.col(key).alias("b")), group).where("a < b")


def word_cloud(texts: DataFrame, stopwords: DataFrame, k: int = 40) -> DataFrame:
    """The k most frequent words: split at spaces, one closing comma or full stop off, lower case; size in percent of the top."""
    raw = texts.select(F.explode(F.split("text", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("_n"))  # cleaned once for each distinct word
    w = raw.select(F.lower(F.regexp_replace("w", r"[,.]\z", "")).alias("word"), "_n")
    w = w.where(~F.col("word").isin("", "..", ".", "?", "!")).groupBy("word").agg(F.sum("_n").alias("n"))
    w = w.join(stopwords.select("word"), "word", "left_anti").orderBy(F.desc("n"), "word").limit(k)
    return w.select("word", "n", (F.col("n") / F.max("n").over(W.partitionBy(F.lit(0))) * 100).alias("size"))  # over k rows


def transcript_segments(segs: DataFrame, links: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Segments whose annotation is a transcript, numbered from 1 by start."""
    c = categories.where("category_name = 'Transcript'").select("category_id")
    a = annotations.join(c, "category_id", "left_semi").select("annotation_id", F.col("name").alias("text"))
    s = segs.join(links, "segment_id").join(a, "annotation_id")
    return s.select("video_id", "segment_id", "start_s", "end_s", "text", F.row_number().over(W.partitionBy("video_id").orderBy("start_s", "segment_id")).alias("number"))


def non_transcripts(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    c = categories.select("category_id", "category_name")
    return annotations.join(c, "category_id", "left").where("category_name is null or category_name <> 'Transcript'").drop("category_name")


def search_transcripts(df: DataFrame, query: str) -> DataFrame:
    return df.where(F.lower("text").contains(query.lower())) if query else df
