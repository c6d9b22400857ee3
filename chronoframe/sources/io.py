"""Typed tables, annotation files, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoframe.functions import iso_time
from chronoframe.operators.joins import interval_join
from chronoframe.operators.shots import segment_agg

SCHEMAS = {
    "scalars": "video_id long, series string, series_idx int, time double, y double, delta_time double",
    "segments": "video_id long, timeline_id long, segment_id long, start_s double, end_s double",
    "frame_probs": "video_id long, i long, p double",
    "annotations": "video_id long, name string, start_s double, end_s double, labels array<string>",
    "bboxes": "video_id long, id long, ref_id long, time double, x double, y double, w double, h double, det_score double, delta_time double",
    "faces": "video_id long, id long, ref_id long",
    "embeddings": "video_id long, id long, ref_id long, time double, delta_time double, embedding array<float>",
    "clusters": "video_id long, cluster_rank int, embedding_id long, ref_id long, time double, is_sample boolean",
    "transcripts": "video_id long, segment_id long, start_s double, end_s double, speaker string, text string",
    "timelines": "video_id long, timeline_id long, parent_id long, name string, type string, ord int, result_id long",
    "segment_annotations": "segment_id long, annotation_id long",
    "annotation_dim": "annotation_id long, category_id long, name string, color string",
    "categories": "category_id long, name string, color string",
    "videos": "video_id long, owner_id long, duration double, fps double",
    "users": "user_id long, username string",
    "runs": "run_id long, video_id long, type string, status string, date timestamp",
    "results": "result_id long, run_id long, type string, data_id string",
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the model, with its fixed schema; other names are refused."""
    if name not in SCHEMAS:
        raise KeyError(f"no table type {name!r}")
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")
    return df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])


def save(df: DataFrame, folder: str, name: str, mode: str = "overwrite", by_video: bool = False) -> None:
    """Columns and their types become the model's. A table of videos' rows is written in ranges of videos, sorted, so that

    a filter on videos skips files and row groups; with ``by_video`` (few, large videos) each video has a folder of its own.
    """
    if name not in SCHEMAS:
        raise KeyError(f"no table type {name!r}")
    want = df.sparkSession.createDataFrame([], SCHEMAS[name]).schema
    out = df.select(*[F.col(f.name).cast(f.dataType) for f in want])
    if "video_id" not in out.columns:
        out.write.mode(mode).parquet(f"{folder}/{name}")
    elif by_video:
        out.write.partitionBy("video_id").mode(mode).parquet(f"{folder}/{name}")
    else:
        out.repartitionByRange("video_id", *[c for c in ("time", "start_s", "i") if c in out.columns]).sortWithinPartitions("video_id").write.mode(mode).parquet(f"{folder}/{name}")


#: The parts of an annotation document that are read; inferring it would turn lists of one into structs.
EAF = (
    "TIME_ORDER struct<TIME_SLOT:array<struct<_TIME_SLOT_ID:string,_TIME_VALUE:string>>>, "
    "TIER array<struct<_TIER_ID:string,ANNOTATION:array<struct<ALIGNABLE_ANNOTATION:struct<_ANNOTATION_ID:string,_TIME_SLOT_REF1:string,_TIME_SLOT_REF2:string,ANNOTATION_VALUE:string>>>>>"
)


def read_eaf(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tiers of annotation documents as timelines, segments (seconds) and labels; an empty value is a segment without label."""
    docs = spark.read.format("xml").option("rowTag", "ANNOTATION_DOCUMENT").schema(EAF).load(path).withColumn("doc", F.input_file_name())
    slots = docs.select("doc", F.explode("TIME_ORDER.TIME_SLOT").alias("s")).select("doc", F.col("s._TIME_SLOT_ID").alias("slot"), (F.col("s._TIME_VALUE").cast("int") / 1000).alias("t"))
    tiers = docs.select("doc", F.posexplode("TIER").alias("ord", "t"))
    a = tiers.select("doc", "ord", F.col("t._TIER_ID").alias("name"), F.posexplode("t.ANNOTATION.ALIGNABLE_ANNOTATION").alias("pos", "a"))
    side = lambda n, c: slots.select("doc", F.col("slot").alias(n), F.col("t").alias(c))
    a = a.select("doc", "ord", "name", "pos", F.col("a._TIME_SLOT_REF1").alias("s1"), F.col("a._TIME_SLOT_REF2").alias("s2"), F.col("a.ANNOTATION_VALUE").alias("label"))
    segs = a.join(side("s1", "start_s"), ["doc", "s1"]).join(side("s2", "end_s"), ["doc", "s2"])
    return {
        "timelines": tiers.select("doc", "ord", F.col("t._TIER_ID").alias("name")),
        "segments": segs.select("doc", "name", "pos", "start_s", "end_s"),
        "labels": segs.where("label is not null and label <> ''").select("doc", "name", "pos", "label"),
    }


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, term string").csv(path)


def export_merged(segs: DataFrame, timelines: DataFrame, scalars: DataFrame, cells: DataFrame, names: list[str], videos: DataFrame) -> DataFrame:
    """A row per segment with times in seconds and ISO form, and a column per timeline name.

    ``gap_duration`` runs to the next segment, for the last one to the end of the video (``videos``: ``video_id, duration``).

    ``cells``: (video_id, segment_id, name, value) of annotation timelines; scalar timelines are means, 0.0 where empty.
    """
    nxt = F.lead("start_s").over(W.partitionBy("video_id").orderBy("start_s", "segment_id"))
    base = segs.withColumn("#", F.row_number().over(W.partitionBy("video_id").orderBy("start_s", "segment_id")))
    base = base.withColumn("_next", nxt).join(videos.select("video_id", F.col("duration").alias("_d")), "video_id", "left")
    base = base.withColumn("gap_duration", F.coalesce("_next", "_d") - F.col("start_s")).drop("_next", "_d").withColumn("duration", F.col("end_s") - F.col("start_s"))
    for c in ("start_s", "end_s", "gap_duration", "duration"):
        base = base.withColumn(f"{c}_iso", iso_time(F.col(c)))
    means = None
    for n in [n for n in names if n in {r.name for r in timelines.where(F.col("name").isin(names) & (F.col("type") == "scalar")).select("name").distinct().collect()}]:
        m = segment_agg(segs, scalars.where(F.col("series") == n), "mean", 0.0).select("video_id", "segment_id", F.lit(n).alias("name"), F.col("value").cast("string").alias("value"))
        means = m if means is None else means.unionByName(m)
    values = cells if means is None else cells.select("video_id", "segment_id", "name", "value").unionByName(means)
    wide = values.groupBy("video_id", "segment_id").pivot("name", names).agg(F.first("value"))
    return base.join(wide, ["video_id", "segment_id"], "left")


def export_individual(scalars: DataFrame, annotations: DataFrame) -> DataFrame:
    """(timeline, start_s, start_iso, duration, value): samples to five digits; distinct annotations with labels as JSON."""
    s = scalars.select("video_id", F.col("series").alias("timeline"), F.col("time").alias("start_s"), F.lit(None).cast("double").alias("duration"), F.bround("y", 5).cast("string").alias("value"))
    a = annotations.select("video_id", F.col("name").alias("timeline"), "start_s", (F.col("end_s") - F.col("start_s")).alias("duration"), F.when(F.size("labels") > 0, F.to_json("labels")).otherwise("").alias("value")).distinct()
    return s.unionByName(a).withColumn("start_iso", iso_time(F.col("start_s")))


def export_elan_rows(segs: DataFrame, scalars: DataFrame, cells: DataFrame, agg: str = "mean") -> DataFrame:
    """Rows (tier, start_ms, end_ms, value) of scalar tiers over segments and of annotation tiers.

    ``cells``: (video_id, tier, segment_id, start_s, end_s, labels[]); unlabelled segments are ``value:index``; rows without
    length go.
    """
    keys = ["video_id", "segment_id", "start_s", "end_s", "series"]
    fn = {"mean": F.avg, "max": F.max, "min": F.min}[agg]
    sc = interval_join(scalars, segs, "closed").groupBy(*keys).agg(F.bround(fn("y"), 3).alias("v"))
    sc = sc.select("video_id", F.col("series").alias("tier"), "start_s", "end_s", F.concat(F.lit("value:"), F.col("v")).alias("value"))
    i = F.row_number().over(W.partitionBy("video_id", "tier").orderBy("start_s", "segment_id")) - 1
    an = cells.withColumn("_i", i).select("video_id", "tier", "start_s", "end_s", F.when(F.size("labels") > 0, F.array_join("labels", "; ")).otherwise(F.concat(F.lit("value:"), F.col("_i"))).alias("value"))
    an = an.join(sc.select("video_id", "tier").distinct(), ["video_id", "tier"], "left_anti")
    ms = lambda c: (F.col(c) * 1000).cast("long")
    return sc.unionByName(an).select("video_id", "tier", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "value").where("start_ms < end_ms")


def export_scalar(scalars: DataFrame, series: str) -> DataFrame:
    return scalars.where(F.col("series") == series).select("video_id", "time", F.col("y").alias("data"))


def to_documents(results: DataFrame, data: DataFrame) -> DataFrame:
    """A JSON document per result, with its data rows."""
    d = data.groupBy("data_id").agg(F.sort_array(F.collect_list(F.struct("time", "y"))).alias("data"))
    r = results.join(d, "data_id", "left")
    return r.select("result_id", F.to_json(F.struct("result_id", "type", "data_id", "data")).alias("json"))


def export_bundle(timelines: DataFrame, segs: DataFrame, cells: DataFrame, runs: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """All that belongs to videos: timelines, annotated segments, runs that are done, results, and the distinct data ids."""
    return {
        "timelines": timelines,
        "segments": segs.join(cells, ["video_id", "segment_id"], "left"),
        "runs": runs.where("status = 'DONE'"),
        "results": results,
        "data_ids": results.select("data_id").where("data_id is not null").distinct(),
    }


def export_many(videos: DataFrame, owners: list[int], ids: list[int]) -> DataFrame:
    """The videos of the owners and those named."""
    return videos.where(F.col("owner_id").isin(owners) | F.col("video_id").isin(ids))


def dedupe_by_content(df: DataFrame, content: str, key: str) -> dict[str, DataFrame]:
    """Rows with the least key of each content, and the mapping of all keys to it."""
    hashed = df.withColumn("_sha1", F.sha1(F.coalesce(F.col(content), F.lit(""))))
    first = hashed.groupBy("_sha1").agg(F.min(key).alias("kept"))
    mapping = hashed.select("_sha1", key).join(first, "_sha1").select(key, "kept", F.col("_sha1").alias("sha1"))
    return {"rows": df.join(first.select(F.col("kept").alias(key)), key, "left_semi"), "mapping": mapping}
