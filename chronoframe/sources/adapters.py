"""The canonical tables as views of the supplied star schema, and the same views as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds():
    return F.round(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6, 6)


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_type").alias("series"), _seconds().alias("time"), F.least(F.col("value") / 500.0, F.lit(1.0)).alias("y"))


def segments(spark: SparkSession, sf_dir: str, series: str = "signup") -> DataFrame:
    w = W.partitionBy("video_id").orderBy("start_s")
    s = scalars(spark, sf_dir).where(F.col("series") == series).select("video_id", F.col("time").alias("start_s"))
    s = s.withColumn("end_s", F.lead("start_s").over(w)).where("end_s is not null")
    return s.select("video_id", F.row_number().over(W.partitionBy("video_id").orderBy("start_s", "end_s")).cast("long").alias("segment_id"), "start_s", "end_s")


def frame_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), _seconds().alias("t"), "event_id", F.least(F.col("value") / 200.0, F.lit(1.0)).alias("p"))
    return e.select("video_id", (F.row_number().over(W.partitionBy("video_id").orderBy("t", "event_id")) - 1).cast("long").alias("i"), "p")


def bboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, h = table(spark, sf_dir, "events"), F.col("event_id")
    part = lambda mul, mod, add: (h * mul % mod + add) / 100.0
    return e.select(
        F.col("user_id").alias("video_id"), h.alias("id"), h.alias("ref_id"), _seconds().alias("time"),
        part(37, 80, 0).alias("x"), part(53, 70, 0).alias("y"), part(11, 16, 5).alias("w"), part(7, 26, 5).alias("h"), part(29, 100, 0).alias("det_score"),
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), (F.col("event_id") * 13 % 4).alias("cluster"), F.col("event_id").alias("ref_id"), _seconds().alias("time"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("video_id"), F.col("vec_id").alias("id"), (F.floor(F.col("vec_id") / 20).cast("double") / 2).alias("time"), "embedding", "label")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn").cast("double") * 10
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").cast("long").alias("segment_id"), t.alias("start_s"), (t + 9.995).alias("end_s"), F.col("role").alias("speaker"), "text")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("owner_id"), (F.col("o_totalprice").cast("double") / 1000.0 * 60).alias("duration"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "DONE").when(F.col("l_returnflag") == "R", "RUNNING").otherwise("QUEUED")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").cast("long").alias("run_id"), status.alias("status"))


T = "round((epoch_us(ts) - 1704067200000000) / 1e6, 6)"
#: name → DuckDB text of the same view; later ones may use those before.
SQL = {
    "a_scalars": f"SELECT user_id AS video_id, event_type AS series, {T} AS time, least(value / 500.0, 1.0)::DOUBLE AS y FROM events",
    "a_segments": "SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_s, end_s) AS segment_id, start_s, end_s FROM "
    "(SELECT video_id, time AS start_s, lead(time) OVER (PARTITION BY video_id ORDER BY time) AS end_s FROM a_scalars WHERE series = 'signup') q WHERE end_s IS NOT NULL",
    "a_frames": f"SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY {T}, event_id) - 1 AS i, least(value / 200.0, 1.0)::DOUBLE AS p FROM events",
    "a_bboxes": f"SELECT user_id AS video_id, event_id AS id, event_id AS ref_id, {T} AS time, (event_id * 37 % 80) / 100.0::DOUBLE AS x, (event_id * 53 % 70) / 100.0::DOUBLE AS y, "
    "(event_id * 11 % 16 + 5) / 100.0::DOUBLE AS w, (event_id * 7 % 26 + 5) / 100.0::DOUBLE AS h, (event_id * 29 % 100) / 100.0::DOUBLE AS det_score FROM events",
    "a_clusters": f"SELECT user_id AS video_id, event_id * 13 % 4 AS cluster, event_id AS ref_id, {T} AS time FROM events",
    "a_embeddings": "SELECT vec_id % 10 AS video_id, vec_id AS id, CAST(floor(vec_id / 20) AS DOUBLE) / 2 AS time, embedding, label FROM embeddings",
    "a_transcripts": "SELECT conv_id AS video_id, turn::BIGINT AS segment_id, CAST(turn * 10 AS DOUBLE) AS start_s, CAST(turn * 10 AS DOUBLE) + 9.995 AS end_s, role AS speaker, text FROM conversations",
    "a_videos": "SELECT o_orderkey AS video_id, o_custkey AS owner_id, o_totalprice::DOUBLE / 1000.0 * 60 AS duration FROM orders",
    "a_runs": "SELECT l_orderkey AS video_id, l_linenumber::BIGINT AS run_id, CASE l_returnflag WHEN 'A' THEN 'DONE' WHEN 'R' THEN 'RUNNING' ELSE 'QUEUED' END AS status FROM lineitem",
}


def with_views(sql: str, *names: str, extra: str = "") -> str:
    """A query over the named views (and what they need)."""
    need = [n for n in SQL if n in names or (n == "a_scalars" and "a_segments" in names)]
    views = ", ".join([*(f"{n} AS ({SQL[n]})" for n in need), *([extra] if extra else [])])
    return f"WITH RECURSIVE {views} {sql}"
