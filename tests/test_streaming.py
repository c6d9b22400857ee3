"""Streams give what the batch operators give once the watermark has passed."""

from pyspark.sql import functions as F

from chronoframe.operators import scalars
from chronoframe.streaming import per_time


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(1, "a", k // 2, 0.25 * (k % 3)) for k in range(200, 240)] + [(1, "a", 10_000, 0.0)]
    df = spark.createDataFrame(rows, "video_id long, series string, time long, y double").withColumn("ts", F.timestamp_seconds("time"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("per_time", per_time.aggregate_per_time(stream)), ("windows", per_time.window_mean(stream, "5 seconds"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    want = {r.time: round(r.y, 9) for r in scalars.aggregate_per_time(df.where("time < 10000")).collect()}
    got = {int(r.t): round(r.y, 9) for r in spark.table("per_time").select(F.unix_seconds("ts").alias("t"), "y").collect()}
    assert got == want
    assert spark.table("windows").count() == 4 and spark.table("windows").agg(F.sum("n")).first()[0] == 40
