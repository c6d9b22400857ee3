"""Embeddings against queries, prompts and concepts; probabilities by class and hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoframe.functions import dot, l2_normalize, let, softmax
from chronoframe.operators.scalars import aggregate_per_time


def element_mean(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """The mean vector of each group, element by element, with partial sums before the shuffle."""
    long = df.select(*keys, F.posexplode(vector).alias("_i", "_v"))
    mean = long.groupBy(*keys, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_v"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias(vector))


#: Query vectors and concepts are what a user asks for; the driver reads them, and refuses more than so many.
MOST_QUERIES = 1_000


def _asked(queries: DataFrame) -> list:
    rows = queries.limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} query vectors; ask in parts")
    return rows


def _queries(queries: DataFrame) -> Column:
    """The query vectors as one literal."""
    rows = _asked(queries.select(l2_normalize(F.col("embedding")).alias("e")))
    return F.array(*[F.array(*[F.lit(float(x)) for x in r.e]) for r in rows])


def cosine_over_time(targets: DataFrame, queries: DataFrame, normalize: int = 0, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """``video_id, time, y``: the largest (cos + 1) / 2 to any query of the rows of a time; min-max scaled if asked.

    Bounds that aren't given are those of the video's values; where they coincide y is 0.
    """
    q = _queries(queries)
    sim = let(l2_normalize(F.col("embedding")), lambda u: F.array_max(F.transform(q, lambda v: (dot(u, v) + 1) / 2)))
    y = targets.withColumn("_y", sim).groupBy("video_id", "time").agg(F.max("_y").alias("y"))
    if not normalize:
        return y
    w = W.partitionBy("video_id")
    low, high = (F.lit(lo) if lo is not None else F.min("y").over(w)), (F.lit(hi) if hi is not None else F.max("y").over(w))
    y = y.withColumn("_lo", low).withColumn("_hi", high)
    return y.select("video_id", "time", F.when(F.col("_hi") > F.col("_lo"), (F.col("y") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0)).alias("y"))


def prompt_probs(embeddings: DataFrame, pos: DataFrame, neg: DataFrame | None = None) -> DataFrame:
    """The likeness of rows to the mean of the positive prompts: a dot product, or the softmax against a negative one."""
    def prompt(df: DataFrame) -> Column:
        units = df.select(l2_normalize(F.col("embedding")).alias("embedding"))
        return _queries(element_mean(units.withColumn("k", F.lit(0)), ["k"]))[0]

    e = l2_normalize(F.col("embedding"))
    p = dot(F.col("_u"), prompt(pos))
    rows = embeddings.withColumn("_u", e)
    y = p if neg is None else softmax(F.array(p, dot(F.col("_u"), prompt(neg))), 100.0)[0]
    return rows.select("video_id", "id", "time", y.alias("y"))


def concept_probs(embeddings: DataFrame, concepts: DataFrame, scale: float = 100.0) -> DataFrame:
    """A series per concept: the softmax over concepts of ``scale`` times the dot products."""
    rows = sorted(_asked(concepts.select("name", l2_normalize(F.col("embedding")).alias("e"))), key=lambda r: r["name"])
    q = F.array(*[F.array(*[F.lit(float(x)) for x in r.e]) for r in rows])
    names = F.array(*[F.lit(r.name if isinstance(r.name, str) else r["name"]) for r in rows])
    near = let(l2_normalize(F.col("embedding")), lambda u: F.transform(q, lambda v: dot(u, v)))
    e = embeddings.withColumn("_p", let(near, lambda p: softmax(p, scale)))
    return e.select("video_id", "id", "time", F.explode(F.arrays_zip(names.alias("series"), F.col("_p").alias("y"))).alias("_z")).select("video_id", "id", "time", F.col("_z.series").alias("series"), F.col("_z.y").alias("y"))


def cluster_to_scalar(clusters: DataFrame, embeddings: DataFrame, cluster_id, targets: DataFrame) -> DataFrame:
    """The likeness over time to the mean of a cluster's sample members."""
    own = clusters.where((F.col("cluster") == cluster_id) & F.col("is_sample")).select(F.col("ref_id").alias("id"))
    centre = element_mean(embeddings.join(own, "id", "left_semi").withColumn("k", F.lit(0)), ["k"])
    return aggregate_per_time(cosine_over_time(targets, centre, normalize=1))


def identify(targets: DataFrame, queries: DataFrame) -> DataFrame:
    return aggregate_per_time(cosine_over_time(targets, queries, normalize=1))


def rollup_probs(probs: DataFrame, membership: DataFrame) -> DataFrame:
    """Leaf probabilities summed to their parents by row-normalised membership: ``video_id, id, level, label, prob``."""
    m = membership.withColumn("_w", F.col("weight") / F.sum("weight").over(W.partitionBy("leaf", "level")))
    up = probs.withColumnRenamed("label", "leaf").join(m, "leaf")
    return up.groupBy("video_id", "id", "level", F.col("parent").alias("label")).agg(F.sum(F.col("prob") * F.col("_w")).alias("prob"))


def best_label(probs: DataFrame, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(F.desc("prob"), "label")
    return probs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def tag_vector(tokens: DataFrame, slots: dict[str, int], default: int, n_slots: int) -> DataFrame:
    """Counts of tags per segment in a fixed number of slots; several tags may share one, unknown ones go to ``default``."""
    slot = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in slots.items() for x in p]), F.col("tag")), F.lit(default))
    counts = tokens.withColumn("_slot", slot).groupBy("video_id", "segment_id").pivot("_slot", list(range(n_slots))).count()
    return counts.select("video_id", "segment_id", F.array(*[F.coalesce(F.col(str(k)), F.lit(0)).cast("long") for k in range(n_slots)]).alias("counts"))


def _exact(prob: Column) -> Column:
    """A probability to 15 places as a decimal (null if it is no number): sums of these are the same in any order, so equal sums are ties."""
    return prob.try_cast("decimal(28,15)")


def merge_topk(chunk_probs: DataFrame, k: int = 3) -> DataFrame:
    """The k best labels over each chunk's k best, as shares of all that these sum to."""
    own = W.partitionBy("video_id", "segment_id")
    top = chunk_probs.withColumn("_r", F.row_number().over(W.partitionBy("video_id", "segment_id", "chunk").orderBy(F.desc("prob"), "label"))).where(F.col("_r") <= k)
    s = top.groupBy("video_id", "segment_id", "label").agg(F.sum(_exact(F.col("prob"))).alias("prob"))
    s = s.withColumn("rank", F.row_number().over(own.orderBy(F.desc("prob"), "label")))
    s = s.withColumn("prob", F.col("prob").cast("double") / F.sum("prob").over(own).cast("double"))
    return s.where(F.col("rank") <= k)


def chunk_mean_label(chunk_probs: DataFrame) -> DataFrame:
    """The label of the highest mean over chunks; of equal means the first label."""
    mean = chunk_probs.groupBy("video_id", "segment_id", "label").agg((F.sum(_exact(F.col("prob"))).cast("double") / F.count("prob")).alias("prob"))
    return best_label(mean, ["video_id", "segment_id"])


def first_chunk_label(chunk_probs: DataFrame) -> DataFrame:
    return best_label(chunk_probs.where("chunk = 0").drop("chunk"), ["video_id", "segment_id"])


def sentiment_label(scores: DataFrame, classes: list[str]) -> DataFrame:
    """The most likely class of each text, and the probabilities in the order of ``classes``."""
    got = scores.groupBy("video_id", "segment_id").agg(*[F.max(F.when(F.col("label") == c, F.col("prob"))).alias(f"_p{k}") for k, c in enumerate(classes)])
    probs = F.array(*[F.coalesce(F.col(f"_p{k}"), F.lit(0.0)) for k in range(len(classes))])
    return got.select("video_id", "segment_id", F.element_at(F.array(*map(F.lit, classes)), F.array_position(probs, F.array_max(probs)).cast("int")).alias("label"), probs.alias("probs"))


def prob_timelines(annos: DataFrame, classes: list[str]) -> DataFrame:
    """A row per class of each annotation: its share as text."""
    return annos.select("video_id", "segment_id", F.posexplode("probs").alias("_i", "p")).select(
        "video_id", "segment_id", F.element_at(F.array(*map(F.lit, classes)), F.col("_i") + 1).alias("timeline"), F.format_string("%.1f%%", F.bround(F.col("p") * 100, 1)).alias("value")
    )
