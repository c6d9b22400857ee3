"""Clustering of embeddings as connected components of a similarity graph, and views of clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoframe.operators.boxes import face_size_filter
from chronoframe.operators.stretches import numbered
from chronoframe.sources.written import written


#: Rows of a video that the metric index measures distances from, at most.
PIVOTS = 256


def _distances(v: np.ndarray, metric: str) -> np.ndarray:
    """Rows as points of a Euclidean space: unit vectors for cosines (where a distance of t is one of sqrt(2 t))."""
    if metric != "cosine":
        return v
    n = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def block_pairs(e: DataFrame, t: float, metric: str, block: int, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """``e`` with ``_b``, its block, and the pairs of blocks ``video_id, _d, _i, _j`` that may hold rows within distance t.

    ``e``: ``video_id, id, embedding, _d, _n`` (blocks that the video asks for). A few rows of a video, those of the least
    hashes, are its pivots. Rows are ordered by their two nearest pivots (along a walk over these) and the distance from the nearest, and cut into
    blocks; a block knows the least and largest distance from each pivot, of those of its rows that share a nearest pivot.
    By the triangle inequality rows whose ranges from one pivot are more than t apart hold no link, and blocks without
    rows that may do not meet. No other pair is left out, so the links are all found.
    """
    own = ["video_id", "_d"]

    def chain(p: np.ndarray) -> np.ndarray:
        """Each pivot's place in a walk from one to the nearest one left, so that those of one cluster are neighbours."""
        free, place, at = np.ones(len(p), bool), np.zeros(len(p), np.int64), 0
        for k in range(len(p)):
            place[at], free[at] = k, False
            d = np.where(free, ((p - p[at]) ** 2).sum(axis=1), np.inf)
            at = int(d.argmin())
        return place

    first = F.row_number().over(W.partitionBy(*own).orderBy(F.xxhash64("id"), "id"))
    chosen = e.withColumn("_r", first).where(F.col("_r") <= pivots).groupBy(*own, "_n").agg(F.sort_array(F.collect_list(F.struct("_r", "embedding"))).alias("_p"))
    chosen = chosen.select(F.col("video_id").alias("_pv"), F.col("_d").alias("_pd"), "_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_pk"))
    dealt = e.withColumn("_k", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_n")))
    kinds = {f.name: f.dataType.simpleString() for f in e.schema}

    def measure(key: tuple, rows: pa.Table, pivot: pa.Table) -> pa.Table:
        size = rows.column("_d")[0].as_py() if rows.num_rows else 0
        if not rows.num_rows or not pivot.num_rows:
            return rows.select(["video_id", "_d", "id", "embedding"]).append_column("_key", pa.array([], pa.float64())).append_column("_near", pa.array([], pa.int32())).append_column("_far", pa.array([], pa.list_(pa.float32()))).slice(0, 0)
        point = lambda column: _distances(pc.list_flatten(column).to_numpy().astype(float).reshape(-1, size), metric)
        x = point(rows.column("embedding"))
        p = point(pc.struct_field(pc.list_flatten(pivot.column("_p").slice(0, 1)), "embedding"))
        far = np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * (x @ p.T)))
        near = np.argsort(far, axis=1, kind="stable")[:, : min(2, len(p))]
        r, rank = far[np.arange(len(x)), near[:, 0]], chain(p)
        order = rank[near[:, 0]] * pivots + rank[near[:, -1]] + np.minimum(r / (1 + r), 0.999999)
        lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * far.shape[1], far.astype(np.float32).ravel())
        return rows.select(["video_id", "_d", "id", "embedding"]).append_column("_key", pa.array(order)).append_column("_near", pa.array(near[:, 0].astype(np.int32))).append_column("_far", lists)

    out = f"video_id {kinds['video_id']}, _d {kinds['_d']}, id {kinds['id']}, embedding {kinds['embedding']}, _key double, _near int, _far array<float>"
    placed = written(dealt.groupBy(*own, "_k").cogroup(chosen.groupBy("_pv", "_pd", "_pk")).applyInArrow(measure, out))
    placed = written(numbered(placed, own, ["_key", "id"]).withColumn("_b", F.floor(F.col("_i") / block).cast("long")).drop("_i", "_n", "_key"))
    ends = placed.select(*own, "_b", "_near", F.posexplode("_far").alias("_q", "_v")).groupBy(*own, "_b", "_near", "_q").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    ends = written(ends.groupBy(*own, "_b", "_near").agg(F.sort_array(F.collect_list(F.struct("_q", "lo", "hi"))).alias("_s")))
    reach = float(np.sqrt(2 * max(0.0, t)) if metric == "cosine" else t) + 1e-5  # the ranges are rounded to floats
    side = lambda b, s: ends.select(*own, F.col("_b").alias(b), F.col("_s").alias(s))
    apart = F.exists(F.zip_with("_si", "_sj", lambda x, y: F.greatest(x["lo"] - y["hi"], y["lo"] - x["hi"])), lambda gap: gap > reach)
    pairs = side("_i", "_si").join(side("_j", "_sj"), own).where((F.col("_i") <= F.col("_j")) & ~apart)
    return placed.drop("_far", "_near"), written(pairs.select(*own, "_i", "_j").distinct())


def linking_pairs(embeddings: DataFrame, t: float, metric: str = "cosine", block: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """``video_id, a, b`` with the same components as all pairs of a video's rows within distance t.

    A video of up to ``block`` rows is one task's work. Of longer ones, equal vectors are first known by one of them, and
    the others are cut into blocks that meet in pairs; ``block_pairs`` rules out pairs that lie too far apart. A pair of
    blocks gives its components as stars around their least ids: fewer pairs than it has rows. Null vectors link with
    nothing, and vectors of different lengths don't link.
    """
    e = embeddings.where("embedding is not null").select("video_id", "id", "embedding", F.size("embedding").alias("_d"))
    sizes = e.groupBy("video_id", "_d").agg(F.ceil(F.count("*") / block).alias("_n"))
    e, copies = e.join(sizes, ["video_id", "_d"]), None
    whole = e.withColumn("_i", F.lit(0).cast("long")).withColumn("_j", F.col("_i"))
    fields = ["video_id", "_d", "id", "embedding", "_i", "_j"]
    if sizes.where("_n > 1").isEmpty():
        x = whole.select(*fields)
    else:
        long = e.where("_n > 1")
        if t > 1e-6:  # equal vectors are linked, but for cosines of vectors of zeros
            alike = long.groupBy("video_id", "_d", "embedding", "_n").agg(F.min("id").alias("id"), F.count("*").alias("_c"))
            zero = F.forall("embedding", lambda v: v == 0)
            apart = zero & F.lit(metric == "cosine" and t < 1)
            kept = alike.where(~apart).select("video_id", "id", "embedding", "_d").unionByName(long.where(apart).select("video_id", "id", "embedding", "_d"))
            copies = long.where(~apart).join(alike.where("_c > 1").select("video_id", "_d", "embedding", F.col("id").alias("a")), ["video_id", "_d", "embedding"]).where("a <> id").select("video_id", "a", F.col("id").alias("b"))
            kept = written(kept)
            long = kept.join(kept.groupBy("video_id", "_d").agg(F.ceil(F.count("*") / block).alias("_n")), ["video_id", "_d"])
        placed, pairs = block_pairs(long, t, metric, block, pivots)
        ends = F.array_distinct(F.array("_i", "_j"))
        x = placed.join(pairs.withColumn("_b", F.explode(ends)), ["video_id", "_d", "_b"]).select(*fields).unionByName(whole.where("_n = 1").select(*fields))
    video, key = (embeddings.schema[c].dataType.simpleString() for c in ("video_id", "id"))

    def stars(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's component in a matrix of links, as (first row of it, row); first rows aren't listed."""
        free, roots, rows = np.ones(len(near), bool), [], []
        for root in range(len(near)):
            if not free[root]:
                continue
            free[root], front = False, [root]
            while front:
                found = np.flatnonzero(near[front.pop()] & free)
                free[found] = False
                front.extend(found)
                roots.append(np.full(len(found), root))
                rows.append(found)
        none = [np.zeros(0, np.int64)]
        return np.concatenate(roots + none), np.concatenate(rows + none)

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("id").combine_chunks()
        v = _distances(pc.list_flatten(cell.column("embedding")).to_numpy().astype(float).reshape(cell.num_rows, cell.column("_d")[0].as_py()), metric)
        if metric == "cosine":
            near = 1 - v @ v.T <= t
        else:
            q = (v * v).sum(axis=1)
            near = np.sqrt(np.maximum(0.0, q[:, None] + q[None] - 2 * (v @ v.T))) <= t
        a, b = stars(near)
        ids = cell.column("id")
        return pa.table({"video_id": cell.column("video_id").take(a), "a": ids.take(a), "b": ids.take(b)})

    found = x.groupBy("video_id", "_d", "_i", "_j").applyInArrow(run, f"video_id {video}, a {key}, b {key}")
    return found if copies is None else found.unionByName(copies)


def label_components(nodes: DataFrame, pairs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``video_id, id, component``: the least id that each row can reach; labels spread along pairs and jump along themselves."""
    both = written(pairs.unionByName(pairs.select("video_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    label = written(nodes.select("video_id", "id", F.col("id").alias("c")))
    for _ in range(most_rounds):
        near = both.join(label.select("video_id", F.col("id").alias("b"), "c"), ["video_id", "b"]).groupBy("video_id", F.col("a").alias("id")).agg(F.min("c").alias("m"))
        new = label.join(near, ["video_id", "id"], "left").select("video_id", "id", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("was"))
        jump = new.join(new.select("video_id", F.col("id").alias("c"), F.col("c").alias("j")), ["video_id", "c"]).select("video_id", "id", F.least("c", "j").alias("c"), "was")
        now = written(jump)
        label = now.drop("was")
        if now.where("c <> was").isEmpty():
            return label.select("video_id", "id", F.col("c").alias("component"))
    raise RuntimeError(f"components are not found after {most_rounds} rounds")


def ranked(members: DataFrame, order: str = "id") -> DataFrame:
    """Clusters of a video by size, ties by their first member: adds ``cluster_rank`` (from 0), ``size`` and ``position``."""
    own = W.partitionBy("video_id", "component")
    m = members.withColumn("size", F.count("*").over(own)).withColumn("position", (F.row_number().over(own.orderBy(order)) - 1).cast("long"))
    first = members.groupBy("video_id", "component").agg(F.count("*").alias("_n"), F.min(order).alias("_f"))
    rank = first.withColumn("cluster_rank", (F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("_n"), "_f")) - 1).cast("int")).drop("_n", "_f")
    return m.join(rank, ["video_id", "component"])


def sample_members(clusters: DataFrame, k: int = 30) -> DataFrame:
    """Marks min(size, k) members at even distances, both ends included, places rounded half to even."""
    n = F.least("size", F.lit(k))
    spots = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.rint(F.when(n > 1, i * ((F.col("size") - 1) / (n - 1))).otherwise(F.lit(0.0))).cast("long"))
    return clusters.withColumn("is_sample", F.array_contains(spots, F.col("position")))


def cluster_single_linkage(embeddings: DataFrame, t: float = 0.5, max_samples: int = 30, metric: str = "cosine") -> DataFrame:
    """Single linkage cut at distance t: ``video_id, id, cluster_rank, size, is_sample``."""
    members = label_components(embeddings, linking_pairs(embeddings, t, metric))
    return sample_members(ranked(members), max_samples).select("video_id", "id", "cluster_rank", "size", "is_sample")


def cluster_dbscan(embeddings: DataFrame, eps: float = 0.5, metric: str = "cosine", max_samples: int = 30) -> DataFrame:
    """DBSCAN with clusters of one allowed: every row is a core, so these are the same components."""
    return cluster_single_linkage(embeddings, eps, max_samples, metric)


def cluster_places(embeddings: DataFrame, places: DataFrame, t: float = 0.25) -> DataFrame:
    """Clusters of place embeddings with the members' vectors and places; a cluster's rows stay rows."""
    return cluster_single_linkage(embeddings, t).join(embeddings.select("video_id", "id", "embedding"), ["video_id", "id"]).join(places, ["video_id", "id"], "left")


def top_clusters(clusters: DataFrame, max_cluster: int = 50) -> DataFrame:
    return clusters.where(F.col("cluster_rank") < max_cluster)


def _items(clusters: DataFrame, embeddings: DataFrame, max_cluster: int) -> DataFrame:
    c = top_clusters(clusters, max_cluster).join(embeddings.select("video_id", "id", "time"), ["video_id", "id"])
    return c.select("video_id", F.concat(F.lit("Cluster "), F.col("cluster_rank") + 1).alias("name"), "cluster_rank", "id", "time", "is_sample")


def face_clustering(bboxes: DataFrame, faces: DataFrame, embeddings: DataFrame, t: float = 0.5, max_cluster: int = 50, min_h: float = 0.1) -> DataFrame:
    """Faces of a sufficient size, clustered, the largest clusters as items."""
    kept = face_size_filter(bboxes, faces, min_h)["faces"].select("video_id", "id")
    own = embeddings.join(kept.withColumnRenamed("id", "ref_id"), ["video_id", "ref_id"], "left_semi")
    return _items(cluster_single_linkage(own, t), own, max_cluster)


def place_clustering(mid_frames: DataFrame, embeddings: DataFrame, t: float = 0.5, max_cluster: int = 50) -> DataFrame:
    """Embeddings of the shots' middle frames, clustered, the largest clusters as items."""
    own = embeddings.join(mid_frames.select("video_id", "time").distinct(), ["video_id", "time"], "left_semi")
    return _items(cluster_single_linkage(own, t), own, max_cluster)


def preview_items(clusters: DataFrame, k: int = 4) -> DataFrame:
    """Every ceil(n / k)-th member of a cluster."""
    own = W.partitionBy("video_id", "cluster")
    c = clusters.withColumn("_n", F.count("*").over(own)).withColumn("_i", F.row_number().over(own.orderBy("time", "ref_id")) - 1)
    return c.where(F.col("_i") % F.ceil(F.col("_n") / k) == 0).drop("_n", "_i")


def latest_clustering(runs: DataFrame, clusters: DataFrame, kind: str, selected: int | None = None) -> DataFrame:
    """The clusters of the chosen run, else of the newest one that is done, by size."""
    done = runs.where((F.col("type") == kind) & (F.col("status") == "DONE"))
    if selected is not None:
        done = done.where(F.col("run_id") == selected)
    newest = done.withColumn("_r", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("date"), F.desc("run_id")))).where("_r = 1")
    c = clusters.join(newest.select("video_id", "run_id"), ["video_id", "run_id"], "left_semi")
    n = c.groupBy("video_id", "cluster").agg(F.count("*").alias("size"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("size"), "cluster")))
