"""Clusters through the metric index: the components of all pairs, with few pairs of blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import clusters
from chronoframe.operators.clusters import block_pairs, label_components, linking_pairs


def table(spark, video, vectors):
    rows = [(v, i, [float(a) for a in x]) for i, (v, x) in enumerate(zip(video, vectors, strict=True))]
    return spark.createDataFrame(rows, "video_id long, id long, embedding array<float>")


def clustered(rng, n, centres, dim=8, spread=0.03):
    c = rng.normal(size=(centres, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * spread


def brute(video, vectors, t, metric):
    own = list(range(len(vectors)))
    find = lambda x: x if own[x] == x else find(own[x])
    v = np.array(vectors, np.float32).astype(float)
    if metric == "cosine":
        n = np.linalg.norm(v, axis=1, keepdims=True)
        u = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    for i, j in zip(*np.where(np.triu(d <= t, 1)), strict=True):
        if video[i] == video[j]:
            a, b = find(int(i)), find(int(j))
            own[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(vectors))}


@pytest.mark.parametrize(("metric", "t"), [("cosine", 0.02), ("euclidean", 0.15)])
def test_components_of_all_pairs(spark, metric, t):
    """A long video, one that is a single block, copies, vectors of zeros, and one pivot's worth of rows."""
    rng = np.random.default_rng(1)
    vectors = [*clustered(rng, 400, 25), *clustered(rng, 20, 3), *[np.ones(8)] * 90, *[np.zeros(8)] * 5]
    video = [1] * 400 + [2] * 20 + [1] * 95
    df = table(spark, video, vectors).repartition(3)
    got = {r.id: r.component for r in label_components(df, linking_pairs(df, t, metric, block=32, pivots=6)).collect()}
    assert got == brute(video, vectors, t, metric) and len(set(got.values())) > 20


def test_few_blocks_meet(spark):
    """Of clustered vectors under a fifth of the block pairs are met, and a row is in few of them."""
    rng = np.random.default_rng(2)
    df = table(spark, [1] * 12_000, clustered(rng, 12_000, 60, 32, 0.02)).withColumn("_d", F.lit(32)).withColumn("_n", F.lit(94).cast("long"))
    placed, pairs = block_pairs(df, 0.05, "cosine", 128)
    blocks, met = placed.select("_b").distinct().count(), pairs.count()
    assert blocks == 94 and met < 0.2 * blocks * (blocks + 1) / 2
    assert placed.count() == 12_000 and met * 2 / blocks < 12


def test_short_videos_take_one_task_each(spark):
    df = table(spark, [1, 1, 2, 2], [[1, 0], [1, 0.01], [0, 1], [1, 0]])
    got = {r.id: r.cluster_rank for r in clusters.cluster_single_linkage(df, 0.1).collect()}
    assert got[0] == got[1] and got[2] != got[3]
