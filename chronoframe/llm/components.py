"""Connected components of an edge table: local contraction, and alternating large and small stars where that isn't enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import cut, discard, lean

#: Edges that a task contracts at a time (16 bytes each).
LOCAL = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges as stars: every node but the least of its component, and that least node."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        high, low = np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart])
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        first = np.concatenate([[True], high[1:] != high[:-1]])
        root[high[first]] = low[first]  # each root under the least one that it meets
        while not np.array_equal(root, to := root[root]):
            root = to
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """``u, v`` dealt into so many tasks, each of which gives the stars of what it got."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, fresh = (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0, []
        for b in batches:
            fresh.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
            size += b.num_rows
            if size >= LOCAL:
                held, size, fresh = stars(*(np.concatenate([x, *y]) for x, y in zip(held, zip(*fresh, strict=True), strict=True))), 0, []
        if fresh:
            held = stars(*(np.concatenate([x, *y]) for x, y in zip(held, zip(*fresh, strict=True), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["u", "v"])

    return edges.repartition(parts).mapInArrow(lean(run), "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60, into: list[str] | None = None, local: int = LOCAL) -> DataFrame:
    """``a, b`` (whole numbers) → ``node, component``: the smallest node that each node of an edge can reach.

    Nulls and loops are left out, repeated edges count once; an empty table gives no rows. The edges are dealt into tasks
    of about ``local`` edges, and each task contracts its own into stars. Where one task holds all that is left, its stars
    are the answer; else every round first ties each node's larger neighbours, then its smaller ones, to its least
    neighbour, and contracts again; the rounds grow with the logarithm of the longest path. Rows of a node with many
    neighbours meet in map-side minima and in joins that can be split. A round's table is deleted when the next one is
    written; the last one's path is added to ``into``.
    """
    paths: list[str] = []
    e, before = cut(edges.where("a <> b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")), paths), None
    n = e.count()
    for _ in range(most_rounds):
        parts = max(1, -(-n // local))
        old, paths = paths, []
        e = cut(contracted(e, parts), paths)
        discard(e.sparkSession, old)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if parts == 1 or (now.n, now.h) == before:
            if into is not None:
                into += paths
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = (now.n, now.h)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u")
        old, paths = paths, []
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(near.select("u", "m")).distinct(), paths)
        discard(e.sparkSession, old)
        n = e.count()
    raise RuntimeError(f"components are not found after {most_rounds} rounds")


def joined(tied: DataFrame, links: DataFrame, into: list[str] | None = None) -> DataFrame:
    """``tied`` (``node, component``) after more links ``a, b``: only components that a link ties are worked on."""
    own = lambda x: tied.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    ends = links.join(own("a"), "a", "left").join(own("b"), "b", "left")
    ends = cut(ends.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), into)
    moved = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), into=into)
    nodes = tied.unionByName(ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("component")), F.struct(F.col("b").alias("node"), F.col("cb").alias("component")))).alias("x")).select("x.*")).distinct()
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return cut(nodes.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), into)
