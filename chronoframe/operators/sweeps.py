"""Batches of edits as sweeps over intervals: who wrote a stretch last, what stays uncovered, which edits can't meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _places(ranges: DataFrame, key: str) -> DataFrame:
    """``key, p, at, n``: the distinct ends of a key's ranges, numbered in order; cell ``at`` is from one to the next."""
    points = ranges.select(key, F.explode(F.array("a", "b")).alias("p")).distinct()
    w = W.partitionBy(key)  # the ends of one key's edits
    return points.select(key, "p", (F.row_number().over(w.orderBy("p")) - 1).cast("long").alias("at"), F.count("*").over(w).alias("n"))


def _nodes(i: Column, j: Column) -> Column:
    """Cells i to j - 1 as few whole nodes ``level, node`` of a binary tree (node k of level l holds 2^l cells from k 2^l on)."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        first, last = F.ceil(i / size).cast("long"), F.floor(j / size).cast("long")
        node = lambda k: F.struct(level.cast("int").alias("level"), k.alias("node"))
        left = F.when((first < last) & (first % 2 == 1), F.array(node(first))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
        right = F.when((first < last) & (last % 2 == 1), F.array(node(last - 1))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
        return F.concat(left, right)

    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(j, F.lit(2)))).cast("int"))
    return F.flatten(F.transform(levels, at))


def _tops(ranges: DataFrame, places: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``key, at, top``: the covered cells, each with its last writer (``order`` as a struct).

    A range is a few nodes of a tree over the cells, and a cell looks at the nodes above it, so that many ranges over
    many cells cost a logarithm each and not their product.
    """
    end = lambda c: places.select(key, F.col("p").alias(c), F.col("at").alias(f"_{c}"))
    r = ranges.join(end("a"), [key, "a"]).join(end("b"), [key, "b"])
    nodes = r.select(key, F.struct(*order).alias("top"), F.inline(_nodes(F.col("_a"), F.col("_b")))).groupBy(key, "level", "node").agg(F.max("top").alias("top"))
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest("n", F.lit(2)))).cast("int"))
    cells = places.where(F.col("at") < F.col("n") - 1).select(key, "at", F.explode(levels).alias("level"))
    cells = cells.withColumn("node", F.floor(F.col("at") / F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    return cells.join(nodes, [key, "level", "node"]).groupBy(key, "at").agg(F.max("top").alias("top"))


def _runs(cells: DataFrame, places: DataFrame, key: str, also: list[str]) -> DataFrame:
    """Runs of neighbouring cells as ``key, also, a, b``."""
    place = F.row_number().over(W.partitionBy(key, *also).orderBy("at"))
    own = cells.withColumn("_run", F.col("at") - place).groupBy(key, *also, "_run").agg(F.min("at").alias("_first"), (F.max("at") + 1).alias("_last"))
    end = lambda c, p: places.select(key, F.col("at").alias(c), F.col("p").alias(p))
    return own.join(end("_first", "a"), [key, "_first"]).join(end("_last", "b"), [key, "_last"]).select(key, *also, "a", "b")


def painted(ranges: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``key, order, a, b``: what is left of each range [a, b] when all are painted in ``order``, the later over the earlier.

    ``ranges`` has ``key, a, b`` with a < b and the columns of ``order``, which tell a key's ranges apart.
    """
    places = _places(ranges, key)
    cells = _tops(ranges, places, key, order).select(key, "at", "top.*")
    return _runs(cells, places, key, order)


def covered(ranges: DataFrame, key: str) -> DataFrame:
    """``key, a, b``: the union of a key's ranges as disjoint stretches that do not touch."""
    places = _places(ranges, key)
    cells = _tops(ranges, places, key, ["a"]).select(key, "at")
    return _runs(cells, places, key, [])


def uncovered(ranges: DataFrame, key: str, low: DataFrame) -> DataFrame:
    """``key, number, a, b``: the gaps between a key's covered stretches, and those up to its bounds ``low`` (``key, lo, hi``)."""
    w = W.partitionBy(key).orderBy("a")
    c = covered(ranges, key).select(key, "a", "b", F.lead("a").over(w).alias("_next"), (F.row_number().over(w) - 1).cast("long").alias("_i")).join(low, key, "left")
    gap = lambda n, a, b: F.struct(n.cast("long").alias("number"), a.alias("a"), b.alias("b"))
    after = gap(F.col("_i"), F.col("b"), F.coalesce("_next", F.greatest("hi", F.col("b") + 1)))
    before = gap(F.lit(-1), F.least("lo", F.col("a") - 1), F.col("a"))
    return c.select(key, F.inline(F.when(F.col("_i") == 0, F.array(before, after)).otherwise(F.array(after))))


def regions(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` (``keys, a, b``) with ``region``: spans of one key that overlap or touch, by chains, are in one."""
    w = W.partitionBy(*keys).orderBy("a", "b")
    apart = F.coalesce((F.col("a") > F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))).cast("long"), F.lit(0))
    return spans.withColumn("_apart", apart).withColumn("region", F.sum("_apart").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_apart")
