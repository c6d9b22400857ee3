"""Mixing sources to target weights by systematic sampling.

Within a source every document expects ``target / source_size`` copies. The expected copies are summed up in a fixed order
(size class, then a hash of the id), one random offset is added, and a document is emitted once for each integer that its
stretch of the sum crosses. Ordering by size makes the words taken follow the target closely.

The sum is not a window over a source, which could hold a third of all rows: documents are counted in small cells (source,
size class, leading bits of the hash), the counts are summed over the few cells of a source, and places are given out
within each cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoframe.llm.common import cut, table

WORD = r"[^\x20\x09-\x0D]+"


def hash32(text: Column) -> Column:
    """The first 32 bits of the MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("string")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source, source_size`` → these and ``target``: shares by weight, at most ``cap`` sizes, the excess reshared.

    Sources take the weights in turn, in code point order, null last. The level at which caps stop the shares is found
    directly: with sources in the order of cap / weight, it is what the sources from some place on get per unit of weight
    once all before are full. One row per source passes through one task (sources are a dimension, not rows of data).
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * cap).alias("c"))
    by_level = W.orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy()
    before_c, before_w = F.sum("c").over(by_level) - F.col("c"), F.sum("w").over(by_level) - F.col("w")
    s = s.withColumn("level", (F.sum("source_size").over(every) - before_c) / (F.sum("w").over(every) - before_w))
    # levels only fall after the first place where the share fits, so that one is the largest
    s = s.withColumn("found", F.max(F.when(F.col("level") * F.col("w") <= F.col("c"), F.col("level"))).over(every))
    return s.select("source", "source_size", F.least(F.col("c").cast("double"), F.col("found") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix", bucket_bits: int = 6, size: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``size, source_size, target, copies`` (columns of these names are replaced).

    ``size`` names a column that holds the number of words, else it is counted in ``text`` (null: 0). ``copies`` is how
    often the mix takes the document, at most ``cap`` times; 0 where it doesn't. Every run gives the same copies. A null
    source is a source of its own; empty documents take part with size 0; rows with equal ids are separate documents, and
    equal rows are interchangeable; rows with a null id are separate documents too and come last in their size class, in
    the order of a hash of their text (of their size if there is no text); an empty table gives no rows. ``bucket_bits``
    splits the cells of a source further for larger tables; it doesn't change the result.
    """
    words = F.col(size) if size else F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    d = docs.withColumn("_mx_size", words.cast("long"))
    # null ids get hashes beyond those of all ids, from what tells their rows apart
    own = F.coalesce("text", F.lit("")) if "text" in docs.columns else F.col("_mx_size")
    d = d.withColumn("_mx_hash", F.coalesce(hash32(F.col("doc_id")), hash32(own) + F.lit(1 << 32)))
    # octave and quarter of the size; exact in whole numbers
    bits = F.length(F.bin("_mx_size"))
    d = d.withColumn("_mx_class", F.when(F.col("_mx_size") == 0, F.lit(0).cast("long")).otherwise(bits * 8 + F.expr("_mx_size * 8 div shiftleft(1L, length(bin(_mx_size)))")))
    d = d.withColumn("_mx_cell", F.shiftright("_mx_hash", 32 - bucket_bits)).withColumn("_mx_source", F.col("source"))
    cells = d.groupBy("_mx_source", "_mx_class", "_mx_cell").agg(F.count("*").alias("n"), F.sum("_mx_size").alias("words"))
    targets = source_targets(cells.groupBy(F.col("_mx_source").alias("source")).agg(F.sum("words").alias("source_size")), weights, cap)
    before = W.partitionBy("_mx_source").orderBy("_mx_class", "_mx_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = cells.select("*", (F.sum("n").over(before) - F.col("n")).alias("before"))
    facts = cells.join(targets, F.col("_mx_source").eqNullSafe(F.col("source"))).select(
        F.col("_mx_source").alias("s"), F.col("_mx_class").alias("c"), F.col("_mx_cell").alias("b"), "before", F.col("source_size").alias("_mx_ss"), F.col("target").alias("_mx_target")
    )
    place = F.row_number().over(W.partitionBy("_mx_source", "_mx_class", "_mx_cell").orderBy("_mx_hash", "doc_id", "_mx_size"))
    d = d.withColumn("_mx_place", place)
    d = d.join(facts, F.col("_mx_source").eqNullSafe(F.col("s")) & (F.col("_mx_class") == F.col("c")) & (F.col("_mx_cell") == F.col("b")))
    rate = F.when(F.col("_mx_ss") > 0, F.col("_mx_target") / F.col("_mx_ss")).otherwise(F.lit(0.0))
    offset = hash32(F.concat(F.lit(f"{seed}:"), F.coalesce("_mx_source", F.lit("null")))) / float(1 << 32)
    at = F.col("before") + F.col("_mx_place")
    copies = F.floor(offset + rate * at) - F.floor(offset + rate * (at - 1))
    kept = [F.col(c) for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    return d.select(*kept, F.col("_mx_size").alias("size"), F.col("_mx_ss").alias("source_size"), F.col("_mx_target").alias("target"), copies.cast("long").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with ``copy`` from 1."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("words")))
    return mix(sized, size="words").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: Over a relation ``docs(doc_id, source, text)``.
MIX_SQL = r"""
sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM docs
), classed AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) * 8 + (size * 8) // (1::BIGINT << length(bin(size))) END AS class FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w, 3 * source_size AS c FROM sources
), levels AS (
  SELECT *, ((sum(source_size) OVER ()) - ((sum(c) OVER up) - c))::DOUBLE / ((sum(w) OVER ()) - ((sum(w) OVER up) - w))::DOUBLE AS level
  FROM weighed WINDOW up AS (ORDER BY c::DOUBLE / w, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
), targets AS (
  SELECT source, source_size, least(c::DOUBLE, (SELECT max(level) FROM levels WHERE level * w <= c) * w) AS target,
    CAST('0x' || substr(md5('mix:' || coalesce(source, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM levels
), placed AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY class, h, doc_id) AS place FROM classed
), mixed AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN
    CAST(floor(u + (t.target / t.source_size) * place) - floor(u + (t.target / t.source_size) * (place - 1)) AS BIGINT) ELSE 0 END AS copies
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
"""

OP4_SQL = f"WITH docs AS (SELECT doc_id, source, text FROM documents), {MIX_SQL} SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"
