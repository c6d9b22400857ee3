"""Ordered work on long series without one task for a whole series.

A window over a video sorts all its rows in one task. Here a series with many rows is dealt into stretches of its order,
about equally many rows each; what a row needs from before or after its stretch comes from small tables of one row for
each stretch (how many rows lie before, the last value known), or from copies of the rows next to a chunk (its halo).
Short series are one stretch and get the same plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A series with more rows than this is dealt into PARTS stretches; a chunk with a halo has so many rows.
SIZE, PARTS = 1 << 17, 128


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join by keys, of which nulls are one key too."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(named[f"_k_{k}"]) for k in keys))
    return left.join(named, on, how).drop(*[f"_k_{k}" for k in keys])


def any_long(df: DataFrame, keys: list[str], size: int) -> bool:
    """Whether a series has more than ``size`` rows (one aggregate, run at once)."""
    return not df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > size).isEmpty()


def stretched(df: DataFrame, keys: list[str], by: str, size: int = SIZE, parts: int = PARTS) -> DataFrame:
    """``df`` with ``_stretch``: 0 for short series, else 0 to ``parts`` - 1 in the order of ``by`` (equal values together).

    The bounds are approximate quantiles, made of mergeable summaries of the long series only. A null ``by`` is in the
    first stretch.
    """
    long = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > size).select(*keys)
    cuts = [k / parts for k in range(1, parts)]
    bounds = _met(df, long, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(by, cuts, 20 * parts).alias("_bounds"))
    at = F.size(F.filter("_bounds", lambda x: x < F.col(by)))
    return _met(df, bounds, keys, "left").withColumn("_stretch", F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(at)).drop("_bounds")


def _over(keys: list[str], order: list):
    return W.partitionBy(*keys, "_stretch").orderBy(*order)


def numbered(df: DataFrame, keys: list[str], order: list[str], size: int = SIZE, parts: int = PARTS) -> DataFrame:
    """``df`` with ``_i``, a row's place in its series from 0, and ``_n``, the series' rows. ``order[0]`` is the column that deals."""
    if not any_long(df, keys, size):
        w = W.partitionBy(*keys)
        return df.withColumn("_i", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("_n", F.count("*").over(w))
    s = stretched(df, keys, order[0], size, parts)
    counts = s.groupBy(*keys, "_stretch").agg(F.count("*").alias("rows"))
    listed = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_stretch", "rows"))).alias("_s"))  # at most ``parts``
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["rows"])
    each = listed.select(*keys, "_s", total(F.col("_s")).alias("_n"), F.explode("_s").alias("_e"))
    each = each.select(*keys, F.col("_e._stretch").alias("_stretch"), "_n", total(F.filter("_s", lambda x: x["_stretch"] < F.col("_e._stretch"))).alias("_before"))
    place = F.row_number().over(_over(keys, order)) - 1
    return _met(s.withColumn("_place", place), each, [*keys, "_stretch"], "inner").withColumn("_i", F.col("_place") + F.col("_before")).drop("_place", "_before", "_stretch")


def with_halo(rows: DataFrame, before: int, after: int, size: int = SIZE) -> DataFrame:
    """Rows of ``numbered`` in chunks of ``size`` places, with copies of the ``before`` and ``after`` rows next to each.

    ``_chunk`` says where a row stands, ``_own`` whether it belongs there or is a copy.
    """
    chunk = lambda i: F.floor(i / size).cast("long")
    first, last = F.greatest(chunk(F.col("_i") - after), F.lit(0).cast("long")), F.least(chunk(F.col("_i") + before), chunk(F.col("_n") - 1))
    x = rows.withColumn("_chunk", F.explode(F.sequence(first, last)))
    return x.withColumn("_own", F.col("_chunk") == chunk(F.col("_i")))


def over_rows(df: DataFrame, keys: list[str], order: list[str], before: int, after: int, make, size: int = SIZE, parts: int = PARTS) -> DataFrame:
    """``df`` with the columns that ``make(window)`` names, which look ``before`` rows back and ``after`` rows ahead at most."""
    if not any_long(df, keys, size):
        return df.withColumns(make(W.partitionBy(*keys).orderBy(*order)))
    x = with_halo(numbered(df, keys, order, size, parts), before, after, size)
    return x.withColumns(make(W.partitionBy(*keys, "_chunk").orderBy("_i"))).where("_own").drop("_chunk", "_own", "_i", "_n")


def with_known(df: DataFrame, keys: list[str], by: str, tie: str, value: str, size: int = SIZE, parts: int = PARTS, long: bool | None = None) -> DataFrame:
    """``df`` with ``_last``, the value at or before each row in the order of ``by`` and ``tie``, and ``_next``, that at or after it.

    For ``_next`` rows of equal ``by`` stand in the falling order of ``tie``: with 0 for rows that have a value and 1 for
    those that ask, a row that asks sees the values of its own ``by`` from either side. Running values are kept within a
    stretch; the last value known is handed from stretch to stretch. ``long`` says whether a series has more than ``size``
    rows (None: they are counted).
    """
    if not (any_long(df, keys, size) if long is None else long):
        w = W.partitionBy(*keys)
        back = w.orderBy(by, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
        ahead = w.orderBy(F.col(by), F.col(tie).desc()).rowsBetween(W.currentRow, W.unboundedFollowing)
        return df.withColumn("_last", F.last(value, ignorenulls=True).over(back)).withColumn("_next", F.first(value, ignorenulls=True).over(ahead))
    s = stretched(df, keys, by, size, parts)
    back = _over(keys, [by, tie]).rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = _over(keys, [F.col(by), F.col(tie).desc()]).rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("_last", F.last(value, ignorenulls=True).over(back)).withColumn("_next", F.first(value, ignorenulls=True).over(ahead))
    known = F.col(value).isNotNull()
    ends = s.where(known).groupBy(*keys, "_stretch").agg(F.min_by(value, F.struct(by, tie)).alias("first"), F.max_by(value, F.struct(by, tie)).alias("last"))
    listed = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_stretch", "first", "last"))).alias("_s"))  # at most ``parts``
    earlier = F.filter("_s", lambda x: x["_stretch"] < F.col("_stretch"))
    later = F.filter("_s", lambda x: x["_stretch"] > F.col("_stretch"))
    spots = _met(s.select(*keys, "_stretch").distinct(), listed, keys, "inner")
    handed = spots.select(*keys, "_stretch", F.try_element_at(earlier, F.lit(-1))["last"].alias("_from"), F.try_element_at(later, F.lit(1))["first"].alias("_to"))
    x = _met(s, handed, [*keys, "_stretch"], "left")
    return x.withColumn("_last", F.coalesce("_last", "_from")).withColumn("_next", F.coalesce("_next", "_to")).drop("_from", "_to", "_stretch")
