"""Folds over small groups without a call of Python, or a table, for each group.

Rows are dealt by their group and sorted; a task reads them as Arrow batches, of which each is cut where a group ends, so
that a fold sees whole groups, many at a time, and holds no more than one batch and one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _same(col: pa.Array, value: pa.Scalar) -> np.ndarray:
    if not value.is_valid:
        return col.is_null().to_numpy(zero_copy_only=False)
    return pc.fill_null(pc.equal(col, value), False).to_numpy(zero_copy_only=False)


def _at_ends(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a group ends."""
    held: list[pa.RecordBatch] = []
    whole = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()
    for b in batches:
        if not b.num_rows:
            continue
        last = b.num_rows - int(np.logical_and.reduce([_same(b.column(k), b.column(k)[-1]) for k in keys]).sum())
        if last:
            yield from whole([*held, b.slice(0, last)])
            held = [b.slice(last)]
        elif held and not all(_same(b.column(k).slice(0, 1), held[-1].column(k)[-1])[0] for k in keys):
            yield from whole(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield from whole(held)


def starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The places where a batch's groups start, and its length."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        a, b = batch.column(k).slice(0, len(new)), batch.column(k).slice(1)
        both = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new |= both | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.concatenate([[0], np.flatnonzero(new) + 1, [batch.num_rows]]).astype(np.int64)


def fold_groups(df: DataFrame, keys: list[str], order: list, fold: Callable[[pa.RecordBatch, np.ndarray], dict], schema: str) -> DataFrame:
    """``fold(batch, starts)`` over whole groups in the order of ``keys`` and ``order``; it returns columns by the names of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _at_ends(batches, keys):
            out = fold(b, starts(b, keys))
            cols = [out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
