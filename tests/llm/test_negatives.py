"""Hard negatives against all scores, and against the query's SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm.common import table
from chronoframe.llm.negatives import OP12_SQL, Shard, mine_negatives, op12_hard_negatives, usable

SF = "/root/testdata/sf0.01"


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    """``rows``: (id, label, whole vector)."""
    dot = lambda p, q: sum(x * y for x, y in zip(p, q, strict=False))
    out = []
    for a_id, a_label, a in {(i, label, tuple(q)) for i, label, q in anchors}:
        scored = [(dot(a, q), i, label) for i, label, q in rows if i != a_id]
        near = sorted((x for x in scored if x[2] == a_label), key=lambda x: (-x[0], x[1]))[:positives]
        for p, p_id, _ in near:
            inside = sorted((x for x in scored if x[2] != a_label and low * p <= 100 * x[0] <= high * p), key=lambda x: (-x[0], x[1]))
            out += [(a_id, p_id, k + 1, n_id, p, n) for k, (n, n_id, _) in enumerate(inside[:negatives])]
    return sorted(out)


def mined(spark, rows, every=10, **more):
    df = spark.createDataFrame([(i, label, [x / 256 for x in q]) for i, label, q in rows], "vec_id long, label int, embedding array<double>")
    rows = usable(df)
    return sorted(tuple(r) for r in mine_negatives(rows, rows.where(f"id % {every} = 0"), **more).collect())


@pytest.mark.parametrize("few", [8192, 0])
def test_random_vectors_with_ties(spark, few):
    """Small whole numbers tie often; shards and blocks are small; anchors are sent to all tasks, or joined."""
    rng = np.random.default_rng(8)
    rows = [(int(i), int(rng.integers(0, 4)), rng.integers(-3, 4, 6).tolist()) for i in rng.permutation(300)]
    rows += [(i, 1, [2, 2, 2, 0, 0, 0]) for i in range(400, 460)]  # a third of a label is one vector
    wanted = brute(rows, [r for r in rows if r[0] % 10 == 0])
    assert len(wanted) > 500
    assert mined(spark, rows, cells=120, block=7, few=few) == wanted


def test_odd_rows(spark):
    rows = [
        (0, 1, [5, -5, 0]), (0, 1, [5, -5, 0]), (0, 2, [1, 1, 1]), (10, 1, [0, 0, 0]), (3, 1, [4, -4, 9]), (4, 2, [3, -2, 1]), (5, 2, [3, -2, 1]), (6, 1, [5, -5]),
        (7, 3, []), (20, 3, [1]), (30, 4, [-7, 1, 0]), (31, 4, [7, -1, 0]), (32, 5, [-3, 0, 0]), (-10, 2, [2, 2, 2]), (11, 2, [5, 5, 5]), (11, 2, [5, 5, 5]),
    ]
    assert mined(spark, rows) == brute(rows, [r for r in rows if r[0] % 10 == 0])
    assert mined(spark, [r for r in rows if r[0] % 10]) == [] and mined(spark, []) == []


def test_what_takes_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 1, None), (3, None, [1.0, 1.0]), (4, 2, [1.0, None]), (5, 2, [inf, 1.0]), (6, 2, [nan, 1.0]), (None, 2, [0.5, 1.0]), (7, 2, [0.5, 1.0]), (8, 2, [1e30, -1e30])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("q", F.lit("x")).withColumn("id", F.lit(1))
    got = usable(df)
    assert {r.id: r.q for r in got.collect()} == {0: [256, 512], 1: [256, 512], 7: [128, 256], 8: [1 << 26, -(1 << 26)]}
    assert [tuple(r) for r in mine_negatives(got, got.where("id = 0")).collect()] == [(0, 1, 1, 7, 5 << 16, 5 << 15)]


def test_search_stops_early_and_misses_nothing():
    """On skewed values the bound ends the search long before the lists do."""
    rng = np.random.default_rng(2)
    n = 4000
    vectors = [np.round(v).astype(int) for v in rng.standard_t(1.5, (n, 3)) * 100]
    shard = Shard.unpacked(*Shard.of(np.arange(n), rng.integers(0, 2, n), vectors).packed())

    class Counted(np.ndarray):
        scored = 0

        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                Counted.scored += len(at)
            return np.asarray(self)[at]

    for a in ([50, -20, 10], [0, 7, 0], [-1, -1, -1]):
        values = shard.exact(50)
        got = shard.search(values.view(Counted), np.array(a), -1, 1, True, [(None, None), (None, 900), (10**9, None), (5, 4)], 5)
        scores = values @ np.array(a)
        mine = np.flatnonzero(shard.labels == 1)
        for (lo, hi), found in zip([(-(10**12), 10**12), (-(10**12), 900)], got[:2], strict=True):
            inside = [i for i in mine if lo <= scores[i] <= hi]
            assert found[0].tolist() == sorted(inside, key=lambda i: (-scores[i], i))[:5]
        assert got[2].shape[1] == got[3].shape[1] == 0
    Counted.scored = 0
    shard.search(shard.exact(50).view(Counted), np.array([50, -20, 10]), -1, 1, True, [(None, None)], 5)
    assert 0 < Counted.scored < n / 4


def test_whole_numbers_beyond_floats():
    """Large components are multiplied as whole numbers, without loss."""
    v = [np.array([(1 << 26) - k, 1 << 26]) for k in range(40)]
    shard = Shard.of(np.arange(40), np.zeros(40, np.int64), v)
    ((ids, scores),) = shard.search(shard.exact(1 << 26), np.array([(1 << 26) - 1, 3]), -1, 0, True, [(None, None)], 3)
    assert ids.tolist() == [0, 1, 2] and scores.tolist() == [int(x[0]) * ((1 << 26) - 1) + 3 * int(x[1]) for x in v[:3]]


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = op12_hard_negatives(spark, SF)
    wanted = con.sql(OP12_SQL)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted.fetchall()) and wanted.columns == got.columns
    assert got.count() > 0 and table(spark, SF, "embeddings").count() == 500
