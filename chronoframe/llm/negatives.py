"""Hard negatives by the threshold algorithm.

Rows are dealt into shards; a shard holds, for each dimension, the list of its rows in the order of their values. An
anchor goes down all lists at once, each from the end that its component's sign favours, scores every row when it first
meets it, and stops where no row further down can matter: the sum of its components times the values reached is a bound
for every row not met yet. Shards are searched side by side, and their few best rows are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoframe.llm.common import cut, lean, small_batches, table

#: Numbers of a shard: rows times the longest vector; and its most rows (their places take two bytes).
SHARD_CELLS, SHARD_ROWS = 1 << 19, 1 << 16
#: About so many anchors are searched for together.
BLOCK = 1024
#: Up to so many anchors (about 1 KB each, for 64 components) are sent to every task; more meet the shards in a shuffle.
FEW = 8192
#: Whole components beyond this are taken as this, so that a score of up to 1,024 of them fits a long.
LARGEST = 1 << 26
#: Rows that are read from each list before the bound is tested first; it doubles from test to test.
FIRST_DEPTH = 32


@dataclass
class Shard:
    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    lists: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray]) -> Shard:
        values = np.zeros((len(ids), max(map(len, vectors), default=0)), np.int32)
        for row, v in zip(values, vectors, strict=True):
            row[: len(v)] = v
        return cls(ids, labels, values, np.argsort(-values.astype(np.int64), axis=0, kind="stable").T.astype(np.uint16))

    def packed(self) -> list:
        return [len(self.ids), self.ids.tobytes(), self.labels.tobytes(), self.values.tobytes(), self.lists.tobytes()]

    @classmethod
    def unpacked(cls, n: int, ids: bytes, labels: bytes, values: bytes, lists: bytes) -> Shard:
        whole = np.frombuffer(values, np.int32).reshape(n, -1)
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), whole, np.frombuffer(lists, np.uint16).reshape(whole.shape[1], n))

    def exact(self, most: int) -> np.ndarray:
        """The values in the kind of number that multiplies without loss with components up to ``most``: floats are faster."""
        mine = int(np.abs(self.values).max(initial=0))
        return self.values.astype(np.float64 if max(1, mine) * max(1, most) * max(1, self.values.shape[1]) < 1 << 53 else np.int64)

    def search(self, values: np.ndarray, anchor: np.ndarray, own_id: int, label: int, same: bool, windows: list[tuple[int | None, int | None]], k: int) -> list[np.ndarray]:
        """For each window (lowest and highest score, None: open) the first ``k`` rows in it: higher scores first, ties by smaller id.

        Rows with the anchor's id take no part, nor do those of another label (``same``) or of its own (not ``same``).
        ``values`` is ``exact()``.
        """
        n, width = self.values.shape
        a = np.zeros(width, values.dtype)
        a[: len(anchor)] = anchor[:width]
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        met, best = np.zeros(n, bool), [(np.zeros(0, np.int64), np.zeros(0, values.dtype)) for _ in windows]
        near, far = 0, min(FIRST_DEPTH, n) if len(up) + len(down) else n
        open_ = [w for w, (lo, hi) in enumerate(windows) if lo is None or hi is None or lo <= hi]
        while open_ and near < n:
            fresh = np.zeros(n, bool)
            if far == n:
                fresh[:] = True
            else:  # sorted access, each list from its own end
                fresh[self.lists[up, near:far]] = True
                fresh[self.lists[down, n - far : n - near]] = True
            fresh &= ~met
            met |= fresh
            rows = np.flatnonzero(fresh & ((self.labels == label) == same) & (self.ids != own_id))
            scores = values[rows] @ a  # random access
            # no row that wasn't met scores more than this
            bound = None if far == n else values[self.lists[up, far - 1], up] @ a[up] + values[self.lists[down, n - far], down] @ a[down]
            still = []
            for w in open_:
                lo, hi = windows[w]
                inside = np.ones(len(rows), bool)
                if lo is not None:
                    inside &= scores >= lo
                if hi is not None:
                    inside &= scores <= hi
                found, score = np.concatenate([best[w][0], rows[inside]]), np.concatenate([best[w][1], scores[inside]])
                if len(found) > k:
                    first = np.lexsort((self.ids[found], -score))[:k]
                    found, score = found[first], score[first]
                best[w] = found, score
                floor = score.min() if len(found) == k else lo
                if bound is not None and (floor is None or bound >= floor):
                    still.append(w)
            open_, near, far = still, far, min(n, 2 * far)
        return [np.stack([self.ids[rows], score.astype(np.int64)]) for rows, score in best]


def usable(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``id, label, q``: rows with an id, a label and a vector of finite numbers; ``q`` is ``floor(scale * x)`` of each."""
    whole = lambda x: F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), F.lit(scale) * x.cast("double")))).cast("int")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & sound)
    return rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(vector, whole).alias("q"))


def shards(rows: DataFrame, cells: int = SHARD_CELLS) -> DataFrame:
    """``shard, n, ids, labels, values, lists``: the rows of ``usable`` as they come, in shards of bounded size."""
    names = ["n", "ids", "labels", "values", "lists"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        widest = 1

        def closed():
            shard = Shard.of(np.array(held[0], np.int64), np.array(held[1], np.int64), held[2])
            for part in held:
                part.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in shard.packed()], names)

        for b in batches:
            q = b.column("q")
            flat, ends = q.values.to_numpy(), q.offsets.to_numpy()
            for i, (id_, label) in enumerate(zip(b.column("id").to_pylist(), b.column("label").to_pylist(), strict=True)):
                v = flat[ends[i] : ends[i + 1]]
                if held[0] and ((len(held[0]) + 1) * max(widest, len(v)) > cells or len(held[0]) == SHARD_ROWS):
                    yield closed()
                    widest = 1
                widest = max(widest, len(v))
                for part, x in zip(held, (id_, label, v.copy()), strict=True):
                    part.append(x)
        if held[0]:
            yield closed()

    found = small_batches(rows).mapInArrow(lean(pack), "n long, ids binary, labels binary, values binary, lists binary")
    return found.select(F.monotonically_increasing_id().alias("shard"), *names)


def searched(packed: DataFrame, n_shards: int, requests: DataFrame, n_requests: int, same: bool, k: int, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """``anchor, place, id, score``: each shard's first ``k`` rows of each window of each request.

    ``requests``: ``anchor, id, label, q, windows`` (an array of ``place, lo, hi``; null: open). Every block of requests
    meets every shard. Up to ``few`` requests are sent to all tasks; more are copied to as many buckets as there are
    shards, and joined by bucket, so that shards are shuffled once whatever the number of anchors.
    """
    blocks = max(1, -(-n_requests // block))
    dealt = requests.select(F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block"), F.struct("anchor", "id", "label", "q", "windows").alias("r"))
    dealt = cut(dealt.groupBy("block").agg(F.collect_list("r").alias("rs")))  # about ``block`` requests each
    buckets = max(1, n_shards)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    if n_requests <= few:
        met = packed.repartition(buckets, "shard").select("*", each(blocks).alias("block")).join(F.broadcast(dealt), "block")
    else:
        own = packed.withColumn("bucket", F.pmod(F.xxhash64("shard"), F.lit(buckets)))
        met = own.join(dealt.select("rs", each(buckets).alias("bucket")).hint("merge"), "bucket")
    names = ["anchor", "place", "id", "score"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard.unpacked(*(b.column(c)[i].as_py() for c in ("n", "ids", "labels", "values", "lists")))
                rs = b.column("rs")[i].as_py()
                values = shard.exact(max((abs(x) for r in rs for x in r["q"]), default=0))
                out: list[tuple[int, int, np.ndarray]] = []
                for r in rs:
                    got = shard.search(values, np.array(r["q"], np.int64), r["id"], r["label"], same, [(w["lo"], w["hi"]) for w in r["windows"]], k)
                    out += [(r["anchor"], w["place"], x) for w, x in zip(r["windows"], got, strict=True) if x.shape[1]]
                n = [x.shape[1] for _, _, x in out]
                found = np.concatenate([x for _, _, x in out], axis=1) if out else np.zeros((2, 0), np.int64)
                columns = [np.repeat(np.array([a for a, _, _ in out], np.int64), n), np.repeat(np.array([p for _, p, _ in out], np.int32), n), *found]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return met.select("n", "ids", "labels", "values", "lists", "rs").mapInArrow(lean(search), "anchor long, place int, id long, score long")


def mine_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, cells: int = SHARD_CELLS, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, of ``usable`` rows and anchors.

    An anchor's positives are its first ``positives`` rows of the same label, a positive's negatives the first
    ``negatives`` rows of other labels whose score is between ``low`` and ``high`` percent of the positive's. Scores are
    inner products (a missing component is 0); higher ones come first, ties go to the smaller id. Rows with the anchor's
    own id are neither. A repeated row counts as often as it stands; a repeated anchor counts once, and an anchor id with
    different vectors is an anchor for each. Null ids, labels, vectors and components, and infinite ones, take no part.
    An empty table gives no rows.
    """
    packed = cut(shards(rows, cells))
    n_shards = packed.count()
    asked = cut(anchors.dropDuplicates(["id", "label", "q"]).select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "q"))
    n_asked = asked.count()
    open_ = F.expr("array(named_struct('place', 0, 'lo', cast(null as bigint), 'hi', cast(null as bigint)))")
    order = (F.col("score").desc(), F.col("id"))

    def merged(found: DataFrame, k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))).where(F.col("rank") <= k)

    near = cut(merged(searched(packed, n_shards, asked.withColumn("windows", open_), n_asked, True, positives, block, few), positives))
    near = near.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    lo, hi = F.expr(f"cast(ceil(positive_score * cast({low} as decimal(3)) / 100) as bigint)"), F.expr(f"cast(floor(positive_score * cast({high} as decimal(3)) / 100) as bigint)")
    windows = near.groupBy("anchor").agg(F.collect_list(F.struct("place", lo.alias("lo"), hi.alias("hi"))).alias("windows"))  # at most ``positives``
    found = merged(searched(packed, n_shards, asked.join(windows, "anchor"), n_asked, False, negatives, block, few), negatives)
    named = found.join(near, ["anchor", "place"]).join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    rows = usable(vectors.withColumn("label", F.expr("case when vec_id % 7 = 0 then (label + 1) % 10 else label end")))
    return mine_negatives(rows, rows.where("id % 100 = 0"))


OP12_SQL = """
WITH v AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
),
a AS (SELECT DISTINCT * FROM v WHERE id % 100 = 0),
near AS (
    SELECT a.id AS anchor_id, a.label AS label, a.q AS q, c.id AS positive_id, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS positive_score
    FROM a JOIN v c ON a.label = c.label AND a.id <> c.id
    QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY positive_score DESC, positive_id) <= 5
),
far AS (
    SELECT n.anchor_id, n.positive_id, n.positive_score, c.id AS negative_id, CAST(list_dot_product(n.q, c.q) AS BIGINT) AS negative_score
    FROM near n JOIN v c ON n.label <> c.label
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM far
WHERE 30 * positive_score <= 100 * negative_score AND 100 * negative_score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)
QUALIFY row_number() OVER w <= 10
"""
