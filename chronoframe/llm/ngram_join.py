"""Jaccard self-join of documents on word shingles, filtered under several global orders of the shingles.

A set of n shingles that is similar to another one shares a shingle with it among its first n - ceil(0.75 n) + 1 shingles,
under any global order. The first order puts frequent shingles last (a bounded table of them is counted over all documents);
its prefixes give lists of sets, one for each shingle. Candidates must also meet in their prefixes under two more orders,
and agree with a bitmap that bounds the symmetric difference, before whole sets are compared.

Equal sets are one class from the start. Short lists give their pairs, those only that can still reach the overlap from
that shingle on. Long lists come from groups of near copies, which share dozens of them: there every set first meets one
other set, that of its longest list; what is linked is one component and meets no more. Lists that still hold different
components are gathered into families, a family's sets are compared block by block with NumPy, each pair of sets once, and
only the pairs that the filters leave are emitted: first the best for each set, so that components grow, at last all. (A
family that would take more pairs than its lists do, since they only touch each other, is compared list by list.) So a
group of thousands of near copies emits a few pairs for each, and yet no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronoframe.llm.common import cut, discard, groups, lean, small_batches, table
from chronoframe.llm.components import components, joined

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without structure."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; a shorter text is one shingle, an empty one none."""
    words = [t.encode("utf-8", "replace").translate(LOWER).split() for t in texts]
    flat = [w for ws in words for w in ws]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), U, len(flat))
    acc = h[: max(0, len(h) - k + 1)].copy()
    for j in range(1, k):
        acc = mixed(acc) + h[j : len(acc) + j]
    acc = mixed(acc + U(k))
    out, at = [], 0
    for ws in words:
        n = len(ws)
        if n >= k:
            out.append(np.unique(acc[at : at + n - k + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=n)], U))
        else:
            out.append(np.zeros(0, U))
        at += n
    return out


def set_keys(s: np.ndarray, bits: int = 64, clash: frozenset[int] = frozenset()) -> tuple[int, int]:
    """A key of so many bits and one of 64 bits of a set; the second one takes the first one's place where that is in ``clash``."""
    h = xxhash.xxh3_128_intdigest(s.tobytes(), seed=len(s))
    first, second = (h >> (128 - bits)) - (1 << (bits - 1)), (h & (1 << 64) - 1) - (1 << 63)
    return (second if first in clash else first), second


class Frequent:
    """A mergeable summary of the most frequent numbers (Misra and Gries): counts fall short by total / size at most."""

    def __init__(self, size: int = 1 << 20):
        self.size, self.wait, self.waiting = size, [], 0
        self.value, self.count = np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        self.wait.append(values)
        self.waiting += len(values)
        if self.waiting > self.size:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            v, c = np.unique(np.concatenate(self.wait), return_counts=True)
            both, place = np.unique(np.concatenate([self.value, v]), return_inverse=True)
            count = np.zeros(len(both), np.int64)
            np.add.at(count, place, np.concatenate([self.count, c]))
            if len(both) > self.size:
                count -= np.partition(count, len(both) - self.size - 1)[len(both) - self.size - 1]
            keep = count > 0
            self.value, self.count, self.wait, self.waiting = both[keep], count[keep], [], 0


def signed(x: np.ndarray) -> np.ndarray:
    return (x ^ U(1 << 63)).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(U) ^ U(1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


#: Pairs whose fingerprints are compared at a time.
STEP, MARK_BYTES = 1024, 500_000
#: Multipliers of the further orders.
ORDERS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))


def prints_of(s: np.ndarray, percent: int) -> bytes:
    """Fingerprints of the prefixes under the further orders, the first one's number ahead."""
    p = prefix_length(len(s), percent)
    parts = []
    for m in ORDERS:
        rank = mixed(s * m)
        parts.append(np.unique((np.partition(rank, p - 1)[:p] & U(0xFFFF)).astype(np.uint16)))
    return b"".join([np.array([len(parts[0])], np.int32).tobytes(), *[p.tobytes() for p in parts]])


def prints_meet(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Of each pair, whether the prefixes may share a shingle under each further order."""

    def parts(marks: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        size = np.fromiter(map(len, marks), np.int64, len(marks)) // 2
        flat, start = np.frombuffer(b"".join(marks), np.uint16).astype(np.int64), np.cumsum(size) - size
        first = flat[start] | flat[start + 1] << 16
        place = np.arange(len(flat)) - np.repeat(start, size) - 2
        own = np.repeat(np.arange(len(marks)), size)
        ahead = place < np.repeat(first, size)
        keys = own << 16 | flat
        return [(own[here], keys[here]) for here in ((place >= 0) & ahead, ~ahead)]

    met = np.ones(len(x), bool)
    ends = np.cumsum([len(p) + len(q) for p, q in zip(x, y, strict=True)])
    first = 0
    while first < len(x):  # whatever the sets' sizes, about MARK_BYTES of fingerprints at a time
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + MARK_BYTES)))
        for (own, a), (_, b) in zip(parts(x[first:last]), parts(y[first:last]), strict=True):
            at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
            met[first:last] &= np.bincount(own[b[at] == a] if len(b) else own[:0], minlength=last - first) > 0
        first = last
    return met


def bitmap(s: np.ndarray, wide: int = 1) -> bytes:
    """The parity of the number of shingles at each place, over ``wide`` times as many places as the set asks for."""
    places = max(64, wide << int(len(s) - 1).bit_length())
    return np.packbits((np.bincount((mixed(s) & U(places - 1)).astype(np.int64), minlength=places) & 1).astype(bool)).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) with several places as one, down to so many bytes."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def bits_agree(n: np.ndarray, x: list[bytes], m: np.ndarray, y: list[bytes], percent: int) -> np.ndarray:
    """False only for pairs of sets of n and m shingles with these bitmaps that can't be linked."""
    fit = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
    wide = [np.fromiter(map(len, marks), np.int64, len(marks)) for marks in (x, y)]
    for a, b in {(int(a), int(b)) for a, b in zip(*(w[fit] for w in wide), strict=True)}:
        at = np.flatnonzero(fit & (wide[0] == a) & (wide[1] == b))
        here, there = (folded(np.frombuffer(b"".join(marks[i] for i in at), np.uint8).reshape(len(at), -1), min(a, b)).view(U) for marks in (x, y))
        # each place that differs holds a shingle of one set only; those are n + m - 2 common, and common >= p / (100 + p) (n + m)
        apart = np.bitwise_count(here ^ there).sum(axis=1, dtype=np.int64)
        fit[at] = apart * (100 + percent) <= (n[at] + m[at]) * (100 - percent)
    return fit


def each_set(docs: DataFrame, key: str, k: int, make, out: str) -> DataFrame:
    """``make(batches of (ids, sets))`` over all texts, as Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets():
            for b in batches:
                ids = b.column(key)
                for first, texts in groups(b.column("text")):
                    yield ids.slice(first, len(texts)), shingle_sets(texts, k)

        yield from make(sets())

    return small_batches(docs).select(key, "text").mapInArrow(lean(run), out)


def summarise(docs: DataFrame, key: str, k: int, percent: int, size: int, keys_of=set_keys) -> DataFrame:
    """A row (id, n, set, other, bits, prints) for each document, and rows (token, count) of each task's frequent shingles."""
    kind, id_type = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)
    names = ["id", "n", "set", "other", "bits", "prints", "token", "count"]

    def make(sets):
        often = Frequent(size)
        for ids, found in sets:
            for s in found:
                often.add(s)
            keys = [keys_of(s) for s in found]
            ints = [pa.array(x, pa.int64()) for x in ([len(s) for s in found], [a for a, _ in keys], [b for _, b in keys])]
            marks = [pa.array([f(s) if len(s) else None for s in found], pa.binary()) for f in (bitmap, lambda s: prints_of(s, percent))]
            none = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *ints, *marks, none, none], names)
        often.merge()
        keep = often.count > 1
        token, count = pa.array(signed(often.value[keep])), pa.array(often.count[keep])
        none, no_marks = pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(token), id_type), none, none, none, no_marks, no_marks, token, count], names)

    return each_set(docs, key, k, make, f"id {kind}, n long, set long, other long, bits binary, prints binary, token long, count long")


def postings(docs: DataFrame, key: str, k: int, percent: int, often: np.ndarray, keys_of=set_keys) -> DataFrame:
    """(token, set, at) for the prefix of each set under the first order: rare by hash, then frequent by count.

    ``at`` holds the set's size (from bit 32), the token's place in the order (from bit 1) and whether it is frequent.
    ``often``: rows of (token, count) in the order of tokens. Equal sets of one task are listed once.
    """
    held = docs.sparkSession.sparkContext.broadcast(often)  # bounded by most_frequent

    def make(sets):
        value, count = unsigned(held.value[:, 0].copy()), held.value[:, 1].astype(U)
        seen: set[int] = set()
        for _, found in sets:
            tokens, keys, places = [], [], []
            for s in found:
                if not len(s) or (h := keys_of(s)[0]) in seen:
                    continue
                seen.add(h)
                p = prefix_length(len(s), percent)
                hot = np.zeros(len(s), bool)
                if len(value):
                    at = np.minimum(np.searchsorted(value, s), len(value) - 1)
                    hot = value[at] == s
                cold = s[~hot][:p]  # sorted by hash
                rest = s[hot]
                if len(cold) < p:
                    rest = rest[np.argsort(count[at[hot]], kind="stable")][: p - len(cold)]
                    tokens.append(np.concatenate([cold, rest]))
                else:
                    tokens.append(cold)
                keys.append(np.full(p, h, np.int64))
                place = np.arange(p)
                places.append((len(s) << 32) + 2 * place + (place >= len(cold)))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], ["token", "set", "at"])

    return each_set(docs, key, k, make, "token long, set long, at long")


def _whole_sets(docs: DataFrame, key: str, k: int, percent: int, wanted: DataFrame, keys_of, broadcast_rows: int, into: list[str]) -> DataFrame:
    """(set, n, tokens, bits, prints) of the sets in ``wanted`` (``set, id``), from the text of one document each.

    Where ids are repeated there are more rows than asked for, one from each task at most; they meet nothing, or the same pair once more.
    """
    ids = cut(wanted.select("id").distinct(), into)
    texts = docs.select(key, "text").join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, F.col(key).eqNullSafe(F.col("id")))

    def make(sets):
        seen: set[int] = set()
        for _, found in sets:
            some = []
            for s in found:
                if len(s) and (h := keys_of(s)[0]) not in seen:
                    seen.add(h)
                    some.append(s)
            columns = [pa.array([keys_of(s)[0] for s in some], pa.int64()), pa.array([len(s) for s in some], pa.int32()), pa.array([signed(s) for s in some], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([f(s) for s in some], pa.binary()) for f in (lambda s: bitmap(s, 4), lambda s: prints_of(s, percent))]], ["set", "n", "tokens", "bits", "prints"])

    return cut(each_set(texts, key, k, make, "set long, n int, tokens array<long>, bits binary, prints binary"), into)


def _passing(pairs: DataFrame, sigs: DataFrame, columns: list[str], test) -> DataFrame:
    """The pairs (a, b) for which ``test`` of both sides' columns, a batch at a time, holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            values = [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in (t.column(f"{c}{x}") for x in "ab" for c in columns)]
            keep = pa.array(test(*values))
            yield pa.RecordBatch.from_arrays([t.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    side = lambda x: sigs.select(F.col("set").alias(x), *[F.col(c).alias(f"{c}{x}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(run), "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are linked."""
    whole = lambda x: sets.select(F.col("set").alias(x), F.col("tokens").alias(f"t{x}"))
    common = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(whole("a"), "a").join(whole("b"), "b").where(common * 100 >= (F.size("ta") + F.size("tb") - common) * percent).select("a", "b")


def agreeing(t: pa.Table, percent: int, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of different components that all filters leave; with ``best`` none of two rows that both have one.

    ``t``: ``n, component, cell, x, y, bits, prints``. Rows of two cells meet across them, rows of one cell among themselves.
    """
    n, component, cell = (t.column(c).to_numpy() for c in ("n", "component", "cell"))
    bits, prints = t.column("bits").to_pylist(), t.column("prints").to_pylist()
    width = np.array([len(x) for x in bits])
    apart = t.column("x")[0] != t.column("y")[0]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = {w: np.flatnonzero(width == w) for w in np.unique(width)}
    maps = {w: np.frombuffer(b"".join(bits[i] for i in at), np.uint8).reshape(len(at), -1) for w, at in rows.items()}
    for w, at in rows.items():
        for v in (v for v in rows if v <= w):
            to, here, there = rows[v], folded(maps[w], v).view(U), maps[v].view(U)
            for i, x in zip(at, here, strict=True):
                ok = (component[to] != component[i]) & (np.minimum(n[to], n[i]) * 100 >= np.maximum(n[to], n[i]) * percent)
                ok &= (cell[to] != cell[i]) if apart else True
                if v == w:
                    ok &= to > i
                if ok.any():
                    j = to[ok]
                    apart_by = np.bitwise_count(there[ok] ^ x).sum(axis=1, dtype=np.int64)
                    good = apart_by * (100 + percent) <= (n[j] + n[i]) * (100 - percent)
                    found.append((np.full(int(good.sum()), i), j[good], apart_by[good] / (n[j[good]] + n[i])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, far = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(far, kind="stable") if best else np.arange(len(a))
    has, kept = np.zeros(len(n), bool), []
    for first in range(0, len(order), STEP):
        some = order[first : first + STEP]
        if best:
            some = some[~(has[a[some]] & has[b[some]])]
        some = some[prints_meet([prints[i] for i in a[some]], [prints[i] for i in b[some]])]
        if not best:
            kept.append(some)
            continue
        for x in some:  # the nearest first
            if not (has[a[x]] and has[b[x]]):
                kept.append(np.array([x]))
                has[a[x]] = has[b[x]] = True
    kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return a[kept], b[kept]


def _in_blocks(rows: DataFrame, marks: DataFrame, percent: int, block: int, best: bool) -> DataFrame:
    """Pairs (a, b) of different components that stand in a group and pass the filters, from blocks of at most about ``block`` rows.

    ``rows``: ``group, set, n, component``, ``marks``: ``set, bits, prints``. A group's cells are its length classes (only neighbours can be
    linked), apart for its largest component (whose rows needn't meet each other), dealt into blocks.
    """
    sizes = rows.groupBy("group", "component").agg(F.count("*").alias("rows"))
    about = sizes.groupBy("group").agg(F.max(F.struct("rows", "component")).getField("component").alias("main"), F.count("*").alias("several")).where("several > 1")
    base = math.log(100 / percent * 1.01)
    of = rows.join(about.select("group", "main"), "group").withColumn("main", (F.col("component") == F.col("main")).cast("int"))
    of = of.withColumn("class", F.floor(F.log("n") / F.lit(base)).cast("long"))
    cells = of.groupBy("group", "main", "class").agg(F.ceil(F.count("*") / block).alias("blocks"))
    met = cells.select("group", *[F.col(c).alias(f"to_{c}") for c in ("main", "class", "blocks")])
    deal = F.pmod(F.xxhash64("set"), F.col("blocks"))
    of = of.join(cells, ["group", "main", "class"]).withColumn("cell", (F.col("class") * 2 + F.col("main")) * (1 << 32) + deal)
    of = of.join(met, "group").where("abs(to_class - class) <= 1 and main + to_main < 2")
    to = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("to_blocks") - 1), lambda o: (F.col("to_class") * 2 + F.col("to_main")) * (1 << 32) + o))
    of = of.withColumn("to", to).withColumn("x", F.least("cell", "to")).withColumn("y", F.greatest("cell", "to"))

    def run(t: pa.Table) -> pa.Table:
        a, b = agreeing(t.combine_chunks(), percent, best)
        ids = t.column("set").to_numpy()
        return pa.table({"a": ids[a], "b": ids[b]}, pa.schema({"a": pa.int64(), "b": pa.int64()}))

    of = of.select("group", "x", "y", "set", "n", "component", "cell").join(marks.select("set", "bits", "prints"), "set")
    pairs = of.groupBy("group", "x", "y").applyInArrow(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_documents(
    docs: DataFrame,
    key: str = "doc_id",
    k: int = 5,
    percent: int = 75,
    heavy_from: int = 8,
    most_frequent: int = 200_000,
    summary_size: int = 1 << 20,
    long_from: int = 32,
    block: int = 512,
    rounds: int = 2,
    broadcast_rows: int = 2_000_000,
    key_bits: int = 64,
) -> DataFrame:
    """``key, n_shingles, component`` for every row of ``docs``: documents that chains of links tie together.

    Two documents are linked when their sets of k-word shingles have a Jaccard similarity of percent / 100 or more; words
    are runs without ASCII white space, A-Z lower-cased. ``component`` is the least key of those reachable. A null or
    empty text has no shingles and is its own component; equal texts are one class whatever their number; rows with the
    same key stay; an empty table gives no rows; other columns are ignored. Shingles are known by 64-bit hashes, sets by
    64 bits too, or by other 64 bits where two sets are found to have the same ones.

    ``heavy_from``, ``most_frequent``, ``summary_size``: which shingles count as frequent. They bound what is broadcast
    and steer the first order; like ``long_from`` (the length of long lists), ``block`` and ``rounds`` they don't change
    the result. Fewer ``key_bits`` are for tests of equal keys.
    """
    spark, done = docs.sparkSession, []
    keys_of = partial(set_keys, bits=key_bits)
    docs = docs.select(F.col(key).alias("key"), "text")
    found = cut(summarise(docs, "key", k, percent, summary_size, keys_of), done)
    frequent = (
        found.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= heavy_from)
        .orderBy(F.desc("count"), "token").limit(most_frequent).collect()
    )
    often = np.array(sorted((r.token, r["count"]) for r in frequent), np.int64).reshape(-1, 2)
    own = found.where("token is null").drop("token", "count")
    classes = own.where("n > 0").groupBy("set").agg(F.min("id").alias("id"), F.min("other").alias("other"), F.max("other").alias("last"))
    clash = frozenset(r["set"] for r in classes.where("other <> last").select("set").collect())  # pairs of rows / 2^65, about
    if clash:
        own = own.withColumn("set", F.when(F.col("set").isin(*clash), F.col("other")).otherwise(F.col("set")))
        classes = own.where("n > 0").groupBy("set").agg(F.min("id").alias("id"))
        keys_of = partial(set_keys, bits=key_bits, clash=clash)

    # lists: the sets that share a prefix shingle, once each; a frequent one's list is counted in cells
    p = postings(docs, "key", k, percent, often, keys_of)
    heavy = F.col("at").bitwiseAND(1) == 1
    p = p.withColumn("cell", F.when(heavy, F.pmod("set", F.lit(64))).otherwise(F.lit(0)).cast("int"))
    w = W.partitionBy("token", "cell")
    p = p.withColumn("before", F.lag("set").over(w.orderBy("set"))).where("before is null or before <> set")
    p = p.withColumn("rows", F.count("*").over(w)).where(heavy | (F.col("rows") > 1))
    n, place = F.shiftright("at", 32), F.shiftright(F.col("at").bitwiseAND(0xFFFFFFFF), 1)
    p = cut(p.select("token", "set", n.alias("n"), (n - place).alias("left"), heavy.alias("heavy"), "rows"), done)
    heavy = p.where("heavy").groupBy("token").agg(F.count("*").alias("all"))  # at most most_frequent rows
    p = p.join(F.broadcast(heavy), "token", "left").withColumn("rows", F.coalesce("all", "rows")).where("rows > 1").drop("all", "heavy")
    short, long = p.where(F.col("rows") < long_from), p.where(F.col("rows") >= long_from)

    # one document of each set in lists
    wanted = cut(classes.select("set", "id").join(p.select("set").distinct(), "set"), done)
    sigs = cut(own.where("n > 0").select("set", "n", "bits", "prints").dropDuplicates(["set"]).join(wanted.select("set"), "set", "left_semi"), done)
    some = lambda marks, sets: cut(marks.join(cut(sets.select("set").distinct(), done), "set", "left_semi"), done)
    ends_of = lambda pairs: pairs.select(F.col("a").alias("set")).union(pairs.select("b"))

    # pairs of short lists that can reach the overlap from this shingle on, and each set with the least one of its longest list
    side = lambda x: short.select("token", F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("left").alias(f"left{x}"))
    both, total = side("a").join(side("b"), "token"), F.col("na") + F.col("nb")
    fit = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (F.least("lefta", "leftb") * (100 + percent) >= total * percent)
    longest = long.groupBy("set").agg(F.max(F.struct("rows", "token")).getField("token").alias("token"))
    stars = longest.join(long.groupBy("token").agg(F.min("set").alias("a")), "token").select("a", F.col("set").alias("b")).where("a <> b")
    pairs = both.where((F.col("a") < F.col("b")) & fit).select("a", "b").union(stars).distinct()
    pairs = cut(_passing(pairs, sigs, ["n", "bits"], lambda n, x, m, y: bits_agree(n, x, m, y, percent)), done)
    pairs = cut(_passing(pairs, some(sigs.select("set", "prints"), ends_of(pairs)), ["prints"], prints_meet), done)
    whole = lambda sets: _whole_sets(docs, "key", k, percent, some(wanted, sets), keys_of, broadcast_rows, done)
    tied = components(_linked(pairs, whole(ends_of(pairs)), percent), into=done)

    # long lists that hold several components still, by families of such lists
    named = lambda rows: rows.join(tied.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    q = named(long)
    about = q.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("last")).where("least <> last")
    q = cut(q.join(about.drop("last"), "token"), done)
    families = components(q.select(F.col("component").alias("a"), F.col("least").alias("b")), into=done)
    q = q.join(families.select(F.col("node").alias("component"), F.col("component").alias("family")), "component")
    # a family is compared as a whole where that takes fewer pairs than list by list; its lists hold all pairs that matter
    costs = q.groupBy("family").agg(F.countDistinct("set").alias("sets"), F.sum("rows").alias("pairs"))
    dense = F.col("sets") * F.col("sets") <= F.col("pairs") * 4
    members = q.join(costs, "family").select(F.when(dense, F.col("family")).otherwise(F.col("token")).alias("group"), "set", "n", dense.alias("dense"))
    members = cut(members.distinct(), done)
    families, lists = members.where("dense"), members.where("not dense")
    if families.take(1):
        sets = whole(families)
        for last in [False] * rounds + [True]:
            pairs = cut(_in_blocks(cut(named(families), done), sets, percent, block, not last), done)
            tied = joined(tied, _linked(pairs, sets, percent), done)
    if lists.take(1):
        pairs = cut(_in_blocks(cut(named(lists), done), some(sigs, lists), percent, block, False), done)
        tied = joined(tied, _linked(pairs, whole(ends_of(pairs)), percent), done)

    roots = classes.select("set", "id").join(tied.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("root", F.coalesce("component", "set"))
    roots = cut(roots.select("set", "root", "id"), done)
    names = roots.join(roots.groupBy("root").agg(F.min("id").alias("component")), "root").select("set", "component")
    out = own.select("id", "n", "set").join(names, "set", "left")
    out = cut(out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component")))
    discard(spark, done)
    return out


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
