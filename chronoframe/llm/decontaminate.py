"""Benchmark decontamination by the q-gram lemma, with banded alignment to verify.

A passage of m characters that differs from a benchmark item by at most k edits shares at least m - q + 1 - k q of its
q-grams, and all of them on k + 1 neighbouring diagonals. Shared q-grams are counted in overlapping bands of diagonals;
regions that meet the bound are aligned within their band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import groups, lean, small_batches, table

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
FILTER_BITS = 22
#: Items are searched for in blocks of at most so many characters; each block is one pass over the documents.
BLOCK_CHARS = 8_000_000
N_CODES = 0x110000


@cache
def folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case where that is one code point, and whether it is a letter or digit."""
    low = np.arange(N_CODES, dtype=np.uint32)
    word = np.zeros(N_CODES, bool)
    for i in range(N_CODES):
        c = chr(i)
        if c.isalnum():
            word[i] = True
            if len(x := c.lower()) == 1:
                low[i] = ord(x)
    return low, word


class Normal:
    """Texts as lower-case letters and digits with single gaps, and where each symbol stands in its text."""

    def __init__(self):
        self.low, self.word = folding()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all texts with a unique separator 0 before each, their place in the own text, and the starts."""
        codes = np.frombuffer("\n".join(["", *texts]).encode("utf-32-le", "replace"), np.uint32)
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]
        word = self.word[codes]
        keep = word.copy()
        keep[1:] |= word[:-1]
        keep[starts] = True
        symbols = np.where(word, self.low[codes], 32).astype(np.uint32)
        symbols[starts] = 0
        place = np.arange(len(codes)) - np.repeat(starts, np.diff([*starts, len(codes)])) - 1
        own = np.cumsum(keep)[starts] - 1
        return symbols[keep], place[keep], own


def grams(symbols: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q symbols from each place on."""
    h = np.zeros(max(0, len(symbols) - q + 1), U)
    for j in range(q):
        h = h * BASE + symbols[j : len(h) + j].astype(U) + U(1)
    h ^= h >> U(29)
    return h * U(0xBF58476D1CE4E5B9)


@dataclass
class Items:
    """A block of distinct items: q-grams in order with the items and places they come from, and each item's edit budget."""

    ids: list[list]
    symbols: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    gram: np.ndarray
    item: np.ndarray
    at: np.ndarray
    first: np.ndarray


def index_items(same: dict[bytes, list], q: int, edits: np.ndarray, common: int = 32, spare: int = 8) -> Items:
    """Items of at least q symbols (``symbols, ids`` by symbols), whose budgets leave at least one of their q-grams.

    k edits spoil at most k q of an item's q-grams, whichever are looked up. So those that stand at more than ``common``
    places of the items are left out, the most frequent first, while k q + ``spare`` stay; the bound falls with them.
    """
    symbols, ids = [s for s, _ in same.values()], [i for _, i in same.values()]
    m = np.array([len(s) for s in symbols], np.int64)
    gram = np.concatenate([grams(s, q) for s in symbols]) if ids else np.zeros(0, U)
    item = np.repeat(np.arange(len(ids)), m - q + 1)
    at = np.concatenate([np.arange(n - q + 1) for n in m]) if ids else np.zeros(0, np.int64)
    _, which, count = np.unique(gram, return_inverse=True, return_counts=True)
    often = count[which] if ids else np.zeros(0, np.int64)
    order = np.lexsort((at, often, item))
    gram, item, at, often = gram[order], item[order], at[order], often[order]
    rank = np.arange(len(item)) - np.repeat(np.cumsum(m - q + 1) - (m - q + 1), m - q + 1)
    keep = (often <= common) | (rank < (edits * q + spare)[item])
    gram, item, at = gram[keep], item[keep], at[keep]
    order = np.argsort(gram, kind="stable")
    held = np.bincount(item, minlength=len(ids))
    gram, item, at = gram[order], item[order], at[order]
    value, first = np.unique(gram, return_index=True)
    return Items(ids, symbols, edits, held - edits * q, value, item, at, np.append(first, len(gram)))


@dataclass
class Short:
    """Items of one number of symbols, fewer than q, with a gap on either side: they count as whole words only."""

    ids: list[list]
    symbols: list[np.ndarray]
    gram: np.ndarray
    edits: int

    def search(self, symbols: np.ndarray, place: np.ndarray, own: np.ndarray) -> Iterator[tuple]:
        """(text, item, start, end, edits, 1) of each place where an item stands; texts' bounds are gaps."""
        gapped = np.append(np.where(symbols == 0, 32, symbols), 32).astype(np.uint32)
        size = len(self.symbols[0])
        g = grams(gapped, size)
        k = np.minimum(np.searchsorted(self.gram, g), len(self.gram) - 1)
        for at in np.flatnonzero(self.gram[k] == g):
            i = int(k[at])
            if np.array_equal(gapped[at : at + size], self.symbols[i]):
                t = int(np.searchsorted(own, at, "right")) - 1
                first = int(at) + 1
                if first + size - 2 <= (own[t + 1] if t + 1 < len(own) else len(symbols)):
                    yield t, i, int(place[first]), int(place[first + size - 3]) + 1, 0, 1


@dataclass
class Block:
    """Items by the q that leaves each of them a q-gram beyond its edit budget, and those shorter than q, by length."""

    long: dict[int, Items]
    short: list[Short]


def index_block(rows: list[tuple], q: int, rate: float, normal: Normal) -> Block:
    """An item of m symbols has a budget of ``m * rate`` edits, rounded down; items of the same symbols are searched once.

    Where q-grams are too long for a short item's budget, it gets shorter ones, as many symbols as leave a q-gram that no
    edit spoils. Items without a letter or digit are no evidence.
    """
    by_q: dict[int, dict[bytes, list]] = {}
    for i, text in rows:
        s = normal.of([text or ""])[0][1:]
        s = s[int(s[0] == 32) :] if len(s) else s
        s = s[:-1] if len(s) and s[-1] == 32 else s
        if len(s):
            by_q.setdefault(min(q, len(s) // (int(len(s) * rate) + 1)) if len(s) >= q else -len(s), {}).setdefault(s.tobytes(), [s, []])[1].append(i)
    long, short = {}, []
    for own, same in sorted(by_q.items()):
        if own > 0:
            edits = (np.array([len(s) for s, _ in same.values()], np.int64) * rate).astype(np.int64)
            long[own] = index_items(same, own, edits)
        else:
            gap = np.array([32], np.uint32)
            found = sorted(((grams(w, len(w))[0], w, ids) for w, ids in ((np.concatenate([gap, s, gap]), ids) for s, ids in same.values())), key=lambda x: int(x[0]))
            short.append(Short([x[2] for x in found], [x[1] for x in found], np.array([x[0] for x in found], U), 0))
    return Block(long, short)


def align(item: np.ndarray, text: np.ndarray, low: int, width: int, most: int) -> tuple[int, int, int] | None:
    """The best (distance, start, end) of the whole item in text on the diagonals low .. low + width - 1, if within ``most``.

    Row i of the table holds text places i + low + 0 .. width - 1; starts and ends in the text are free.
    """
    far = most + 1
    d = np.arange(width)
    # before the first item symbol: every place of the text is a free start
    place = low + d
    cost = np.where((place >= 0) & (place <= len(text)), 0, far)
    start = np.clip(place, 0, len(text))
    for i in range(len(item)):
        place = i + low + d  # text symbol that a diagonal step uses
        ok = (place >= 0) & (place < len(text))
        same = ok & (text[np.clip(place, 0, len(text) - 1)] == item[i])
        step = np.where(ok, cost + ~same, far)
        drop = np.append(cost[1:] + 1, far)  # item symbol without one in the text
        new = np.minimum(step, drop)
        origin = np.where(drop < step, np.append(start[1:], 0), start)
        # text symbols without one in the item: along the row, each costs 1
        run = np.minimum.accumulate(new - d)
        better = run + d < new
        if better.any():
            source = np.maximum.accumulate(np.where(new - d == run, d, 0))
            new, origin = np.where(better, run + d, new), np.where(better, origin[source], origin)
        cost, start = np.minimum(new, far), origin
        if cost.min() > most:
            return None
    best = int(cost.argmin())
    return int(cost[best]), int(start[best]), int(min(len(item) + low + best, len(text)))


def exact(item: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int, int] | None:
    """The item itself on one of the diagonals."""
    for p in range(max(0, low), min(low + width, len(text) - len(item) + 1)):
        if text[p] == item[0] and np.array_equal(text[p : p + len(item)], item):
            return 0, p, p + len(item)
    return None


def bands(hit: np.ndarray, k: np.ndarray, items: Items, zero: int, most: int = 2_000_000) -> Iterator[tuple[int, int, int]]:
    """(item, band, shared q-grams) of the bands that meet their item's bound, for q-grams k of the items at places ``hit``.

    Bands of 2 (e + 1) diagonals begin every e + 1, for an item's budget of e: any e + 1 neighbouring diagonals lie within
    one. About ``most`` shared grams are held at a time: a band is judged when the text is past it.
    """
    n = items.first[k + 1] - items.first[k]
    whole, size = np.cumsum(n), 2 * zero
    length = np.array([len(x) for x in items.symbols])
    key, count, begin = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while begin < len(hit):
        end = max(begin + 1, int(np.searchsorted(whole, (whole[begin - 1] if begin else 0) + most, "right")))
        here, of = n[begin:end], k[begin:end]
        entry = np.repeat(items.first[of] - np.cumsum(here) + here, here) + np.arange(here.sum())
        pos, item = np.repeat(hit[begin:end], here), items.item[entry]
        band = item * size + (pos - items.at[entry] + zero) // (items.edits[item] + 1)
        key, to = np.unique(np.concatenate([key, band, band - 1]), return_inverse=True)
        count = np.bincount(to, np.concatenate([count, np.ones(2 * len(band), np.int64)])).astype(np.int64)
        item = key // size
        over = key % size * (items.edits[item] + 1) - zero + 2 * (items.edits[item] + 1) + length[item]
        past = over < hit[end] if end < len(hit) else np.ones(len(key), bool)
        good = past & (count >= items.bound[item])
        yield from zip((key[good] // size).tolist(), (key[good] % size).tolist(), count[good].tolist(), strict=True)
        key, count, begin = key[~past], count[~past], end


def search(texts: list[str], block: Block, normal: Normal, bits: dict[int, np.ndarray]) -> list[tuple]:
    """(text, item, start, end, edits, shared q-grams) of every verified region; offsets in code points of the text."""
    symbols, place, own = normal.of(texts)
    found = [(t, one, *rest) for short in block.short for t, i, *rest in short.search(symbols, place, own) for one in short.ids[i]]
    for q, items in block.long.items():
        found += _search_long(symbols, place, own, items, q, bits[q])
    return found


def _search_long(symbols: np.ndarray, place: np.ndarray, own: np.ndarray, items: Items, q: int, bits: np.ndarray) -> list[tuple]:
    g = grams(symbols, q)
    hit = np.flatnonzero(bits[(g >> U(64 - FILTER_BITS)).astype(np.int64)])
    k = np.searchsorted(items.gram, g[hit])
    k[k == len(items.gram)] = 0
    real = items.gram[k] == g[hit]
    hit, k = hit[real], k[real]
    if not len(hit):
        return []
    zero = len(symbols) + 3 * max(len(x) for x in items.symbols) + 3
    out: dict[tuple, tuple] = {}
    ends = np.append(own[1:], len(symbols))
    for i, b, c in bands(hit, k, items, zero):
        w = int(items.edits[i]) + 1
        low, most, word = b * w - zero, int(items.edits[i]), items.symbols[i]
        for t in {int(x) for x in np.searchsorted(own, [max(low, 0), max(low, 0) + 2 * w, low + len(word)], "right") - 1 if x >= 0}:
            begin, end = int(own[t]) + 1, int(ends[t])
            text = symbols[begin:end]
            got = exact(word, text, low - begin, 2 * w) or (align(word, text, low - begin, 2 * w, most) if len(text) else None)
            if got:
                e, s, x = got
                x = max(x, s + 1)
                first, last = int(place[begin + s]), int(place[begin + min(x, len(text)) - 1]) + 1
                old = out.get((t, i, first))
                if old is None or e < old[4]:
                    out[(t, i, first)] = (t, i, first, last, e, c)
    return [(t, one, *rest) for t, i, *rest in out.values() for one in items.ids[i]]


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", q: int = 10, rate: float = 0.06, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key, item, start, end, edits, shared``: passages of whole texts within ``rate`` edits per character of an item.

    Texts are compared as lower-case letters and digits with single gaps, so case, punctuation and white space don't
    matter. An item of fewer than q letters, digits and gaps has to stand there as whole words, without an edit. Null and
    empty texts have no passages; items that are null or have no letter or digit are no evidence; repeated documents and items are each reported; ``shared`` counts those q-grams of an item that are looked up; one region may be reported for several items, and once per start; an empty
    table on either side gives no rows; other columns are ignored.

    The items are the stated query set: they are read in blocks of at most ``block_chars`` characters (plus one item), so
    that what is broadcast is bounded, and each block is a pass over the documents. Two documents never share a region.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    out = f"{key} {kind}, {item} {item_kind}, start int, end int, edits int, shared int"
    rows = small_batches(docs).select(key, "text").where("text is not null")
    found = None
    for held in _blocks(benchmark, item, q, rate, block_chars):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b, first, leaks in _searched(batches, held.value):
                if leaks:
                    t, i, s, e, d, n = zip(*leaks, strict=True)
                    ids = b.column(key).take(pa.array([first + x for x in t]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(i), *[pa.array(v, pa.int32()) for v in (s, e, d, n)]], [key, item, "start", "end", "edits", "shared"])

        part = rows.mapInArrow(lean(run), out)
        found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], out)


def _blocks(benchmark: DataFrame, item: str, q: int, rate: float, block_chars: int) -> list:
    normal, blocks, now, size = Normal(), [], [], 0
    put = benchmark.sparkSession.sparkContext.broadcast
    for r in benchmark.select(item, "text").where("text is not null").orderBy(item, "text").toLocalIterator():
        now.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_chars:
            blocks.append(put(index_block(now, q, rate, normal)))
            now, size = [], 0
    return [*blocks, put(index_block(now, q, rate, normal))] if now else blocks


def _searched(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[pa.RecordBatch, int, list[tuple]]]:
    """Each group of texts: its batch, the place of its first row, and the regions found (text numbers are within the group)."""
    normal, bits = Normal(), {}
    for q, items in block.long.items():
        bits[q] = np.zeros(1 << FILTER_BITS, bool)
        bits[q][(items.gram >> U(64 - FILTER_BITS)).astype(np.int64)] = True
    for b in batches:
        for first, texts in groups(b.column("text")):
            yield b, first, search(texts, block, normal, bits)


def without_leaks(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", q: int = 10, rate: float = 0.06, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they are; null and empty texts stay. No shuffle."""
    for held in _blocks(benchmark, item, q, rate, block_chars):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            last, bad = None, set()
            for b, first, leaks in _searched(batches, held.value):
                if b is not last:
                    if last is not None:
                        yield _rest(last, bad)
                    last, bad = b, set()
                bad.update(first + x[0] for x in leaks)
            if last is not None:
                yield _rest(last, bad)

        docs = small_batches(docs).mapInArrow(lean(run), docs.schema)
    return docs


def _rest(batch: pa.RecordBatch, bad: set[int]) -> pa.RecordBatch:
    keep = np.ones(batch.num_rows, bool)
    keep[list(bad)] = False
    return batch.filter(pa.array(keep))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", F.col("start").alias("first_char"), F.col("end").alias("end_char"), "edits", "shared")
