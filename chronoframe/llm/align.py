"""Alignment of two tokenizers over the same texts.

The tokens of both cover the same bytes, so they can be compared by the bytes at which they end. A text's tokens are cut
where both end: first at a common end near the middle, then each half in the same way; an interval without a common end
is a leaf, a group of tokens that can only be compared as a whole. All texts of a batch are cut at the same time, level
by level. The id pairs that share a group are counted over all documents, and each document is described by the counts
of its links.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.llm.common import cut, groups, lean, small_batches, table

#: Folder of the vocabulary files; a parameter of the operator.
VOCABULARIES = "/opt/tokenizers"
#: The splitting rule of byte-level vocabularies whose file asks for it by name (a fixed value of that format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are tokenized in groups of so many bytes (one text may exceed it alone).
GROUP_BYTES = 1_000_000
#: Links that are written out at a time; more of a batch are counted in steps.
STEP = 4_000_000
#: In a group with more links than this, equal tokens are counted before they are paired.
LARGE = 1 << 16
#: Pairs of ids up to this number are sent to every task (17 bytes each); beyond it documents and pairs are joined.
MOST_PAIRS = 4_000_000
#: Ids of a vocabulary take at most so many bits.
ID_BITS = 20


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 32]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """``encode(texts)`` gives ids and tokens a text; ``spelled`` the bytes of each id."""

    encode: Callable[[list[str]], list]
    spelled: list[bytes]

    @cached_property
    def widths(self) -> np.ndarray:
        return np.fromiter(map(len, self.spelled), np.int64, len(self.spelled))

    @cached_property
    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """All spellings in one row of bytes, and where each starts."""
        return np.frombuffer(b"".join(self.spelled), np.uint8), np.cumsum(self.widths) - self.widths

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one row, and the number of each text's."""
        got = self.encode(texts)
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int64, int(n.sum())), n

    def spells(self, ids: np.ndarray, n: np.ndarray, data: list[bytes]) -> np.ndarray:
        """Whether each text's tokens spell its bytes."""
        text = np.repeat(np.arange(len(n)), n)
        length = np.fromiter(map(len, data), np.int64, len(data))
        same = np.bincount(text, self.widths[ids], len(n)).astype(np.int64) == length
        kept = same[text]
        ids, (row, start) = ids[kept], self.letters
        width = self.widths[ids]
        before = np.cumsum(width) - width
        spelled = row[np.repeat(start[ids] - before, width) + np.arange(int(width.sum()))]
        wanted = np.frombuffer(b"".join(d for d, ok in zip(data, same, strict=True) if ok), np.uint8)
        wrong = np.flatnonzero(spelled != wanted)
        same[np.unique(np.searchsorted(np.cumsum(np.where(same, length, 0)), wrong, "right"))] = False
        return same


def byte_level(data: bytes) -> Vocabulary:
    """A byte-level BPE from its JSON file, encoding a space before each text. Special tokens' strings are plain text.

    Where the merges are in the order of their ids and the splitting rule is the named one, ranks say the same and are
    several times as fast; the test compares both over all characters. Else the file's own library encodes.
    """
    spec = json.loads(data)
    letters = byte_letters()
    special = {t["content"] for t in spec["added_tokens"] if t["special"]}
    ids = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    spelled = [b""] * (max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    for t, i in ids.items():
        spelled[i] = bytes(letters[c] for c in t)
    made = [ids.get("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
    pre = spec["pre_tokenizer"] or {}
    ranked = None not in made and all(a < b for a, b in zip(made, made[1:])) and set(ids.values()) == set(range(len(ids)))
    if ranked and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre["add_prefix_space"] and not spec["normalizer"]:
        import tiktoken

        ranks = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks={spelled[i]: i for i in ids.values()}, special_tokens={})
        return Vocabulary(lambda texts: [ranks.encode_ordinary(" " + t) for t in texts], spelled)
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(data.decode())
    own.encode_special_tokens = True
    return Vocabulary(lambda texts: [e.ids for e in own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], spelled)


def pieces(data: bytes) -> Vocabulary:
    """A piece model with byte fallback; the model puts the space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), spelled)


@lru_cache(maxsize=4)
def vocabulary(data: bytes, kind: str) -> Vocabulary:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return byte_level(data) if kind == "json" else pieces(data)


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Which A tokens end where a B token ends, by cutting in halves.

    Ends are byte offsets over texts laid end to end, ascending; ``texts`` are the tokens of A in each text, each of which
    has at least one, and the last of a text is a common end. Every interval looks, from its middle outwards, for an end
    of A that a bisection of B's ends also finds; what it finds nearest to the middle cuts it into two.
    """
    cuts = np.zeros(len(ends_a), bool)
    hi = np.cumsum(texts)
    lo = hi - texts
    cuts[hi - 1] = True
    while True:
        long = hi - lo > 1
        lo, hi = lo[long], hi[long]
        if not len(lo):
            return cuts
        last = hi - 2
        middle = (lo + last) >> 1
        found = np.full(len(lo), -1, np.int64)
        open_, near, far = np.arange(len(lo)), 0, 1
        while len(open_):
            steps = np.arange(near, far)
            steps = np.array([0]) if far == 1 else np.stack([steps, -steps], axis=1).ravel()  # nearest first
            at = middle[open_, None] + steps
            inside = (at >= lo[open_, None]) & (at <= last[open_, None])
            at = np.where(inside, at, middle[open_, None])
            ends = ends_a[at]
            hit = (ends_b[np.searchsorted(ends_b, ends.ravel())].reshape(at.shape) == ends) & inside
            first = hit.argmax(axis=1)
            row = np.arange(len(open_))
            yes = hit[row, first]
            found[open_[yes]] = at[row[yes], first[yes]]
            open_ = open_[~yes]
            near, far = far, 2 * far
            open_ = open_[(middle[open_] - lo[open_] >= near) | (last[open_] - middle[open_] >= near)]
        cut_here = found >= 0  # the others are leaves
        lo, hi, found = lo[cut_here], hi[cut_here], found[cut_here]
        cuts[found] = True
        lo, hi = np.stack([lo, found + 1], axis=1).ravel(), np.stack([found + 1, hi], axis=1).ravel()


def _squeezed(keys: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their times (1 each without)."""
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))) if times is None else np.add.reduceat(times, first) if len(first) else times


def links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, text: np.ndarray, bits: int = ID_BITS, step: int = STEP, large: int = LARGE) -> tuple[np.ndarray, np.ndarray]:
    """``(text << bits | a) << bits | b`` of all links, distinct and in order, and how often each occurs.

    ``n_a`` and ``n_b`` are the tokens of each group, ``text`` the text it is in. What is written out at a time is bounded
    by ``step``; the distinct pairs of a batch's texts have to fit a task.
    """
    whole, end_b = n_a * n_b, np.cumsum(n_b)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    group = np.repeat(np.arange(len(n_a)), n_a)
    many = np.where(whole > large, 0, n_b)[group]
    head = (text[group] << (2 * bits)) | (a << bits)
    start = (end_b - n_b)[group]
    done = np.cumsum(many)
    marks = np.unique(np.concatenate([[0], np.searchsorted(done, np.arange(step, (done[-1] if len(done) else 0) + step, step), "right"), [len(a)]]))
    for i, j in zip(marks[:-1], marks[1:], strict=True):
        n = many[i:j]
        before = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(before - start[i:j], n)
        found.append(_squeezed(np.repeat(head[i:j], n) | b[place], None))
    begin_a = np.cumsum(n_a) - n_a
    for g in np.flatnonzero(whole > large):
        ua, ka = np.unique(a[begin_a[g] : begin_a[g] + n_a[g]], return_counts=True)
        ub, kb = np.unique(b[end_b[g] - n_b[g] : end_b[g]], return_counts=True)
        found.append(((((text[g] << (2 * bits)) | (ua << bits))[:, None] | ub).ravel(), (ka[:, None] * kb[None, :]).ravel()))
    if len(found) == 1:
        return found[0]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _squeezed(np.concatenate([k for k, _ in found]), np.concatenate([t for _, t in found]))


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to n - 1 as rows of bytes, left-aligned, and the number of them."""
    width = len(str(n))
    flat = np.array([str(i) for i in range(n)], f"S{width}").view(np.uint8).reshape(n, width)
    return np.concatenate([flat, np.zeros((n, 1), np.uint8)], axis=1), (flat > 0).sum(axis=1)


class Speller:
    """The groups of texts as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, n_a: int, n_b: int):
        self.digits, self.width = _digits(max(n_a, n_b))

    def spell(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, texts: np.ndarray) -> list[bytes]:
        """``texts``: the number of groups of each."""
        both = n_a + n_b
        end = np.cumsum(both)
        start = end - both
        place_a = np.arange(len(a)) + np.repeat(start - (np.cumsum(n_a) - n_a), n_a)
        place_b = np.arange(len(b)) + np.repeat(start + n_a - (np.cumsum(n_b) - n_b), n_b)
        ids, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        after[start + n_a - 1], after[end - 1] = ord("|"), ord(";")
        rows, width = self.digits[ids], self.width[ids]
        rows[np.arange(len(ids)), width] = after
        text_end = np.cumsum(np.add.reduceat(width + 1, (np.append(0, end[np.cumsum(texts)[:-1] - 1])))) if len(texts) else []
        flat = rows.ravel()
        flat = flat[flat > 0].tobytes()
        return [flat[i : j - 1] for i, j in zip([0, *text_end[:-1]], text_end, strict=True)]


@dataclass
class Aligned:
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    spelled: bytes
    pairs: np.ndarray
    times: np.ndarray


def aligned(texts: list[str], va: Vocabulary, vb: Vocabulary, speller: Speller, bits: int = ID_BITS) -> list[Aligned | None]:
    """The alignment of each text; None where it has no tokens, or where either's do not spell a space and the text."""
    data = [b" " + t.encode() if t else b"" for t in texts]
    (a, len_a), (b, len_b) = va.ids(texts), vb.ids(texts)
    fits = va.spells(a, len_a, data) & vb.spells(b, len_b, data) & np.fromiter(map(bool, data), bool, len(data))
    whole = np.flatnonzero(fits)
    out: list[Aligned | None] = [None] * len(texts)
    if not len(whole):
        return out
    a, b, len_a, len_b = a[np.repeat(fits, len_a)], b[np.repeat(fits, len_b)], len_a[fits], len_b[fits]
    ends_a, ends_b = np.cumsum(va.widths[a]), np.cumsum(vb.widths[b])
    cuts = common_ends(ends_a, ends_b, len_a)
    last_a = np.flatnonzero(cuts)
    last_b = np.searchsorted(ends_b, ends_a[last_a])
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    n_groups = np.diff(np.cumsum(cuts)[np.cumsum(len_a) - 1], prepend=0)
    keys, times = links(a, b, n_a, n_b, np.repeat(np.arange(len(whole)), n_groups), bits)
    bounds = np.searchsorted(keys >> (2 * bits), np.arange(len(whole) + 1))
    n_links = np.add.reduceat(n_a * n_b, np.cumsum(n_groups) - n_groups)
    pairs = keys & ((1 << (2 * bits)) - 1)
    for k, spelled in enumerate(speller.spell(a, b, n_a, n_b, n_groups)):
        mine = slice(bounds[k], bounds[k + 1])
        out[whole[k]] = Aligned(int(len_a[k]), int(len_b[k]), int(n_groups[k]), int(n_links[k]), spelled, pairs[mine], times[mine])
    return out


def _times(x: np.ndarray) -> bytes:
    """Numbers as bytes, each in the fewest of 1, 2 or 8 bytes that hold them all."""
    most = int(x.max()) if len(x) else 0
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u8").tobytes()


def unpacked(pairs: bytes, times: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a document (``a << bits | b``) and how often each is linked."""
    codes = np.frombuffer(pairs, "<u4" if bits == 16 else "<u8")
    return codes, np.frombuffer(times, f"<u{len(times) // max(1, len(codes)) or 1}")


@dataclass
class Pair:
    """The files of two vocabularies: A, byte-level JSON, and B, a piece model."""

    json_file: bytes
    piece_file: bytes

    @classmethod
    def of(cls, json_path: str, piece_path: str) -> Pair:
        with open(json_path, "rb") as a, open(piece_path, "rb") as b:
            return cls(a.read(), b.read())

    def loaded(self) -> tuple[Vocabulary, Vocabulary]:
        return vocabulary(self.json_file, "json"), vocabulary(self.piece_file, "model")

    @property
    def bits(self) -> int:
        """Bits of an id in a pair."""
        most = max(len(v.spelled) for v in self.loaded())
        if most > 1 << ID_BITS:
            raise ValueError(f"a vocabulary has more than {1 << ID_BITS} ids")
        return 16 if most <= 1 << 16 else ID_BITS


def align_tokens(docs: DataFrame, vocabularies: Pair, key: str = "doc_id", with_groups: bool = False) -> DataFrame:
    """``row, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` for every row, from the whole ``text``.

    ``pairs`` are the distinct linked ids and ``times`` how often each is linked (``unpacked`` reads them); ``row`` numbers
    the rows. ``with_groups`` adds the groups themselves, ``a1,a2|b1;a3|b2,b3``. A null or empty text, and one whose tokens
    do not spell a space and the text (a model may rewrite some characters), has zeros and an empty digest. Repeated rows
    are each answered; other columns are ignored, whatever their names. An empty table gives no rows.
    """
    held, bits = docs.sparkSession.sparkContext.broadcast(vocabularies), vocabularies.bits  # two vocabulary files
    kind = next(f for f in docs.schema if f.name == key)
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("_key", kind.dataType), *T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, groups string")])
    names, types = schema.names, [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        va, vb = held.value.loaded()
        speller = Speller(len(va.spelled), len(vb.spelled))
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            keys = batch.column("_key")
            for first, texts in groups(batch.column("_text"), GROUP_BYTES):
                values = [
                    (0, 0, 0, 0, "", b"", b"", "" if with_groups else None) if g is None else
                    (g.n_a, g.n_b, g.n_groups, g.n_links, hashlib.sha256(g.spelled).hexdigest(), g.pairs.astype("<u4" if bits == 16 else "<u8").tobytes(), _times(g.times), g.spelled.decode() if with_groups else None)
                    for g in aligned(texts, va, vb, speller, bits)
                ]
                cols = [pa.array(c, t) for c, t in zip(zip(*values, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(texts))), keys.slice(first, len(texts)), *cols], names)
                row += len(texts)

    found = small_batches(docs).select(F.col(key).alias("_key"), F.col("text").alias("_text")).mapInArrow(lean(run), schema)
    return found if with_groups else found.drop("groups")


def count_links(found: DataFrame, bits: int, most: int = STEP) -> DataFrame:
    """``pair, n, best``: in how many rows a pair is linked, and whether no pair of the same A id is in more (ties included).

    Tasks count their rows before they are shuffled, and give out what they have when it is over ``most`` pairs.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def merged():
            keys, n = _squeezed(np.concatenate(waiting), None) if waiting else held
            return _squeezed(np.concatenate([held[0], keys.astype(np.int64)]), np.concatenate([held[1], n])) if waiting else held

        for b in batches:
            for pairs in b.column("pairs").to_pylist():
                codes, _ = unpacked(pairs, b"", bits)
                waiting.append(codes)
                size += len(codes)
                if size >= most:
                    held, waiting, size = merged(), [], 0
                    if len(held[0]) >= most:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["pair", "n"])
                        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        held = merged()
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["pair", "n"])

    counts = found.select("pairs").mapInArrow(lean(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.shiftright("pair", bits))  # at most as many rows as B has ids
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(own)).alias("best"))


def describe_links(found: DataFrame, counts: DataFrame, bits: int, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``found`` with ``n_best`` (links whose pair is the best of its A id) and ``count_sum`` (sum of the pairs' ``n`` over links).

    Up to ``most_pairs`` counted pairs go to every task; more are joined with the rows' pairs, with the same result.
    """
    kept = [f for f in found.schema if f.name not in ("pairs", "times")]
    names = [f.name for f in kept]
    if counts.count() <= most_pairs:
        got = counts.toArrow()
        codes, n, best = (got.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(codes)
        held = found.sparkSession.sparkContext.broadcast((codes[order], n[order], best[order]))  # at most most_pairs rows

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, n, best = held.value
            codes = codes.astype("<u4" if bits == 16 else "<u8")
            for b in batches:
                out = np.zeros((2, b.num_rows), np.int64)
                for i, (pairs, times) in enumerate(zip(b.column("pairs").to_pylist(), b.column("times").to_pylist(), strict=True)):
                    mine, often = unpacked(pairs, times, bits)
                    at = np.searchsorted(codes, mine)
                    often = often.astype(np.int64)
                    out[:, i] = often @ best[at], often @ n[at]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(out[0]), pa.array(out[1])], [*names, "n_best", "count_sum"])

        return found.mapInArrow(lean(look_up), T.StructType([*kept, *T.StructType.fromDDL("n_best long, count_sum long")]))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, pairs, times in zip(*(b.column(c).to_pylist() for c in ("row", "pairs", "times")), strict=True):
                mine, often = unpacked(pairs, times, bits)
                for i in range(0, len(mine), STEP):
                    some = mine[i : i + STEP].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row)), pa.array(some), pa.array(often[i : i + STEP].astype(np.int64))], ["row", "pair", "often"])

    each = found.select("row", "pairs", "times").mapInArrow(lean(listed), "row long, pair long, often long").join(counts, "pair")
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("n_best"), F.sum(F.col("often") * F.col("n")).alias("count_sum"))
    return found.select(*names).join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def op11_token_alignment(spark: SparkSession, sf_dir: str, folder: str = VOCABULARIES) -> DataFrame:
    pair = Pair.of(f"{folder}/byte_bpe_50k.json", f"{folder}/piece_bpe_32k.model")
    found = cut(align_tokens(table(spark, sf_dir, "documents"), pair))
    counts = cut(count_links(found, pair.bits))
    out = describe_links(found, counts, pair.bits)
    return out.select(F.col("_key").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
