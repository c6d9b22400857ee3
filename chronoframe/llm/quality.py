"""Quality rules: counts that fail a text outright, and a calibrated classifier for the rest.

The classifier is logistic regression on hashed n-grams of characters and of words. A family of n-grams counts by the
share of each n-gram in it, so a text's logit is a bias and one mean of weights for each family, whatever its length.
Weights are whole numbers of a fixed fraction: their sums do not depend on the batch that a text is in. A second, tiny
regression on rows that the first didn't see turns the logit into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.llm.common import crc_mod, cut, groups, labelled_sample, lean, small_batches, table

BITS = 18
#: Characters of an n-gram, words of an n-gram, and neighbours' shapes: the families, each with its own place in the hash.
CHARS, WORDS = (1, 2, 3, 4), (1, 2)
FAMILIES = len(CHARS) + len(WORDS) + 1
UNIT = 1 << 16
#: Shares are multiplied by this before they are weighted, so that weights are of the order of one.
SCALE = 16.0
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window; a text fails with fewer words than LEAST_WORDS, or more than this percentage of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: A text is kept from this probability of being good on.
KEEP = 0.5


@cache
def _classes() -> np.ndarray:
    """0 other, 1 lower case, 2 upper case, 3 digit, for every code point and the gap between texts."""
    out = np.zeros(0x110001, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        out[i] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 0
    return out


class Counter:
    """The counts and the hashed n-grams of texts laid end to end."""

    def __init__(self):
        self.classes = _classes()
        self.space, self.symbol = (np.isin(np.arange(0x110001), [ord(c) for c in s]) for s in (SPACE, SYMBOLS))
        self.space[-1] = True  # the gap after each text

    def count(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each text; and of each family all n-grams' slots, and where each text's begin and end."""
        gap = np.array([0x110000], np.uint32)
        codes = np.concatenate([x for t in texts for x in (np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32), gap)]) if texts else gap[:0]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(size + 1) - size - 1
        space, symbol = self.space[codes], self.symbol[codes]
        total = lambda mask: np.add.reduceat(mask.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        last = np.flatnonzero(~space & np.concatenate([space[1:], [True]]))
        word_text = np.searchsorted(start, first, "right") - 1
        n_words = np.bincount(word_text, minlength=len(texts)).astype(np.int64)
        families: list[tuple[np.ndarray, np.ndarray]] = []

        def add(hashes: np.ndarray, begin: np.ndarray, n: np.ndarray) -> None:
            slots = ((hashes ^ np.uint32(0x9E3779B1 * (len(families) + 1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            families.append((slots.astype(np.int32), np.stack([begin, begin + n])))

        spread = codes * np.uint32(0xC2B2AE35)
        h = spread ^ (spread >> np.uint32(15))
        base = h
        for n in CHARS:
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) + base[n - 1 :]
            add(h, np.minimum(start, max(0, len(h))), np.maximum(size - n + 1, 0))
        length = last - first + 1
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        power = np.cumprod(np.full(int(length.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        letters = (base[~space].astype(np.uint64) + np.uint64(1)) * power[inside]
        begins = np.cumsum(length) - length
        wide = np.add.reduceat(letters, begins) if len(begins) else np.zeros(0, np.uint64)
        wide ^= wide >> np.uint64(29)
        word = (wide * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
        word_start = np.cumsum(n_words) - n_words
        again = np.zeros(len(word), bool)
        again[1:] = (wide[1:] == wide[:-1]) & (word_text[1:] == word_text[:-1])
        for n in WORDS:
            w = word if n == 1 else word[:-1] * np.uint32(0x01000193) + word[1:]
            add(w, np.minimum(word_start, len(w)), np.maximum(n_words - n + 1, 0))
        kind = self.classes[codes]
        lower = np.add.reduceat((kind[~space] == 1).astype(np.int32), begins) > 0 if len(begins) else again
        marked = np.add.reduceat(symbol[~space].astype(np.int32), begins) > 0 if len(begins) else again
        shape = ((((kind[first].astype(np.uint32) * 4 + kind[last]) * 2 + lower) * 2 + marked) * 2 + again) * 4 + np.minimum(length, 4) - 1
        shape = shape.astype(np.uint32)
        add(shape[:-1] * np.uint32(0x01000193) + shape[1:] * np.uint32(0xC2B2AE35), np.minimum(word_start, max(0, len(shape) - 1)), np.maximum(n_words - 1, 0))
        lines = [t.split("\n") for t in texts]
        filled = [[x for x in ls if x.strip(SPACE)] if len(ls) > 1 else [] for ls in lines]
        dup = np.fromiter((len(ls) - len(set(ls)) for ls in filled), np.int64, len(texts))
        repeat = self._repeated(texts, wide, word_text, n_words, word_start)
        return np.stack([n_words, total(~space), total(symbol), dup, repeat]), families

    @staticmethod
    def _repeated(texts: list[str], wide: np.ndarray, word_text: np.ndarray, n_words: np.ndarray, word_start: np.ndarray) -> np.ndarray:
        """Words in windows that a text holds twice; hashes say in which texts to look, the words themselves decide."""
        out = np.zeros(len(texts), np.int64)
        if len(wide) <= WINDOW:
            return out
        h = wide[: len(wide) - WINDOW + 1].copy()
        for k in range(1, WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + wide[k : len(h) + k]
        own = word_text[: len(h)]
        h = (h ^ (own.astype(np.uint64) << np.uint64(40)))[own == word_text[WINDOW - 1 :]]
        own = own[own == word_text[WINDOW - 1 :]]
        order = np.argsort(h)
        same = np.flatnonzero(h[order][1:] == h[order][:-1])
        for i in np.unique(own[order[same]]):
            out[i] = repeated_words(texts[i].encode().split())
        return out


def repeated_words(words: list) -> int:
    """Words in windows of eight that occur twice or more, the first ones included."""
    seen: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i in range(len(words) - WINDOW + 1):
        at = seen.setdefault(tuple(words[i : i + WINDOW]), i)
        if at != i:
            covered[at : at + WINDOW] = covered[i : i + WINDOW] = b"\1" * WINDOW
    return sum(covered)


@dataclass
class Model:
    """Whole weights of slots (UNIT is one), a bias, and the two numbers that turn a logit into a probability."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def logits(self, families: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        for slots, (begin, end) in families:
            sums = np.concatenate([[0], np.cumsum(self.weights[slots], dtype=np.int64)])
            out += (sums[end] - sums[begin]) * (SCALE / UNIT) / np.maximum(end - begin, 1)
        return out

    def probabilities(self, families: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(families, n) + self.offset, -30, 30)))


def _shares(texts: list[str], counter: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and share of all n-grams of the texts."""
    rows, slots, shares = [], [], []
    for first in range(0, len(texts), 50):
        some = texts[first : first + 50]
        _, families = counter.count(some)
        keys, values = [], []
        for found, (begin, end) in families:
            for i, (b, e) in enumerate(zip(begin, end, strict=True)):
                if e > b:
                    slot, n = np.unique(found[b:e], return_counts=True)
                    keys.append(((first + i) << BITS) | slot.astype(np.int64))
                    values.append((n * (SCALE / (e - b))).astype(np.float32))
        key, where = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_inverse=True)
        rows.append((key >> BITS).astype(np.int32))
        slots.append((key & ((1 << BITS) - 1)).astype(np.int32))
        shares.append(np.bincount(where, np.concatenate(values or [np.zeros(0)]), len(key)).astype(np.float32))
    return np.concatenate(rows or [np.zeros(0, np.int32)]), np.concatenate(slots or [np.zeros(0, np.int32)]), np.concatenate(shares or [np.zeros(0, np.float32)])


def calibrated(logits: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve nearest to the labels (Newton's method); smoothed targets keep both finite."""
    n = [weight[y == v].sum() for v in (0, 1)]
    target = np.where(y == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x, w = np.column_stack([logits, np.ones(len(logits))]), np.array([1.0, 0.0])

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((weight * (np.logaddexp(0, z) - target * z)).sum()) + 1e-6 * float(v @ v)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)) + 2e-6 * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return max(float(w[0]), 1e-3), float(w[1])


def train(texts: list[str], good: list[int], shares: tuple[float, float] = (0.5, 0.5), rounds: int = 120, every: int = 4) -> Model | None:
    """The classifier, from whole texts and labels; every ``every``-th text of either label only calibrates it.

    ``shares`` are those of the labels 0 and 1 in all labelled rows, whatever the sample's. None unless both labels occur
    ``every`` times.
    """
    y = np.array(good, np.float64)
    if min((y == 0).sum(), (y == 1).sum()) < every:
        return None
    place = np.zeros(len(y), np.int64)
    for v in (0, 1):
        place[y == v] = np.arange((y == v).sum())
    later = place % every == every - 1
    counter = Counter()
    fit = np.flatnonzero(~later)
    row, slot, share = _shares([texts[i] for i in fit], counter)
    target = y[fit]
    weight = np.where(target == 1, 0.5 / (target == 1).sum(), 0.5 / (target == 0).sum())
    theta, bias = np.zeros(1 << BITS), 0.0
    m, s, mb, sb = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    for k in range(1, rounds + 1):  # Adam on the whole sample, with a little shrinkage
        z = np.bincount(row, share * theta[slot], len(fit)) + bias
        diff = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        g, gb = np.bincount(slot, share * diff[row], 1 << BITS) + 1e-6 * theta, diff.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = 0.05 * (1 - k / (rounds + 1))
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**k)) / (np.sqrt(sb / (1 - 0.99**k)) + 1e-8)
    model = Model(np.rint(theta * UNIT).astype(np.int32), bias)
    rest = np.flatnonzero(later)
    logits = np.concatenate([model.logits(counter.count(some)[1], len(some)) for a, b in pairwise([*range(0, len(rest), 50), len(rest)]) for some in [[texts[i] for i in rest[a:b]]]])
    mine = y[rest]
    share_of = np.where(mine == 1, shares[1] / (mine == 1).mean(), shares[0] / (mine == 0).mean())
    model.slope, model.offset = calibrated(logits, mine, share_of)
    return model


def learn_quality(docs: DataFrame, labels: DataFrame, per_label: int = 1500, most_chars: int = 40_000) -> Model | None:
    """Train on about ``per_label`` labelled texts of either label, none longer than ``most_chars`` (the sample's bounds).

    Labels other than 0 and 1 and null texts teach nothing; an id that is labelled twice counts twice. None unless both
    labels occur.
    """
    known = labels.where("quality in (0, 1)").select(F.col("doc_id"), F.col("quality").cast("int").alias("_q_label"))
    fit = docs.select("doc_id", "text").where(f"text is not null and length(text) <= {int(most_chars)}")
    ids = cut(fit.select("doc_id").join(known, "doc_id"))
    n = {r._q_label: r.n for r in ids.groupBy("_q_label").agg(F.count("*").alias("n")).collect()}  # two rows
    chosen = labelled_sample(ids, "_q_label", per_label)
    got = fit.join(F.broadcast(chosen), "doc_id").collect()  # about 2 * per_label rows
    got.sort(key=lambda r: (str(r.doc_id), r.text, r._q_label))
    total = max(1, sum(n.values()))
    return train([r.text for r in got], [r._q_label for r in got], (n.get(0, 0) / total, n.get(1, 0) / total))


def judge_quality(docs: DataFrame, model: Model | None, key: str = "doc_id", keep: float = KEEP) -> DataFrame:
    """``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, quality, base_failed, kept`` for every row, from the whole ``text``.

    ``quality`` is the probability of label 1; a text is kept if it doesn't fail by its counts and ``quality`` is ``keep``
    or more. A null text is as an empty one: no words, so it fails. Without a model ``quality`` is 1. Repeated rows are
    answered each; other columns are ignored, whatever their names. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights
    kind = next(f for f in docs.schema if f.name == key)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([T.StructField("_key", kind.dataType), *[T.StructField(c, T.LongType()) for c in counts], T.StructField("quality", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for b in batches:
            for first, texts in groups(b.column("_text")):
                n, families = counter.count(texts)
                p = np.ones(len(texts)) if held.value is None else held.value.probabilities(families, len(texts))
                yield pa.RecordBatch.from_arrays([b.column("_key").slice(first, len(texts)), *map(pa.array, n), pa.array(p)], schema.names)

    found = small_batches(docs).select(F.col(key).alias("_key"), F.col("text").alias("_text")).mapInArrow(lean(judge), schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.select(F.col("_key").alias(key), *counts, "quality", failed.alias("base_failed"), (~failed & (F.col("quality") >= keep)).alias("kept"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labelled rows but a fifth (crc32 of the id), which stay for measuring accuracy."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge_quality(docs, learn_quality(docs, labels.where(crc_mod("doc_id", 5) != 4)))
