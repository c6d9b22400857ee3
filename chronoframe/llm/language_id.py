"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram is the product of its letters' vectors, each rotated by its
place; a document is the sum of its n-grams' vectors, a language the sum of its documents' unit vectors. The language whose
prototype has the largest cosine with the document wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.llm.common import crc_mod, groups, labelled_sample, lean, small_batches, table

N_CODES = 0x110000
#: Prototypes are summed as whole numbers of this fraction, so that the order of additions doesn't matter.
UNIT = 1 << 20


@cache
def alphabet() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(N_CODES)), bool, N_CODES)


class Space:
    """Vectors of letters, and documents as counts of n-grams over them."""

    def __init__(self, dim: int = 1024, n: int = 3, seed: int = 7):
        self.dim, self.n, self.seed = dim, n, seed
        self.letters: dict[int, np.ndarray] = {}
        self.alpha = alphabet()
        self.index = np.zeros(N_CODES, np.int32)
        self.seen = np.zeros(N_CODES, bool)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.Philox(key=[self.seed, code])).integers(0, 2, self.dim, dtype=np.int8)
            self.letters[code] = bits * np.int8(2) - np.int8(1)
        return self.letters[code]

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The documents' vectors and whether each has a letter. A text is whole; what isn't a letter is one gap."""
        low = [t.lower() for t in texts]
        codes = np.frombuffer(" ".join(["", *low, ""]).encode("utf-32-le", "replace"), np.uint32)
        starts = np.cumsum([0, *[len(t) + 1 for t in low]])[:-1]
        doc = np.zeros(len(codes), np.int32)
        doc[starts[1:]] = 1
        doc = np.cumsum(doc, dtype=np.int32)
        letter = self.alpha[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the gap after a letter
        keep[starts] = True  # and the one before the text
        lettered = np.bincount(doc[letter], minlength=len(low))[: len(low)] > 0
        # the place where a text starts also ends the one before: after a letter it is kept twice
        again = keep.astype(np.int8)
        ended = starts[1:][letter[starts[1:] - 1]]
        again[ended] = 2
        symbols, doc = np.repeat(np.where(letter, codes, 0), again), np.repeat(doc, again)
        doc[np.cumsum(again)[ended] - 2] -= 1
        self.seen[symbols] = True
        ids = np.flatnonzero(self.seen)
        self.seen[ids] = False
        self.index[ids] = np.arange(len(ids))
        dense, n = self.index[symbols].astype(np.int64), self.n
        grams = np.zeros(max(0, len(dense) - n + 1), np.int64)
        for j in range(n):
            grams = grams * len(ids) + dense[j : len(grams) + j]
        own = doc[: len(grams)]
        inside = own == doc[n - 1 :][: len(grams)]
        grams, own = grams[inside], own[inside]
        if len(ids) ** n <= 4_000_000:
            there = np.zeros(len(ids) ** n, bool)
            there[grams] = True
            used = np.flatnonzero(there)
            place = np.zeros(len(there), np.int32)
            place[used] = np.arange(len(used))
            grams = place[grams]
        else:
            used, grams = np.unique(grams, return_inverse=True)
        out = np.zeros((len(low), self.dim), np.float32)
        if not len(used):
            return out, lettered
        base = np.stack([self.letter(int(c)) for c in ids])
        turned = [np.roll(base, n - 1 - j, axis=1) for j in range(n)]
        order = np.argsort(grams, kind="stable") if len(used) > 4096 else None
        bounds = np.arange(0, len(used) + 4096, 4096)
        marks = np.searchsorted(grams[order], bounds) if order is not None else None
        for k, first in enumerate(range(0, len(used), 4096)):
            some = used[first : first + 4096]
            vector = np.ones((len(some), self.dim), np.int8)
            rest = some.copy()
            for j in reversed(range(n)):
                vector *= turned[j][rest % len(ids)]
                rest //= len(ids)
            mine = slice(None) if order is None else order[marks[k] : marks[k + 1]]
            flat = np.bincount(own[mine].astype(np.int64) * len(some) + (grams[mine] - first), minlength=len(low) * len(some))
            out += flat.reshape(len(low), len(some)).astype(np.float32) @ vector.astype(np.float32)
        return out, lettered

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        v, lettered = self.vectors(texts)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9), lettered


def learn_prototypes(docs: DataFrame, per_lang: int = 2000, dim: int = 1024, n: int = 3) -> dict[str, np.ndarray]:
    """Language → unit prototype, from ``text, lang`` of about ``per_lang`` rows of each language (the sample's bound).

    Rows with a null text or lang teach nothing. The sums are made on the executors; the driver gets one vector a language.
    """
    known = labelled_sample(docs.where("lang is not null and text is not null"), "lang", per_lang)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = Space(dim, n), {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for first, texts in groups(b.column("text")):
                units, _ = space.units(texts)
                whole = np.rint(units * UNIT).astype(np.int64)
                for lang in set(langs[first : first + len(texts)]):
                    mine = [i for i in range(len(texts)) if langs[first + i] == lang]
                    total[lang] = total.get(lang, 0) + whole[mine].sum(axis=0)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "i", "v"])

    parts = known.select("text", "lang").mapInArrow(lean(sums), "lang string, i int, v long")
    found: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).toLocalIterator():  # dim rows for each language
        found.setdefault(r.lang, np.zeros(dim))[r.i] = r.v
    return {k: (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32) for k, v in sorted(found.items())}


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], key: str | None = "doc_id", n: int = 3) -> DataFrame:
    """``key, lang_pred, score`` for every row: the language of the largest cosine (floored at 0), read from ``text`` alone.

    A text that is null or has no letter is ``und`` with score 0, and so is every text when no language was learned.
    Ties go to the language that comes first; repeated rows are each answered. Other columns are ignored, or with no
    ``key`` kept as they are (but for columns that have the names of the two new ones).
    """
    names = list(prototypes)
    spark = docs.sparkSession
    matrix = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, 1024), np.float32)
    held = spark.sparkContext.broadcast(matrix)  # dim numbers for each learned language
    kept = [f for f in docs.schema if (f.name == key if key else f.name not in ("lang_pred", "score"))]
    names_out = [f.name for f in kept]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        space = Space(m.shape[1], n)
        for b in batches:
            pred, score = [], []
            for _, texts in groups(b.column("text")):
                if not names:
                    pred += ["und"] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                units, lettered = space.units(texts)
                cos = units @ m.T
                best = cos.argmax(axis=1)
                pred += [names[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)]
                score += np.where(lettered, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names_out], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names_out, "lang_pred", "score"])

    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return small_batches(docs).select(*dict.fromkeys([*names_out, "text"])).mapInArrow(lean(predict), schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_prototypes(docs.where(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    out = predict_language(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
