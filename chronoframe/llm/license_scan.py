"""License scans: ordered signature rules behind a keyword prefilter, and base phrases counted in words.

One pass of a keyword automaton over the whole text tells which rules can match at all; only these are run. Detections are
taken in the order of priority, then length, then rule; one that lies within a taken one is suppressed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import groups, table
from chronoframe.llm.license_rules import RULES, Rule

#: The phrases that are always counted, in words, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: A-Z to lower case; what is no word character (ASCII other than letters and digits) to a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: A-Z to lower case only, one character to one, so that offsets hold.
LOWER = {c: c + 32 for c in range(65, 91)}


class Scanner:
    def __init__(self, rules: list[Rule] = RULES):
        self.rules = rules
        self.compiled: dict[int, re.Pattern] = {}
        self.words = ahocorasick.Automaton()
        wanted: dict[str, list[int]] = {}
        for k, r in enumerate(rules):
            for w in r.keywords:
                wanted.setdefault(w, []).append(k)
        for w, ks in wanted.items():
            self.words.add_word(w, tuple(ks))
        self.words.make_automaton()

    def candidates(self, low: str) -> list[int]:
        found: set[tuple[int, ...]] = {ks for _, ks in self.words.iter(low)}
        return sorted({k for ks in found for k in ks})

    def raw(self, low: str, ks: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, rule) of every match of the rules."""
        out = []
        for k in ks:
            if k not in self.compiled:
                self.compiled[k] = re.compile(self.rules[k].pattern)
            out += [(m.start(), m.end(), k) for m in self.compiled[k].finditer(low)]
        return out

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """The detections that stay, by place."""
        low = text.translate(LOWER)
        found = self.raw(low, self.candidates(low))
        found.sort(key=lambda d: (-self.rules[d[2]].priority, d[0] - d[1], d[2], d[0]))
        taken: list[tuple[int, int, int]] = []
        cover: dict[int, list[tuple[int, int]]] = {}  # taken ones by the cells of 512 characters they touch
        for s, e, k in found:
            if any(a <= s and e <= b for a, b in cover.get(s >> 9, ())):
                continue
            taken.append((s, e, k))
            for c in range(s >> 9, (e >> 9) + 1):
                cover.setdefault(c, []).append((s, e))
        return sorted(taken)


def base_places(text: str) -> tuple[int, list[tuple[int, str]]]:
    """The number of words, and the word at which each place of a base phrase starts, with its label."""
    words = text.encode("utf-8", "replace").translate(WORDS).split()
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in BASE:
        p = phrase.encode()
        at = joined.find(b" " + p + b" ")
        if at < 0:
            continue
        seen, last = 0, 0
        while at >= 0:
            seen += joined.count(b" ", last, at + 1)
            last = at + 1
            out.append((seen - 1, label))
            at = joined.find(b" " + p + b" ", at + 1)
    return len(words), sorted(out)


def scan_licenses(docs: DataFrame, key: str = "doc_id", rules: list[Rule] = RULES) -> DataFrame:
    """``key, n_words, base, detections, score`` for every row, from the whole ``text`` (null: empty).

    ``base``: (word, label) of every place of a base phrase. ``detections``: (start, end, label, priority) in code points.
    ``score``: 1 minus the product of (1 - priority / 100) over the labels found, 0.95 for each base label. Repeated rows
    are each answered; an empty text has nothing and score 0; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("priority", pa.int32())]))
    names = [key, "n_words", "base", "detections", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in batches:
            n_words, base, found, score = [], [], [], []
            for _, texts in groups(b.column("text")):
                for text in texts:
                    n, places = base_places(text)
                    hits = scanner.scan(text)
                    weight = {}
                    for _, _, k in hits:
                        weight[rules[k].label] = max(weight.get(rules[k].label, 0.0), rules[k].priority / 100)
                    weight |= {label: 0.95 for _, label in places}
                    n_words.append(n)
                    base.append([{"word": w, "label": label} for w, label in places])
                    found.append([{"start": s, "end": e, "label": rules[k].label, "priority": rules[k].priority} for s, e, k in hits])
                    score.append(1 - math.prod(1 - weight[x] for x in sorted(weight)))
            arrays = [b.column(key), pa.array(n_words, pa.int64()), pa.array(base, base_type), pa.array(found, found_type), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"{key} {kind}, n_words long, base array<struct<word:long,label:string>>, detections array<struct<start:int,end:int,label:string,priority:int>>, score double"
    return docs.select(key, "text").mapInArrow(run, schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.concat("base.label", "detections.label")).alias("labels"),
        "score",
    )
