"""Quality rules against plain counting, n-gram by n-gram, and on rows that taught nothing."""

import random
import re
import zlib
from collections import Counter as Tally

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import quality
from chronoframe.llm.common import table
from chronoframe.llm.quality import BITS, CHARS, FAMILIES, SCALE, UNIT, Counter, Model, calibrated, judge_quality, learn_quality, op13_quality_rules, repeated_words, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    "", " ", "\n\n \n", "one", "a a a a a a a a a", "a b c d e f g h", "#*$%&|<> x\n#*$%&|<> x\n\t\n\t\n", "x\r\nx\r\nx\n", "a\x1cb c\x85d\xa0e", "漢字 😀 é\n漢字 😀 é",
    "w " * 5000, "z" * 200_000, "one two three four five six seven eight " * 2 + "nine", "\n".join(["line of words"] * 50), "A\0b",
]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Tally(windows)
    covered = {k for i, w in enumerate(windows) if n[w] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 500 else len(lines) - len(set(lines)), len(covered)


def texts_of(spark, n=150):
    return [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").limit(n).collect()]


def test_counts_whatever_the_batch(spark):
    texts = texts_of(spark) + ODD
    wanted = [counted(t) for t in texts]
    counter = Counter()
    for size in (1, 7, len(texts)):
        got = np.concatenate([counter.count(texts[i : i + size])[0] for i in range(0, len(texts), size)], axis=1)
        assert [tuple(x) for x in got.T.tolist()] == wanted


def test_repeated_windows_of_few_words():
    rng = random.Random(6)
    for _ in range(300):
        words = [rng.choice("ab") for _ in range(rng.randrange(40))]
        assert repeated_words(words) == counted(" ".join(words))[4]


def test_ngrams_of_each_family_and_probabilities(spark):
    """Every family has as many n-grams as the text; equal ones share a slot; logits add up n-gram by n-gram, in any batch."""
    texts = texts_of(spark, 30) + ODD
    rng = np.random.default_rng(1)
    model = Model(rng.integers(-UNIT, UNIT, 1 << BITS).astype(np.int32), 0.25, 0.8, -0.1)
    counter = Counter()
    _, families = counter.count(texts)
    assert len(families) == FAMILIES
    whole = model.probabilities(families, len(texts))
    seen: dict = {}
    for i, t in enumerate(texts):
        words = WORD.findall(t)
        grams = [[t[k : k + n] for k in range(len(t) - n + 1)] for n in CHARS] + [words, list(zip(words, words[1:], strict=False))]
        logit = 0.25
        for f, (slots, (begin, end)) in enumerate(families):
            mine = slots[begin[i] : end[i]]
            if f < len(grams):
                assert len(mine) == len(grams[f])
                for g, s in zip(grams[f][:3000], mine[:3000].tolist(), strict=True):
                    assert seen.setdefault((f, g), s) == s
            logit += sum(model.weights[mine].tolist()) / UNIT * SCALE / max(1, len(mine))
        p = 1 / (1 + np.exp(-np.clip(0.8 * logit - 0.1, -30, 30)))
        assert whole[i] == pytest.approx(p, abs=1e-9)
        assert model.probabilities(counter.count([t])[1], 1)[0] == whole[i]
    assert len({v for (f, _), v in seen.items() if f == 3}) > 0.9 * len({g for f, g in seen if f == 3})


def test_calibration_finds_the_curve():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 3, 40_000)
    y = (rng.random(len(z)) < 1 / (1 + np.exp(-(0.5 * z + 1)))).astype(float)
    slope, offset = calibrated(z, y, np.ones(len(z)))
    assert slope == pytest.approx(0.5, abs=0.03) and offset == pytest.approx(1, abs=0.05)
    slope, offset = calibrated(np.array([-5.0, 5.0, -4.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert np.isfinite([slope, offset]).all() and slope > 0


def test_training_separates_and_needs_both_labels():
    rng = random.Random(3)
    good = [" ".join(rng.choice(["plain", "words", "stand", "here", "today"]) for _ in range(30)) for _ in range(60)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    model = train(good + bad, [1] * 60 + [0] * 60)
    p = model.probabilities(Counter().count(["today plain words stand", "TODAY!! PLAIN!! WORDS!!"])[1], 2)
    assert p[0] > 0.8 and p[1] < 0.2
    assert train(good, [1] * 60) is None and train([], []) is None and train(good[:3] + bad, [1] * 3 + [0] * 60) is None


def test_rows_of_every_kind(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (7, "same text"), (7, "same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("x")).withColumn("kept", F.lit(1))
    got = judge_quality(docs, None)
    assert Tally((r.doc_id, *(r[c] for c in COUNTS)) for r in got.collect()) == Tally((k, *counted(t)) for k, t in rows)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)
    assert judge_quality(docs.limit(0), None).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert learn_quality(docs, labels) is None and learn_quality(docs.limit(0), labels) is None


def test_query_and_accuracy_on_rows_that_taught_nothing(spark, monkeypatch):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in op13_quality_rules(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert out.keys() == texts.keys()
    for i in sorted(texts)[:1500]:
        r = out[i]
        assert tuple(r[c] for c in COUNTS) == counted(texts[i])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= quality.KEEP)
    held = [(out[r.doc_id], r.quality) for r in table(spark, sf, "labels").where("quality is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 4]
    good, bad = ([r.quality for r, y in held if y == v] for v in (1, 0))
    assert len(bad) > 80 and len(good) > 500
    assert np.mean(np.array(good) >= 0.5) > 0.99 and np.mean(np.array(bad) < 0.5) > 0.95
    # calibrated: the mean probability is near the share of good rows
    assert abs(np.mean(good + bad) - len(good) / len(held)) < 0.03
