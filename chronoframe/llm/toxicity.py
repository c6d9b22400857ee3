"""Toxic spans by a linear-chain conditional random field; document scores from its marginals.

Only documents carry labels, so tokens are labelled from them first: a token is toxic where it stands in a toxic document
and its word, or its beginning, is far more frequent in toxic documents than in clean ones. The field (two tags, hashed
features of the word, transitions) is trained on windows of such tokens, and its forward-backward marginals give each
token's probability. A document's score is a logistic function of the marginals, fitted on the same sample.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.llm.common import crc_mod, cut, groups, labelled_sample, lean, small_batches, table

TOKEN = re.compile(r"[^\W\d_]+")
BITS = 18
#: Words whose emission a task remembers.
REMEMBERED = 400_000
BLOCK = 256


def features(word: str) -> tuple[str, ...]:
    """The word, its beginnings and its end; these say what kind of token it is."""
    return (f"w{word}", f"3{word[:3]}", f"4{word[:4]}", f"5{word[:5]}", f"e{word[-3:]}")


def slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "replace")) & ((1 << BITS) - 1) for f in features(word)]


@dataclass
class Field:
    """Weights of the difference between the tags toxic and clean; ``trans[a][b]`` is the log potential of a → b."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: tuple[float, float, float] = (0.0, 0.0, -3.0)


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(toxic) of each token by forward-backward over chains laid end to end; ``first`` marks where each chain starts.

    The stream is folded into rows of BLOCK tokens. Steps are 2 x 2 matrices; each row's product is taken for all rows at
    once, the rows' products are chained, and the messages are then run through all rows at once: exact, whatever the
    lengths.
    """
    n = len(emit)
    if n == 0:
        return np.zeros(0)
    rows = -(-n // BLOCK)
    size = rows * BLOCK
    e = np.zeros(size)
    e[:n] = np.clip(emit, -30, 30)
    start = np.zeros(size, bool)
    start[:n] = first
    start[n:] = True
    a = np.exp(trans)
    # the step into token t: a column of potentials times the token's factor; a chain's start forgets what was before
    step = np.empty((size, 2, 2))
    step[:, :, 0] = np.where(start[:, None], 1.0, a[None, :, 0])
    step[:, :, 1] = np.where(start[:, None], 1.0, a[None, :, 1]) * np.exp(e)[:, None]
    step /= step.sum(axis=(1, 2), keepdims=True)
    step = step.reshape(rows, BLOCK, 2, 2)
    whole = np.broadcast_to(np.eye(2), (rows, 2, 2)).copy()
    for t in range(BLOCK):
        whole = whole @ step[:, t]
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    ahead = np.empty((rows, 2))
    v = np.array([0.5, 0.5])
    for r in range(rows):
        ahead[r] = v
        v = v @ whole[r]
        v = v / v.sum()
    behind = np.empty((rows, 2))
    v = np.array([0.5, 0.5])
    for r in reversed(range(rows)):
        behind[r] = v
        v = whole[r] @ v
        v = v / v.sum()
    forward, backward = np.empty((rows, BLOCK, 2)), np.empty((rows, BLOCK, 2))
    for t in range(BLOCK):
        ahead = np.einsum("ri,rij->rj", ahead, step[:, t])
        ahead /= ahead.sum(axis=1, keepdims=True)
        forward[:, t] = ahead
    for t in reversed(range(BLOCK)):
        backward[:, t] = behind
        behind = np.einsum("rij,rj->ri", step[:, t], behind)
        behind /= behind.sum(axis=1, keepdims=True)
    both = forward * backward
    return (both[:, :, 1] / both.sum(axis=2)).reshape(-1)[:n]


def _window_pass(e: np.ndarray, mask: np.ndarray, tags: np.ndarray, trans: np.ndarray):
    """Marginals, and expected minus seen transitions, of a batch of padded windows."""
    b, length = e.shape
    forward = np.zeros((b, length, 2))
    node = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], axis=2)
    a = np.exp(trans)
    forward[:, 0] = node[:, 0] / node[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        v = (forward[:, t - 1] @ a) * node[:, t]
        v /= v.sum(axis=1, keepdims=True)
        forward[:, t] = np.where(mask[:, t, None], v, forward[:, t - 1])
    backward = np.full((b, length, 2), 0.5)
    grad_t = np.zeros((2, 2))
    for t in reversed(range(length - 1)):
        nxt = node[:, t + 1] * backward[:, t + 1]
        v = nxt @ a.T
        v /= v.sum(axis=1, keepdims=True)
        live = mask[:, t + 1, None]
        backward[:, t] = np.where(live, v, backward[:, t + 1])
        pair = forward[:, t, :, None] * a[None] * nxt[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        grad_t += (pair * mask[:, t + 1, None, None]).sum(axis=0)
    both = forward * backward
    p = both[:, :, 1] / both.sum(axis=2)
    live = mask[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            grad_t[i, j] -= ((tags[:, :-1] == i) & (tags[:, 1:] == j) & live).sum()
    return p, grad_t


def label_tokens(docs: list[list[str]], toxic: list[int], ratio: float = 20.0, least: int = 6) -> set[str]:
    """Features (words and beginnings) that mark toxic tokens: at least ``least`` toxic documents, ``ratio`` times the rate."""
    seen = (Counter(), Counter())
    for words, y in zip(docs, toxic, strict=True):
        seen[y].update({f for w in set(words) for f in features(w)[:4] if len(f) > 3})
    n = [max(1, toxic.count(y)) for y in (0, 1)]
    return {f for f, k in seen[1].items() if k >= least and (k / n[1]) >= ratio * ((seen[0][f] + 0.5) / n[0])}


def train(texts: list[str], toxic: list[int], window: int = 48, most_windows: int = 24_000, epochs: int = 4, seed: int = 5) -> Field:
    """The field and the document score, from whole labelled texts. Needs both labels; else every text gets the same low score."""
    model = Field()
    distinct = list(dict.fromkeys(zip(texts, toxic, strict=True)))
    docs, y = [list(map(sys.intern, TOKEN.findall(t.lower()))) for t, _ in distinct], [v for _, v in distinct]
    del texts, distinct
    if 0 not in y or 1 not in y:
        return model
    marks = label_tokens(docs, y)
    rng = np.random.default_rng(seed)
    known: dict[str, tuple[list[int], bool]] = {}
    chosen: list[tuple[list[str], bool]] = []
    plain: list[tuple[list[str], bool]] = []
    for words, v in zip(docs, y, strict=True):
        for i in range(0, len(words), window):
            part = words[i : i + window]
            for w in filterfalse(known.__contains__, set(part)):
                known[w] = (slots(w), any(f in marks for f in features(w)[:4]))
            (chosen if v and any(known[w][1] for w in part) else plain).append((part, bool(v)))
    rng.shuffle(chosen)
    rng.shuffle(plain)
    chosen = chosen[: most_windows // 2]
    data = chosen + plain[: max(1000, min(most_windows - len(chosen), 2 * len(chosen)))]
    ids = np.zeros((len(data), window, 5), np.int32)
    mask, tags = np.zeros((len(data), window), bool), np.zeros((len(data), window), np.int8)
    for k, (part, v) in enumerate(data):
        ids[k, : len(part)] = [known[w][0] for w in part]
        mask[k, : len(part)] = True
        if v:
            tags[k, : len(part)] = [known[w][1] for w in part]
    # Adam on the mean negative log likelihood of windows, with a little shrinkage
    size = (1 << BITS) + 5
    theta, m, s, step = np.zeros(size), np.zeros(size), np.zeros(size), 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), 512):
            some = order[i : i + 512]
            x, live = ids[some], mask[some]
            e = theta[x].sum(axis=2) + theta[1 << BITS]
            p, grad_t = _window_pass(e, live, tags[some], theta[(1 << BITS) + 1 :].reshape(2, 2))
            diff = (p - tags[some]) * live / len(some)
            g = np.bincount(x.ravel(), weights=np.repeat(diff.ravel(), 5), minlength=size)[:size]
            g[1 << BITS] = diff.sum()
            g[(1 << BITS) + 1 :] = (grad_t / len(some)).ravel()
            g += 1e-5 * theta
            step += 1
            m = 0.9 * m + 0.1 * g
            s = 0.99 * s + 0.01 * g * g
            theta -= 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    del ids, mask, tags, data, chosen, plain, known, m, s
    model.weights, model.bias = theta[: 1 << BITS].astype(np.float32), float(theta[1 << BITS])
    model.trans = theta[(1 << BITS) + 1 :].reshape(2, 2)
    # the document's score: logistic regression on two sums of its marginals
    tagger = Tagger(model)
    x = np.array([tagger.summary(p) for i in range(0, len(docs), 200) for p in tagger.tag_words(docs[i : i + 200])])
    x = np.column_stack([x, np.ones(len(x))])
    w, target = np.zeros(3), np.array(y, float)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.02 * np.eye(3)
        w -= np.linalg.solve(h, x.T @ (p - target) + 0.02 * w)
    model.score = tuple(float(v) for v in w)
    return model


class Tagger:
    """Marginals of texts under a field; emissions of words are remembered within a task."""

    def __init__(self, model: Field):
        self.model, self.known = model, {}

    def tag_words(self, docs: list[list[str]]) -> list[np.ndarray]:
        flat = [w for words in docs for w in words]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = sorted(filterfalse(self.known.__contains__, set(flat)))
        if new:
            self.known.update(zip(new, (self.model.weights[np.array([slots(w) for w in new])].sum(axis=1) + self.model.bias).tolist(), strict=True))
        first = np.zeros(len(flat), bool)
        ends = np.cumsum([len(w) for w in docs]) if docs else np.zeros(0, int)
        first[[s for s, e in zip([0, *ends[:-1]], ends, strict=True) if s < e]] = True
        p = marginals(np.fromiter(map(self.known.__getitem__, flat), float, len(flat)), first, self.model.trans)
        return np.split(p, ends[:-1]) if docs else []

    @staticmethod
    def summary(p: np.ndarray) -> tuple[float, float]:
        """How sure the surest token is, and how much toxic text is expected in all."""
        if not len(p):
            return math.log(1e-6), 0.0
        top = min(max(float(p.max()), 1e-6), 1 - 1e-6)
        return math.log(top / (1 - top)), math.log1p(float(p[p > 0.05].sum()))

    def score(self, p: np.ndarray) -> float:
        a, b = self.summary(p)
        w = self.model.score
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] * a + w[1] * b + w[2]))))


def learn_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 2500, most_chars: int = 40_000) -> Field:
    """Train on about ``per_label`` labelled texts of either label, none longer than ``most_chars`` (the sample's bounds).

    Rows with a null text or label teach nothing; an id that is labelled twice counts twice.
    """
    known = labels.where("toxic is not null").select(F.col("doc_id"), F.col("toxic").cast("int").alias("_tx_label"))
    fit = docs.select("doc_id", "text").where(f"text is not null and length(text) <= {int(most_chars)}")
    # ids meet labels without their texts; only the sample's texts are read
    chosen = labelled_sample(cut(fit.select("doc_id").join(known, "doc_id")), "_tx_label", per_label)
    got = fit.join(F.broadcast(chosen), "doc_id").collect()  # about 2 * per_label rows
    got.sort(key=lambda r: (str(r.doc_id), r.text))
    return train([r.text for r in got], [r._tx_label for r in got])


def places(text: str, low: str):
    """From places of the lower-cased text to those of the text; a few letters become two."""
    if len(text) == len(low):
        return int
    begins = np.cumsum([0, *[len(c.lower()) for c in text]])
    return lambda k: int(np.searchsorted(begins, k, "right")) - 1


def tag_toxicity(docs: DataFrame, model: Field, key: str | None = "doc_id", threshold: float = 0.5) -> DataFrame:
    """``key, score, spans`` for every row, from the whole ``text`` alone.

    ``spans`` are (start, end, p) of runs of tokens whose marginal is over ``threshold``, in code points of the text. An empty or null text has no token and the score of a text without toxic signs;
    repeated rows are each answered; an empty table gives no rows. Other columns are ignored, or with no ``key`` kept as
    they are (but for columns that have the names of the two new ones).
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights
    kept = [f for f in docs.schema if (f.name == key if key else f.name not in ("score", "spans"))]
    names = [f.name for f in kept]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(held.value)
        for b in batches:
            scores, spans = [], []
            for _, texts in groups(b.column("text")):
                lows = [t.lower() for t in texts]
                for text, low, p in zip(texts, lows, tagger.tag_words([TOKEN.findall(t) for t in lows]), strict=True):
                    scores.append(tagger.score(p))
                    found: list[dict] = []
                    if len(p) and p.max() > threshold:
                        last = -2
                        hot = set(np.flatnonzero(p > threshold).tolist())
                        place = places(text, low)
                        for k, m in enumerate(TOKEN.finditer(low)):
                            if k in hot:
                                start, end = place(m.start()), place(m.end() - 1) + 1
                                if last == k - 1:
                                    found[-1]["end"], found[-1]["p"] = end, max(found[-1]["p"], float(p[k]))
                                else:
                                    found.append({"start": start, "end": end, "p": float(p[k])})
                                last = k
                    spans.append(found)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(scores, pa.float64()), pa.array(spans, span)], [*names, "score", "spans"])

    schema = T.StructType([*kept, *T.StructType.fromDDL("score double, spans array<struct<start:int,end:int,p:double>>")])
    return small_batches(docs).select(*dict.fromkeys([*names, "text"])).mapInArrow(lean(tag), schema)


#: A document is rejected from this score on.
REJECT = 0.7


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn_toxicity(docs, labels.where(crc_mod("doc_id", 3) != 1))
    out = tag_toxicity(docs, model)
    return out.select(
        "doc_id",
        (crc_mod("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
        "spans",
    )
