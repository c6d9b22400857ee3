"""Audio samples and pixels: loudness, amplitude, spectra, brightness, colours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.operators.stretches import PARTS, SIZE, over_rows
from chronoframe.operators.whole_groups import fold_groups


def _scaled(df: DataFrame, normalize: bool) -> DataFrame:
    if not normalize:
        return df
    b = df.groupBy("video_id").agg(F.min("y").alias("_lo"), F.max("y").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return df.join(b, "video_id").withColumn("y", F.when(span > 0, (F.col("y") - F.col("_lo")) / span).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def frame_brightness(pixels: DataFrame, fps: float = 2.0, normalize: bool = True) -> DataFrame:
    """The mean of the largest channel of each frame's pixels."""
    y = pixels.groupBy("video_id", "frame_idx").agg(F.avg(F.greatest("r", "g", "b") / 255.0).alias("y"))
    return _scaled(y.select("video_id", (F.col("frame_idx") / fps).alias("time"), "y"), normalize)


def dominant_colors(pixels: DataFrame, k: int = 4, max_iter: int = 10) -> DataFrame:
    """``video_id, frame_idx, rank, r, g, b`` in [0, 1]: k-means centres of a frame's pixels, the smallest cluster first.

    k = 1 is the mean colour. Centres start at evenly spaced pixels in the order of brightness. Equal pixels are counted
    first, so that a frame is at most its distinct colours; the centres of many frames are computed at once.
    """
    if k == 1:
        return pixels.groupBy("video_id", "frame_idx").agg(*[(F.avg(c) / 255).alias(c) for c in "rgb"]).withColumn("rank", F.lit(0)).select("video_id", "frame_idx", "rank", "r", "g", "b")
    counted = pixels.groupBy("video_id", "frame_idx", "r", "g", "b").agg(F.count("*").alias("n"))

    rows = counted.select(F.col("video_id").cast("long"), F.col("frame_idx").cast("long"), *(F.col(c).cast("double") for c in "rgb"), F.col("n").cast("double"))
    bright = F.col("r") + F.col("g") + F.col("b")

    def means(batch: pa.RecordBatch, starts: np.ndarray) -> dict:
        x, n = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "rgb"], axis=1), batch.column("n").to_numpy()
        first, size = starts[:-1], np.diff(starts)
        # frame f has the centres c[f, :many[f]]
        many = np.minimum(size, k)
        steps = np.arange(k)[None] * ((size - 1) / np.maximum(many - 1, 1))[:, None]
        steps[np.arange(len(many)), many - 1] = np.where(many > 1, size - 1, 0)
        c = x[first[:, None] + np.minimum(steps.round().astype(np.int64), (size - 1)[:, None])]
        frame = np.repeat(np.arange(len(size)), size)

        def nearest(at: np.ndarray, f: np.ndarray) -> np.ndarray:
            best, own = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
            for j in range(k):
                d = at - c[f, j]
                d = np.where(j < many[f], d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2], np.inf)
                own[d < best] = j
                best = np.minimum(best, d)
            return own

        def sums(slot: np.ndarray, weights: np.ndarray) -> np.ndarray:
            return np.bincount(slot, weights, len(size) * k).reshape(len(size), k)

        todo = np.ones(len(size), bool)
        for _ in range(max_iter):
            rows = np.flatnonzero(todo[frame])
            slot = frame[rows] * k + nearest(x[rows], frame[rows])
            held = sums(slot, n[rows])
            total = np.stack([sums(slot, x[rows, j] * n[rows]) for j in range(3)], axis=2)
            new = np.where((held > 0)[:, :, None], total / np.maximum(held, 1)[:, :, None], c)
            todo &= ~np.isclose(new, c).all(axis=(1, 2))
            c[todo] = new[todo]
            if not todo.any():
                break
        held = np.where(np.arange(k)[None] < many[:, None], sums(frame * k + nearest(x, frame), n), np.inf)
        order = np.argsort(held, axis=1, kind="stable")
        f, rank = np.nonzero(np.arange(k)[None] < many[:, None])
        out, at = c[f, order[f, rank]] / 255, pa.array(first[f])
        return {"video_id": batch.column("video_id").take(at), "frame_idx": batch.column("frame_idx").take(at), "rank": rank.astype(np.int32)} | {ch: out[:, j] for j, ch in enumerate("rgb")}

    return fold_groups(rows, ["video_id", "frame_idx"], [bright, "r", "g", "b"], means, "video_id long, frame_idx long, rank int, r double, g double, b double")


def audio_rms(signal: DataFrame, hop: int = 512, size: int = 2048, normalize: bool = False) -> DataFrame:
    """The root mean square of frames of ``size`` samples centred at every ``hop``-th one, with zeros beyond the ends."""
    half = size // 2
    n = signal.groupBy("video_id").agg((F.max("i") + 1).alias("n"), F.first("sr").alias("sr"))
    first = F.ceil((F.col("i") - half + 1) / hop)
    last = F.floor((F.col("i") + half) / hop)
    s = signal.select("video_id", "i", "y").join(n, "video_id")
    s = s.withColumn("f", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), first), F.least(last, F.floor(F.col("n") / hop)))))
    y = s.groupBy("video_id", "f", "sr").agg(F.sqrt(F.sum(F.col("y") * F.col("y")) / size).alias("y"))
    return _scaled(y.select("video_id", (F.col("f") * hop / F.col("sr")).alias("time"), "y"), normalize)


def audio_amplitude(signal: DataFrame, max_samples: int | None = 200_000, normalize: bool = True, size: int = SIZE, parts: int = PARTS) -> DataFrame:
    """The signal at the places k n / ``max_samples``, between neighbours by a straight line and flat past the last sample.

    Short audio gets more samples; without ``max_samples`` they stay as they are. ``normalize`` scales them to 0 to 1.
    """
    if not max_samples:
        return _scaled(signal.select("video_id", (F.col("i") / F.col("sr")).alias("time"), "y"), normalize)
    n = signal.groupBy("video_id").agg((F.max("i") + 1).alias("n"), F.first("sr").alias("sr"))
    g = n.select("video_id", "n", "sr", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_samples - 1).cast("long"))).alias("k"))
    g = g.withColumn("at", F.col("k") * F.col("n") / max_samples).withColumn("i", F.floor("at"))
    s = over_rows(signal.select("video_id", "i", "y"), ["video_id"], ["i"], 0, 1, lambda w: {"_next": F.lead("y").over(w)}, size, parts)
    y = g.join(s, ["video_id", "i"])
    y = y.select("video_id", (F.col("k") * F.col("n") / max_samples / F.col("sr")).alias("time"), (F.col("y") + (F.coalesce("_next", "y") - F.col("y")) * (F.col("at") - F.col("i"))).alias("y"))
    return _scaled(y, normalize)


def spectrogram(signal: DataFrame, n_fft: int = 256, normalize: bool = False, floor_db: float = 80.0) -> DataFrame:
    """``video_id, frame, time, bins``: magnitudes of the windowed Fourier transform in decibels below the video's largest.

    A frame's samples meet by a join of frame numbers; the transform is one Arrow batch of frames at a time.
    """
    hop, half = n_fft // 4, n_fft // 2
    n = signal.groupBy("video_id").agg((F.max("i") + 1).alias("n"), F.first("sr").alias("sr"))
    s = signal.select("video_id", "i", "y").join(n, "video_id")
    first, last = F.ceil((F.col("i") - half + 1) / hop), F.floor((F.col("i") + half) / hop)
    s = s.withColumn("frame", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), first), F.least(last, F.floor(F.col("n") / hop)))))
    s = s.withColumn("slot", F.col("i") - F.col("frame") * hop + half)
    f = s.groupBy("video_id", "frame", "n", "sr").agg(F.collect_list(F.struct("slot", "y")).alias("s"))  # at most n_fft samples

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
        for b in batches:
            x, samples = np.zeros((b.num_rows, n_fft)), pc.list_flatten(b.column("s"))
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("s")).to_numpy())
            slot, y = (pc.struct_field(samples, c).to_numpy(zero_copy_only=False) for c in ("slot", "y"))
            ok = (slot >= 0) & (slot < n_fft)
            x[row[ok], slot[ok]] = y[ok]
            mag = np.abs(np.fft.rfft(x * window, axis=1))
            lists = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * mag.shape[1], mag.ravel())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("video_id", "frame", "n", "sr")], lists], ["video_id", "frame", "n", "sr", "mag"])

    f = f.select(F.col("video_id").cast("long"), F.col("frame").cast("long"), F.col("n").cast("long"), F.col("sr").cast("int"), "s")
    m = f.mapInArrow(transform, "video_id long, frame long, n long, sr int, mag array<double>")
    top = m.groupBy("video_id").agg(F.max(F.array_max("mag")).alias("_top"), F.max("frame").alias("_last"))
    db = lambda x: F.greatest(F.lit(-floor_db), 20 * F.log10(F.greatest(x, F.lit(1e-10)) / F.greatest(F.col("_top"), F.lit(1e-10))))
    out = m.join(top, "video_id").withColumn("bins", F.transform("mag", db))
    if normalize:
        ends = out.groupBy("video_id").agg(F.min(F.array_min("bins")).alias("_lo"), F.max(F.array_max("bins")).alias("_hi"))
        span = F.col("_hi") - F.col("_lo")
        out = out.join(ends, "video_id").withColumn("bins", F.transform("bins", lambda x: F.when(span > 0, (x - F.col("_lo")) / span).otherwise(F.lit(0.0))))
    return out.select("video_id", "frame", (F.col("frame") * (F.col("n") / F.col("sr")) / (F.col("_last") + 1)).alias("time"), "bins")
