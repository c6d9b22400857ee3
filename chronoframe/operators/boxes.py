"""Boxes: size filters, normalisation, suppression, tracks and lines of words."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.operators.joins import interval_join
from chronoframe.operators.whole_groups import fold_groups


def face_size_filter(bboxes: DataFrame, faces: DataFrame, min_h: float = 0.1, images: DataFrame | None = None, kps: DataFrame | None = None) -> dict[str, DataFrame]:
    """Boxes of at least ``min_h``, and the faces, images and keypoints that they refer to."""
    kept = bboxes.where(F.col("h") >= min_h)
    ids = kept.select("video_id", F.col("ref_id").alias("_ref")).distinct()
    semi = lambda df, c: df.join(ids.withColumnRenamed("_ref", c), ["video_id", c], "left_semi")
    out = {"bboxes": kept, "faces": semi(faces, "id")}
    if images is not None:
        out["images"] = semi(images, "ref_id")
    if kps is not None:
        out["keypoints"] = semi(kps, "ref_id")
    return out


def quality_filter(bboxes: DataFrame, least_score: float = 0.6, min_h: float = 0.05) -> DataFrame:
    return bboxes.where((F.col("det_score") >= least_score) & (F.col("h") > min_h))


def normalise_boxes(df: DataFrame, width: float, height: float) -> DataFrame:
    """Corners (x1, y1, x2, y2) in pixels as x, y, w, h in parts of the frame, cut at its upper and left edge."""
    x, y = F.greatest(F.col("x1"), F.lit(0.0)), F.greatest(F.col("y1"), F.lit(0.0))
    return df.select("video_id", "id", "time", (x / width).alias("x"), (y / height).alias("y"), ((F.col("x2") - x) / width).alias("w"), ((F.col("y2") - y) / height).alias("h"))


def nms(boxes: DataFrame, thr: float = 0.4) -> DataFrame:
    """Greedy suppression within a frame, by score, then id; areas count a pixel at either end. A fold over the frame's boxes."""
    box = F.struct((-F.col("score")).alias("s"), "id", "x1", "y1", "x2", "y2")
    g = boxes.groupBy("video_id", "time").agg(F.sort_array(F.collect_list(box)).alias("b"))
    area = lambda b: (b["x2"] - b["x1"] + 1) * (b["y2"] - b["y1"] + 1)

    def clash(k, b):
        w = F.greatest(F.lit(0.0), F.least(k["x2"], b["x2"]) - F.greatest(k["x1"], b["x1"]) + 1)
        h = F.greatest(F.lit(0.0), F.least(k["y2"], b["y2"]) - F.greatest(k["y1"], b["y1"]) + 1)
        return w * h / (area(k) + area(b) - w * h) > thr

    kept = F.aggregate("b", F.filter(F.col("b"), lambda x: F.lit(False)), lambda acc, b: F.when(F.exists(acc, lambda k: clash(k, b)), acc).otherwise(F.concat(acc, F.array(b))))
    return g.select("video_id", "time", F.explode(kept).alias("k")).select("video_id", "time", F.col("k.id").alias("id"), (-F.col("k.s")).alias("score"))


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The overlap of boxes (rows of x, y, w, h) one by one; 0 where the union is not positive."""
    w = np.maximum(0.0, np.minimum(a[:, 0] + a[:, 2], b[:, 0] + b[:, 2]) - np.maximum(a[:, 0], b[:, 0]))
    h = np.maximum(0.0, np.minimum(a[:, 1] + a[:, 3], b[:, 1] + b[:, 3]) - np.maximum(a[:, 1], b[:, 1]))
    union = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - w * h
    return np.divide(w * h, union, out=np.zeros(len(w)), where=union > 0)


#: Pairs of boxes that are compared at once.
PAIRS = 1 << 18


def _links(box: np.ndarray, frame: np.ndarray, group: np.ndarray, within: int, iou: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (i, j) of a group that overlap by more than ``iou``, j up to ``within`` frames after i; in order."""
    # frames of all groups on one line, too far apart to meet
    frame = frame - frame.min()
    line = group * (int(frame.max()) + within + 1) + frame
    first, last = np.searchsorted(line, line, "right"), np.searchsorted(line, line + within, "right")
    many = np.maximum(last - first, 0)
    total, found, at = np.cumsum(many), [], 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = many[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]
        ok = _iou(box[i], box[j]) > iou
        found.append((i[ok], j[ok]))
        at = to
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _tracks(n: int, i: np.ndarray, j: np.ndarray) -> list[list[int]]:
    """Chains of rows along the links: the first free row begins one, each goes on to the first free row that it has a link to."""
    at, to = np.searchsorted(i, np.arange(n + 1)).tolist(), j.tolist()
    free, tracks = bytearray(b"\1") * n, []
    for start in range(n):
        if free[start] and at[start] < at[start + 1]:
            track, row = [start], start
            while True:
                for k in to[at[row] : at[row + 1]]:
                    if free[k]:
                        free[k], row = 0, k
                        track.append(k)
                        break
                else:
                    break
            if len(track) > 1:
                tracks.append(track)
    return tracks


def track_faces(bboxes: DataFrame, shots: DataFrame, fps: float = 25.0, num_failed: int = 10, iou: float = 0.5, least_shot: float = 1.0) -> DataFrame:
    """Boxes of a shot linked to tracks: ``video_id, segment_id, track, frame, x, y, w, h``, missing frames interpolated.

    A track takes, frame by frame, the first free box that overlaps its last one by more than ``iou``, and ends when
    ``num_failed`` frames have none. Tracks of one box are dropped. The boxes of a shot are one group; overlaps are computed
    for many shots at once.
    """
    long = shots.where(F.col("end_s") - F.col("start_s") >= least_shot)
    inside = interval_join(bboxes.select("video_id", "id", "time", "x", "y", "w", "h"), long, "half_open")
    inside = inside.withColumn("frame", F.rint(F.col("time") * fps).cast("long"))

    own = ["video_id", "segment_id"]
    rows = inside.select(*(F.col(c).cast("long") for c in own), "frame", "id", *(F.col(c).cast("double") for c in "xywh"))

    def link(batch: pa.RecordBatch, starts: np.ndarray) -> dict:
        box = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xywh"], axis=1)
        frame, group = batch.column("frame").to_numpy(), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        tracks = _tracks(len(box), *_links(box, frame, group, num_failed, iou))
        sizes = np.array([len(t) for t in tracks], np.int64)
        a = np.fromiter(itertools.chain.from_iterable(tracks), np.int64, int(sizes.sum()))
        end = np.zeros(len(a), bool)
        end[np.cumsum(sizes) - 1] = True
        b = np.where(end, a, np.append(a[1:], 0))
        gap = np.where(end, 1, frame[b] - frame[a])  # the last box is a frame of its own
        # a track's number within its group
        of = group[a[np.cumsum(sizes) - sizes]]
        number = np.arange(len(of)) - np.searchsorted(of, of)
        row, step = np.repeat(np.arange(len(a)), gap), np.arange(int(gap.sum())) - np.repeat(np.cumsum(gap) - gap, gap)
        x = box[a][row] + (box[b] - box[a])[row] * step[:, None] / gap[row][:, None]
        first = pa.array(a[row])
        out = {c: batch.column(c).take(first) for c in own} | {c: x[:, k] for k, c in enumerate("xywh")}
        return out | {"track": np.repeat(number, sizes)[row].astype(np.int32), "frame": frame[a][row] + step}

    return fold_groups(rows, own, ["frame", "id"], link, "video_id long, segment_id long, track int, frame long, x double, y double, w double, h double")


def merge_lines(words: DataFrame, max_x: float = 100.0, max_y: float = 10.0, overlap: float = 0.5) -> DataFrame:
    """Word boxes of a frame as lines, lines as blocks: ``video_id, time, block, x, y, w, h, text``.

    Words are taken by their left edge; one joins the line whose rightmost word it overlaps in height by ``overlap`` of
    either, unless the gap is over ``max_x``. Blocks are the same with the axes exchanged and ``max_y``.
    """
    def chain(items: list, a: int, gap: float) -> list:
        """Items (x, y, w, h, text) chained along axis ``a``."""
        o, lines, near = 1 - a, [], []  # near: lines that a later item can still join, each with its rightmost item
        for it in sorted(items, key=lambda r: (r[a], r[o], r[4])):
            at, low, high, size = it[a], it[o], it[o] + it[o + 2], it[o + 2]
            passed = False
            for line in near:
                _, end, l_low, l_high, l_size = line
                if at - end > gap:
                    passed = True
                    continue
                shared = min(l_high, high) - max(l_low, low)
                if shared > 0 and (shared >= overlap * l_size or shared >= overlap * size):
                    line[0].append(it)
                    if at + it[a + 2] > end:
                        line[1:] = at + it[a + 2], low, high, size
                    break
            else:
                lines.append([it])
                near.append([lines[-1], at + it[a + 2], low, high, size])
            if passed:  # items come by their left edge, so these stay out of reach
                near = [line for line in near if at - line[1] <= gap]
        out = []
        for line in lines:
            x, y = min(r[0] for r in line), min(r[1] for r in line)
            out.append((x, y, max(r[0] + r[2] for r in line) - x, max(r[1] + r[3] for r in line) - y, " ".join(r[4] for r in line)))
        return out

    def merge(batch: pa.RecordBatch, starts: np.ndarray) -> dict:
        items = list(zip(*(batch.column(c).to_pylist() for c in ("x", "y", "w", "h", "text")), strict=True))
        found = [sorted(chain(chain(items[i:j], 0, max_x), 1, max_y), key=lambda r: (r[1], r[0])) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        sizes = [len(blocks) for blocks in found]
        first = pa.array(np.repeat(starts[:-1], sizes))
        x, y, w, h, text = zip(*itertools.chain.from_iterable(found), strict=True)
        number = np.fromiter((k for n in sizes for k in range(n)), np.int32, len(x))
        return {"video_id": batch.column("video_id").take(first), "time": batch.column("time").take(first), "block": number, "x": x, "y": y, "w": w, "h": h, "text": pa.array(text, pa.string())}

    rows = words.select(F.col("video_id").cast("long"), F.col("time").cast("double"), *(F.col(c).cast("double") for c in "xywh"), F.col("text").cast("string"))
    return fold_groups(rows, ["video_id", "time"], ["x", "y", "text", "w", "h"], merge, "video_id long, time double, block int, x double, y double, w double, h double, text string")
