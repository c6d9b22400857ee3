"""Edits of timelines as transformations: each takes tables and an edits table and returns new tables."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoframe.operators.clusters import label_components
from chronoframe.operators.joins import interval_join, overlap_join
from chronoframe.operators.sweeps import painted, regions, uncovered
from chronoframe.operators.whole_groups import fold_groups
from chronoframe.sources.written import written


def split_segments(segs: DataFrame, links: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """Segments cut at all their times t into pieces (new ids from the old one), annotations on each.

    ``edits``: (segment_id, t), any number for a segment, in any order: a later cut cuts the piece that it falls into. A
    time that is not inside its segment, or is named again, changes nothing.
    """
    s = segs.join(edits.select("segment_id", "t").distinct(), "segment_id").where("t > start_s and t < end_s")
    cuts = s.select("segment_id", F.col("t").alias("_a"))
    old = segs.withColumn("_old", F.col("segment_id")).join(cuts.select("segment_id").distinct().withColumn("_cut", F.lit(True)), "segment_id", "left")
    starts = old.where("_cut").select("segment_id", F.col("start_s").alias("_a")).unionByName(cuts)
    w = W.partitionBy("segment_id").orderBy("_a")  # one segment's cuts
    pieces = starts.withColumn("_b", F.lead("_a").over(w)).withColumn("_k", F.row_number().over(w) - 1)
    x = old.join(pieces, "segment_id", "left").withColumn("segment_id", F.when(F.col("_k").isNull(), F.col("_old")).otherwise(F.xxhash64("_old", "_k")))
    out = x.withColumn("start_s", F.coalesce("_a", "start_s")).withColumn("end_s", F.coalesce("_b", "end_s"))
    moved = links.withColumnRenamed("segment_id", "_old").join(out.select("_old", "segment_id"), "_old").drop("_old").select(*links.columns)
    return {"segments": out.select(*segs.columns), "segment_annotations": moved}


def _merged(line, old: list, a: list, b: list, edit: list) -> list[tuple]:
    """What the edits of a region merge, as (timeline, segment, last edit, bounds of what it went into).

    Segments come first, without an edit and in the order of their bounds; then the edits' segments in the order of edits.
    What is there is kept in order, so that an edit looks only at what starts within its range.
    """
    place, start, end, steps = {}, [], [], {}
    for o, x, y, e in zip(old, a, b, edit, strict=True):
        if e is not None:
            steps.setdefault(e, []).append(o)
        elif o not in place:
            place[o] = len(start)
            start.append(x)
            end.append(y)
    holder, maker = list(range(len(start))), [None] * len(start)
    there = list(zip(start, end, holder, strict=True))

    def find(i: int) -> int:
        while holder[i] != i:
            holder[i] = i = holder[holder[i]]
        return i

    for e, names in steps.items():
        heads = {find(place[o]) for o in names if o in place}
        if len(heads) > 1:
            lo, hi = min(start[h] for h in heads), max(end[h] for h in heads)
            i, j = bisect_left(there, (lo,)), bisect_right(there, (hi, math.inf))
            stay, went = [], []
            for x in there[i:j]:
                (stay if x[1] > hi else went).append(x)
            head = went[0][2]
            for x in went:
                holder[x[2]] = head
            start[head], end[head], maker[head] = lo, hi, e
            there[i:j] = sorted([*stay, (lo, hi, head)])
    return [(line, o, maker[h], start[h], end[h]) for o, i in place.items() if maker[h := find(i)] is not None]


def merge_segments(segs: DataFrame, links: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """Segments of an edit become one over their whole range; what lies inside it goes, its annotations move.

    ``edits``: (edit_id, segment_id), any number, which take effect in the order of edit_id: a segment that is gone stands
    for the one that it went into. An edit changes nothing if it names one segment, several timelines, or a segment that
    isn't there. Edits whose ranges can't meet are worked on apart, so a task holds what one chain of overlapping edits of
    a timeline covers.
    """
    asked = edits.select("edit_id", "segment_id").distinct()
    named = asked.join(segs.select("segment_id", "timeline_id", "start_s", "end_s"), "segment_id", "left")
    whole = named.groupBy("edit_id").agg(F.count("*").alias("_n"), F.count("timeline_id").alias("_there"), F.countDistinct("timeline_id").alias("_t"), F.min("timeline_id").alias("timeline_id"), F.min("start_s").alias("a"), F.max("end_s").alias("b"))
    spans = regions(whole.where("_n > 1 and _t = 1 and _there = _n").select("edit_id", "timeline_id", "a", "b"), ["timeline_id"])
    bounds = spans.groupBy("timeline_id", "region").agg(F.min("a").alias("_from"), F.max("b").alias("_to"))
    as_segments = bounds.select(F.col("timeline_id").alias("video_id"), F.col("region").alias("segment_id"), F.col("_from").alias("start_s"), F.col("_to").alias("end_s"))
    inside = interval_join(segs.select(F.col("timeline_id").alias("video_id"), F.col("segment_id").alias("old"), F.col("start_s").alias("time"), F.col("end_s").alias("until")), as_segments, "closed").where("until <= end_s")
    inside = inside.select(F.col("video_id").alias("timeline_id"), F.col("segment_id").alias("region"), "old", F.col("time").alias("a"), F.col("until").alias("b"))
    kind = {c: dict(f.dtypes)[n] for c, f, n in (("timeline_id", segs, "timeline_id"), ("old", segs, "segment_id"), ("edit_id", edits, "edit_id"))}
    bare = lambda c, t: F.lit(None).cast(t).alias(c)
    steps = asked.join(spans.select("edit_id", "timeline_id", "region"), "edit_id")
    steps = steps.select("timeline_id", "region", F.col("segment_id").cast(kind["old"]).alias("old"), bare("a", "double"), bare("b", "double"), "edit_id")
    rows = inside.select("timeline_id", "region", "old", F.col("a").cast("double"), F.col("b").cast("double"), bare("edit_id", kind["edit_id"])).unionByName(steps)

    def fold(batch: pa.RecordBatch, starts: np.ndarray) -> dict:
        line, old, a, b, edit = (batch.column(c).to_pylist() for c in ("timeline_id", "old", "a", "b", "edit_id"))
        out = [found for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) for found in _merged(line[i], old[i:j], a[i:j], b[i:j], edit[i:j])]
        cols = list(zip(*out, strict=True)) or [()] * 5
        types = (batch.schema.field(c).type for c in ("timeline_id", "old", "edit_id", "a", "b"))
        return {c: pa.array(x, t) for c, x, t in zip(("timeline_id", "old", "edit_id", "a", "b"), cols, types, strict=True)}

    out = f"timeline_id {kind['timeline_id']}, old {kind['old']}, edit_id {kind['edit_id']}, a double, b double"
    # segments (no edit_id) by their bounds, then the edits in their order
    gone = written(fold_groups(rows, ["timeline_id", "region"], [F.col("edit_id").asc_nulls_first(), "a", "b", "old"], fold, out))
    gone = gone.withColumn("_new", F.xxhash64("edit_id", "timeline_id"))
    into = gone.select(F.col("old").alias("segment_id"), "_new")
    video = segs.groupBy("timeline_id").agg(F.min("video_id").alias("video_id"))
    made = gone.select("timeline_id", "_new", "a", "b").distinct().join(video, "timeline_id")
    made = made.select("video_id", "timeline_id", F.col("_new").alias("segment_id"), F.col("a").alias("start_s"), F.col("b").alias("end_s"))
    moved = links.join(into, "segment_id").select(F.col("_new").alias("segment_id"), "annotation_id").distinct()
    kept = segs.join(into, "segment_id", "left_anti").select(*made.columns)
    return {"segments": kept.unionByName(made), "segment_annotations": links.join(into, "segment_id", "left_anti").select("segment_id", "annotation_id").unionByName(moved)}


def _ranges_apart(segs: DataFrame, links: DataFrame, e: DataFrame) -> dict[str, DataFrame]:
    """``annotate_range`` for timelines of which each has one edit: an old segment has two pieces at most."""
    each = e.select("timeline_id", "edit_id", "a", "b").distinct()
    s = segs.join(each.select("timeline_id", "a", "b"), "timeline_id")
    piece = lambda i, x, y: F.struct(i.alias("i"), x.alias("a"), y.alias("b"))
    left = piece(F.col("segment_id"), F.col("start_s"), F.least("end_s", "a"))
    right = piece(F.when(F.col("start_s") < F.col("a"), F.xxhash64("segment_id", "b")).otherwise(F.col("segment_id")), F.greatest("start_s", "b"), F.col("end_s"))
    apart = (F.col("end_s") <= F.col("a")) | (F.col("start_s") >= F.col("b"))
    both = F.array_compact(F.array(F.when(F.col("start_s") < F.col("a"), left), F.when(F.col("end_s") > F.col("b"), right)))
    parts = F.when(apart, F.array(piece(F.col("segment_id"), F.col("start_s"), F.col("end_s")))).otherwise(both)
    out = s.select("video_id", "timeline_id", F.col("segment_id").alias("_old"), F.explode(parts).alias("_p"))
    out = out.select("video_id", "timeline_id", "_old", F.col("_p.i").alias("segment_id"), F.col("_p.a").alias("start_s"), F.col("_p.b").alias("end_s"))
    video = segs.groupBy("timeline_id").agg(F.min("video_id").alias("video_id"))
    new = e.join(video, "timeline_id").withColumn("segment_id", F.xxhash64("timeline_id", "edit_id", "a", "b"))
    made = new.select("video_id", "timeline_id", "segment_id", F.col("a").alias("start_s"), F.col("b").alias("end_s")).distinct()
    moved = links.withColumnRenamed("segment_id", "_old").join(out.select("_old", "segment_id"), "_old").select("segment_id", "annotation_id")
    noted = new.where(F.col("annotation_id").isNotNull()).select("segment_id", "annotation_id").distinct()
    return {"segments": out.drop("_old").unionByName(made), "segment_annotations": moved.unionByName(noted)}


#: A timeline with up to so many edits is painted at once; longer ones take the sweep.
FEW = 64


def _painted_row(a: list, b: list) -> list[tuple]:
    """Ranges painted in order as stretches (from, to, the range on top or None), with all before and after them."""
    points = sorted({*a, *b})
    at = {p: i for i, p in enumerate(points)}
    top = [None] * (len(points) - 1)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        top[at[x] : at[y]] = [k] * (at[y] - at[x])
    out = [(-math.inf, points[0], None)]
    for i, k in enumerate(top):
        if i and k == top[i - 1]:
            out[-1] = (out[-1][0], points[i + 1], k)
        else:
            out.append((points[i], points[i + 1], k))
    return [*out, (points[-1], math.inf, None)]


def _ranges_few(segs: DataFrame, links: DataFrame, e: DataFrame) -> dict[str, DataFrame]:
    """``annotate_range`` for timelines of few edits: what they cover and leave is found timeline by timeline, many at a time."""
    each = e.select("timeline_id", "edit_id", "a", "b").distinct()
    kind = dict(each.dtypes)

    def fold(batch: pa.RecordBatch, starts: np.ndarray) -> dict:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        rows = [(i, x, y, None if k is None else i + k) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) for x, y, k in _painted_row(a[i:j], b[i:j])]
        of, x, y, top = zip(*rows, strict=True)
        own, by = batch.column("timeline_id").take(pa.array(of)), pa.array(top, pa.int64())
        return {"timeline_id": own, "edit_id": batch.column("edit_id").take(by), "from": batch.column("a").take(by), "to": batch.column("b").take(by), "a": x, "b": y}

    runs = written(fold_groups(each, ["timeline_id"], ["edit_id", "a", "b"], fold, f"timeline_id {kind['timeline_id']}, edit_id {kind['edit_id']}, from double, to double, a double, b double"))
    ranges = e.groupBy("timeline_id").agg(F.collect_set(F.struct(F.col("a").alias("from"), F.col("b").alias("to"))).alias("_r"))
    gaps = runs.where("from is null").groupBy("timeline_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_gaps")).join(ranges, "timeline_id")
    # old segments: their parts in gaps, the first of which keeps the id; those without length go if a range reaches beyond them
    piece = lambda i, a, b: F.struct(i.alias("i"), a.alias("a"), b.alias("b"))
    met = F.filter("_gaps", lambda g: F.greatest("start_s", g["a"]) < F.least("end_s", g["b"]))
    parts = F.transform(met, lambda g, k: piece(F.when(k == 0, F.col("segment_id")).otherwise(F.xxhash64("segment_id", F.greatest("start_s", g["a"]))), F.greatest("start_s", g["a"]), F.least("end_s", g["b"])))
    whole = F.array(piece(F.col("segment_id"), F.col("start_s").cast("double"), F.col("end_s").cast("double")))
    hidden = F.exists("_r", lambda x: (x["from"] < F.col("start_s")) & (F.col("start_s") < x["to"]))
    s = segs.select("video_id", "timeline_id", "segment_id", "start_s", "end_s").join(gaps, "timeline_id", "left")
    kept = F.when(F.col("_r").isNull(), whole).when(F.col("start_s") < F.col("end_s"), parts).when(F.coalesce(hidden, F.lit(False)), F.filter(whole, lambda x: F.lit(False))).otherwise(whole)
    out = s.select("video_id", "timeline_id", F.col("segment_id").alias("_old"), F.explode(kept).alias("_x")).select("video_id", "timeline_id", "_old", F.col("_x.i").alias("segment_id"), F.col("_x.a").alias("start_s"), F.col("_x.b").alias("end_s"))
    video = segs.groupBy("timeline_id").agg(F.min("video_id").alias("video_id"))
    new = runs.where("from is not null").join(video, "timeline_id").withColumn("segment_id", F.xxhash64("timeline_id", "edit_id", "from", "to", "a"))
    made = new.select("video_id", "timeline_id", "segment_id", F.col("a").alias("start_s"), F.col("b").alias("end_s"))
    moved = links.withColumnRenamed("segment_id", "_old").join(out.select("_old", "segment_id"), "_old").select("segment_id", "annotation_id")
    notes = e.select("timeline_id", "edit_id", F.col("a").alias("from"), F.col("b").alias("to"), "annotation_id").where("annotation_id is not null").distinct()
    noted = new.join(notes, ["timeline_id", "edit_id", "from", "to"]).select("segment_id", "annotation_id")
    return {"segments": out.drop("_old").unionByName(made), "segment_annotations": moved.unionByName(noted)}


def _ranges_swept(segs: DataFrame, links: DataFrame, e: DataFrame) -> dict[str, DataFrame]:
    """``annotate_range`` for timelines of many edits."""
    each = e.select("timeline_id", "edit_id", "a", "b").distinct()
    # new segments: an edit's bounds are part of what tells it apart
    steps = each.select("timeline_id", "edit_id", F.col("a").alias("from"), F.col("b").alias("to"), "a", "b")
    pieces = painted(steps, "timeline_id", ["edit_id", "from", "to"]).withColumn("segment_id", F.xxhash64("timeline_id", "edit_id", "from", "to", "a"))
    noted = pieces.join(e.select("timeline_id", "edit_id", F.col("a").alias("from"), F.col("b").alias("to"), "annotation_id").distinct(), ["timeline_id", "edit_id", "from", "to"])
    # old segments: what lies in gaps between all edits of the timeline
    old = segs.join(each.select("timeline_id").distinct(), "timeline_id", "left_semi")
    low = old.groupBy("timeline_id").agg((F.min("start_s") - 1).alias("lo"), (F.max("end_s") + 1).alias("hi"))
    gaps = written(uncovered(each, "timeline_id", low))
    as_segments = gaps.select(F.col("timeline_id").alias("video_id"), F.col("number").alias("segment_id"), F.col("a").alias("start_s"), F.col("b").alias("end_s"))
    on_timeline = old.select(F.col("timeline_id").alias("video_id"), "segment_id", "start_s", "end_s")
    met = overlap_join(on_timeline.where("start_s < end_s"), as_segments, strict=True).select(F.col("video_id").alias("timeline_id"), F.col("a_id").alias("segment_id"), F.col("b_id").alias("number"))
    left = old.join(met, ["timeline_id", "segment_id"]).join(gaps, ["timeline_id", "number"])
    left = left.withColumn("start", F.greatest("start_s", "a")).withColumn("end", F.least("end_s", "b"))
    first = F.col("start") == F.min("start").over(W.partitionBy("segment_id"))  # one segment's pieces
    left = left.select("video_id", "timeline_id", F.col("segment_id").alias("_old"), F.when(first, F.col("segment_id")).otherwise(F.xxhash64("segment_id", "start")).alias("segment_id"), F.col("start").alias("start_s"), F.col("end").alias("end_s"))
    # segments without length stay unless an edit reaches beyond them on both sides
    ranges = each.select(F.col("timeline_id").alias("video_id"), F.xxhash64("edit_id", "a", "b").alias("segment_id"), F.col("a").alias("start_s"), F.col("b").alias("end_s"))
    spots = on_timeline.where("not start_s < end_s").select("video_id", F.col("segment_id").alias("spot"), F.col("start_s").alias("time"))
    hit = interval_join(spots, ranges, "open").select(F.col("spot").alias("segment_id"))
    kept = segs.join(each.select("timeline_id").distinct(), "timeline_id", "left_anti").unionByName(old.where("not start_s < end_s").join(hit, "segment_id", "left_anti"))
    out = kept.select("video_id", "timeline_id", F.col("segment_id").alias("_old"), "segment_id", "start_s", "end_s").unionByName(left)
    video = segs.groupBy("timeline_id").agg(F.min("video_id").alias("video_id"))
    made = pieces.join(video, "timeline_id").select("video_id", "timeline_id", "segment_id", F.col("a").alias("start_s"), F.col("b").alias("end_s"))
    moved = links.withColumnRenamed("segment_id", "_old").join(out.select("_old", "segment_id"), "_old").select("segment_id", "annotation_id")
    noted = noted.join(video, "timeline_id").where(F.col("annotation_id").isNotNull()).select("segment_id", "annotation_id")
    return {"segments": out.drop("_old").unionByName(made), "segment_annotations": moved.unionByName(noted)}


def annotate_range(segs: DataFrame, links: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """New segments [a, b] with annotations: what they cover goes, what they overlap is trimmed, what encloses them is cut in two.

    ``edits``: (timeline_id, a, b, annotation_id), any number for a timeline, in the order of ``edit_id`` (without that
    column all are one step, in the order of a and b): of overlapping ones the last stays whole, the others keep what is
    left. Rows of one edit with equal bounds name several annotations; an edit without length or bound changes nothing. The
    first piece of an old segment keeps its id. Timelines with one edit are cut directly, those with a few many at a time;
    for those with more, instead of step by step, the last writer of every stretch between bounds is found in one sweep.
    """
    e = edits if "edit_id" in edits.columns else edits.withColumn("edit_id", F.lit(0).cast("long"))
    e = e.where("timeline_id is not null and a < b").select("timeline_id", "edit_id", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), "annotation_id")
    counts = e.select("timeline_id", "edit_id", "a", "b").distinct().groupBy("timeline_id").agg(F.count("*").alias("_n"))
    most = counts.agg(F.max("_n")).first()[0] or 0
    if most > 1:
        if most > FEW:
            long = counts.where(F.col("_n") > FEW).select("timeline_id")
            swept = _ranges_swept(segs, links, e.join(long, "timeline_id", "left_semi"))
            segs, links, e = swept["segments"], swept["segment_annotations"], e.join(long, "timeline_id", "left_anti")
        return _ranges_few(segs, links, e)
    edited = e.select("timeline_id").distinct()
    rest = segs.join(edited, "timeline_id", "left_anti").select("video_id", "timeline_id", "segment_id", "start_s", "end_s")
    cut = _ranges_apart(segs, links, e)
    still = links.join(rest.select("segment_id"), "segment_id", "left_semi").select("segment_id", "annotation_id")
    return {"segments": cut["segments"].unionByName(rest), "segment_annotations": cut["segment_annotations"].unionByName(still)}


def replace_annotations(links: DataFrame, dims: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """The annotations of the edited segments are replaced by (segment_id, name, category_id); missing ones are made."""
    wanted = edits.join(dims.select("annotation_id", "name", "category_id"), ["name", "category_id"], "left")
    wanted = wanted.withColumn("annotation_id", F.coalesce("annotation_id", F.xxhash64("name", "category_id")))
    fresh = wanted.select("annotation_id", "name", "category_id").distinct().join(dims.select("annotation_id"), "annotation_id", "left_anti")
    kept = links.join(edits.select("segment_id").distinct(), "segment_id", "left_anti")
    return {"segment_annotations": kept.unionByName(wanted.select("segment_id", "annotation_id").distinct()), "annotation_dim": dims.select("annotation_id", "name", "category_id").unionByName(fresh)}


def toggle_annotations(links: DataFrame, edits: DataFrame) -> DataFrame:
    """Links of which the edits name each once: what is there goes, what isn't comes."""
    a, b = links.select("segment_id", "annotation_id").distinct(), edits.select("segment_id", "annotation_id").distinct()
    own = ["segment_id", "annotation_id"]
    return a.join(b, own, "left_anti").unionByName(b.join(a, own, "left_anti"))


def merge_clusters(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Clusters merged by (from_id, to_id) in the order of ``edit_id`` (without that column, of from_id and to_id).

    The items of ``from_id`` go to ``to_id``, with all that came to it before, and ``from_id`` is no more: a later edit that
    names it on either side changes nothing, nor does one that names nothing or one cluster twice. Edits are followed within
    each component of their graph.
    """
    e = edits if "edit_id" in edits.columns else edits.withColumn("edit_id", F.lit(0).cast("long"))
    e = e.where("from_id <> to_id").select("edit_id", "from_id", "to_id").distinct()
    ends = e.select(F.lit(0).alias("video_id"), F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    tied = label_components(ends, e.select(F.lit(0).alias("video_id"), F.col("from_id").alias("a"), F.col("to_id").alias("b")))
    kind = dict(edits.dtypes)["to_id"]

    def fold(todo: pd.DataFrame) -> pd.DataFrame:
        into: dict = {}
        for f, t in todo.sort_values(["edit_id", "from_id", "to_id"])[["from_id", "to_id"]].itertuples(index=False):
            if f not in into and t not in into:
                into[f] = t
        last = {}
        for f in reversed(into):  # a target goes after what it took in
            last[f] = last.get(into[f], into[f])
        return pd.DataFrame({"cluster": list(last), "_to": list(last.values())})

    final = e.join(tied.select(F.col("id").alias("from_id"), "component"), "from_id").groupBy("component").applyInPandas(fold, f"cluster {kind}, _to {kind}")
    x = items.join(final, "cluster", "left")
    return x.withColumn("cluster", F.coalesce("_to", "cluster")).select(*items.columns)


def move_items(items: DataFrame, edits: DataFrame) -> DataFrame:
    x = items.join(edits.select("ref_id", F.col("cluster").alias("_to")), "ref_id", "left")
    return x.withColumn("cluster", F.coalesce("_to", "cluster")).select(*items.columns)


def delete_items(items: DataFrame, edits: DataFrame) -> DataFrame:
    return items.join(edits.select("ref_id"), "ref_id", "left_anti").select(*items.columns)


def new_timeline(videos: DataFrame, name: str) -> dict[str, DataFrame]:
    """A timeline of one segment over the whole of each video."""
    t = F.xxhash64("video_id", F.lit(name))
    return {
        "timelines": videos.select("video_id", t.alias("timeline_id"), F.lit(name).alias("name")),
        "segments": videos.select("video_id", t.alias("timeline_id"), F.xxhash64("video_id", F.lit(name), F.lit(0)).alias("segment_id"), F.lit(0.0).alias("start_s"), F.col("duration").alias("end_s")),
    }


def annotations_to_timeline(annos: DataFrame, category: str) -> dict[str, DataFrame]:
    """Annotations (name, labels[]) as timelines by name, segments by annotation, and a table of distinct labels."""
    a = annos.withColumn("timeline_id", F.xxhash64("video_id", "name")).withColumn("segment_id", F.xxhash64("video_id", "name", "start_s", "end_s"))
    links = a.select("segment_id", F.explode("labels").alias("label")).withColumn("annotation_id", F.xxhash64("label", F.lit(category)))
    return {
        "timelines": a.select("video_id", "timeline_id", "name").distinct(),
        "segments": a.select("video_id", "timeline_id", "segment_id", "start_s", "end_s").distinct(),
        "segment_annotations": links.select("segment_id", "annotation_id").distinct(),
        "annotation_dim": links.select("annotation_id", F.col("label").alias("name"), F.lit(category).alias("category")).distinct(),
    }


def annotation_cells(segs: DataFrame, links: DataFrame, annotations: DataFrame, categories: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """A segment's annotations as ``category::name`` joined by +, in order; "None" where there is none.

    With ``target`` (other segments of the same videos) each of those gets the cells of all segments that it overlaps or
    touches, by their starts, joined by + too.
    """
    a = annotations.join(categories.select("category_id", "category_name"), "category_id", "left")
    cell = F.concat(F.coalesce(F.concat("category_name", F.lit("::")), F.lit("")), F.col("name"))
    named = links.join(a.select("annotation_id", cell.alias("cell")), "annotation_id")
    g = segs.join(named, "segment_id", "left").groupBy("video_id", "segment_id").agg(F.array_join(F.sort_array(F.collect_list("cell")), "+").alias("cell"), F.min("start_s").alias("start_s"))
    g = g.withColumn("cell", F.when(F.col("cell") == "", "None").otherwise(F.col("cell")))
    if target is None:
        return g.drop("start_s")
    own = g.withColumnRenamed("segment_id", "b_id")
    met = overlap_join(target, segs, strict=False).join(own, ["video_id", "b_id"])
    cells = F.transform(F.sort_array(F.collect_list(F.struct("start_s", "b_id", "cell"))), lambda x: x["cell"])
    met = met.groupBy("video_id", F.col("a_id").alias("segment_id")).agg(F.array_join(cells, "+").alias("cell"))
    return target.select("video_id", "segment_id").join(met, ["video_id", "segment_id"], "left").fillna("None", ["cell"])


def affected_segments(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("segment_id")
    for p in parts[1:]:
        out = out.union(p.select("segment_id"))
    return out.distinct()


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def reorder_timelines(timelines: DataFrame, order: DataFrame) -> DataFrame:
    """Orders from a list (video_id, ids[]); timelines that it leaves out keep their order after those named."""
    o = order.select("video_id", F.posexplode("ids").alias("_p", "timeline_id"))
    x = timelines.join(o, ["video_id", "timeline_id"], "left")
    place = F.row_number().over(W.partitionBy("video_id").orderBy(F.col("_p").asc_nulls_last(), "ord", "timeline_id")) - 1
    return x.withColumn("ord", place.cast("int")).select(*timelines.columns)


def next_timeline(timelines: DataFrame) -> DataFrame:
    w = W.partitionBy("video_id").orderBy("ord", "timeline_id")
    return timelines.select("video_id", "timeline_id", F.lag("timeline_id").over(w).alias("previous_id"), F.lead("timeline_id").over(w).alias("next_id"))


def segments_at(segs: DataFrame, t: float) -> DataFrame:
    return segs.where((F.col("start_s") <= t) & (F.col("end_s") >= t))
