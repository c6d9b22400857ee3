"""The same queries in SQL for DuckDB, over the same adapter views."""

from __future__ import annotations

from chronoframe.sources.adapters import SQL as VIEWS
from chronoframe.sources.adapters import with_views as v

IN = "p.video_id = s.video_id AND p.time"
PURCHASE = VIEWS["a_segments"].replace("'signup'", "'purchase'")
NOTES = """
items AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2),
segs AS (SELECT l_orderkey AS video_id, l_orderkey * 10 + l_linenumber AS segment_id, l_orderkey AS timeline_id, (l_linenumber * 10)::DOUBLE AS start_s, (l_linenumber * 10 + l_partkey % 20)::DOUBLE AS end_s FROM items),
links AS (SELECT l_orderkey * 10 + l_linenumber AS segment_id, l_partkey % 50 AS annotation_id FROM items),
dim AS (SELECT range AS annotation_id, 'note' || range AS name, CASE WHEN range % 3 < 2 THEN range % 3 END AS category_id FROM range(50)),
cats AS (SELECT range AS category_id, CASE range WHEN 0 THEN 'Transcript' ELSE 'Mood' END AS category_name FROM range(2))"""
MENTIONS = """
i AS (SELECT l_orderkey AS seg_id, l_linenumber * 10 AS s, min(l_partkey) AS p, min(l_suppkey) AS u FROM lineitem GROUP BY l_orderkey, l_linenumber),
m AS (SELECT seg_id, s::INT AS start_c, (s + 5)::INT AS end_c, 'p' || (p % 50) AS text, ['PER', 'ORG', 'LOC', 'MISC', 'DATE'][p % 5 + 1] AS type FROM i),
c AS (SELECT seg_id, s + u % 7 - 3 AS ch_from, s + u % 7 + 1 AS ch_to, (p % 1000) / 100000.0::DOUBLE AS page_rank, 'Q' || (u % 100) AS wd_id, CASE WHEN p % 2 = 0 THEN 'one' ELSE 'two words' END AS wd_label FROM i WHERE p % 3 > 0),
best AS (SELECT m.seg_id, m.start_c, m.end_c, arg_max(c.wd_id, (c.page_rank, -c.ch_from)) AS wd, arg_max(c.wd_label, (c.page_rank, -c.ch_from)) AS wl FROM m JOIN c ON m.seg_id = c.seg_id AND c.page_rank >= 1e-4 AND ch_from >= start_c - 2 AND ch_to <= end_c + 2 GROUP BY 1, 2, 3),
linked AS (SELECT m.*, coalesce(wd, CASE WHEN substr(text, 2)::INT < 25 THEN 'F' || substr(text, 2) END, 'unk') AS wd_id, coalesce(wl, CASE WHEN substr(text, 2)::INT < 25 THEN text END, 'unk') AS wd_label FROM m LEFT JOIN best USING (seg_id, start_c, end_c) WHERE type <> 'DATE')"""
PARTS = "parts AS (SELECT l_orderkey AS video_id, l_linenumber::BIGINT AS timeline_id, (l_partkey % 10)::INT AS ord, CASE WHEN l_linenumber > 1 THEN l_linenumber // 2 END::BIGINT AS parent_id FROM lineitem)"
PIXELS = "px AS (SELECT l_orderkey % 50 AS video_id, l_orderkey AS frame_idx, l_partkey * 7 % 256 AS r, l_suppkey * 11 % 256 AS g, l_linenumber * 31 % 256 AS b FROM lineitem)"
CHUNKS = "chunks AS (SELECT video_id, floor(time / 864000)::BIGINT AS segment_id, floor(time / 86400)::BIGINT AS chunk, series AS label, max(y) AS prob FROM a_scalars GROUP BY ALL)"
UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"
UNITS = f"units AS (SELECT video_id, id, time, label, embedding, {UNIT} AS u FROM a_embeddings)"


def _grid(how: str, order: str = "['click', 'view', 'purchase']") -> str:
    agg = {"prod": "product(y)", "or": "1 - product(1 - y)"}[how]
    return v(
        f"SELECT video_id, time, round({agg}, 9) AS y FROM vals GROUP BY video_id, time",
        "a_scalars",
        extra=f"""
    s AS (SELECT video_id, series, time, max(y) AS y FROM a_scalars WHERE list_contains({order}, series) GROUP BY ALL),
    n AS (SELECT video_id, series, count(*) AS n FROM s GROUP BY ALL),
    longest AS (SELECT video_id, series FROM n QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY n DESC, list_position({order}, series)) = 1),
    grid AS (SELECT s.video_id, s.time FROM s JOIN longest USING (video_id, series)),
    asked AS (SELECT g.video_id, g.time, n.series FROM grid g JOIN n USING (video_id)),
    lo AS (SELECT q.*, s.time AS t0, s.y AS y0 FROM asked q ASOF LEFT JOIN s ON q.video_id = s.video_id AND q.series = s.series AND q.time >= s.time),
    hi AS (SELECT q.*, s.time AS t1, s.y AS y1 FROM asked q ASOF LEFT JOIN s ON q.video_id = s.video_id AND q.series = s.series AND q.time <= s.time),
    vals AS (SELECT video_id, time, series, CASE WHEN coalesce(t0, t1) = coalesce(t1, t0) THEN coalesce(y0, y1)
      ELSE y0 + (y1 - y0) * (time - t0) / (t1 - t0) END AS y FROM lo JOIN hi USING (video_id, time, series))""",
    )


def _walk(facts: str, opens: str, goes: str, back: int, least: int, *views: str) -> str:
    """Runs of shots by a walk from shot to shot. ``facts``: video_id, segment_id, x; ``opens`` is of shots a and b, ``goes`` of shots j and k, ``back`` shots apart."""
    return v(
        f"""SELECT w.video_id, w.i::INT AS first_shot, st.e::INT AS last_shot, a.start_s, b.end_s FROM walk w JOIN st USING (video_id, i) JOIN sh a USING (video_id, i) JOIN sh b ON b.video_id = w.video_id AND b.i = st.e WHERE takes""",
        "a_segments", *views,
        extra=f"""facts AS ({facts}),
    sh AS (SELECT s.video_id, start_s, end_s, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY s.video_id) AS n, x FROM a_segments s LEFT JOIN facts USING (video_id, segment_id) WINDOW w AS (PARTITION BY s.video_id ORDER BY start_s, segment_id)),
    stop AS (SELECT k.video_id, k.i AS brk FROM sh k JOIN sh j ON j.video_id = k.video_id AND j.i = k.i - {back} WHERE NOT coalesce({goes}, false)),
    ends AS (SELECT a.video_id, a.i, a.n, min(coalesce(brk, a.n)) - 1 AS e FROM sh a LEFT JOIN stop ON stop.video_id = a.video_id AND brk >= a.i + 2 GROUP BY a.video_id, a.i, a.n),
    st AS (SELECT g.video_id, g.i, e, g.i < g.n - 2 AND coalesce({opens}, false) AND e - g.i + 1 >= {least} AS takes FROM ends g JOIN sh a ON a.video_id = g.video_id AND a.i = g.i LEFT JOIN sh b ON b.video_id = g.video_id AND b.i = g.i + 1),
    walk AS (SELECT DISTINCT video_id, 0::BIGINT AS i FROM sh UNION ALL SELECT w.video_id, CASE WHEN takes THEN e + 1 ELSE w.i + 1 END FROM walk w JOIN st USING (video_id, i))""",
    )


SIDES = f"""SELECT video_id, segment_id, struct_pack(c := min(cluster), s := min(side)) AS x FROM (SELECT video_id, segment_id, cluster, CASE WHEN sum(l) > sum(r) THEN 'left' ELSE 'right' END AS side FROM (SELECT s.video_id, s.segment_id, p.cluster,
    lx * oy / (p.w * p.h + 0.5 - lx * oy) AS l, rx * oy / (p.w * p.h + 0.5 - rx * oy) AS r FROM a_segments s JOIN (SELECT b.*, c.cluster, greatest(0, least(x + w, 0.5) - greatest(x, 0)) AS lx, greatest(0, least(x + w, 1) - greatest(x, 0.5)) AS rx, greatest(0, least(y + h, 1) - greatest(y, 0)) AS oy
    FROM a_bboxes b JOIN a_clusters c ON b.video_id = c.video_id AND b.id = c.ref_id) p ON {IN} > s.start_s AND p.time < s.end_s) GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(DISTINCT cluster) = 1"""


def _components(t: float) -> str:
    return f"""{UNITS},
    near AS (SELECT a.video_id, a.id AS a, b.id AS b FROM units a JOIN units b ON a.video_id = b.video_id AND a.id <> b.id AND 1 - list_dot_product(a.u, b.u) <= {t}),
    reach AS (SELECT video_id, id, id AS to_id FROM units UNION SELECT r.video_id, r.id, n.b FROM reach r JOIN near n ON r.video_id = n.video_id AND r.to_id = n.a),
    comp AS (SELECT video_id, id, min(to_id) AS c FROM reach GROUP BY ALL),
    sizes AS (SELECT video_id, c, count(*) AS size, row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, c) - 1 AS cluster_rank FROM comp GROUP BY video_id, c),
    members AS (SELECT video_id, id, cluster_rank, size, row_number() OVER (PARTITION BY video_id, c ORDER BY id) - 1 AS position FROM comp JOIN sizes USING (video_id, c))"""


def _elan(fn: str) -> str:
    return v(
        f"""SELECT video_id, 'notes' AS tier, trunc(start_s * 1000)::BIGINT AS start_ms, trunc(end_s * 1000)::BIGINT AS end_ms, CASE WHEN segment_id % 2 = 0 THEN 'a; b' ELSE 'value:' || (row_number() OVER (PARTITION BY video_id ORDER BY start_s, segment_id) - 1) END AS value FROM a_segments WHERE trunc(start_s * 1000) < trunc(end_s * 1000)
        UNION ALL SELECT s.video_id, p.series, trunc(s.start_s * 1000)::BIGINT, trunc(s.end_s * 1000)::BIGINT, 'value:' || round_even({fn}(floor(p.y * 64) / 64), 3) FROM a_segments s JOIN a_scalars p ON {IN} BETWEEN s.start_s AND s.end_s WHERE trunc(s.start_s * 1000) < trunc(s.end_s * 1000) GROUP BY s.video_id, s.segment_id, s.start_s, s.end_s, p.series""",
        "a_scalars", "a_segments",
    )


WHOLE = "round(sum(y), 9)"
SEGVAL = f"SELECT s.video_id, s.segment_id, round(avg(p.y), 9) AS mean FROM a_segments s JOIN a_scalars p ON {IN} BETWEEN s.start_s AND s.end_s GROUP BY ALL"
HOURS = "hours AS (SELECT video_id, segment_id, start_s / 3600 AS start_s, end_s / 3600 AS end_s FROM a_segments)"

ORACLES: dict[str, str] = {
    "interval_join": v(f"SELECT s.video_id, s.segment_id, count(*) AS n, round(sum(p.y), 9) AS total FROM a_segments s JOIN a_scalars p ON {IN} >= s.start_s AND p.time < s.end_s GROUP BY ALL", "a_scalars", "a_segments"),
    "overlap_join": v("SELECT a.video_id, a.segment_id AS a_id, b.segment_id AS b_id FROM a_segments a JOIN b_segments b ON a.video_id = b.video_id AND least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s) > 0", "a_scalars", "a_segments", extra=f"b_segments AS ({PURCHASE})"),
    "neighbours": v(
        """SELECT m.video_id, m.segment_id, (SELECT p.segment_id FROM a_segments p WHERE p.video_id = m.video_id AND p.end_s <= m.start_s ORDER BY p.end_s DESC, p.segment_id LIMIT 1) AS previous_id,
        (SELECT n.segment_id FROM a_segments n WHERE n.video_id = m.video_id AND n.start_s >= m.end_s ORDER BY n.end_s, n.segment_id LIMIT 1) AS next_id FROM a_segments m""", "a_segments"),
    "frame_faces": v("SELECT f.video_id, f.series, f.time, k.id FROM a_scalars f JOIN a_bboxes k ON f.video_id = k.video_id AND round(f.time * 1e6) = round(k.time * 1e6)", "a_scalars", "a_bboxes"),
    "zip_by_order": v("""SELECT video_id, position, a_start, b_start FROM (SELECT video_id, start_s AS a_start, row_number() OVER (PARTITION BY video_id ORDER BY start_s) AS position FROM a_segments) a
        JOIN (SELECT video_id, start_s AS b_start, row_number() OVER (PARTITION BY video_id ORDER BY start_s) AS position FROM b_segments) b USING (video_id, position)""", "a_segments", extra=f"b_segments AS ({PURCHASE})"),
    "shot_thumbnails": v("""SELECT i.video_id, i.segment_id, first_i, middle_i, last_i, a.frame_id AS first_frame, b.frame_id AS middle_frame, c.frame_id AS last_frame FROM idx i
        LEFT JOIN f a ON a.video_id = i.video_id AND a.i = first_i LEFT JOIN f b ON b.video_id = i.video_id AND b.i = middle_i LEFT JOIN f c ON c.video_id = i.video_id AND c.i = last_i""",
        "a_segments", "a_frames", extra="""f AS (SELECT video_id, i, video_id * 1000000 + i AS frame_id FROM a_frames), n AS (SELECT video_id, count(*) AS n FROM f GROUP BY ALL),
        idx AS (SELECT video_id, segment_id, least(ceil(start_s / 86400.0), n - 1)::BIGINT AS first_i, floor((start_s + end_s) / 2 / 86400.0 + 0.5)::BIGINT AS middle_i, floor(end_s / 86400.0)::BIGINT AS last_i FROM a_segments LEFT JOIN n USING (video_id))"""),
    "face_facts": v("SELECT b.video_id, b.id AS face_id, b.time, b.x, b.y, b.w, b.h, c.cluster FROM a_bboxes b JOIN a_clusters c ON b.video_id = c.video_id AND b.id = c.ref_id", "a_bboxes", "a_clusters"),
    "timeline_tree": v("SELECT video_id, timeline_id, depth, path FROM tree", extra=f"""{PARTS}, tree AS (SELECT video_id, timeline_id, 0 AS depth, ord::VARCHAR AS path FROM parts WHERE parent_id IS NULL
        UNION ALL SELECT t.video_id, t.timeline_id, p.depth + 1, p.path || '/' || t.ord FROM parts t JOIN tree p ON t.video_id = p.video_id AND t.parent_id = p.timeline_id)""").replace("WITH RECURSIVE , ", "WITH RECURSIVE "),
    "clone_videos": v("SELECT video_id + 1000000000 AS video_id, count(*) AS runs, count(DISTINCT run_id) AS ids FROM a_runs JOIN (SELECT video_id FROM a_videos) USING (video_id) WHERE status = 'DONE' GROUP BY 1", "a_runs", "a_videos"),
    "orphaned_data": "SELECT p_partkey AS data_id FROM part WHERE p_partkey NOT IN (SELECT l_suppkey FROM lineitem)",
    "scalar_threshold": v("SELECT video_id, series, time, round(CASE WHEN y >= 0.7 THEN 0.7 WHEN y < 0.1 THEN 0.1 ELSE y END, 9) AS y FROM a_scalars", "a_scalars"),
    "threshold_events": v("SELECT video_id, series, time FROM a_scalars WHERE y >= 0.9", "a_scalars"),
    "resample_approx": v("""SELECT video_id, series, time, round(y, 9) AS y FROM (SELECT *, row_number() OVER (PARTITION BY video_id, series ORDER BY time, y) - 1 AS i, count(*) OVER (PARTITION BY video_id, series) AS n FROM a_scalars)
        WHERE i % (2 ** greatest(ceil(log2(n) - log2(8.0)), 0))::BIGINT = 0""", "a_scalars"),
    "aggregate_scalars": _grid("prod"),
    "aggregate_scalars_or": _grid("or"),
    "aggregate_per_time": v("SELECT video_id, floor(time / 3600)::DOUBLE AS time, round(1 - product(1 - y), 9) AS y FROM a_scalars GROUP BY 1, 2", "a_scalars"),
    "aggregate_list_per_time": v("SELECT video_id, series, floor(time / 86400)::DOUBLE AS time, round(avg(y), 9) AS y FROM a_scalars GROUP BY 1, 2, 3", "a_scalars"),
    "min_max_norm": v("""SELECT video_id, series, time, round(CASE WHEN hi - lo >= 0.01 THEN (y - lo) / (hi - lo) ELSE y END, 9) AS y FROM
        (SELECT *, min(y) OVER (PARTITION BY video_id, series) AS lo, max(y) OVER (PARTITION BY video_id, series) AS hi FROM a_scalars)""", "a_scalars"),
    "invert_scalar": v("""SELECT video_id, series, time, round(1 - CASE WHEN hi > 1 OR lo < 0 THEN CASE WHEN hi - lo > 0 THEN (y - lo) / (hi - lo) END ELSE y END, 9) AS y FROM
        (SELECT video_id, series, time, y * 2 AS y, min(y * 2) OVER (PARTITION BY video_id, series) AS lo, max(y * 2) OVER (PARTITION BY video_id, series) AS hi FROM a_scalars)""", "a_scalars"),
    "series_bounds": v("SELECT video_id, series, round(greatest(0.0, max(y)), 9) AS upper, round(least(-0.1, min(y)), 9) AS lower FROM a_scalars GROUP BY ALL", "a_scalars"),
    "shot_density": v("""SELECT video_id, round(i * step, 9) AS time, round(CASE WHEN max(d) OVER w > min(d) OVER w THEN (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) ELSE 0.0 END, 9) AS y FROM dens WINDOW w AS (PARTITION BY video_id)""",
        "a_segments", extra=f"""{HOURS}, last AS (SELECT video_id, max(end_s) AS e, ceil(max(end_s) * 0.25)::BIGINT + 1 AS n FROM hours GROUP BY ALL),
        grid AS (SELECT video_id, unnest(range(n)) AS i, CASE WHEN n > 1 THEN e / (n - 1) ELSE 1.0 END AS step FROM last),
        dens AS (SELECT g.video_id, g.i, g.step, sum(exp(-1.0 * ((g.i * g.step - h.start_s) * (g.i * g.step - h.start_s)) / (2 * 24.0 * 24.0))) AS d FROM grid g JOIN hours h USING (video_id) GROUP BY ALL)"""),
    "annotate_shots": v(f"""SELECT video_id, segment_id, series AS label, round(mean, 9) AS mean FROM (SELECT s.video_id, s.segment_id, p.series, avg(p.y) AS mean FROM a_segments s JOIN a_scalars p ON {IN} > s.start_s AND p.time < s.end_s GROUP BY ALL)
        WHERE mean > 0 QUALIFY row_number() OVER (PARTITION BY video_id, segment_id ORDER BY mean DESC, series) = 1""", "a_segments"),
    "annotate_shots_scalar": v(SEGVAL, "a_segments"),
    "segment_agg": v(f"SELECT s.video_id, s.segment_id, round(coalesce(max(p.y), 0.0), 9) AS value FROM a_segments s LEFT JOIN a_scalars p ON p.series = 'view' AND {IN} BETWEEN s.start_s AND s.end_s GROUP BY ALL", "a_segments"),
    "scalar_annotation_style": v(f"""SELECT video_id, segment_id, round(CASE WHEN max(m) OVER w > min(m) OVER w THEN (m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w) ELSE 0.0 END, 9) AS lightness FROM
        (SELECT s.video_id, s.segment_id, avg(p.y) AS m FROM a_segments s JOIN a_scalars p ON {IN} BETWEEN s.start_s AND s.end_s GROUP BY ALL) WINDOW w AS (PARTITION BY video_id)""", "a_segments"),
    "face_sizes": v("SELECT video_id, time, round(max(w * h), 9) AS y FROM a_bboxes GROUP BY ALL", "a_bboxes"),
    "quality_filter": v("SELECT video_id, id, time FROM a_bboxes WHERE det_score >= 0.6 AND h > 0.05", "a_bboxes"),
    "face_size_labels": v(f"""SELECT s.video_id, s.segment_id, CASE WHEN EXISTS (SELECT 1 FROM a_bboxes p WHERE p.det_score >= 0.6 AND p.h > 0.05 AND {IN} >= s.start_s AND p.time < s.end_s) THEN 'size' || (s.segment_id % 5) ELSE 'None' END AS label FROM a_segments s""", "a_segments", "a_bboxes"),
    "collect_labels": v(f"""SELECT s.video_id, s.segment_id, coalesce(string_agg('v' || floor(p.y * 10)::BIGINT, ',' ORDER BY p.time, 'v' || floor(p.y * 10)::BIGINT), '') AS labels FROM a_segments s LEFT JOIN a_scalars p ON p.series = 'view' AND {IN} BETWEEN s.start_s AND s.end_s GROUP BY ALL""", "a_segments"),
    "detect_shots": v("""SELECT video_id, CASE WHEN scene = 0 THEN 1 ELSE scene END::BIGINT AS segment_id, min(i) / 25.0 AS start_s, max(i) / 25.0 AS end_s FROM d
        WHERE (scene > 0 AND (NOT cut OR closes)) OR scenes = 0 GROUP BY video_id, scene""",
        "a_frames", extra="""f AS (SELECT video_id, i, p > 0.5 AS cut, lag(p > 0.5) OVER (PARTITION BY video_id ORDER BY i) AS before FROM a_frames),
        c AS (SELECT *, sum((NOT cut AND coalesce(before, true))::INT) OVER (PARTITION BY video_id ORDER BY i) AS scene, cut AND NOT coalesce(before, true) AS closes FROM f),
        d AS (SELECT *, max(scene) OVER (PARTITION BY video_id) AS scenes FROM c)"""),
    "speaker_turns": v("""SELECT video_id, turn, speaker, round(CASE WHEN start_s - before <= 0.01 THEN before + 0.01 ELSE start_s END, 9) AS start_s, round(end_s, 9) AS end_s, text FROM
        (SELECT *, lag(end_s) OVER (PARTITION BY video_id ORDER BY turn) AS before FROM t)""", "a_transcripts", extra="""
        a AS (SELECT *, coalesce(speaker, 'Unknown') AS who, lag(coalesce(speaker, 'Unknown')) OVER (PARTITION BY video_id ORDER BY start_s, segment_id) AS prev FROM a_transcripts),
        b AS (SELECT *, sum((prev IS NULL OR who <> prev)::INT) OVER (PARTITION BY video_id ORDER BY start_s, segment_id)::BIGINT AS turn FROM a),
        t AS (SELECT video_id, turn, min(who) AS speaker, min(start_s) AS start_s, arg_max(end_s, (start_s, segment_id)) AS end_s, string_agg(text, ' ' ORDER BY start_s, segment_id) AS text FROM b GROUP BY video_id, turn)"""),
    "active_speaker": v("""SELECT video_id, 0 AS track_id, round(avg((s >= 0)::INT), 9) AS ratio, round(avg(s), 9) AS mean_score, avg((s >= 0)::INT) > 0.6 AS is_speaking FROM
        (SELECT video_id, avg(p - 0.4) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM a_frames) GROUP BY video_id""", "a_frames"),
    "median_filter": v("""SELECT video_id, 'x' AS series, i::DOUBLE AS time, round(list_sort(list_concat(l, list_transform(range(13 - len(l)), lambda z: 0.0::DOUBLE)))[7], 9) AS y FROM
        (SELECT video_id, i, list(p) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS l FROM a_frames)""", "a_frames"),
    "frame_windows": v("SELECT video_id, i // 50 AS window, count(*) AS n, min(i) AS first, max(i) AS last FROM a_frames GROUP BY 1, 2", "a_frames"),
    "row_batches": v("SELECT video_id, i // 8 AS batch, count(*) AS size, round(min(i / 5.0), 9) AS time FROM a_frames GROUP BY 1, 2", "a_frames"),
    "segment_durations": v("""SELECT video_id, segment_id, round(end_s - start_s, 9) AS duration, round(lead(start_s, 1, max_e + 10) OVER (PARTITION BY video_id ORDER BY start_s, segment_id) - start_s, 9) AS no_gap FROM
        (SELECT *, max(end_s) OVER (PARTITION BY video_id) AS max_e FROM a_segments)""", "a_segments"),
    "chunk_segments": v("""SELECT video_id, segment_id, chunk, round(start_s + chunk * 10.0, 9) AS chunk_start, round(CASE WHEN len > 10 THEN start_s + chunk * 10.0 + 10 ELSE start_s + greatest(len, 1.0) END, 9) AS chunk_end FROM
        (SELECT *, unnest(range(CASE WHEN len > 10 THEN floor(len / 10)::BIGINT ELSE 1 END)) AS chunk FROM (SELECT video_id, segment_id, start_s, (start_s + (end_s - start_s) / 10000) - start_s AS len FROM a_segments))""", "a_segments"),
    "fill_chunk_bounds": v("""SELECT t.video_id, t.segment_id, round(CASE WHEN segment_id > 0 THEN start_s ELSE 0.0 END, 9) AS start_s, round(CASE WHEN speaker = 'user' THEN end_s ELSE duration END, 9) AS end_s FROM a_transcripts t LEFT JOIN a_videos v ON t.video_id = v.video_id""", "a_transcripts", "a_videos"),
    "frames_to_annotations": v("SELECT video_id, round(time, 9) AS start_s, round(time + 0.25, 9) AS end_s, series AS labels FROM a_scalars", "a_scalars"),
    "cosine_over_time": v("SELECT video_id, time, round(CASE WHEN max(y) OVER w > min(y) OVER w THEN (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) ELSE 0.0 END, 9) AS y FROM sims WINDOW w AS (PARTITION BY video_id)", "a_embeddings",
        extra=f"{UNITS}, sims AS (SELECT a.video_id, a.time, max((list_dot_product(a.u, q.u) + 1) / 2) AS y FROM units a, units q WHERE q.id < 3 GROUP BY ALL)"),
    "identify": v("SELECT video_id, time, round(CASE WHEN max(y) OVER w > min(y) OVER w THEN (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) ELSE 0.0 END, 9) AS y FROM sims WINDOW w AS (PARTITION BY video_id)", "a_embeddings",
        extra=f"{UNITS}, sims AS (SELECT a.video_id, a.time, max((list_dot_product(a.u, q.u) + 1) / 2) AS y FROM units a, units q WHERE q.id < 1 GROUP BY ALL)"),
    "concept_probs": v("SELECT video_id, id, time, series, round(e / sum(e) OVER (PARTITION BY id), 9) AS y FROM sims", "a_embeddings",
        extra=f"{UNITS}, sims AS (SELECT a.video_id, a.id, a.time, 'c' || q.id AS series, exp(10 * list_dot_product(a.u, q.u)) AS e FROM units a, units q WHERE q.id < 4)"),
    "element_mean": v("SELECT label, (i - 1)::INT AS i, round(avg(x), 9) AS v FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM a_embeddings) GROUP BY 1, 2", "a_embeddings"),
    "merge_topk": v("""SELECT video_id, segment_id, label, round(prob, 9) AS prob, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id, segment_id ORDER BY prob DESC, label) AS rank FROM
        (SELECT video_id, segment_id, label, sum(prob) / sum(sum(prob)) OVER (PARTITION BY video_id, segment_id) AS prob FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY video_id, segment_id, chunk ORDER BY prob DESC, label) <= 3) GROUP BY 1, 2, 3)) WHERE rank <= 3""", "a_scalars", extra=CHUNKS),
    "chunk_mean_label": v("SELECT video_id, segment_id, label, round(p, 9) AS prob FROM (SELECT video_id, segment_id, label, avg(prob) AS p FROM chunks GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY video_id, segment_id ORDER BY p DESC, label) = 1", "a_scalars", extra=CHUNKS),
    "sentiment_label": v("""SELECT video_id, segment_id, CASE WHEN c >= p AND c >= w THEN 'click' WHEN p >= w THEN 'purchase' ELSE 'view' END AS label, round(greatest(c, p, w), 9) AS top FROM (SELECT video_id, segment_id,
        coalesce(max(prob) FILTER (label = 'click'), 0) AS c, coalesce(max(prob) FILTER (label = 'purchase'), 0) AS p, coalesce(max(prob) FILTER (label = 'view'), 0) AS w FROM chunks WHERE label IN ('click', 'purchase', 'view') GROUP BY 1, 2)""", "a_scalars", extra=CHUNKS),
    "rollup_probs": v("SELECT video_id, video_id AS id, 'coarse' AS level, parent AS label, round(sum(prob * w), 9) AS prob FROM (SELECT video_id, series, avg(y) AS prob FROM a_scalars GROUP BY 1, 2), (VALUES ('all', 0.25), ('own', 0.75)) m(kind, w), LATERAL (SELECT CASE kind WHEN 'all' THEN 'all' ELSE substr(series, 1, 1) END AS parent) GROUP BY ALL", "a_scalars"),
    "tag_vector": v("""SELECT video_id, 0 AS segment_id, count(*) FILTER (series = 'click') || ',' || count(*) FILTER (series = 'view') || ',' || count(*) FILTER (series = 'purchase') || ',' || count(*) FILTER (series NOT IN ('click', 'view', 'purchase')) AS counts FROM a_scalars GROUP BY video_id""", "a_scalars"),
    "cluster_single_linkage": v("SELECT video_id, id, cluster_rank::INT AS cluster_rank, size, list_contains(list_transform(range(least(size, 3)), lambda i: round_even(CASE WHEN size > 1 THEN i * ((size - 1) / (least(size, 3) - 1)) ELSE 0 END, 0)::BIGINT), position) AS is_sample FROM members", "a_embeddings", extra=_components(0.7)),
    "top_clusters": v("SELECT video_id, id, cluster_rank::INT AS cluster_rank, size FROM members WHERE cluster_rank < 2", "a_embeddings", extra=_components(0.7)),
    "preview_items": v("SELECT video_id, cluster, ref_id FROM (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY video_id, cluster) AS n FROM a_clusters WINDOW w AS (PARTITION BY video_id, cluster ORDER BY time, ref_id)) WHERE i % ceil(n / 4)::BIGINT = 0", "a_clusters"),
    "latest_clustering": v("""SELECT video_id, cluster, size, row_number() OVER (PARTITION BY video_id ORDER BY size DESC, cluster) AS place FROM (SELECT l_orderkey AS video_id, l_partkey % 3 AS cluster, count(*) AS size FROM lineitem
        WHERE (l_orderkey, l_linenumber) IN (SELECT video_id, max(run_id) FROM a_runs WHERE status = 'DONE' GROUP BY 1) GROUP BY 1, 2)""", "a_runs"),
    "face_size_filter": v("SELECT video_id, id FROM a_bboxes WHERE h >= 0.2", "a_bboxes"),
    "normalise_boxes": v("SELECT video_id, id, time, round(greatest(x * 100 - 5, 0) / 100, 9) AS x, round(greatest(y * 100 - 5, 0) / 100, 9) AS y, round(((x + w) * 100 - greatest(x * 100 - 5, 0)) / 100, 9) AS w, round(((y + h) * 100 - greatest(y * 100 - 5, 0)) / 100, 9) AS h FROM a_bboxes", "a_bboxes"),
    "node_counts": v(f"SELECT video_id, series, count(*) AS n FROM (SELECT DISTINCT p.video_id, p.series, s.segment_id FROM a_segments s JOIN a_scalars p ON {IN} BETWEEN s.start_s AND s.end_s) GROUP BY 1, 2", "a_segments"),
    "constellation_edges": v("SELECT x.video_id, x.series AS a, y.series AS b, count(*) AS n FROM pl x JOIN pl y ON x.video_id = y.video_id AND x.segment_id = y.segment_id AND x.series < y.series GROUP BY 1, 2, 3", "a_segments",
        extra=f"pl AS (SELECT DISTINCT p.video_id, p.series, s.segment_id FROM a_segments s JOIN a_scalars p ON {IN} BETWEEN s.start_s AND s.end_s)"),
    "constellation_edges_by_time": v("SELECT x.video_id, x.series AS a, y.series AS b, count(*) AS n FROM pl x JOIN (SELECT DISTINCT * FROM pl) y ON x.video_id = y.video_id AND x.t = y.t AND x.series < y.series GROUP BY 1, 2, 3", "a_scalars",
        extra="pl AS (SELECT video_id, series, floor(time / 86400) AS t FROM a_scalars)"),
    "person_graph": v("SELECT x.video_id, x.cluster::VARCHAR AS a, y.cluster::VARCHAR AS b, count(*) AS n FROM pl x JOIN pl y ON x.video_id = y.video_id AND x.segment_id = y.segment_id AND x.cluster < y.cluster GROUP BY 1, 2, 3", "a_segments", "a_clusters",
        extra=f"pl AS (SELECT DISTINCT p.video_id, p.cluster, s.segment_id FROM a_segments s JOIN a_clusters p ON {IN} BETWEEN s.start_s AND s.end_s)"),
    "cluster_items_by_shot": v("""SELECT video_id, segment_id, cluster, count(*) AS n, array_to_string(list(ref_id ORDER BY t, ref_id)[1:5], ',') AS items FROM (SELECT c.video_id, s.segment_id, c.cluster, c.ref_id, floor(c.time + 0.5) AS t FROM a_segments s JOIN a_clusters c
        ON c.video_id = s.video_id AND floor(c.time + 0.5) >= floor(s.start_s + 0.5) AND floor(c.time + 0.5) < floor(s.end_s + 0.5)) GROUP BY 1, 2, 3""", "a_segments", "a_clusters"),
    "segments_by_second": v("SELECT video_id, second, count(*) AS n FROM (SELECT video_id, unnest(range(floor(start_s)::BIGINT, ceil(end_s)::BIGINT)) AS second FROM hours) GROUP BY 1, 2", "a_segments", extra=HOURS),
    "annotations_by_second": v("SELECT video_id, second, count(*) AS n FROM (SELECT video_id, unnest(range(ceil(start_s)::BIGINT, ceil(end_s)::BIGINT)) AS second FROM hours) GROUP BY 1, 2", "a_segments", extra=HOURS),
    "usage_stats": v("""SELECT count(*) AS users_all, count(*) FILTER (n >= 5) AS users_5, count(*) FILTER (n >= 10) AS users_10, count(*) FILTER (n >= 50) AS users_50, any_value(videos_all) AS videos_all, any_value(videos_10min) AS videos_10min, any_value(videos_60min) AS videos_60min,
        any_value(minutes) AS minutes, any_value(runs) AS runs, any_value(videos_5runs) AS videos_5runs, any_value(videos_10runs) AS videos_10runs, any_value(videos_20runs) AS videos_20runs FROM (SELECT user_id, count(video_id) AS n FROM uu LEFT JOIN a_videos ON owner_id = user_id GROUP BY 1),
        (SELECT count(*) AS videos_all, count(*) FILTER (duration >= 600) AS videos_10min, count(*) FILTER (duration >= 3600) AS videos_60min, round(sum(duration) / 60, 3) AS minutes FROM vv),
        (SELECT sum(n)::BIGINT AS runs, count(*) FILTER (n >= 5) AS videos_5runs, count(*) FILTER (n >= 10) AS videos_10runs, count(*) FILTER (n >= 20) AS videos_20runs FROM (SELECT video_id, count(*) AS n FROM a_runs WHERE video_id IN (SELECT video_id FROM vv) GROUP BY 1))""",
        "a_videos", "a_runs", extra="uu AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (1, 2, 3)), vv AS (SELECT * FROM a_videos WHERE owner_id IN (SELECT user_id FROM uu))"),
    "video_progress": v("SELECT v.video_id, round(p, 9) AS progress FROM a_videos v LEFT JOIN (SELECT video_id, 100.0::DOUBLE * count(*) FILTER (status NOT IN ('RUNNING', 'QUEUED')) / count(*) AS p FROM a_runs GROUP BY 1) r ON v.video_id = r.video_id", "a_videos", "a_runs"),
    "timeline_counts": "SELECT l_orderkey AS video_id, count(*) AS n FROM lineitem GROUP BY 1",
    "exclude_names": "SELECT n_name AS name FROM nation WHERE n_regionkey <> 1",
    "unordered_pairs": v("SELECT DISTINCT x.video_id, x.series AS a, y.series AS b FROM a_scalars x JOIN a_scalars y ON x.video_id = y.video_id AND x.series < y.series", "a_scalars"),
    "word_cloud": r"""WITH w AS (SELECT lower(regexp_replace(w, '[,.]$', '')) AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)),
        t AS (SELECT word, count(*) AS n FROM w WHERE word NOT IN ('', '..', '.', '?', '!') AND word NOT IN (SELECT lower(n_name) FROM nation) AND word NOT IN ('the', 'die', 'and', 'und', 'la') GROUP BY 1 ORDER BY n DESC, word LIMIT 40)
        SELECT word, n, round(n::DOUBLE / (SELECT max(n) FROM t) * 100, 9) AS size FROM t""",
    "transcript_segments": f"WITH {NOTES} SELECT s.video_id, s.segment_id, s.start_s, s.end_s, d.name AS text, row_number() OVER (PARTITION BY s.video_id ORDER BY s.start_s, s.segment_id) AS number FROM segs s JOIN links USING (segment_id) JOIN dim d USING (annotation_id) JOIN cats c USING (category_id) WHERE category_name = 'Transcript'",
    "non_transcripts": f"WITH {NOTES} SELECT name, count(*) AS n FROM links JOIN dim USING (annotation_id) LEFT JOIN cats USING (category_id) WHERE category_name IS NULL OR category_name <> 'Transcript' GROUP BY 1",
    "search_transcripts": v("SELECT video_id, segment_id FROM a_transcripts WHERE contains(lower(text), 'tion')", "a_transcripts"),
    "annotation_cells": f"WITH {NOTES} SELECT s.video_id, s.segment_id, coalesce(string_agg(coalesce(category_name || '::', '') || name, '+' ORDER BY coalesce(category_name || '::', '') || name), 'None') AS cell FROM segs s LEFT JOIN links USING (segment_id) LEFT JOIN dim USING (annotation_id) LEFT JOIN cats USING (category_id) GROUP BY 1, 2",
    "annotation_cells_by_target": f"""WITH {NOTES}, own AS (SELECT s.video_id, s.segment_id, s.start_s, s.end_s, coalesce(string_agg(coalesce(category_name || '::', '') || name, '+' ORDER BY coalesce(category_name || '::', '') || name), 'None') AS cell FROM segs s LEFT JOIN links USING (segment_id) LEFT JOIN dim USING (annotation_id) LEFT JOIN cats USING (category_id) GROUP BY 1, 2, 3, 4),
        t AS (SELECT video_id, segment_id, start_s + 4 AS a, end_s + 9 AS b FROM segs WHERE segment_id % 2 = 1)
        SELECT t.video_id, t.segment_id, coalesce(string_agg(cell, '+' ORDER BY o.start_s, o.segment_id), 'None') AS cell FROM t LEFT JOIN own o ON o.video_id = t.video_id AND ((o.start_s BETWEEN a AND b) OR (o.end_s BETWEEN a AND b) OR (o.start_s <= a AND o.end_s >= b)) GROUP BY 1, 2""",
    "overlap_join_closed": f"WITH {NOTES} SELECT x.video_id, x.segment_id AS a_id, y.segment_id AS b_id FROM segs x JOIN segs y ON x.video_id = y.video_id AND x.start_s <= y.end_s + 10 AND y.end_s <= x.end_s",
    "split_segments": f"""WITH {NOTES}, cut AS (SELECT *, segment_id % 3 = 0 AND end_s > start_s + 4 AS c FROM segs)
        SELECT video_id, start_s, CASE WHEN c THEN start_s + 4 ELSE end_s END AS end_s FROM cut UNION ALL SELECT video_id, start_s + 4, end_s FROM cut WHERE c""",
    "merge_segments": f"""WITH {NOTES}, e AS (SELECT timeline_id, min(start_s) AS a, max(end_s) AS b FROM segs WHERE segment_id % 10 <= 2 AND video_id % 2 = 0 GROUP BY 1 HAVING count(DISTINCT segment_id) > 1)
        SELECT s.video_id, s.start_s, s.end_s FROM segs s LEFT JOIN e USING (timeline_id) WHERE NOT coalesce(s.start_s >= a AND s.end_s <= b, false) UNION ALL SELECT timeline_id, a, b FROM e""",
    "annotate_range": f"""WITH {NOTES} SELECT video_id, start_s, CASE WHEN start_s < 12 AND end_s > 12 THEN 12.0 ELSE end_s END AS end_s FROM segs WHERE start_s < 12 OR end_s <= 12
        UNION ALL SELECT video_id, greatest(start_s, 25.0), end_s FROM segs WHERE end_s > 25 OR (start_s >= 25) UNION ALL SELECT DISTINCT video_id, 12.0, 25.0 FROM segs""",
    "split_segments_often": f"""WITH {NOTES}, cuts AS (SELECT segment_id, start_s AS t FROM segs UNION SELECT segment_id, start_s + k FROM segs, (VALUES (4), (7), (9)) v(k) WHERE segment_id % 3 = 0 AND start_s + k < end_s)
        SELECT video_id, t AS start_s, coalesce(lead(t) OVER (PARTITION BY segment_id ORDER BY t), end_s) AS end_s, annotation_id FROM segs JOIN cuts USING (segment_id) JOIN links USING (segment_id)""",
    "merge_segments_in_order": f"""WITH {NOTES}, e AS (SELECT timeline_id, min(start_s) AS a, max(end_s) AS b FROM segs WHERE segment_id % 10 IN (1, 3, 5) GROUP BY 1 HAVING count(*) > 1 AND bool_or(segment_id % 10 = 3))
        SELECT DISTINCT ON (segment_id, annotation_id) video_id, start_s, end_s, annotation_id FROM (SELECT s.video_id, s.segment_id, s.start_s, s.end_s FROM segs s LEFT JOIN e USING (timeline_id) WHERE NOT coalesce(s.start_s >= a AND s.end_s <= b, false)) JOIN links USING (segment_id)
        UNION ALL SELECT DISTINCT timeline_id, a, b, annotation_id FROM segs s JOIN e USING (timeline_id) JOIN links USING (segment_id) WHERE s.start_s >= a AND s.end_s <= b""",
    "annotate_ranges": f"""WITH {NOTES}, e AS (SELECT timeline_id, segment_id AS edit_id, start_s + 1 AS a, start_s + 1 + segment_id % 37 AS b FROM segs WHERE segment_id % 4 < 2 AND segment_id % 37 > 0),
        pts AS (SELECT DISTINCT timeline_id, unnest([a, b]) AS p FROM e),
        cells AS (SELECT timeline_id, p AS lo, lead(p) OVER w AS hi, row_number() OVER w AS k FROM pts WINDOW w AS (PARTITION BY timeline_id ORDER BY p)),
        tops AS (SELECT c.timeline_id, lo, hi, k, max(edit_id) AS top FROM cells c JOIN e ON e.timeline_id = c.timeline_id AND a <= lo AND b >= hi GROUP BY ALL),
        news AS (SELECT timeline_id, top, min(lo) AS a, max(hi) AS b FROM (SELECT *, k - row_number() OVER (PARTITION BY timeline_id, top ORDER BY k) AS g FROM tops) GROUP BY timeline_id, top, g),
        cov AS (SELECT timeline_id, min(lo) AS a, max(hi) AS b FROM (SELECT *, k - row_number() OVER (PARTITION BY timeline_id ORDER BY k) AS g FROM tops) GROUP BY timeline_id, g),
        gaps AS (SELECT timeline_id, b AS g0, coalesce(lead(a) OVER w, 1e9) AS g1 FROM cov WINDOW w AS (PARTITION BY timeline_id ORDER BY a) UNION ALL SELECT timeline_id, -1e9, min(a) FROM cov GROUP BY 1),
        olds AS (SELECT video_id, segment_id, greatest(start_s, g0) AS start_s, least(end_s, g1) AS end_s FROM segs JOIN gaps USING (timeline_id) WHERE start_s < end_s AND greatest(start_s, g0) < least(end_s, g1)
            UNION ALL SELECT video_id, segment_id, start_s, end_s FROM segs s WHERE start_s < end_s AND NOT EXISTS (SELECT 1 FROM e WHERE e.timeline_id = s.timeline_id)
            UNION ALL SELECT video_id, segment_id, start_s, end_s FROM segs s WHERE start_s = end_s AND NOT EXISTS (SELECT 1 FROM e WHERE e.timeline_id = s.timeline_id AND a < start_s AND b > start_s))
        SELECT video_id, start_s, end_s, annotation_id FROM olds JOIN links USING (segment_id)
        UNION ALL SELECT timeline_id, a, b, unnest([100, 200 + top % 10]) FROM news""",
    "merge_clusters_in_order": v("SELECT video_id, CASE WHEN cluster IN (2, 3) THEN 1 ELSE cluster END AS cluster, count(*) AS n FROM a_clusters GROUP BY 1, 2", "a_clusters"),
    "replace_annotations": f"WITH {NOTES} SELECT annotation_id, count(*) AS n FROM (SELECT segment_id, annotation_id FROM links WHERE segment_id % 5 <> 0 UNION ALL SELECT DISTINCT segment_id, 4 FROM links WHERE segment_id % 5 = 0) GROUP BY 1",
    "toggle_annotations": f"WITH {NOTES}, e AS (SELECT segment_id, CASE WHEN segment_id % 8 = 0 THEN 7 ELSE annotation_id END AS annotation_id FROM links WHERE segment_id % 4 = 0) (SELECT * FROM links EXCEPT SELECT * FROM e) UNION ALL (SELECT * FROM e EXCEPT SELECT * FROM links)",
    "merge_clusters": v("SELECT video_id, CASE cluster WHEN 3 THEN 1 ELSE cluster END AS cluster, count(*) AS n FROM a_clusters GROUP BY 1, 2", "a_clusters"),
    "delete_items": v("SELECT video_id, count(*) AS n FROM a_clusters WHERE ref_id % 3 <> 0 GROUP BY 1", "a_clusters"),
    "new_timeline": v("SELECT video_id, 0.0::DOUBLE AS start_s, round(duration, 9) AS end_s FROM a_videos", "a_videos"),
    "annotations_to_timeline": v("SELECT video_id, 'tier' || (segment_id % 2) AS name, count(*) AS n FROM (SELECT DISTINCT video_id, segment_id % 2 AS segment_id, start_s, end_s FROM a_segments) GROUP BY 1, 2", "a_segments"),
    "reorder_timelines": f"WITH {PARTS} SELECT video_id, timeline_id, (row_number() OVER (PARTITION BY video_id ORDER BY timeline_id = (max(timeline_id) OVER (PARTITION BY video_id)) DESC, ord, timeline_id) - 1)::INT AS ord FROM parts".replace("(max(timeline_id) OVER (PARTITION BY video_id))", "m").replace("FROM parts", "FROM (SELECT *, max(timeline_id) OVER (PARTITION BY video_id) AS m FROM parts)"),
    "next_timeline": f"WITH {PARTS} SELECT video_id, timeline_id, lag(timeline_id) OVER w AS previous_id, lead(timeline_id) OVER w AS next_id FROM parts WINDOW w AS (PARTITION BY video_id ORDER BY ord, timeline_id)",
    "segments_at": v("SELECT video_id, segment_id FROM a_segments WHERE start_s <= 604800 AND end_s >= 604800", "a_segments"),
    "affected_segments": v("SELECT video_id * 10000 + segment_id AS segment_id FROM a_segments WHERE start_s < 1e6 UNION SELECT video_id * 10000 + segment_id FROM a_segments WHERE start_s > 5e5", "a_segments"),
    "audio_rms": v("SELECT video_id, round(f * 4 / 16.0, 9) AS time, round(sqrt(sum((p - 0.5) ** 2) / 16), 9) AS y FROM fr JOIN a_frames a USING (video_id) WHERE a.i >= f * 4 - 8 AND a.i < f * 4 + 8 GROUP BY video_id, f", "a_frames",
        extra="fr AS (SELECT video_id, unnest(range(count(*) // 4 + 1)) AS f FROM a_frames GROUP BY video_id)"),
    "audio_amplitude": v("SELECT video_id, round(k * n / 64.0 / 16, 9) AS time, round(CASE WHEN max(y) OVER w > min(y) OVER w THEN (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) ELSE 0.0 END, 9) AS y FROM q WINDOW w AS (PARTITION BY video_id)", "a_frames",
        extra="""g AS (SELECT video_id, count(*) AS n, unnest(range(64)) AS k FROM a_frames GROUP BY video_id),
        q AS (SELECT g.video_id, k, n, a.p + (coalesce(b.p, a.p) - a.p) * (k * n / 64.0::DOUBLE - floor(k * n / 64.0::DOUBLE)) AS y FROM g JOIN a_frames a ON a.video_id = g.video_id AND a.i = floor(k * n / 64.0::DOUBLE) LEFT JOIN a_frames b ON b.video_id = g.video_id AND b.i = a.i + 1)"""),
    "frame_brightness": f"""WITH {PIXELS}, y AS (SELECT video_id, frame_idx, avg(greatest(r, g, b) / 255.0::DOUBLE) AS y FROM px GROUP BY 1, 2)
        SELECT video_id, frame_idx / 2.0::DOUBLE AS time, round(CASE WHEN max(y) OVER w > min(y) OVER w THEN (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) ELSE 0.0 END, 9) AS y FROM y WINDOW w AS (PARTITION BY video_id)""",
    "dominant_colors": f"WITH {PIXELS} SELECT video_id, frame_idx, 0 AS rank, round(avg(r) / 255, 9) AS r, round(avg(g) / 255, 9) AS g, round(avg(b) / 255, 9) AS b FROM px GROUP BY 1, 2",
    "colors": f"WITH {PIXELS} SELECT DISTINCT r::INT AS r, g::INT AS g, b::INT AS b, printf('#%02x%02x%02x', r, g, b) AS hex, printf('#%02x%02x%02x', round_even(r / 255.0::DOUBLE * 159 + (1 - r / 255.0::DOUBLE) * 255, 0)::BIGINT, round_even(r / 255.0::DOUBLE * 39 + (1 - r / 255.0::DOUBLE) * 255, 0)::BIGINT, round_even(r / 255.0::DOUBLE * 31 + (1 - r / 255.0::DOUBLE) * 255, 0)::BIGINT) AS prob_hex, ['Black', 'White', 'Red', 'Lime', 'Blue', 'Yellow', 'Cyan', 'Magenta', 'Silver', 'Gray', 'Maroon', 'Olive', 'Green', 'Purple', 'Teal', 'Navy'][list_position(far, list_min(far))] AS name FROM (SELECT *, list_transform([0, 765, 255, 255, 255, 510, 510, 510, 576, 384, 128, 256, 128, 256, 256, 128], lambda x: abs(x - (r + g + b))) AS far FROM px)",
    "luminance": f"WITH {PIXELS} SELECT DISTINCT printf('#%02x%02x%02x', r, g, b) AS hex, round(sqrt(0.299 * (r / 255.0::DOUBLE) ** 2 + 0.587 * (g / 255.0::DOUBLE) ** 2 + 0.114 * (b / 255.0::DOUBLE) ** 2), 9) AS luminance, true AS bright FROM px",
    "linear_map": v("SELECT y, printf('#%02x%02x%02x', floor(255 - 81 * s + 0.5)::BIGINT, floor(255 - 236 * s + 0.5)::BIGINT, floor(255 - 236 * s + 0.5)::BIGINT) AS hex FROM (SELECT DISTINCT y, greatest(0.0, least(1.0, (y - 0.2::DOUBLE) / (0.8::DOUBLE - 0.2::DOUBLE))) AS s FROM a_scalars)", "a_scalars"),
    "truncate_label": "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 96) || ' ...' ELSE text END AS label FROM documents",
    "box_iou": v("""SELECT video_id, id, round(CASE WHEN u - o > 0 THEN o / (u - o) ELSE 0.0 END, 9) AS iou FROM (SELECT video_id, id, w * h + pw * ph AS u, greatest(0, least(x + w, px + pw) - greatest(x, px)) * greatest(0, least(y + h, py + ph) - greatest(y, py)) AS o FROM
        (SELECT *, lag(x) OVER q AS px, lag(y) OVER q AS py, lag(w) OVER q AS pw, lag(h) OVER q AS ph FROM a_bboxes WINDOW q AS (PARTITION BY video_id ORDER BY time, id)) WHERE px IS NOT NULL)""", "a_bboxes"),
    "export_elan_rows": _elan("avg"),
    "export_elan_rows_max": _elan("max"),
    "export_elan_rows_min": _elan("min"),
    "export_scalar": v("SELECT video_id, time, round(y, 9) AS data FROM a_scalars WHERE series = 'view'", "a_scalars"),
    "export_many": v("SELECT video_id, owner_id, round(duration, 9) AS duration FROM a_videos WHERE owner_id IN (1, 2, 3) OR video_id IN (7, 32)", "a_videos"),
    "export_individual": v("SELECT DISTINCT video_id, 'tier' AS timeline, start_s, '[\"l' || segment_id || '\"]' AS value FROM a_segments UNION ALL SELECT video_id, series, time, round_even(floor(y * 64) / 64, 5)::VARCHAR FROM a_scalars", "a_scalars", "a_segments"),
    "dedupe_by_content": "SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha1(coalesce(text, '')) AS sha1 FROM documents",
    "sample_frames": v("""SELECT video_id, segment_id, part, time FROM (
        SELECT *, row_number() OVER (PARTITION BY video_id, segment_id, part ORDER BY dist, time) AS n FROM (
          SELECT video_id, segment_id, time, unnest([{'part': 'start', 'ok': time >= start_s, 'dist': abs(time - start_s)}, {'part': 'middle', 'ok': true, 'dist': abs(time - (start_s + end_s) / 2)}, {'part': 'end', 'ok': time <= end_s, 'dist': abs(time - end_s)}], recursive := true)
          FROM span JOIN f USING (video_id) WHERE i > coalesce(prev, 0) AND i <= last) WHERE ok) WHERE n = 1""", "a_segments", extra="""
        f AS (SELECT video_id, time, row_number() OVER (PARTITION BY video_id ORDER BY time) AS i FROM (SELECT DISTINCT video_id, time FROM a_scalars)),
        k AS (SELECT s.*, row_number() OVER (PARTITION BY video_id ORDER BY start_s, segment_id) AS k FROM a_segments s),
        c AS (SELECT k.*, (SELECT min(i) FROM f WHERE f.video_id = k.video_id AND f.time >= k.end_s) AS first_i FROM k),
        e AS (SELECT *, max(first_i - k) OVER (PARTITION BY video_id ORDER BY k) + k AS last FROM c),
        span AS (SELECT *, lag(last) OVER (PARTITION BY video_id ORDER BY k) AS prev FROM e)"""),
    "multi_scale_mean": v("""SELECT g.video_id, g.i, round_even(avg(coalesce(score, -5.0)), 1) AS score FROM (SELECT DISTINCT m.video_id, m.i, s.series FROM m JOIN (SELECT DISTINCT video_id, series FROM m) s USING (video_id)) g
        LEFT JOIN m ON m.video_id = g.video_id AND m.i = g.i AND m.series = g.series GROUP BY 1, 2""", "a_scalars", extra="m AS (SELECT video_id, series, row_number() OVER (PARTITION BY video_id, series ORDER BY time, y) - 1 AS i, floor(y * 8)::DOUBLE AS score FROM a_scalars)"),
    "shot_reverse_shot": _walk(f"SELECT s.video_id, s.segment_id, min(p.cluster % 2) AS x FROM a_segments s JOIN a_clusters p ON {IN} > s.start_s AND p.time < s.end_s GROUP BY 1, 2", "a.x <> b.x", "k.x = j.x", 2, 3, "a_clusters"),
    "opposition": _walk(SIDES, "a.x.c <> b.x.c AND a.x.s <> b.x.s", "k.x = j.x", 2, 2, "a_bboxes", "a_clusters"),
    "frameshare": _walk(SIDES, "a.x.s = b.x.s", "k.x = j.x", 2, 2, "a_bboxes", "a_clusters"),
    "intensification": _walk("SELECT video_id, segment_id, segment_id * 4 % 5 AS x FROM a_segments", "b.x < a.x", "k.x <= j.x", 1, 3),
    "shot_sides": v(f"""SELECT video_id, segment_id, cluster, CASE WHEN sum(l) > sum(r) THEN 'left' ELSE 'right' END AS side FROM (SELECT s.video_id, s.segment_id, p.cluster,
        lx * oy / (p.w * p.h + 0.5 - lx * oy) AS l, rx * oy / (p.w * p.h + 0.5 - rx * oy) AS r FROM a_segments s JOIN (SELECT b.*, c.cluster, greatest(0, least(x + w, 0.5) - greatest(x, 0)) AS lx, greatest(0, least(x + w, 1) - greatest(x, 0.5)) AS rx, greatest(0, least(y + h, 1) - greatest(y, 0)) AS oy
        FROM a_bboxes b JOIN a_clusters c ON b.video_id = c.video_id AND b.id = c.ref_id) p ON {IN} > s.start_s AND p.time < s.end_s) GROUP BY 1, 2, 3""", "a_segments", "a_bboxes", "a_clusters"),
    "prompt_probs": v("SELECT u.video_id, u.id, u.time, round(sum(u.u[i] * m.x) / sqrt((SELECT sum(x * x) FROM m)), 9) AS y FROM units u, m GROUP BY 1, 2, 3", "a_embeddings",
        extra=f"{UNITS}, m AS (SELECT i, avg(x) AS x FROM (SELECT unnest(range(1, 65)) AS i, unnest(u) AS x FROM units WHERE id < 3) GROUP BY 1)"),
    "time_formats": v("""SELECT DISTINCT video_id, time, printf('%02d:%02d:%02d.', w // 3600, w // 60 % 60, w % 60) || round_even((t - w) * 1000, 0)::BIGINT AS iso,
        CASE WHEN w >= 3600 THEN w // 3600 || ' h ' ELSE '' END || CASE WHEN w // 60 % 60 > 0 THEN w // 60 % 60 || ' min ' ELSE '' END || CASE WHEN w % 60 > 0 THEN w % 60 || ' sec' ELSE '' END AS shown,
        printf('%02d:%02d:%02d.%03d', w // 3600, w // 60 % 60, w % 60, floor((t - w) * 1000 + 0.5)::BIGINT) AS code
        FROM (SELECT video_id, time, time / 7 AS t, floor(time / 7)::BIGINT AS w FROM a_scalars)""", "a_scalars"),
    "snake_case": r"SELECT camel, lower(regexp_replace(regexp_replace(camel, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake FROM (SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS camel FROM nation)",
    "cluster_to_scalar": v("SELECT video_id, time, round(CASE WHEN max(y) OVER w > min(y) OVER w THEN (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) ELSE 0.0 END, 9) AS y FROM sims WINDOW w AS (PARTITION BY video_id)", "a_embeddings",
        extra=f"""{UNITS}, m AS (SELECT i, avg(x) AS x FROM (SELECT unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM units WHERE id % 5 = 1 AND id % 2 = 0) GROUP BY 1),
        cos AS (SELECT u.video_id, u.id, u.time, (sum(u.u[i] * m.x) / sqrt((SELECT sum(x * x) FROM m)) + 1) / 2 AS y FROM units u, m GROUP BY 1, 2, 3), sims AS (SELECT video_id, time, max(y) AS y FROM cos GROUP BY 1, 2)"""),
    "first_chunk_label": v("SELECT video_id, segment_id, label, round(prob, 9) AS prob FROM (SELECT *, min(chunk) OVER (PARTITION BY video_id, segment_id) AS c FROM chunks) WHERE chunk = c QUALIFY row_number() OVER (PARTITION BY video_id, segment_id ORDER BY prob DESC, label) = 1", "a_scalars", extra=CHUNKS),
    "prob_timelines": v("""SELECT video_id, segment_id, timeline, printf('%.1f%%', round_even(p * 100, 1)) AS value FROM (SELECT video_id, segment_id, unnest(['click', 'purchase', 'view']) AS timeline, unnest([c, p, w]) AS p FROM (SELECT video_id, segment_id,
        coalesce(max(floor(prob * 16) / 16) FILTER (label = 'click'), 0) AS c, coalesce(max(floor(prob * 16) / 16) FILTER (label = 'purchase'), 0) AS p, coalesce(max(floor(prob * 16) / 16) FILTER (label = 'view'), 0) AS w FROM chunks WHERE label IN ('click', 'purchase', 'view') GROUP BY 1, 2))""", "a_scalars", extra=CHUNKS),
    "cluster_places": v("SELECT m.video_id, m.cluster_rank::INT AS cluster_rank, count(*) AS n, min(m.id) AS first, max('place' || u.label) AS place FROM members m JOIN units u ON u.id = m.id GROUP BY 1, 2", "a_embeddings", extra=_components(0.7)),
    "face_clustering": v("SELECT m.video_id, 'Cluster ' || (m.cluster_rank + 1) AS name, m.id, u.time FROM members m JOIN units u ON u.id = m.id WHERE m.cluster_rank < 3", "a_embeddings", extra=_components(0.7).replace("FROM a_embeddings)", "FROM a_embeddings WHERE (id % 20) / 40.0 >= 0.1)")),
    "place_clustering": v("SELECT m.video_id, 'Cluster ' || (m.cluster_rank + 1) AS name, m.id, u.time FROM members m JOIN units u ON u.id = m.id WHERE m.cluster_rank < 3", "a_embeddings", extra=_components(0.7)),
    "link_entities": f"WITH {MENTIONS} SELECT * FROM linked",
    "resolve_entity_types": f"""WITH {MENTIONS} SELECT type, CASE WHEN q IS NOT NULL AND q % 10 = 2 THEN 'EVENT' WHEN q IS NOT NULL AND q % 10 = 1 THEN 'ORG' WHEN q % 3 = 0 THEN 'LOC' WHEN q % 8 = 0 THEN 'EPER' WHEN q % 4 = 0 THEN 'LPER'
        WHEN type = 'PER' THEN CASE WHEN wd_label = 'two words' THEN 'EPER' ELSE 'LPER' END ELSE type END AS resolved, count(*) AS n FROM (SELECT *, CASE WHEN wd_id LIKE 'Q%' THEN substr(wd_id, 2)::INT END AS q FROM linked) GROUP BY 1, 2""",
    "move_items": v("SELECT video_id, CASE WHEN ref_id % 3 = 0 THEN 0 ELSE cluster END AS cluster, count(*) AS n FROM a_clusters GROUP BY 1, 2", "a_clusters"),
    "to_documents": """SELECT r AS result_id, min(event_id) AS first_time, (length('{"result_id":' || r || ',"type":"scalar","data_id":"' || r || '"}') + CASE WHEN count(event_id) > 0 THEN length(',"data":[]') + sum(length('{"time":' || event_id || ',"y":' || floor(value)::BIGINT || '}')) + count(*) - 1 ELSE 0 END)::BIGINT AS chars
        FROM (SELECT c_custkey AS r FROM customer) LEFT JOIN events ON user_id = r GROUP BY 1""",
    "export_merged": v("""SELECT video_id, segment_id, row_number() OVER w AS "#", printf('%02d:%02d:%02d.', floor(start_s)::BIGINT // 3600, floor(start_s)::BIGINT // 60 % 60, floor(start_s)::BIGINT % 60) || round_even((start_s - floor(start_s)) * 1000, 0)::BIGINT AS start_s_iso,
        round(end_s - start_s, 9) AS duration, round(coalesce(lead(start_s) OVER w, max(end_s) OVER (PARTITION BY video_id) + 10) - start_s, 9) AS gap_duration, 'n' || (segment_id % 3) AS notes FROM a_segments WINDOW w AS (PARTITION BY video_id ORDER BY start_s, segment_id)""", "a_segments"),
    "export_bundle": v("SELECT DISTINCT 'd' || (video_id % 100) AS data_id FROM a_runs WHERE run_id % 2 = 0", "a_runs"),
    "softmax": v("SELECT id, round(a / (a + b + c), 9) AS p0, round(b / (a + b + c), 9) AS p1, round(c / (a + b + c), 9) AS p2 FROM (SELECT id, exp(10 * (embedding[1]::DOUBLE - m)) AS a, exp(10 * (embedding[2]::DOUBLE - m)) AS b, exp(10 * (embedding[3]::DOUBLE - m)) AS c FROM (SELECT *, greatest(embedding[1], embedding[2], embedding[3])::DOUBLE AS m FROM a_embeddings))", "a_embeddings"),
    "label_map": v("SELECT CASE series WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' ELSE series END AS label, count(*) AS n FROM a_scalars GROUP BY 1", "a_scalars"),
    "clean_ocr_text": "SELECT r_regionkey, 'a  b' || r_name AS text FROM region",
}
