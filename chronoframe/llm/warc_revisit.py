"""WARC: revisit records that say "not modified", resolved to the latest earlier full response of the same canonical URL.

The as-of join is a running "last response" in two steps, so that a URL with a large part of all records isn't one task's
work: within a URL and a stretch of time, then over the few stretches of a URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronoframe.llm.common import table

#: Headers that a "not modified" answer may replace in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, the scheme's default port and fragment are dropped, the host is lower-cased, query parts are sorted, a closing slash goes."""
    u = F.regexp_replace(F.trim(url), r"#.*\z", "")
    u = F.regexp_replace(u, r"(?i)\A(?:http://([^/?]*):80|https://([^/?]*):443|https?://([^/?]*))(?=[/?]|\z)", "$1$2$3")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"\A[^/?]*", 0)), r"\Awww\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"\A[^/?]*([^?]*)", 1), r"/+\z", "")
    query = F.regexp_extract(u, r"\?(.*)\z", 1)
    return F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))))


def opaque(etag: Column) -> Column:
    """An entity tag without its mark for weakness: a "not modified" answer compares tags weakly."""
    return F.regexp_replace(F.trim(etag), r"\AW/", "")


def instant(date: Column) -> Column:
    """A date of HTTP in any of its three spellings as ``year-month-day time``; what is none of them as it is."""
    d = F.trim(date)
    long, short = r"(?i)\A[a-z]+,\s*(\d{1,2})[ -]([a-z]{3})[ -](\d{4}|\d{2})\s+(\d{2}:\d{2}:\d{2})\s+(?:gmt|utc)\z", r"(?i)\A[a-z]{3}\s+([a-z]{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\d{4})\z"

    def spelled(pattern: str, day: int, month: int, year: int, time: int) -> Column:
        part = lambda k: F.regexp_extract(d, pattern, k)
        place = F.position(F.lower(part(month)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
        full = F.when(F.length(part(year)) == 4, part(year)).otherwise(F.concat(F.when(part(year) < "70", "20").otherwise("19"), part(year)))
        return F.concat(full, F.lit("-"), F.lpad(((place + 2) / 3).cast("int").cast("string"), 2, "0"), F.lit("-"), F.lpad(part(day), 2, "0"), F.lit(" "), part(time))

    return F.when(d.rlike(long), spelled(long, 1, 2, 3, 4)).when(d.rlike(short), spelled(short, 2, 1, 4, 3)).otherwise(d)


def merged(stored: Column, new: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """The stored headers with those permitted ones that the revisit sends anew."""
    sent = F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*permitted))
    kept = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(sent, k))
    return F.map_concat(kept, sent)


def resolve_revisits(records: DataFrame, stretch_s: int = 21_600) -> DataFrame:
    """One row for each revisit: ``record_id, url_key, ts, outcome, target_id, target_ts, headers``.

    ``records``: ``record_id, url, ts`` (long, seconds), ``kind`` (response or revisit), ``status``, ``etag``,
    ``last_modified``, ``headers`` (map, lower-case names). Full responses are responses of status 200. The target is the
    full response of the same canonical URL that comes last before the revisit, by time, then id; a response at the same
    second counts as earlier if its id is smaller. ``outcome``: ``resolved`` (headers are merged), ``mismatch`` (an etag
    that both have differs but for a mark of weakness, or without etags a last-modified time that both have, whatever
    spelling of HTTP's dates it is in), ``unvalidated`` (no validator that both
    have; not merged), ``unresolved`` (no earlier full response). Null URLs or times are unresolved; rows of other kinds
    are left out; repeated records are each answered; extra columns are ignored. The result doesn't depend on
    ``stretch_s``, the length of the stretches of time.
    """
    r = records.where("kind in ('response', 'revisit')").select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", "status", "etag", "last_modified", "headers")
    r = r.withColumn("stretch", F.floor(F.col("ts") / stretch_s))
    facts = F.struct("record_id", "ts", "etag", "last_modified", "headers")
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    r = r.withColumn("full", F.when(full, facts))
    order = ["ts", "record_id"]
    within = W.partitionBy("url_key", "stretch").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    near = r.withColumn("near", F.last("full", ignorenulls=True).over(within)).where("kind = 'revisit'").drop("full")
    last = r.where("full is not null").groupBy("url_key", "stretch").agg(F.max_by("full", F.struct("ts", "record_id")).alias("closing"))
    # what each stretch that has a revisit inherits: the last response of the stretches before it
    asked = near.where("near is null and url_key is not null and ts is not null").select("url_key", "stretch").distinct()
    before = W.partitionBy("url_key").orderBy("stretch", F.col("closing").isNotNull()).rowsBetween(W.unboundedPreceding, -1)
    both = last.unionByName(asked.withColumn("closing", F.lit(None).cast(last.schema["closing"].dataType)))
    handed = both.withColumn("earlier", F.last("closing", ignorenulls=True).over(before)).join(asked, ["url_key", "stretch"], "left_semi").where("closing is null").select("url_key", "stretch", "earlier")
    out = near.join(handed, ["url_key", "stretch"], "left").withColumn("target", F.coalesce("near", "earlier"))
    t = F.col("target")
    etags, times = F.col("etag").isNotNull() & t["etag"].isNotNull(), F.col("last_modified").isNotNull() & t["last_modified"].isNotNull()
    outcome = (
        F.when(t.isNull(), "unresolved")
        .when(etags, F.when(opaque(F.col("etag")) == opaque(t["etag"]), "resolved").otherwise("mismatch"))
        .when(times, F.when(instant(F.col("last_modified")) == instant(t["last_modified"]), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    out = out.withColumn("outcome", outcome)
    headers = F.when(F.col("outcome") == "resolved", merged(t["headers"], F.col("headers"))).otherwise(F.col("headers"))
    return out.select("record_id", "url_key", "ts", "outcome", t["record_id"].alias("target_id"), t["ts"].alias("target_ts"), headers.alias("headers"))


def page_records(pages: DataFrame) -> DataFrame:
    """Capture records derived from ``pages``: each page is a response and, later, a revisit.

    Pages that stand for one address (host and the page's number modulo 50) are captures of it. Validators come from the
    page's digest; a revisit sends those of its own page, so that they agree with the capture before it only if that has
    the same content. By turns an etag stands for changed content, or a validator is missing on one side.
    """
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"\Ahttps?://([^/?#]*)", 1)
    number = (F.col("page_id") % 50).cast("string")
    url, other = F.concat(F.lit("https://"), host, F.lit("/"), number, F.lit("/?b=2&a=1#top")), F.concat(F.lit("HTTP://"), F.upper(host), F.lit("/"), number, F.lit("?a=1&b=2"))
    base = pages.select("page_id", url.alias("url"), other.alias("other"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    ts = F.col("page_id") * 60
    own, changed, time = F.substring("digest", 1, 16), F.substring("digest", 17, 16), F.concat(F.lit("t"), F.substring("digest", 1, 2))
    response = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", ts.alias("ts"), F.lit("response").alias("kind"), F.when(F.col("page_id") % 11 == 0, 503).otherwise(200).alias("status"),
        F.when(F.col("page_id") % 7 != 0, own).alias("etag"), F.when(F.col("page_id") % 5 != 0, time).alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), own, F.lit("x-page"), F.col("page_id").cast("string")).alias("headers"),
    )
    revisit = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.col("other").alias("url"), (ts + 3600).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(F.col("page_id") % 5 < 3, own).when(F.col("page_id") % 5 == 3, changed).alias("etag"), F.when(F.col("page_id") % 4 != 0, time).alias("last_modified"),
        F.create_map(F.lit("date"), (ts + 3600).cast("string"), F.lit("set-cookie"), F.lit("no")).alias("headers"),
    )
    return response.unionByName(revisit)


def op7_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_records(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "url_key", "ts", "outcome", "target_id", "target_ts", lines.alias("headers"))


OP7_SQL = r"""
WITH base AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^https?://([^/?#]*)', 1)) AS host, '/' || (page_id % 50) || '?a=1&b=2' AS rest,
    substr(md5(coalesce(html, '')), 1, 16) AS own, substr(md5(coalesce(html, '')), 17, 16) AS changed, 't' || substr(md5(coalesce(html, '')), 1, 2) AS time FROM pages
), response AS (
  SELECT page_id, page_id * 2 AS record_id, regexp_replace(regexp_replace(host, ':443$', ''), '^www\.', '') || rest AS r_k, page_id * 60 AS ts, page_id % 11 <> 0 AS ok,
    CASE WHEN page_id % 7 <> 0 THEN own END AS etag, CASE WHEN page_id % 5 <> 0 THEN time END AS lm, own FROM base
), revisit AS (
  SELECT page_id * 2 + 1 AS record_id, regexp_replace(regexp_replace(host, ':80$', ''), '^www\.', '') || rest AS k, page_id * 60 + 3600 AS ts,
    CASE WHEN page_id % 5 < 3 THEN own WHEN page_id % 5 = 3 THEN changed END AS etag, CASE WHEN page_id % 4 <> 0 THEN time END AS lm FROM base
), found AS (
  SELECT v.*, r.record_id AS target_id, r.ts AS target_ts, r.etag AS r_etag, r.lm AS r_lm, r.own, r.page_id AS r_page,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.record_id DESC) AS n
  FROM revisit v LEFT JOIN response r ON v.k = r.r_k AND r.ok AND (r.ts < v.ts OR (r.ts = v.ts AND r.record_id < v.record_id))
), judged AS (
  SELECT *, CASE WHEN target_id IS NULL THEN 'unresolved'
    WHEN etag IS NOT NULL AND r_etag IS NOT NULL THEN CASE WHEN etag = r_etag THEN 'resolved' ELSE 'mismatch' END
    WHEN lm IS NOT NULL AND r_lm IS NOT NULL THEN CASE WHEN lm = r_lm THEN 'resolved' ELSE 'mismatch' END ELSE 'unvalidated' END AS outcome
  FROM found WHERE n = 1
)
SELECT record_id, k AS url_key, ts, outcome, target_id, target_ts,
  CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;date=' || ts || ';etag=' || own || ';x-page=' || r_page ELSE 'date=' || ts || ';set-cookie=no' END AS headers
FROM judged
"""
