"""Main text of web pages with a site style tree.

The pages of a host are merged by style path (tags with their classes from the root). A leaf's content importance falls as
its texts recur over the host's pages (their entropy over the pages), an inner node's importance blends the entropy of its
presentations with what stands below; branches of low importance are removed from each page of the host.

Marked parts are not left to statistics: navigation, forms, adverts, comments and the like go by their tag, role or class,
but for an element that is marked by class or id alone and holds most of the page: that is a layout. Within an ``article``
or ``main`` element only leaves that recur much more are removed, and none where the whole element recurs on the host, since
copies of an article on one host look like a template.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import cut, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br input".split())
NOISE_TAGS = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea head title dialog menu object canvas audio video map datalist option".split())
LANDMARKS = frozenset(("article", "main"))
#: A path's part down to its first landmark.
LANDMARK = r"\A(.*?/(?:article|main)(?:\.[^/]*)?)(?:/|\z)"
UNJUDGED = frozenset(("html", "body", "article", "main"))
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted comment comments respond disqus sidebar widget menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent notice gdpr popup modal newsletter subscribe signup share sharing social related recommended "
    "toolbar pagination pager login search".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag that ends an open element of these, down to the nearest of the bounds.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}


def blocks(page: str) -> Iterator[tuple[str, bool, bool, str]]:
    """(style path, marked as noise, within a landmark, text) of each block of text, in page order."""
    #: open elements: tag, path, noise by tag or role, landmark, numbers of the elements around that class or id mark as noise
    stack: list[tuple[str, str, bool, bool, tuple[int, ...]]] = [("", "", False, False, ())]
    text: list[str] = []
    raw = ""
    marked = 0
    out: list[tuple[str, bool, bool, str, tuple[int, ...]]] = []

    def noisy(e: tuple) -> bool:
        return e[2] or bool(e[4])

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if joined:
                _, path, noise, landmark, marks = stack[-1]
                out.append((path, noise, landmark, joined, marks))

    def close(k: int) -> None:
        """Elements from place k on end; text of a block or of a marked part ends with them."""
        if any(e[0] not in INLINE or (noisy(e) and not noisy(stack[k - 1])) for e in stack[k:]):
            flush()
        del stack[k:]

    pos, size = 0, len(page)
    while pos < size:
        if raw:
            m = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(page, pos)
            pos = m.start() if m else size
            raw = ""
            if not m:
                break
        m = TOKEN.search(page, pos)
        if not m:
            text.append(page[pos:])
            break
        if m.start() > pos:
            text.append(page[pos : m.start()])
        pos = m.end()
        if not m[2] or not m[4]:  # a comment or declaration, or a tag that the page's end cuts off
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in VOID:
                text.append(" " if tag == "br" else "")
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            text.append(" " if tag in ("br", "hr") else "")
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        if tag in SIBLINGS:
            ended, bounds = SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ended:
                    close(k)
                    if tag != "tr":
                        break
                elif stack[k][0] in bounds:
                    break
        if tag not in INLINE:
            flush()
        _, path, noise, landmark, marks = stack[-1]
        words = ""
        if m[3] and not m[3].isspace():
            found = {}
            for a in ATTR.finditer(m[3]):
                found.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
            words = f"{found.get('class', '')} {found.get('id', '')}".lower()
            if tag not in UNJUDGED and not noise:
                noise = "hidden" in found or found.get("role", "").lower() in NOISE_ROLES
                if not noise and not NOISE_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", words)):
                    marks, marked = (*marks, marked), marked + 1
        noise = noise or tag in NOISE_TAGS
        if (noise or marks) and not noisy(stack[-1]) and tag in INLINE:
            flush()
        style = tag + "".join(f".{w}" for w in sorted(set(words.split())))
        stack.append((tag, f"{path}/{style}", noise, landmark or tag in LANDMARKS, marks))
        if tag in RAW:
            raw = tag
    flush()
    layouts = frame(out) if marked else frozenset()
    return iter([(path, noise or not layouts.issuperset(marks), landmark, t) for path, noise, landmark, t, marks in out])


def frame(out: list[tuple[str, bool, bool, str, tuple[int, ...]]]) -> frozenset[int]:
    """The marked elements that hold more than half of the page's text, and all of its landmarks' text."""
    whole, own = [0, 0], {}
    for _, noise, landmark, t, marks in out:
        if not noise:
            for total in (whole, *(own.setdefault(k, [0, 0]) for k in marks)):
                total[0] += len(t)
                total[1] += len(t) * landmark
    return frozenset(k for k, (n, inside) in own.items() if 2 * n > whole[0] and inside == whole[1])


def pick(found: list[tuple[str, bool, bool, str]], low: frozenset[str]) -> str:
    """The blocks that stay: those that aren't a low leaf, nor (outside landmarks) under a low branch, its path and a slash.

    What makes up half or more of the text in a page's landmarks is its article, however many pages of the host share it:
    then no block in them is removed.
    """
    kept = [b for b in found if not b[1]]
    if low:
        branches = tuple(p for p in low if p.endswith("/"))
        inside = [b for b in kept if b[2]]
        template = 2 * sum(len(b[3]) for b in inside if b[0] in low) < sum(len(b[3]) for b in inside)
        kept = [b for b in kept if (b[0] not in low or (b[2] and not template)) and (b[2] or not f"{b[0]}/".startswith(branches))]
    return "\n".join(b[3] for b in kept)


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"\A(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))


def style_tree(pages: DataFrame, gamma: float = 0.9) -> DataFrame:
    """``host, path, leaf, pages, importance`` of the style nodes, over all pages.

    A leaf seen on m pages with texts that recur on c pages each has importance 1 - mean(log c / log m); an inner node has
    (1 - gamma) times the entropy of its presentations (the sets of styles below it) plus gamma times the mean importance
    of the leaves below. What is seen on one page has importance 1. Marked noise isn't in the tree.
    """
    names = ["host", "path", "mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[str, str, int]] = []
            for name, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                leaves = {(p, xxhash.xxh3_64_intdigest(t) >> 1) for p, noise, _, t in blocks(page or "") if not noise}
                below: dict[str, set[str]] = {}
                for p, _ in leaves:
                    parts = p.split("/")
                    for k in range(2, len(parts)):
                        below.setdefault("/".join(parts[:k]), set()).add(parts[k])
                rows += [(name, p, f) for p, f in leaves]
                rows += [(name, p, -1 - (xxhash.xxh3_64_intdigest("\n".join(sorted(s))) >> 1)) for p, s in below.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows, strict=True)], names)

    marks = cut(pages.select("host", "html").mapInArrow(run, "host string, path string, mark long").groupBy("host", "path", "mark").agg(F.count("*").alias("c")))
    leaf = marks.where("mark >= 0").groupBy("host", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("h"))
    leaf = leaf.select("host", "path", "m", F.when(F.col("m") > 1, 1 - F.col("h") / F.col("m") / F.log("m")).otherwise(1.0).alias("content"))
    inner = marks.where("mark < 0").groupBy("host", "path").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("h"))
    # the entropy of presentations to the base m: log m - sum(c log c) / m, over log m
    inner = inner.select("host", "path", "m", F.when(F.col("m") > 1, 1 - F.col("h") / F.col("m") / F.log("m")).otherwise(1.0).alias("shape"))
    parts = F.split("path", "/")
    above = leaf.select("host", "m", "content", F.regexp_extract("path", LANDMARK, 1).alias("top"), F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path"))
    # a landmark counts for what is in it, not for what is around it
    above = above.where((F.col("top") == "") | F.startswith("path", "top")).groupBy("host", "path").agg((F.sum(F.col("content") * F.col("m")) / F.sum("m")).alias("content"))
    nodes = inner.join(above, ["host", "path"]).select("host", "path", F.lit(False).alias("leaf"), F.col("m").alias("pages"), ((1 - gamma) * F.col("shape") + gamma * F.col("content")).alias("importance"))
    return leaf.select("host", "path", F.lit(True).alias("leaf"), F.col("m").alias("pages"), F.col("content").alias("importance")).unionByName(nodes)


def extract_text(pages: DataFrame, least_importance: float = 0.35, least_pages: int = 4, few: int = 100_000, prior: float = 0.2) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``page_id, url, html``.

    Character references are decoded, white space within a block becomes one space, blocks are joined by a line feed. A
    null or empty page has the empty text; a null url belongs to the host without a name; repeated rows are each answered
    (and count as pages of their host); an empty table gives no rows; other columns are ignored. Style nodes of less than
    ``least_importance`` that ``least_pages`` pages of a host have are removed. In an article or main element only leaves
    are judged, with ``prior`` more importance, not where the element itself has less than ``least_importance``, and not on
    a page where they would be half or more of such elements' text. The list of such nodes is sent to every task if there are at most ``few``, else joined by host.
    """
    named = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    nodes = cut(style_tree(named).where((F.col("importance") < least_importance) & (F.col("pages") >= least_pages)).withColumn("top", F.regexp_extract("path", LANDMARK, 1)))
    outside = nodes.where("top = ''").where(F.col("leaf") | ~F.substring_index("path", "/", -1).rlike(r"\A(html|body)(\.|\z)"))
    outside = outside.select("host", F.when(F.col("leaf"), F.col("path")).otherwise(F.concat("path", F.lit("/"))).alias("path"))
    copies = nodes.where("not leaf and path = top").select("host", "top")
    inside = nodes.where("leaf and top not in ('', path)").where(F.col("importance") + prior < least_importance).join(copies, ["host", "top"], "left_anti")
    low = outside.unionByName(inside.select("host", "path"))
    low = cut(low.groupBy("host").agg(F.collect_set("path").alias("low")))
    small = (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= few
    joined = named.join(F.broadcast(low) if small else low, "host", "left").select("page_id", "url", "html", "low")
    kind = pages.schema["page_id"].dataType.simpleString()
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [pick(list(blocks(page or "")), frozenset(paths or ())) for page, paths in zip(b.column("html").to_pylist(), b.column("low").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
