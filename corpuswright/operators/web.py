"""Pages to materials, links, course plans and crawl frontiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..functions import urls as ur
from ..functions.html import article_pieces, page_material, page_text
from ..functions.images import is_decorative_article
from ..session import bucketed, materialize
from .ordering import row_numbers

MATERIAL_FIELDS = (
    "title string, content string,"
    " images array<struct<url:string,alt:string,local_path:string,description:string,idx:int,position:int>>,"
    " code_blocks array<struct<language:string,code:string,comment:string>>,"
    " headings array<struct<level:int,text:string>>"
)


#: Pages that a worker has as Python objects at a time.
AT_ONCE = 32


def _read_pages(pages: DataFrame, read: Callable[[dict], dict], schema: str) -> DataFrame:
    """``read`` of every row. A few pages at a time, so a worker holds little beside the Arrow batch it was sent."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                yield pa.RecordBatch.from_pylist([read(row) for row in b.slice(at, AT_ONCE).to_pylist()], fields)

    return pages.mapInArrow(run, schema)


def pages_to_text(pages: DataFrame) -> DataFrame:
    """Visible text of every page (page_id, url, html)."""

    def read(row: dict) -> dict:
        return {"page_id": row["page_id"], "url": row["url"], "text": page_text(row["html"])}

    return _read_pages(pages.select("page_id", "url", "html"), read, "page_id long, url string, text string")


def pages_to_materials(pages: DataFrame) -> DataFrame:
    """One structured row per page: title, content, images, code, headings."""

    def read(row: dict) -> dict:
        found = page_material(row["html"], row["url"])
        return {"page_id": row["page_id"], "url": row["url"], **found, "raw_html_length": len(row["html"])}

    return _read_pages(pages.select("page_id", "url", "html"), read, f"page_id long, url string, {MATERIAL_FIELDS}, raw_html_length long")


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def article_title(html: Column) -> Column:
    """Title up to the first dash, then up to the first bar."""
    return tx.strip(F.substring_index(F.substring_index(page_title(html), "-", 1), "|", 1))


def unescape(col: Column) -> Column:
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        col = F.replace(col, F.lit(entity), F.lit(char))
    return col


def page_links(html: Column, base: Column) -> Column:
    """Distinct absolute links of the anchors of a page."""
    markup = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    quoted = r"""(?is)<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    groups = [F.regexp_extract_all(markup, F.lit(quoted), F.lit(g)) for g in (1, 2, 3)]
    hrefs = F.transform(
        F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]),
        lambda h: unescape(F.concat(h["g0"], h["g1"], h["g2"])),
    )
    links = F.transform(hrefs, lambda h: ur.resolve_href(base, h))
    return F.array_distinct(F.filter(links, lambda u: u.rlike("^https?://")))


def extract_links(pages: DataFrame) -> DataFrame:
    """Edges (page_id, url, link); links of one page come from its own row."""
    return pages.select("page_id", "url", F.explode(page_links(F.col("html"), F.col("url"))).alias("link"))


def course_links(html: Column, base: Column) -> Column:
    """Anchor links, absolute-path and quoted relative matches under the base.

    Same host and path below the base path, distinct, in natural order.
    """
    root = F.concat(ur.scheme(base), F.lit("://"), ur.authority(base))
    base_path = F.regexp_replace(ur.path(base), "/+$", "")
    last = F.element_at(F.split(base_path, "/"), -1)
    parent = F.regexp_replace(base_path, "/[^/]*$", "")
    word = r"[\p{L}\p{N}_\-]"
    quote = F.concat(F.lit(r"\Q"), base_path, F.lit(r"\E"))
    absolute = F.transform(
        F.regexp_extract_all(html, F.concat(quote, F.lit(r"/[\p{L}\p{N}_\-/]+")), F.lit(0)),
        lambda m: F.concat(root, m),
    )
    relative = F.transform(
        F.regexp_extract_all(
            html, F.concat(F.lit(r"""["'/](\Q"""), last, F.lit(rf"""\E/{word}+(?:/{word}+)*)["']""")), F.lit(1)
        ),
        lambda m: F.when(m.startswith("/"), F.concat(root, m)).otherwise(F.concat(root, parent, F.lit("/"), m)),
    )
    every = F.array_distinct(F.concat(page_links(html, base), absolute, relative))
    inside = F.filter(
        every, lambda u: (ur.authority(u) == ur.authority(base)) & ur.path(u).startswith(F.concat(base_path, F.lit("/")))
    )
    keyed = F.array_sort(F.transform(inside, lambda u: F.struct(ur.natural_key(ur.path(u)).alias("k"), u.alias("u"))))
    return F.transform(keyed, lambda x: x["u"])


def discover_course_links(pages: DataFrame, base: Column | None = None) -> DataFrame:
    """Course links of every page with their order (from 0)."""
    base = F.col("url") if base is None else base
    return pages.select("page_id", F.posexplode(course_links(F.col("html"), base)).alias("ord", "link")).withColumn(
        "ord", F.col("ord").cast("long")
    )


def plan_course(pages: DataFrame, cap: int = 50) -> DataFrame:
    """First ``cap`` course links, else same-host links under the page path."""
    url, html = F.col("url"), F.col("html")
    fallback = F.filter(
        page_links(html, url),
        lambda u: (ur.authority(u) == ur.authority(url)) & ur.path(u).startswith(ur.path(url)) & (u != url),
    )
    found = pages.select("page_id", course_links(html, url).alias("links"), F.array_sort(fallback).alias("other"))
    chosen = F.when(F.size("links") > 0, F.col("links")).otherwise(F.col("other"))
    return found.select("page_id", F.posexplode(F.slice(chosen, 1, cap)).alias("ord", "link")).withColumn(
        "ord", F.col("ord").cast("long")
    )


def plan_doc(pages: DataFrame, cap: int = 20) -> DataFrame:
    """The root first, then same-host links in natural order, ``cap`` in all."""
    url = F.col("url")
    same = F.filter(page_links(F.col("html"), url), lambda u: (ur.authority(u) == ur.authority(url)) & (u != url))
    keyed = F.array_sort(F.transform(same, lambda u: F.struct(ur.natural_key(ur.path(u)).alias("k"), u.alias("u"))))
    plan = F.slice(F.concat(F.array(url), F.transform(keyed, lambda x: x["u"])), 1, cap)
    return pages.select("page_id", F.posexplode(plan).alias("ord", "link")).withColumn("ord", F.col("ord").cast("long"))


def plan_article(pages: DataFrame, text: Column | None = None) -> DataFrame:
    """An article and what it points to: the page, repositories, papers.

    Rows (page_id, kind, ord, url) with kind page, github or arxiv. ``text`` is
    searched for links (the page source by default).
    """
    source = F.col("html") if text is None else text
    repos = F.array_distinct(F.regexp_extract_all(source, F.lit(r"https?://github\.com/[\w\-.]+/[\w\-.]+"), F.lit(0)))
    papers = F.array_distinct(F.regexp_extract_all(source, F.lit(r"https?://arxiv\.org/(?:abs|pdf)/\d{4}\.\d{4,5}"), F.lit(0)))
    def entries(kind: str, urls: Column) -> Column:
        return F.transform(urls, lambda u, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("ord"), u.alias("url")))

    listed = F.concat(entries("page", F.array("url")), entries("github", repos), entries("arxiv", papers))
    return pages.select("page_id", F.explode(listed).alias("p")).select("page_id", "p.kind", "p.ord", "p.url")


ARTICLE_PIECES = "array<struct<text:string,src:string,data_type:string,width:string,context:string,position:double>>"


def pages_to_articles(pages: DataFrame) -> DataFrame:
    """Article body with its images in place as Markdown, decoration dropped."""

    def pieces(row: dict) -> dict:
        return {"page_id": row["page_id"], "pieces": article_pieces(row["html"])}

    read = _read_pages(pages.select("page_id", "html"), pieces, f"page_id long, pieces {ARTICLE_PIECES}")

    def kept(p: Column) -> Column:
        return p["src"].isNotNull() & ~is_decorative_article(p["src"], p["data_type"], p["width"], p["context"], p["position"])

    shown = F.transform(
        "pieces", lambda p: F.concat(p["text"], F.when(kept(p), F.concat(F.lit("\n\n![]("), p["src"], F.lit(")\n\n"))).otherwise(""))
    )
    body = tx.strip(F.regexp_replace(F.array_join(shown, ""), "\n{3,}", "\n\n"))
    return read.select("page_id", body.alias("content"), F.transform(F.filter("pieces", kept), lambda p: p["src"]).alias("images"))


def course_root(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """Ancestor page with the most course links, walking up from each start URL.

    The walk ends at the first level with fewer links than the best so far. A
    start has as many levels as its path has segments, so its window is small.
    """
    path = F.regexp_replace(ur.path(F.col("start_url")), "/+$", "")
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    levels = F.when(
        path != "",
        F.transform(
            F.sequence(F.size(segments), F.lit(1), F.lit(-1)),
            lambda n: F.concat(F.lit("/"), F.concat_ws("/", F.slice(segments, 1, n))),
        ),
    ).otherwise(F.array().cast("array<string>"))
    root = F.concat(ur.scheme(F.col("start_url")), F.lit("://"), ur.authority(F.col("start_url")))
    tries = starts.select("start_url", root.alias("_root"), F.posexplode_outer(levels).alias("level", "path")).select(
        "start_url", "level", "path", F.concat("_root", "path").alias("candidate")
    )
    counted = pages.select(
        F.col("url").alias("candidate"),
        F.size(
            F.filter(course_links(F.col("html"), F.col("url")), lambda u: ur.main_content_link(u, ur.path(F.col("url"))))
        ).alias("links"),
    )
    seen = tries.join(counted, "candidate")
    before = W.partitionBy("start_url").orderBy("level").rowsBetween(W.unboundedPreceding, -1)
    best = F.coalesce(F.max("links").over(before), F.lit(0))
    dropped = F.max(F.when(F.col("links") < F.col("_best"), 1).otherwise(0)).over(before)
    kept = seen.withColumn("_best", best).withColumn("_dropped", F.coalesce(dropped, F.lit(0))).where("_dropped = 0")
    winner = kept.groupBy("start_url").agg(
        F.max(F.struct("links", (-F.col("level")).alias("up"), "candidate")).alias("w")
    )
    return starts.join(winner, "start_url", "left").select(
        "start_url",
        F.when(F.coalesce("w.links", F.lit(0)) > 0, F.col("w.candidate")).otherwise(F.col("start_url")).alias("root_url"),
        F.coalesce("w.links", F.lit(0)).cast("long").alias("links"),
    )


def crawl_frontier(
    edges: DataFrame,
    pages: DataFrame,
    roots: DataFrame,
    depth: int = 1,
    max_pages: int = 5,
    follow_unchanged: bool = False,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """Breadth-first pages of every root, inside its host and path prefix.

    ``edges(src_url, dst_url)``, ``pages(url, changed)`` with unique URLs,
    ``roots(root_url)``. The walk begins at the root, or at the ``seeds(root_url,
    url)`` where there are some. A page is visited once; an unchanged page is
    skipped and its links are not followed. At most ``max_pages`` changed pages
    per root, nearest first and by URL within a level. ``depth`` bounds the
    rounds. The links are written into buckets of their source once, so a round
    moves its frontier to them and not the links; every round is written to the
    shared folder, so a lost executor costs one round.
    """
    known = bucketed(pages.select("url", "changed"), "url", "crawl_pages")
    links = bucketed(edges.select("src_url", "dst_url"), "src_url", "crawl_links")
    level = roots.select("root_url", F.col("root_url").alias("url")) if seeds is None else seeds.select("root_url", "url").distinct()
    visited = None
    for d in range(depth + 1):
        here = level.join(known, "url").withColumn("depth", F.lit(d).cast("long"))
        here = materialize(here.select("root_url", "url", "changed", "depth"), "crawl")
        visited = here if visited is None else visited.unionByName(here)
        if d == depth or here.isEmpty():
            break
        sources = here if follow_unchanged else here.where("changed")
        step = sources.select("root_url", F.col("url").alias("src_url")).join(links, "src_url")
        inside = (ur.authority(F.col("dst_url")) == ur.authority(F.col("root_url"))) & ur.path(
            F.col("dst_url")
        ).startswith(ur.path(F.col("root_url")))
        level = (
            step.where(inside)
            .select("root_url", F.col("dst_url").alias("url"))
            .distinct()
            .join(visited.select("root_url", "url"), ["root_url", "url"], "left_anti")
        )
    # Spark limits every root to max_pages rows ahead of the shuffle
    rank = F.row_number().over(W.partitionBy("root_url").orderBy("depth", "url"))
    ranked = visited.where("changed").withColumn("ord", rank).where(F.col("ord") <= max_pages)
    return ranked.select("root_url", "url", "depth", (F.col("ord") - 1).cast("long").alias("ord"))


def extract_references(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Links to repositories, papers and model hubs, distinct per row."""
    return df.select(key, F.posexplode(ur.references_in(text)).alias("pos", "ref")).select(
        key, F.col("pos").cast("long").alias("pos"), "ref.url", "ref.type", "ref.title"
    )


def extract_code_blocks(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Fenced blocks longer than ten characters, language given or detected."""
    pattern = r"(?s)```([\p{L}\p{N}_]*)\n(.*?)```"
    blocks = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("given"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("raw"),
    )
    coded = F.transform(
        blocks,
        lambda b: F.struct(
            F.when(b["given"] != "", b["given"]).otherwise(tx.code_language(b["raw"])).alias("language"),
            tx.strip(b["raw"]).alias("code"),
        ),
    )
    kept = F.filter(coded, lambda b: F.length(b["code"]) > 10)
    return df.select(key, F.posexplode(kept).alias("i", "block")).select(
        key, F.col("i").cast("long").alias("i"), "block.language", "block.code"
    )


def site_order(pages: DataFrame) -> DataFrame:
    """Position of every page within its host, in natural path order (from 0)."""
    keyed = pages.select(
        "page_id",
        "url",
        ur.authority(F.col("url")).alias("host"),
        ur.natural_key(ur.path(F.col("url"))).alias("_path_key"),
    )
    return row_numbers(keyed, ["host"], ["_path_key", "page_id"], "order_index", start=0).drop("_path_key")


def host_report(pages: DataFrame) -> DataFrame:
    """Pages, links, source kinds and low-quality flag per host."""
    per_page = pages.select(
        ur.authority(F.col("url")).alias("host"),
        ur.classify_url(F.col("url"), "explorer").alias("kind"),
        ur.is_low_quality(F.col("url")).alias("low"),
        F.size(page_links(F.col("html"), F.col("url"))).alias("links"),
    )
    return per_page.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("links").alias("links"),
        F.concat_ws(",", F.array_sort(F.collect_set("kind"))).alias("kinds"),
        F.max("low").alias("low_quality"),
    )
