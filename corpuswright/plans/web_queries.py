"""Queries over pages, links and discovered resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as ur
from ..operators import explore as ex
from ..operators import web as wb
from ..sources.config import registry_rows
from .binding import documents, pages, table
from .registry import query
from .text_queries import AUTH, LADDER_SQL, NORM, PATH, WS, _ladder

VISIBLE = "html"
for _tag in ("script", "style", "nav", "footer", "header"):
    VISIBLE = f"regexp_replace({VISIBLE}, '(?is)<{_tag}[ >].*?</{_tag}>', '', 'g')"
UNESCAPE = (
    "replace(replace(regexp_replace(replace({c}, '&quot;', chr(34)), '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·')"
)


@query(
    "g1_pages_to_text",
    f"""WITH t AS (SELECT page_id, url, {UNESCAPE.format(c=f"regexp_replace(regexp_replace({VISIBLE}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')")} AS raw FROM pages)
    SELECT page_id, url, array_to_string(list_filter(list_transform(string_split_regex(raw, '\\n|  '),
      lambda x: trim(x, {WS})), lambda x: x <> ''), chr(10)) AS text FROM t""",
)
def g1(spark, d):
    return wb.pages_to_text(pages(spark, d))


AREA = "regexp_extract(html, '(?is)<article>(.*?)</article>', 1)"


@query(
    "g2_pages_to_materials",
    f"""WITH t AS (SELECT page_id, url, html, {AREA} AS area FROM pages)
    SELECT page_id, url, {UNESCAPE.format(c="regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title,
      {UNESCAPE.format(c=f"array_to_string(list_filter(list_transform(string_split_regex(area, '<[^>]*>'), lambda x: trim(x, {WS})), lambda x: x <> ''), chr(10))")} AS content,
      '1:' || trim({UNESCAPE.format(c="regexp_extract(area, '(?is)<h1>(.*?)</h1>', 1)")}, {WS}) AS headings,
      0::BIGINT AS images, 0::BIGINT AS code_blocks, length(html)::BIGINT AS raw_html_length FROM t""",
)
def g2(spark, d):
    rows = wb.pages_to_materials(pages(spark, d))
    heads = F.transform("headings", lambda h: F.concat(h["level"].cast("string"), F.lit(":"), h["text"]))
    return rows.select(
        "page_id", "url", "title", "content", F.concat_ws("|", heads).alias("headings"),
        F.size("images").alias("images"), F.size("code_blocks").alias("code_blocks"), "raw_html_length",
    )


@query(
    "g3_page_titles",
    f"""WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages)
    SELECT page_id, title, trim(split_part(split_part(title, '-', 1), '|', 1), {WS}) AS article_title FROM t""",
)
def g3(spark, d):
    html = F.col("html")
    return pages(spark, d).select(
        "page_id", wb.page_title(html).alias("title"), wb.article_title(html).alias("article_title")
    )


ROOT_SQL = f"regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)"


@query(
    "g4_extract_links",
    f"""WITH h AS (SELECT page_id, url, trim(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), {WS}) AS href FROM pages)
    SELECT DISTINCT page_id, url, {ROOT_SQL} || split_part(href, '#', 1) AS link FROM h WHERE starts_with(href, '/')""",
)
def g4(spark, d):
    return wb.extract_links(pages(spark, d))


COURSE_SQL = f"""raw AS (SELECT page_id, {ROOT_SQL} AS root, html FROM pages),
    found AS (SELECT page_id, root, root || split_part(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)), '#', 1) AS link FROM raw
      UNION SELECT page_id, root, root || unnest(regexp_extract_all(html, '/[\\p{{L}}\\p{{N}}_\\-/]+')) FROM raw
      UNION SELECT page_id, root, root || unnest(regexp_extract_all(html, '["''/](/[\\p{{L}}\\p{{N}}_\\-]+(?:/[\\p{{L}}\\p{{N}}_\\-]+)*)["'']', 1)) FROM raw),
    inside AS (SELECT DISTINCT page_id, link, {PATH.format(c='link')} AS path FROM found
      WHERE {AUTH.format(c='link')} = {AUTH.format(c='root')} AND starts_with({PATH.format(c='link')}, '/')),
    keyed AS (SELECT *, regexp_replace(regexp_replace(path, '(\\d+)', '{'0' * 20}\\1', 'g'), '\\d*(\\d{{20}})', '\\1', 'g') AS k FROM inside)"""


@query(
    "g5_discover_course_links",
    f"""WITH {COURSE_SQL}
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k, link) - 1 AS ord, link FROM keyed""",
)
def g5(spark, d):
    """Base is the host root of every page."""
    base = F.concat(ur.scheme(F.col("url")), F.lit("://"), ur.authority(F.col("url")))
    return wb.discover_course_links(pages(spark, d), base)


@query(
    "i4_union_links",
    f"""WITH {COURSE_SQL} SELECT {AUTH.format(c='link')} AS host, count(DISTINCT link) AS links FROM keyed GROUP BY 1""",
)
def i4(spark, d):
    """Distinct course links per host over the three link sources."""
    base = F.concat(ur.scheme(F.col("url")), F.lit("://"), ur.authority(F.col("url")))
    links = wb.discover_course_links(pages(spark, d), base).select("link").distinct()
    return links.groupBy(ur.authority(F.col("link")).alias("host")).agg(F.count(F.lit(1)).alias("links"))


@query(
    "g6_plan_doc",
    f"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
    l AS (SELECT DISTINCT page_id, url, {ROOT_SQL} || split_part(href, '#', 1) AS link FROM h),
    k AS (SELECT *, regexp_replace(regexp_replace({PATH.format(c='link')}, '(\\d+)', '{'0' * 20}\\1', 'g'), '\\d*(\\d{{20}})', '\\1', 'g') AS nk
          FROM l WHERE link <> url),
    r AS (SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY nk, link) AS ord FROM k)
    SELECT page_id, 0::BIGINT AS ord, url AS link FROM pages UNION ALL SELECT page_id, ord, link FROM r WHERE ord < 20""",
)
def g6_doc(spark, d):
    return wb.plan_doc(pages(spark, d))


@query(
    "g6_plan_course",
    f"""WITH {COURSE_SQL}, r AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k, link) - 1 AS ord, link FROM keyed)
    SELECT * FROM r WHERE ord < 50""",
)
def g6_course(spark, d):
    """Every page read as the course page of its host."""
    root = F.concat(ur.scheme(F.col("url")), F.lit("://"), ur.authority(F.col("url")))
    return wb.plan_course(pages(spark, d).withColumn("url", root))


SECTION = "^([A-Za-z]+://[^/?#]*/[^/?#]+)"
SITE = "^([A-Za-z]+://[^/?#]*)"


def _course_pages(spark, d):
    """Every page as a course: its own anchors, moved below its path, and one index page per language of a host.

    Anchors of the given pages hang on the host's root, where no page is; the
    index page has the anchors of the section's first page.
    """
    url = F.col("url")
    rows = pages(spark, d).where("url IS NOT NULL").select(ur.url_normalize(url).alias("url"), "page_id", "html")
    rows = rows.groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    section = F.regexp_extract("url", SECTION, 1)
    heads = rows.where(section != "").groupBy(section.alias("section")).agg(F.min_by("html", "url").alias("html"))
    heads = heads.join(rows, heads["section"] == rows["url"], "left_anti").select(F.col("section").alias("url"), "html")
    moved = F.replace("html", F.lit('<a href="/'), F.concat(F.lit('<a href="'), ur.path(url), F.lit("/")))
    return rows.select("url"), rows.unionByName(heads).select("url", moved.alias("html"))


@query(
    "g7_course_root",
    rf"""WITH one AS (SELECT {NORM.format(c='url')} AS url, arg_min(html, page_id) AS html FROM pages WHERE url IS NOT NULL GROUP BY 1),
    heads AS (SELECT regexp_extract(url, '{SECTION}', 1) AS section, arg_min(html, url) AS html FROM one GROUP BY 1),
    every AS (SELECT url, html FROM one UNION ALL SELECT section, html FROM heads WHERE section <> '' AND section NOT IN (SELECT url FROM one)),
    p AS (SELECT url, regexp_extract(url, '{SITE}', 1) AS root, {PATH.format(c='url')} AS base,
          replace(html, '<a href="/', '<a href="' || {PATH.format(c='url')} || '/') AS html FROM every),
    found AS (SELECT url, base, root || split_part(unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)), '#', 1) AS link FROM p
      UNION SELECT url, base, root || unnest(regexp_extract_all(html, regexp_escape(base) || '/[\p{{L}}\p{{N}}_\-/]+')) FROM p
      UNION SELECT url, base, root || regexp_replace(base, '/[^/]*$', '') || '/'
        || unnest(regexp_extract_all(html, '["''/](' || regexp_escape(split_part(base, '/', -1)) || '/[\p{{L}}\p{{N}}_\-]+(?:/[\p{{L}}\p{{N}}_\-]+)*)["'']', 1)) FROM p),
    inside AS (SELECT url, string_split(trim({PATH.format(c='link')}, '/'), '/') AS parts, len(string_split(trim(base, '/'), '/')) AS depth
      FROM found WHERE starts_with({PATH.format(c='link')}, base || '/')),
    counted AS (SELECT url, count(*) FILTER (len(parts) > depth AND NOT regexp_matches(parts[depth + 1], '^[a-zA-Z]{{2,3}}(-[a-zA-Z]{{2,3}})?$')
      AND parts[depth + 1] NOT IN ('events', 'assets', 'static')) AS links FROM inside GROUP BY url),
    starts AS (SELECT url || '/a/b' AS start_url, root, string_split(trim(base || '/a/b', '/'), '/') AS segs FROM p WHERE url IN (SELECT url FROM one)),
    tries AS (SELECT start_url, len(segs) - n AS level, root || '/' || array_to_string(segs[1:n], '/') AS candidate
      FROM starts, LATERAL (SELECT unnest(range(1, len(segs) + 1)) AS n) ns),
    seen AS (SELECT start_url, level, candidate, coalesce(links, 0) AS links FROM tries JOIN p ON p.url = candidate LEFT JOIN counted c ON c.url = candidate),
    best AS (SELECT *, coalesce(max(links) OVER w, 0) AS best FROM seen WINDOW w AS (PARTITION BY start_url ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    kept AS (SELECT * FROM (SELECT *, coalesce(bool_or(links < best) OVER w, false) AS over FROM best
      WINDOW w AS (PARTITION BY start_url ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE NOT over),
    won AS (SELECT *, row_number() OVER (PARTITION BY start_url ORDER BY links DESC, level) AS place FROM kept)
    SELECT start_url, CASE WHEN links > 0 THEN candidate ELSE start_url END AS root_url, links FROM won WHERE place = 1""",
)
def g7(spark, d):
    """The walk starts two levels below every page, at a section that is no page."""
    urls, courses = _course_pages(spark, d)
    return wb.course_root(urls.select(F.concat("url", F.lit("/a/b")).alias("start_url")), courses)


@query(
    "g8_crawl_frontier",
    f"""WITH p AS (SELECT {NORM.format(c='url')} AS url, {ROOT_SQL} AS root, html, row_number() OVER (PARTITION BY html ORDER BY page_id) = 1 AS fresh
      FROM pages WHERE url IS NOT NULL),
    edges AS (SELECT DISTINCT url, {NORM.format(c='link')} AS link FROM (
      SELECT url, root || split_part(trim(unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)), {WS}), '#', 1) AS link FROM p) l),
    known AS (SELECT url, bool_or(fresh) AS changed FROM p GROUP BY url
      UNION ALL SELECT DISTINCT link, true FROM edges WHERE link NOT IN (SELECT url FROM p)),
    seeds AS (SELECT DISTINCT root, url FROM p),
    next_ AS (SELECT DISTINCT s.root, e.link AS url FROM seeds s JOIN known k ON k.url = s.url AND k.changed JOIN edges e ON e.url = s.url
      WHERE {AUTH.format(c='e.link')} = {AUTH.format(c='s.root')}),
    visited AS (SELECT root, url, 0 AS depth FROM seeds
      UNION ALL SELECT root, url, 1 FROM next_ WHERE (root, url) NOT IN (SELECT (root, url) FROM seeds)),
    r AS (SELECT root AS root_url, v.url, depth::BIGINT AS depth, row_number() OVER (PARTITION BY root ORDER BY depth, v.url) - 1 AS ord
      FROM visited v JOIN known k ON k.url = v.url AND k.changed)
    SELECT * FROM r WHERE ord < 12""",
)
def g8(spark, d):
    """Every host from its pages along their links; a page whose source an earlier page has too is unchanged.

    Link targets that are no pages yet are new and end the walk.
    """
    given = pages(spark, d).where("url IS NOT NULL")
    fresh = given.groupBy("html").agg(F.min("page_id").alias("page_id")).select("page_id", F.lit(True).alias("fresh"))
    url = ur.url_normalize(F.col("url"))
    site = given.select("page_id", url.alias("url"), F.regexp_extract("url", SITE, 1).alias("root_url"))
    known = site.join(fresh, "page_id", "left").groupBy("url").agg(F.max(F.coalesce("fresh", F.lit(False))).alias("changed"))
    links = wb.extract_links(given).select(url.alias("src_url"), ur.url_normalize(F.col("link")).alias("dst_url")).distinct()
    targets = links.select(F.col("dst_url").alias("url")).distinct().join(known, "url", "left_anti").withColumn("changed", F.lit(True))
    seeds = site.select("root_url", "url").distinct()
    return wb.crawl_frontier(links, known.unionByName(targets), seeds.select("root_url").distinct(), depth=2, max_pages=12, seeds=seeds)


LINKED_SQL = """SELECT doc_id, lang, text || ' https://github.com/' || lang || '/' || source || '/tree/main x'
    || ' http://arxiv.org/pdf/2401.' || lpad(n_chars::VARCHAR, 5, '0') || ' https://huggingface.co/' || lang || '/m-' || source
    || ' https://github.com/' || lang || '/' || source AS text, source FROM documents"""


def _linked(spark, d):
    lit, doc = F.lit, F.lpad(F.col("n_chars").cast("string"), 5, "0")
    text = F.concat(
        F.col("text"), lit(" https://github.com/"), "lang", lit("/"), "source", lit("/tree/main x"),
        lit(" http://arxiv.org/pdf/2401."), doc, lit(" https://huggingface.co/"), "lang", lit("/m-"), "source",
        lit(" https://github.com/"), "lang", lit("/"), "source",
    )
    return documents(spark, d).select("doc_id", "lang", "source", text.alias("text"))


@query(
    "g9_extract_references",
    f"""WITH l AS ({LINKED_SQL})
    SELECT doc_id, 0::BIGINT AS pos, 'https://github.com/' || lang || '/' || source AS url, 'github' AS type, lang || '/' || source AS title FROM l
    UNION ALL SELECT doc_id, 1, 'https://arxiv.org/abs/' || i, 'arxiv', 'arXiv:' || i FROM
      (SELECT doc_id, regexp_extract(text, 'https?://arxiv\\.org/(?:abs|pdf)/(\\d{{4}}\\.\\d{{4,5}})', 1) AS i FROM l)
    UNION ALL SELECT doc_id, 2, 'https://huggingface.co/' || lang || '/m-' || source, 'huggingface', lang || '/m-' || source FROM l""",
)
def g9(spark, d):
    return wb.extract_references(_linked(spark, d), "doc_id", F.col("text"))


@query(
    "g9_plan_article",
    f"""WITH l AS ({LINKED_SQL}) SELECT doc_id AS page_id, 'page' AS kind, 0::BIGINT AS ord, 'doc/' || doc_id AS url FROM l
    UNION ALL SELECT doc_id, 'github', 0, 'https://github.com/' || lang || '/' || source FROM l
    UNION ALL SELECT doc_id, 'arxiv', 0, regexp_extract(text, 'http://arxiv\\.org/pdf/[0-9.]{{10}}') FROM l""",
)
def g9_article(spark, d):
    rows = _linked(spark, d).select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), "text"
    )
    return wb.plan_article(rows, F.col("text"))


@query(
    "d13_distinct_refs",
    f"""WITH l AS ({LINKED_SQL}), r AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://github\\.com/([\\w\\-.]+/[\\w\\-.]+)', 1)) AS n FROM l)
    SELECT doc_id, count(DISTINCT n) AS github, 1::BIGINT AS arxiv, 1::BIGINT AS huggingface FROM r GROUP BY doc_id""",
)
def d13(spark, d):
    refs = _linked(spark, d).select("doc_id", ur.references_in(F.col("text")).alias("refs"))

    def n(kind):
        return F.size(F.filter("refs", lambda r: r["type"] == kind)).alias(kind)

    return refs.select("doc_id", n("github"), n("arxiv"), n("huggingface"))


@query(
    "g10_extract_code_blocks",
    """SELECT doc_id, 0::BIGINT AS i, 'python' AS language, 'import os' || chr(10) || 'def ' || source || '(): pass' AS code FROM documents
    UNION ALL SELECT doc_id, 1, CASE lang WHEN 'en' THEN 'sql' ELSE '' END, 'select ' || replace(text, chr(10), ' ') || ' end' FROM documents""",
)
def g10(spark, d):
    """Two real blocks around one that is too short to keep."""
    lit = F.lit
    tag = F.when(F.col("lang") == "en", "sql").otherwise("")
    text = F.concat(
        lit("a\n```\nimport os\ndef "), "source", lit("(): pass\n```\nb\n```js\nx\n```\n```"), tag, lit("\nselect "),
        F.replace("text", lit("\n"), lit(" ")), lit(" end\n```\n"),
    )
    rows = table(spark, d, "documents").select("doc_id", text.alias("text"))
    return wb.extract_code_blocks(rows, "doc_id", F.col("text"))


@query(
    "g11_host_report",
    f"""WITH p AS (SELECT {AUTH.format(c='url')} AS host, page_id, url,
        len(list_distinct(list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: starts_with(x, '/')))) AS links FROM pages)
    SELECT host, count(*) AS pages, sum(links)::BIGINT AS links, string_agg(DISTINCT CASE
        WHEN regexp_matches(url, 'docs[.]|documentation|readthedocs|/docs/') THEN 'doc'
        WHEN regexp_matches(url, 'learn|course|tutorial') THEN 'course' ELSE 'web' END, ',') AS kinds, false AS low_quality
    FROM p GROUP BY host""",
)
def g11(spark, d):
    return wb.host_report(pages(spark, d))


@query(
    "e2_order_index",
    f"""WITH p AS (SELECT page_id, url, {AUTH.format(c='url')} AS host, regexp_replace(regexp_replace({PATH.format(c='url')},
        '(\\d+)', '{'0' * 20}\\1', 'g'), '\\d*(\\d{{20}})', '\\1', 'g') AS k FROM pages)
    SELECT page_id, url, host, row_number() OVER (PARTITION BY host ORDER BY k, page_id) - 1 AS order_index FROM p""",
)
def e2(spark, d):
    return wb.site_order(table(spark, d, "pages"))


@query(
    "j6_route_tasks",
    f"""WITH p AS ({LADDER_SQL}) SELECT CASE WHEN contains(url, 'github.com') THEN 'github' WHEN contains(url, 'arxiv.org') THEN 'arxiv'
        WHEN regexp_matches(lower(url), 'learn|course|tutorial') THEN 'course' ELSE 'web' END AS route, count(*) AS n FROM p GROUP BY 1""",
)
def j6(spark, d):
    return ex.route_tasks(_ladder(spark, d))


REGISTRY = registry_rows()
REGISTRY_SQL = "registry(ord, name, url, type, keyword) AS (VALUES " + ", ".join(
    "(%d, '%s', '%s', '%s', '%s')" % (i, r["name"], r["url"], r["type"], k.lower().replace("'", "''"))
    for i, r in enumerate(REGISTRY)
    for k in r["keywords"]
) + ")"


def _registry(spark):
    from ..sources.config import read_registry

    return read_registry(spark)


@query(
    "c1_match_registry",
    f"""WITH {REGISTRY_SQL}
    SELECT doc_id AS query_id, name, url, type, 100 + 10 * count(*) AS score
    FROM documents JOIN registry ON contains(lower(text), keyword) GROUP BY ALL""",
)
def c1(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("query_id"), "text")
    return ex.match_registry(rows, _registry(spark))


@query(
    "c2_fill_known_sources",
    f"""WITH {REGISTRY_SQL}, first_url AS (SELECT url, min(ord) AS ord FROM registry GROUP BY url)
    SELECT DISTINCT b.item_id AS topic_id, f.name, r.url, f.type, f.ord::BIGINT AS ord FROM benchmark b
    JOIN registry r ON contains(lower(b.text), r.keyword)
    JOIN first_url u ON u.url = r.url JOIN registry f ON f.ord = u.ord
    WHERE NOT (b.item_id % 2 = 1 AND r.url = '{REGISTRY[0]['url']}')""",
)
def c2(spark, d):
    """Every other topic already knows the first source."""
    known = F.when(F.col("item_id") % 2 == 1, F.array(F.lit(REGISTRY[0]["url"]))).otherwise(F.array().cast("array<string>"))
    topics = table(spark, d, "benchmark").select(
        F.col("item_id").alias("topic_id"), F.lit("").alias("name"), F.col("text").alias("description"),
        F.array().cast("array<string>").alias("search_queries"), known.alias("known_urls"),
    )
    return ex.fill_known_sources(topics, _registry(spark))


HITS_SQL = f"""hits AS (SELECT page_id AS seq, url, {NORM.format(c='url')} AS norm_url, {AUTH.format(c='url')} AS host,
      CASE WHEN contains(url, 'www.') THEN 'registry' WHEN contains(url, 'm.') THEN 'web' WHEN contains(url, 'blog.') THEN 'github' ELSE 'arxiv' END AS channel,
      CASE WHEN contains(url, 'www.') THEN 100 + 10 * length({AUTH.format(c='url')}) WHEN contains(url, 'm.') THEN 50
        WHEN contains(url, 'blog.') THEN least(70, 30 + (page_id * 37) // 1000) ELSE 60 END::BIGINT AS score,
      CASE WHEN contains(url, 'www.') THEN 0 WHEN contains(url, 'm.') THEN 1 WHEN contains(url, 'blog.') THEN 2 ELSE 3 END::BIGINT AS channel_ord
      FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, {NORM.format(c='url')} || '/' FROM pages))"""


def _addresses(spark, d):
    """Every page found twice, the second time under its plain address; one scan."""
    pair = F.array(
        F.struct(F.col("page_id").alias("seq"), F.col("url")),
        F.struct((F.col("page_id") + 1000000).alias("seq"), F.concat(ur.url_normalize(F.col("url")), F.lit("/")).alias("url")),
    )
    return table(spark, d, "pages").select(F.inline(pair))


def _host_kinds():
    return tuple(F.contains("url", F.lit(x)) for x in ("www.", "m.", "blog."))


def _channels(spark, d):
    """The same hits as separate channels."""
    www, mobile, blog = _host_kinds()
    both = _addresses(spark, d).select("seq", "url", F.lit("").alias("title"), F.lit("web").alias("type"))
    return ex.union_channels(
        both.where(www).withColumn("score", 100 + 10 * F.length(ur.authority(F.col("url")))),
        both.where(~www & mobile),
        both.where(~www & ~mobile & blog).withColumn("stars", F.col("seq") * 37),
        both.where(~www & ~mobile & ~blog),
    )


def _hits(spark, d):
    """Hits of one table that holds all channels, with their channel and score."""
    www, mobile, blog = _host_kinds()

    def pick(registry, web, github, arxiv):
        return F.when(www, registry).when(mobile, web).when(blog, github).otherwise(arxiv)

    score = pick(
        100 + 10 * F.length(ur.authority(F.col("url"))), F.lit(ex.WEB_SCORE), ex.github_score(F.col("seq") * 37), F.lit(ex.ARXIV_SCORE)
    )
    return _addresses(spark, d).select(
        "seq",
        "url",
        F.lit("").alias("title"),
        F.lit("web").alias("type"),
        pick(*map(F.lit, ("registry", "web", "github", "arxiv"))).alias("channel"),
        pick(*map(F.lit, range(4))).cast("long").alias("channel_ord"),
        score.cast("long").alias("score"),
    )


@query("i1_union_channels", f"WITH {HITS_SQL} SELECT channel, channel_ord, seq, url, score FROM hits")
def i1(spark, d):
    return _channels(spark, d).select("channel", "channel_ord", "seq", "url", "score")


DEDUP_SQL = f"""{HITS_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY norm_url ORDER BY score DESC, channel_ord, seq) AS rn,
      first_value((channel_ord, seq)) OVER (PARTITION BY norm_url ORDER BY channel_ord, seq) AS first_seen FROM hits WHERE norm_url <> '')"""


@query(
    "d7_dedup_urls",
    f"""WITH {DEDUP_SQL} SELECT norm_url, url, channel, score, first_seen[1] AS first_channel_ord, first_seen[2] AS first_seq
    FROM best WHERE rn = 1""",
)
def d7(spark, d):
    return ex.dedup_urls(_hits(spark, d), ("channel_ord", "seq")).select(
        "norm_url", "url", "channel", "score", "first_channel_ord", "first_seq"
    )


@query(
    "h3_explore_topk",
    f"""WITH {DEDUP_SQL} SELECT norm_url, channel, score FROM best WHERE rn = 1
    ORDER BY score DESC, first_seen[1], first_seen[2], norm_url LIMIT 10""",
)
def h3(spark, d):
    return ex.explore_topk(_hits(spark, d), 10, ("channel_ord", "seq")).select("norm_url", "channel", "score")


@query(
    "h7_channel_caps",
    f"""WITH {HITS_SQL}, r AS (SELECT host, channel, seq, url, row_number() OVER (PARTITION BY host, channel ORDER BY seq) AS hit_rank FROM hits)
    SELECT * FROM r WHERE hit_rank <= CASE channel WHEN 'web' THEN 5 WHEN 'github' THEN 5 WHEN 'arxiv' THEN 3 ELSE hit_rank END""",
)
def h7(spark, d):
    hits = _hits(spark, d).withColumn("host", ur.authority(F.col("url")))
    return ex.cap_channels(hits, ["host"], {"web": 5, "github": 5, "arxiv": 3}).select("host", "channel", "seq", "url", "hit_rank")


@query(
    "h7_search_terms",
    """WITH q AS (SELECT doc_id, lang, source, text AS head FROM documents)
    SELECT doc_id, CASE lang WHEN 'fr' THEN source || ' 中 教程 文档' WHEN 'de' THEN source || ' tutorial documentation'
      ELSE head || ' tutorial documentation|' || source || ' guide' END AS terms,
      CASE lang WHEN 'fr' THEN source || ' 中' WHEN 'de' THEN source ELSE head END AS term FROM q""",
)
def h7_terms(spark, d):
    """French rows ask in CJK only, German ones in both, the others in English."""
    head, src, cjk = F.col("text"), F.col("source"), F.concat("source", F.lit(" 中"))
    queries = F.when(F.col("lang") == "fr", F.array(cjk)).when(F.col("lang") == "de", F.array(cjk, src)).otherwise(F.array(head, src))
    return table(spark, d, "documents").select(
        "doc_id", F.concat_ws("|", ex.web_search_terms(queries)).alias("terms"), ex.catalogue_term(queries).alias("term")
    )


QUEUE_SQL = f"""queue AS (SELECT DISTINCT {NORM.format(c='url')} AS url, CASE WHEN contains(url, '/fr/') THEN 'processed' ELSE 'pending' END AS state
    FROM pages WHERE url LIKE 'https://%')"""


def _queue(spark, d):
    state = F.when(F.contains("url", F.lit("/fr/")), "processed").otherwise("pending")
    rows = table(spark, d, "pages").where(F.col("url").startswith("https://"))
    return rows.select(ur.url_normalize(F.col("url")).alias("url"), state.alias("state")).distinct()


@query(
    "i2_enqueue_urls",
    f"""WITH {QUEUE_SQL} SELECT {NORM.format(c='url')} AS url, min(page_id) AS seq, 'pending' AS state FROM pages
    WHERE {NORM.format(c='url')} NOT IN (SELECT url FROM queue) GROUP BY 1""",
)
def i2(spark, d):
    new = table(spark, d, "pages").select(ur.url_normalize(F.col("url")).alias("url"), F.col("page_id").alias("seq"))
    return ex.enqueue_urls(new, _queue(spark, d))


@query(
    "i3_mark_processed",
    f"""WITH {QUEUE_SQL} SELECT url, CASE WHEN state = 'pending' AND contains(url, 'blog.') THEN 'processed' ELSE state END AS state FROM queue""",
)
def i3(spark, d):
    queue = _queue(spark, d)
    return ex.mark_processed(queue, queue.where(F.contains("url", F.lit("blog."))))
