"""The whole flows on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as ur
from ..operators import web as wb
from ..operators.explore import explore_topics
from .binding import MATERIALS_SQL, pages
from .flows import ingest_pages, publish
from .publish_queries import OUTLINE_SQL, PROV_SQL, QUALITY_SQL, REFS_SQL, _outline, _with_refs
from .registry import query
from .text_queries import AUTH, NORM, PATH, WS
from .web_queries import AREA, REGISTRY_SQL, UNESCAPE, _registry

EXTRACT_SQL = f"""x AS (SELECT page_id, url, {UNESCAPE.format(c="regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title,
      {UNESCAPE.format(c=f"array_to_string(list_filter(list_transform(string_split_regex(area, '<[^>]*>'), lambda x: trim(x, {WS})), lambda x: x <> ''), chr(10))")} AS content
    FROM (SELECT page_id, url, html, {AREA} AS area FROM pages))"""


@query(
    "course_ingest",
    f"""WITH {REGISTRY_SQL}, {EXTRACT_SQL},
    k AS (SELECT DISTINCT name AS tag, keyword FROM registry WHERE length(name) < 30),
    tags AS (SELECT page_id, least(5, count(DISTINCT tag)) AS n_tags FROM x JOIN k ON contains(lower(content), keyword) GROUP BY 1),
    terms AS (SELECT page_id, least(20, count(DISTINCT t)) AS n_terms FROM (SELECT page_id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM x)
              WHERE length(t) < 50 GROUP BY 1),
    f AS (SELECT x.*, coalesce(n_tags, 0) AS tag_count, coalesce(n_terms, 0) AS term_count, length(trim(content, {WS})) AS chars,
       length(regexp_replace(content, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS letters, len(regexp_extract_all(content, '[\\x{{4e00}}-\\x{{9fff}}]')) AS cjk
       FROM x LEFT JOIN tags USING (page_id) LEFT JOIN terms USING (page_id)),
    s AS (SELECT *, 95 - 20 * (trim(title, {WS}) = '')::INT - 35 * (chars < 80)::INT - 10 * (tag_count = 0)::INT - 10 * (term_count = 0)::INT
       - 10 * (letters > 0 AND cjk / letters <= 0.3)::INT AS score FROM f)
    SELECT page_id::VARCHAR AS id, url AS source_url, title, substr(sha256(content), 1, 16) AS content_hash, tag_count::BIGINT AS tag_count,
      term_count::BIGINT AS term_count, score::BIGINT AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' ELSE 'D' END AS grade,
      trim(title, {WS}) <> '' AND chars >= 80 AND tag_count > 0 AND term_count > 0 AND score >= 60 AS ready
    FROM s WHERE content = '' OR page_id IN (SELECT min(page_id) FROM x GROUP BY content)""",
)
def course_ingest(spark, d):
    """Pages extracted, enriched, assessed and deduplicated."""
    words = _registry(spark).select(F.col("name").alias("tag"), F.explode("keywords").alias("keyword"))
    out = ingest_pages(pages(spark, d), words)
    return out.select("id", "source_url", "title", "content_hash", "tag_count", "term_count", "score", "grade", "ready")


LOW_SQL = "('youtube.com', 'twitter.com', 'x.com', 'facebook.com', 'reddit.com', 'medium.com', 'readmedium.com', 'stackoverflow.com')"


@query(
    "explore_topics",
    f"""WITH {REGISTRY_SQL},
    x AS (SELECT page_id, regexp_extract({PATH.format(c='url')}, '^/([a-z]+)', 1) AS topic_id,
            CASE WHEN page_id % 5 = 0 THEN replace(url, 'example.com', 'x.com') ELSE url END AS url,
            regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages WHERE url IS NOT NULL),
    t AS (SELECT topic_id, arg_min(title, page_id) || ' langchain' AS q FROM x GROUP BY 1),
    web AS (SELECT *, row_number() OVER (PARTITION BY topic_id, page_id % 2 ORDER BY page_id) AS hit FROM x WHERE page_id % 3 = 0),
    git AS (SELECT *, page_id % 2 = 1 AS fallback, row_number() OVER (PARTITION BY topic_id, page_id % 2 ORDER BY page_id) AS hit FROM x WHERE page_id % 3 = 1),
    arx AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY page_id) AS hit FROM x WHERE page_id % 3 = 2),
    hits AS (
      SELECT topic_id, 'registry' AS channel, 0 AS c, ord AS seq, url, name AS title, type, 100 + 10 * count(*) AS score
        FROM t JOIN registry ON contains(lower(q), keyword) GROUP BY topic_id, ord, url, name, type
      UNION ALL SELECT topic_id, 'web', 1, page_id, url, title, CASE WHEN contains(url, 'github.com') THEN 'github' WHEN contains(url, 'arxiv.org') THEN 'arxiv'
          WHEN regexp_matches(url, 'docs[.]|documentation|readthedocs|/docs/') THEN 'doc' WHEN regexp_matches(url, 'learn|course|tutorial') THEN 'course' ELSE 'web' END, 50
        FROM web WHERE hit <= 5 AND replace({AUTH.format(c='url')}, 'www.', '') NOT IN {LOW_SQL}
      UNION ALL SELECT topic_id, 'github', 2, page_id, url, title, 'github', CASE WHEN fallback THEN least(65, 25 + page_id * 37 // 1000) ELSE least(70, 30 + page_id * 37 // 1000) END
        FROM git WHERE (NOT fallback AND hit <= 5) OR (fallback AND topic_id = 'fr' AND hit <= 3)
      UNION ALL SELECT topic_id, 'arxiv', 3, page_id, url, title, 'arxiv', 60 FROM arx WHERE hit <= 3),
    n AS (SELECT *, {NORM.format(c='url')} AS norm_url FROM hits),
    best AS (SELECT *, row_number() OVER (PARTITION BY topic_id, norm_url ORDER BY score DESC, c, seq) AS place,
        first_value((c, seq)) OVER (PARTITION BY topic_id, norm_url ORDER BY c, seq) AS seen FROM n WHERE norm_url <> ''),
    r AS (SELECT topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, seen, norm_url) AS rank, norm_url, url, title, type, channel, score::BIGINT AS score
      FROM best WHERE place = 1)
    SELECT * FROM r WHERE rank <= 10""",
)
def explore(spark, d):
    """Every language section as a topic; its pages are what the searches found. French topics ask in Chinese only."""
    page_id, url = F.col("page_id"), F.col("url")
    moved = F.when(page_id % 5 == 0, F.replace(url, F.lit("example.com"), F.lit("x.com"))).otherwise(url)
    found = pages(spark, d).where("url IS NOT NULL").select(
        F.regexp_extract(ur.path(url), "^/([a-z]+)", 1).alias("topic_id"), page_id.alias("seq"), moved.alias("url"), wb.page_title(F.col("html")).alias("title")
    )
    asked = F.concat(F.min_by("title", "seq"), F.lit(" langchain"))
    topics = found.groupBy("topic_id").agg(asked.alias("q"))
    cjk = F.concat("q", F.lit(" 中"))
    queries = F.when(F.col("topic_id") == "fr", F.array(cjk)).when(F.col("topic_id") == "de", F.array(cjk, F.col("q"))).otherwise(F.array("q"))
    kind = F.col("seq") % 3
    return explore_topics(
        topics.select("topic_id", queries.alias("queries")),
        _registry(spark),
        found.where(kind == 0).withColumn("term", F.col("seq") % 2),
        found.where(kind == 1).withColumns({"stars": F.col("seq") * 37, "fallback": F.col("seq") % 2 == 1}),
        found.where(kind == 2),
    )


PUBLISHED_SQL = f"""{MATERIALS_SQL}, r AS ({REFS_SQL}), {OUTLINE_SQL},
    numbered AS (SELECT *, dense_rank() OVER (ORDER BY chapter) AS chapter_no, row_number() OVER (PARTITION BY chapter ORDER BY item_id) AS section_no FROM outline),
    c AS (SELECT p.item_id, string_agg('--- 素材: ' || coalesce(nullif(title, ''), r.id) || ' ---' || chr(10) || {PROV_SQL} || chr(10) || '正文摘录:' || chr(10) || body,
      chr(10) || chr(10) ORDER BY pos) AS content FROM placed p JOIN r ON r.id = p.id WHERE body <> '' GROUP BY p.item_id),
    w AS (SELECT item_id, section, unnest(list_filter(string_split_regex(lower(section), '\\s+'), lambda x: length(x) > 2)) AS word FROM outline),
    n AS (SELECT item_id, count(*) AS n FROM w GROUP BY 1),
    hit AS (SELECT c.item_id, w.item_id AS other, any_value(w.section) AS title, any_value(o.section) AS own, count(*) AS m
      FROM c JOIN w ON contains(lower(c.content), w.word) JOIN outline o ON o.item_id = c.item_id GROUP BY ALL),
    rel AS (SELECT hit.item_id, title, row_number() OVER (PARTITION BY hit.item_id ORDER BY other) AS rk FROM hit JOIN n ON n.item_id = other WHERE m >= n * 0.3 AND title <> own),
    related AS (SELECT item_id, string_agg(title, '|' ORDER BY rk) AS related FROM rel WHERE rk <= 5 GROUP BY 1),
    sections AS (SELECT n.*, length(content)::BIGINT AS chars, {QUALITY_SQL}) AS flags, coalesce(related, '') AS related
      FROM numbered n JOIN c USING (item_id) LEFT JOIN related USING (item_id))"""


@query("publish_sections", f"WITH {PUBLISHED_SQL} SELECT item_id, chapter_no, section_no, chars, flags, related, 'default' AS content_type FROM sections")
def publish_sections(spark, d):
    """The outline written from its materials, with quality and related titles."""
    sections, _ = publish(_with_refs(spark, d), _outline(spark, d).drop("text"), 300, "item_id")
    return sections.select(
        "item_id", "chapter_no", "section_no", "chars", F.concat_ws(",", "flags").alias("flags"),
        F.concat_ws("|", "related").alias("related"), "content_type",
    )


@query(
    "publish_report",
    f"""WITH {PUBLISHED_SQL}, a AS (SELECT count(*) AS completed_sections, count(*) FILTER (flags <> '') AS flagged_sections FROM sections),
    e AS (SELECT count(*) AS expected_sections FROM numbered)
    SELECT completed_sections, flagged_sections, expected_sections, expected_sections - completed_sections AS missing_sections,
      CASE WHEN completed_sections = 0 THEN 'error' WHEN expected_sections > completed_sections OR flagged_sections > 0 THEN 'partial' ELSE 'success' END AS status FROM a, e""",
)
def publish_report(spark, d):
    _, report = publish(_with_refs(spark, d), _outline(spark, d).drop("text"), 300, "item_id")
    return report
