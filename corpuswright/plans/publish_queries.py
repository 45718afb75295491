"""Queries over outlines, sections, citations, terms, retrieval and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quality, text as tx
from ..operators import chunking as ck
from ..operators import citations as ct
from ..operators import materials as mt
from ..operators import publish as pb
from ..operators import related as rl
from ..operators import repos as rp
from ..operators import responses as rs
from ..operators import retrieval as rt
from ..operators import terms as tm
from ..operators import vectors as vt
from ..session import scratch_path
from ..sources import book as bk
from ..sources import files as fs
from ..sources import tables as tb
from .binding import ASSESSED_SQL, MATERIALS_SQL, documents, materials, table
from .registry import query
from .text_queries import CODE_SQL, WS, _code
from .web_queries import LINKED_SQL, REGISTRY_SQL, _linked, _registry

OUTLINE_SQL = """outline AS (SELECT item_id, 'Part ' || (item_id // 10) AS chapter, substr(split_part(text, chr(10), 1), 1, 40) AS section,
    [(item_id * 2)::VARCHAR, (item_id * 2 + 1)::VARCHAR, (item_id * 5 + 7)::VARCHAR] AS material_ids, text FROM benchmark),
  placed AS (SELECT item_id, unnest(material_ids) AS id, unnest([0, 1, 2]) AS pos FROM outline)"""


def _outline(spark, d):
    item = F.col("item_id")
    ids = F.array(*[c.cast("string") for c in (item * 2, item * 2 + 1, item * 5 + 7)])
    return table(spark, d, "benchmark").select(
        "item_id",
        F.concat(F.lit("Part "), F.floor(item / 10).cast("long").cast("string")).alias("chapter"),
        F.substring(F.substring_index("text", "\n", 1), 1, 40).alias("section"),
        ids.alias("material_ids"),
        "text",
    )


def _placed(spark, d, store):
    return mt.fetch_by_ids(_outline(spark, d), store, "item_id")


#: Materials with two references, one of them untitled in the French rows.
REFS_SQL = """SELECT *, 'https://github.com/' || language || '/' || source_type AS ref1, CASE language WHEN 'fr' THEN '' ELSE 'Repo ' || source_type END AS ref1_title,
   CASE language WHEN 'fr' THEN 'https://github.com/' || language || '/' || source_type ELSE 'Repo ' || source_type END AS ref1_shown FROM materials"""


def _with_refs(spark, d):
    url = F.concat(F.lit("https://github.com/"), "language", F.lit("/"), "source_type")
    title = F.when(F.col("language") == "fr", "").otherwise(F.concat(F.lit("Repo "), "source_type"))
    refs = F.array(
        F.struct(url.alias("url"), F.lit("github").alias("type"), title.alias("title")),
        F.struct(F.lit("").alias("url"), F.lit("").alias("type"), F.lit("Notes").alias("title")),
    )
    return materials(spark, d).withColumn("references", refs)


PROV_SQL = """'来源类型: ' || source_type || chr(10) || '来源链接: ' || source_url || chr(10) || '参考引用:' || chr(10)
    || '- [github] ' || ref1_shown || ' - ' || ref1 || chr(10) || '- [reference] Notes'"""


@query(
    "b25_format_provenance",
    f"""WITH {MATERIALS_SQL}, r AS ({REFS_SQL})
    SELECT id, {PROV_SQL} AS provenance, '**来源与延伸阅读：**' || chr(10) || '- [' || source_type || '] '
      || coalesce(nullif(title, ''), source_url) || ' - ' || source_url || chr(10) || '  - 延伸 [github] ' || ref1_shown || ' - ' || ref1 || chr(10)
      || '  - 延伸 [reference] Notes' || chr(10) || '- [source] https://extra.example/' || id AS sources FROM r""",
)
def b25(spark, d):
    rows = _with_refs(spark, d)
    mats = F.array(F.struct("id", "title", "source_type", "source_url", "references"))
    urls = F.array("source_url", F.concat(F.lit("https://extra.example/"), "id"))
    return rows.select("id", pb.provenance().alias("provenance"), pb.sources_block(mats, urls).alias("sources"))


@query(
    "c9_unassigned_materials",
    f"""WITH {ASSESSED_SQL}, {OUTLINE_SQL},
    rest AS (SELECT *, row_number() OVER (ORDER BY ready DESC, score DESC, order_index, created_at DESC, id) AS n FROM assessed
             WHERE id NOT IN (SELECT id FROM placed))
    SELECT id, n AS section_no, '补充 ' || n || ': ' || substr('[' || source_type || '] ' || title
      || CASE WHEN len(tags) > 0 THEN ' | 标签: ' || array_to_string(tags, ', ') ELSE '' END || ' | 质量:' || score
      || CASE WHEN ready THEN ' | 可出版' ELSE ' | 待整理' END || CASE WHEN summary <> '' THEN ' | ' || substr(summary, 1, 100) ELSE '' END, 1, 32) AS section FROM rest""",
)
def c9(spark, d):
    keep = ["id", "title", "source_type", "tags", "summary", "score", "ready", "order_index", "created_at"]
    rows = quality.assess(materials(spark, d)).select(*keep)
    return pb.unassigned_materials(rows, _outline(spark, d)).select("id", "section_no", "section")


@query(
    "c9_coverage",
    f"""WITH {OUTLINE_SQL} SELECT count(*) AS total_materials, count(*) FILTER (doc_id::VARCHAR IN (SELECT id FROM placed)) AS assigned_materials,
      count(*) FILTER (doc_id::VARCHAR NOT IN (SELECT id FROM placed)) AS auto_assigned_materials FROM documents""",
)
def c9_coverage(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return pb.coverage(rows, _outline(spark, d))


DONE_SQL = f"""{OUTLINE_SQL}, numbered AS (SELECT *, dense_rank() OVER (ORDER BY chapter) AS chapter_no,
     row_number() OVER (PARTITION BY chapter ORDER BY item_id) AS section_no FROM outline),
  done AS (SELECT n.*, CASE WHEN d.lang IN ('en', 'fr') THEN n.text ELSE '' END AS content,
     CASE WHEN d.lang = 'de' THEN '无可用素材' END AS reason FROM numbered n JOIN documents d ON d.doc_id = n.item_id * 2)"""


def _expected_and_done(spark, d):
    """Sections count as written where their first material is English or French."""
    numbered = pb.number_sections(_outline(spark, d), "item_id", F.floor(F.col("item_id") / 65536))
    docs = table(spark, d, "documents").select((F.col("doc_id") / 2).cast("long").alias("item_id"), "lang", "doc_id").where("doc_id = item_id * 2")
    done = numbered.join(docs, "item_id").withColumns(
        {
            "content": F.when(F.col("lang").isin("en", "fr"), F.col("text")).otherwise(""),
            "reason": F.when(F.col("lang") == "de", "无可用素材"),
        }
    )
    return numbered, done


@query(
    "c10_missing_sections",
    f"""WITH {DONE_SQL} SELECT n.chapter, n.section, n.chapter_no, n.section_no, coalesce(d.reason, '章节未生成') AS reason
    FROM numbered n LEFT JOIN done d USING (chapter_no, section_no) WHERE coalesce(d.content, '') = ''""",
)
def c10(spark, d):
    numbered, done = _expected_and_done(spark, d)
    return pb.missing_sections(numbered, done).select("chapter", "section", "chapter_no", "section_no", "reason")


QUALITY_SQL = f"""concat_ws(',', CASE WHEN len(regexp_extract_all(content, '[A-Za-z0-9_]+')) < 200 THEN 'too_short' END,
    CASE WHEN NOT regexp_matches(rtrim(content, {WS}), '[。！？.`|]$') THEN 'abrupt_end' END,
    CASE WHEN NOT contains(content, '## ') THEN 'missing_headings' END"""


@query(
    "d8_publish_status",
    f"""WITH {DONE_SQL}, q AS (SELECT *, {QUALITY_SQL}) AS flags FROM done WHERE content <> ''),
    c AS (SELECT count(*) AS completed_sections, count(*) FILTER (flags <> '') AS flagged_sections FROM q),
    e AS (SELECT count(*) AS expected_sections FROM numbered)
    SELECT completed_sections, flagged_sections, expected_sections, expected_sections - completed_sections AS missing_sections,
      CASE WHEN completed_sections = 0 THEN 'error' WHEN expected_sections > completed_sections OR flagged_sections > 0 THEN 'partial'
           ELSE 'success' END AS status FROM c, e""",
)
def d8(spark, d):
    numbered, done = _expected_and_done(spark, d)
    written = done.where("content <> ''").withColumn("passed", F.lit(True))
    return pb.publish_status(pb.section_quality(written, 300), numbered, pb.missing_sections(numbered, done))


@query(
    "d8_quality_summary",
    f"""WITH {DONE_SQL}, q AS (SELECT *, {QUALITY_SQL}) AS flags FROM done WHERE content <> '')
    SELECT chapter, section, flags FROM q WHERE flags <> ''""",
)
def d8_summary(spark, d):
    _, done = _expected_and_done(spark, d)
    written = done.where("content <> ''").withColumn("passed", F.lit(True))
    return pb.quality_summary(pb.section_quality(written, 300)).withColumn("flags", F.concat_ws(",", "flags"))


@query(
    "d9_section_quality",
    f"""WITH s AS (SELECT doc_id, text AS content, quality FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, length(content)::BIGINT AS chars, len(regexp_extract_all(content, '[A-Za-z0-9_]+'))::BIGINT AS units,
      {QUALITY_SQL}, CASE WHEN quality = 0 THEN 'review_failed' END) AS flags FROM s""",
)
def d9(spark, d):
    """A quality label of 0 stands for a failed review."""
    rows = documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", F.col("text").alias("content"), (F.col("quality") == 1).alias("passed")
    )
    out = pb.section_quality(rows, 300)
    return out.select("doc_id", "chars", F.col("estimated_length_units").alias("units"), F.concat_ws(",", "flags").alias("flags"))


@query(
    "d10_combine_materials",
    f"""WITH {MATERIALS_SQL}, r AS ({REFS_SQL}), {OUTLINE_SQL}
    SELECT p.item_id, 0::BIGINT AS part, count(*) AS pieces, string_agg('--- 素材: ' || coalesce(nullif(title, ''), r.id) || ' ---' || chr(10)
      || {PROV_SQL} || chr(10) || '正文摘录:' || chr(10) || body, chr(10) || chr(10) ORDER BY pos) AS content
    FROM placed p JOIN r ON r.id = p.id WHERE body <> '' GROUP BY p.item_id""",
)
def d10(spark, d):
    return pb.combine_materials(_placed(spark, d, _with_refs(spark, d)), ["item_id"])


KIND_SQL = "CASE source_type WHEN 'src0' THEN 'arxiv' WHEN 'src1' THEN 'github' WHEN 'src2' THEN 'course_page' ELSE 'web' END"


@query(
    "d11_section_content_type",
    f"""WITH {OUTLINE_SQL}, m AS (SELECT item_id, CASE source WHEN 'src0' THEN 'arxiv' WHEN 'src1' THEN 'github' WHEN 'src2' THEN 'course_page' ELSE 'web' END AS kind
      FROM placed JOIN documents ON doc_id::VARCHAR = id)
    SELECT item_id, CASE WHEN bool_or(kind = 'arxiv') THEN 'paper' WHEN bool_or(kind = 'github') THEN 'code'
      WHEN bool_or(kind = 'course_page') THEN 'tutorial' ELSE 'default' END AS content_type FROM m GROUP BY 1""",
)
def d11(spark, d):
    src = F.col("source_type")
    kind = F.when(src == "src0", "arxiv").when(src == "src1", "github").when(src == "src2", "course_page").otherwise("web")
    store = materials(spark, d, heavy=False).select("id", "source_type").withColumn("source_type", kind)
    return pb.section_content_type(_placed(spark, d, store), ["item_id"])


@query(
    "d12_collect_assets",
    f"""WITH {OUTLINE_SQL} SELECT item_id, 0::BIGINT AS part, string_agg('img' || id, ',' ORDER BY pos) AS images, string_agg(lang, ',' ORDER BY pos) AS languages,
      string_agg('https://corpus.example/' || source || '/' || doc_id, ',' ORDER BY pos) FILTER (lang <> 'es') AS source_urls
    FROM placed JOIN documents ON doc_id::VARCHAR = id GROUP BY item_id
    HAVING count(*) FILTER (lang <> 'es') > 0
    UNION ALL SELECT item_id, 0::BIGINT, string_agg('img' || id, ',' ORDER BY pos), string_agg(lang, ',' ORDER BY pos), ''
    FROM placed JOIN documents ON doc_id::VARCHAR = id GROUP BY item_id HAVING count(*) FILTER (lang <> 'es') = 0""",
)
def d12(spark, d):
    """One image and one code block per material; Spanish ones have no URL."""
    lit = F.lit
    store = materials(spark, d, heavy=False).select(
        "id",
        F.array(F.struct(F.concat(lit("img"), "id").alias("url"))).alias("images"),
        F.array(F.struct(F.col("language").alias("language"), lit("x").alias("code"))).alias("code_blocks"),
        F.when(F.col("language") != "es", F.col("source_url")).alias("source_url"),
    )
    out = pb.collect_assets(_placed(spark, d, store), ["item_id"])
    return out.select(
        "item_id", "part", F.concat_ws(",", F.transform("images", lambda x: x["url"])).alias("images"),
        F.concat_ws(",", F.transform("code_blocks", lambda x: x["language"])).alias("languages"),
        F.concat_ws(",", "source_urls").alias("source_urls"),
    )


@query(
    "d14_discovered_sources",
    f"""WITH {MATERIALS_SQL}, {OUTLINE_SQL} SELECT item_id AS topic_id, source_url AS url, source_type AS type, title FROM placed JOIN materials USING (id)""",
)
def d14(spark, d):
    topics = _outline(spark, d).select(F.col("item_id").alias("topic_id"), "material_ids")
    produced = topics.select("topic_id", F.explode("material_ids").alias("id"))
    store = materials(spark, d, heavy=False).select("id", "source_url", "source_type", "title")
    return pb.discovered_sources(topics, produced, store)


# --- references and citations --------------------------------------------------------


@query(
    "c7_reference_frontier",
    f"""WITH l AS ({LINKED_SQL}), i AS (SELECT *, regexp_extract(text, 'arxiv\\.org/pdf/(\\d+\\.\\d+)', 1) AS aid FROM l),
    refs AS (SELECT source AS parent_id, 'https://github.com/' || lang || '/' || source AS url, 'github' AS type FROM i
      UNION SELECT source, 'https://arxiv.org/abs/' || aid, 'arxiv' FROM i
      UNION SELECT source, 'https://github.com/plan/' || source, 'github' FROM i),
    store AS (SELECT 'https://arxiv.org/abs/' || aid AS url FROM i WHERE lang = 'en')
    SELECT * FROM refs WHERE url NOT IN (SELECT url FROM store)""",
)
def c7(spark, d):
    """The papers the English rows cite are stored already."""
    from ..functions.urls import references_in

    rows = _linked(spark, d).withColumn("references", references_in(F.col("text")))
    mats = rows.select(F.col("source").alias("parent_id"), "references", "lang")
    plan = mats.select("parent_id", F.concat(F.lit("https://github.com/plan/"), "parent_id").alias("url"), F.lit("github").alias("type"))
    papers = F.filter("references", lambda r: r["type"] == "arxiv")
    store = mats.where("lang = 'en'").select(F.explode(papers).alias("r")).select(F.col("r.url").alias("source_url"))
    return ct.reference_frontier(mats, plan, store)


@query(
    "c11_verify_citations",
    f"""WITH l AS ({LINKED_SQL}), i AS (SELECT doc_id, lang, regexp_extract(text, 'arxiv\\.org/pdf/(\\d+\\.\\d+)', 1) AS aid FROM l)
    SELECT doc_id, aid AS arxiv_id FROM i WHERE aid NOT IN (SELECT aid FROM i WHERE lang = 'en')
    UNION SELECT doc_id, '9912.' || lpad(doc_id::VARCHAR, 5, '0') FROM l""",
)
def c11(spark, d):
    """Every row also cites a paper in the prefixed form that no catalogue holds."""
    rows = _linked(spark, d)
    cited = F.concat(F.col("text"), F.lit(" ArXiv:9912."), F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    rows = rows.withColumn("text", cited)
    known = F.regexp_extract("text", r"arxiv\.org/pdf/(\d+\.\d+)", 1)
    catalog = rows.where("lang = 'en'").select(known.alias("arxiv_id"))
    return ct.verify_citations(rows, catalog, "doc_id", "text")


TOC = [
    {"dir_name": "00_src1 news", "name": "src1 news"},
    {"dir_name": "01_src2", "name": "two"},
    {"dir_name": "02_src12 deep", "name": "src12"},
]


@query(
    "c12_assign_category",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN CASE source WHEN 'src2' THEN '01_src2' WHEN 'src12' THEN '02_src12 deep' ELSE '00_src1 news' END
        WHEN lang = 'fr' THEN CASE WHEN source = 'src2' THEN '01_src2' WHEN source = 'src12' THEN '02_src12 deep' WHEN source = 'src1' THEN '00_src1 news' ELSE '00_src1 news' END
        WHEN lang = 'de' THEN NULL ELSE CASE WHEN source = 'src12' THEN '02_src12 deep' WHEN source = 'src2' THEN '01_src2' ELSE '00_src1 news' END END AS dir_name,
      CASE WHEN lang = 'de' THEN 'New ' || source END AS new_category FROM documents""",
)
def c12(spark, d):
    lang, src, lit = F.col("lang"), F.col("source"), F.lit
    decision = (
        F.when(lang == "en", F.concat(lit("ok\nEXISTING|"), F.when(src == "src2", "01_src2").when(src == "src12", "02_src12deep").otherwise("nowhere")))
        .when(lang == "fr", F.concat(lit("EXISTING|"), F.when(src == "src2", "_src2").when(src == "src12", "x02_src12 deep").otherwise("00_src1 news")))
        .when(lang == "de", F.concat(lit("NEW|07_New "), src, lit("|text")))
        .otherwise(F.concat(lit("perhaps "), F.when(src == "src12", "02_src12 deep").when(src == "src2", "number two").otherwise("none")))
    )
    rows = table(spark, d, "documents").select("doc_id", decision.alias("decision"))
    return ct.assign_category(rows, TOC).select("doc_id", "dir_name", "new_category")


@query(
    "c13_attach_catalog",
    """WITH papers AS (SELECT '2401.' || lpad(item_id::VARCHAR, 5, '0') AS arxiv_id, substr(text, 1, 20) AS paper_title FROM benchmark),
    repos AS (SELECT lang || '/' || source AS repo, count(*) AS stars FROM documents WHERE lang <> 'de' GROUP BY 1),
    u AS (SELECT doc_id, CASE lang WHEN 'en' THEN '2401.' || lpad(doc_id::VARCHAR, 5, '0') END AS arxiv_id,
          CASE WHEN lang <> 'en' THEN lang || '/' || source END AS repo FROM documents)
    SELECT doc_id, u.arxiv_id, u.repo, paper_title, stars FROM u LEFT JOIN papers USING (arxiv_id) LEFT JOIN repos USING (repo)""",
)
def c13(spark, d):
    lit, lang = F.lit, F.col("lang")
    docs = table(spark, d, "documents")
    paper = F.concat(lit("https://arxiv.org/abs/2401."), F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    url = F.when(lang == "en", paper).otherwise(F.concat(lit("https://github.com/"), lang, lit("/"), "source", lit(".git")))
    papers = table(spark, d, "benchmark").select(
        F.concat(lit("2401."), F.lpad(F.col("item_id").cast("string"), 5, "0")).alias("arxiv_id"), F.substring("text", 1, 20).alias("paper_title")
    )
    repos = docs.where("lang <> 'de'").groupBy(F.concat("lang", lit("/"), "source").alias("repo")).agg(F.count(lit(1)).alias("stars"))
    out = rp.attach_catalog(docs.select("doc_id", url.alias("url")), papers, repos)
    return out.select("doc_id", "arxiv_id", "repo", "paper_title", "stars")


# --- related sections, terms ---------------------------------------------------------

TITLE4 = "array_to_string(list_slice(string_split_regex(trim(text, {ws}), '\\s+'), 1, 4), ' ')".format(ws=WS)


def _title4():
    return F.concat_ws(" ", F.slice(F.split(tx.strip(F.col("text")), r"\s+"), 1, 4))


@query(
    "c8_related_sections",
    f"""WITH s AS (SELECT item_id AS ord, {TITLE4} AS title FROM benchmark),
    w AS (SELECT ord, title, unnest(list_filter(string_split_regex(lower(title), '\\s+'), lambda x: length(x) > 2)) AS word FROM s),
    n AS (SELECT ord, count(*) AS n FROM w GROUP BY 1),
    hit AS (SELECT d.doc_id AS id, w.ord, any_value(w.title) AS title, count(*) AS m, any_value(s.title) AS own
      FROM documents d JOIN w ON contains(lower(d.text), w.word) LEFT JOIN s ON s.ord = d.doc_id GROUP BY 1, 2),
    r AS (SELECT id, hit.ord, title AS related_title, row_number() OVER (PARTITION BY id ORDER BY hit.ord) AS related_rank
      FROM hit JOIN n USING (ord) WHERE m >= n.n * 0.3 AND title IS DISTINCT FROM own)
    SELECT * FROM r WHERE related_rank <= 5""",
)
def c8(spark, d):
    """Documents against the section titles; a document shares a title by number."""
    sections = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), _title4().alias("title"))
    contents = documents(spark, d).join(sections, F.col("doc_id") == F.col("ord"), "left").select(
        F.col("doc_id").alias("id"), "title", F.col("text").alias("content")
    )
    return rl.related_sections(contents, sections)


TOKENS_SQL = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents)"


@query(
    "d15_key_terms",
    f"""WITH {TOKENS_SQL}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE length(term) < 50 GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT doc_id, term, tf, df, round(tf * ln((SELECT count(*) FROM documents) / df::DOUBLE), 6) AS score FROM tf JOIN df USING (term)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS term_rank FROM s)
    SELECT doc_id, term_rank, term, tf, df, score FROM r WHERE term_rank <= 20""",
)
def d15(spark, d):
    return tm.key_terms(documents(spark, d), "doc_id", "text")


@query(
    "d16_topic_tags",
    f"""WITH {REGISTRY_SQL}, k AS (SELECT DISTINCT name AS tag, keyword FROM registry WHERE length(name) < 30),
    h AS (SELECT doc_id, tag, sum((length(text) - length(replace(lower(text), keyword, ''))) // length(keyword))::BIGINT AS hits
      FROM documents JOIN k ON contains(lower(text), keyword) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, tag) AS tag_rank FROM h)
    SELECT * FROM r WHERE tag_rank <= 5""",
)
def d16(spark, d):
    words = _registry(spark).select(F.col("name").alias("tag"), F.explode("keywords").alias("keyword"))
    return tm.topic_tags(documents(spark, d), words, "doc_id", "text")


@query(
    "d17_gap_report",
    f"""WITH {TOKENS_SQL}, t AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM tok WHERE length(term) < 50 GROUP BY 1),
    c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM benchmark)
    SELECT term, df, tf FROM t WHERE term NOT IN (SELECT term FROM c) ORDER BY df DESC, tf DESC, term LIMIT 30""",
)
def d17(spark, d):
    topics = table(spark, d, "benchmark").select(F.col("text").alias("topic"))
    return tm.gap_report(documents(spark, d), topics, "doc_id", "text").withColumn("tf", F.col("tf").cast("long"))


# --- chunking ------------------------------------------------------------------------

PARAS_SQL = """par AS (SELECT doc_id, string_split(text, chr(10)) AS raw, length(text) + len(string_split(text, chr(10))) - 1 AS n FROM documents)"""


def _paragraphs(spark, d):
    """Every line break becomes a blank line, so lines are paragraphs."""
    return documents(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def _chunk_sql(size: int, overlap: int) -> str:
    return f"""WITH RECURSIVE {PARAS_SQL},
    p AS (SELECT doc_id, list_filter(list_transform(raw, lambda x: trim(x, {WS})), lambda x: x <> '') AS ps FROM par WHERE n > {size}),
    w AS (SELECT doc_id, ps, 1 AS i, [ps[1]] AS cur, NULL::VARCHAR[] AS done, 0 AS no FROM p WHERE len(ps) > 0
      UNION ALL SELECT doc_id, ps, i + 1,
        CASE WHEN full_ THEN list_append(ov, ps[i + 1]) ELSE list_append(cur, ps[i + 1]) END,
        CASE WHEN full_ THEN cur END, CASE WHEN full_ THEN no + 1 ELSE no END
      FROM (SELECT *, length(array_to_string(cur, '')) + 2 * len(cur) + length(ps[i + 1]) + 2 > {size} AS full_,
              list_slice(cur, (SELECT max(j) FROM (SELECT unnest(generate_series(1, len(cur))) AS j) t
                 WHERE j = 1 OR length(array_to_string(list_slice(cur, j, len(cur)), '')) + 2 * (len(cur) - j + 1) >= {overlap}), len(cur)) AS ov
            FROM w WHERE i < len(ps))),
    c AS (SELECT doc_id, no - 1 AS chunk_no, array_to_string(done, chr(10) || chr(10)) AS chunk FROM w WHERE done IS NOT NULL
      UNION ALL SELECT doc_id, no, array_to_string(cur, chr(10) || chr(10)) FROM w WHERE i = len(ps)
      UNION ALL SELECT doc_id, 0, array_to_string(raw, chr(10) || chr(10)) FROM par WHERE n <= {size}
      UNION ALL SELECT p.doc_id, 0, array_to_string(raw, chr(10) || chr(10)) FROM p JOIN par USING (doc_id) WHERE len(ps) = 0)
    SELECT doc_id, chunk_no::BIGINT AS chunk_no, chunk FROM c"""


@query("f1_chunk_overlap", _chunk_sql(600, 100))
def f1(spark, d):
    """Small chunks (600 with 100 overlap), so most documents have several."""
    return ck.chunk_rows(_paragraphs(spark, d), "doc_id", "text", 600, 100)


@query("f1_chunk_overlap_default", _chunk_sql(6000, 500))
def f1_default(spark, d):
    return ck.chunk_rows(_paragraphs(spark, d), "doc_id", "text")


SEGMENT_SQL = f"""{PARAS_SQL},
    s AS (SELECT doc_id, raw, 1 AS i, raw[1] AS cur, NULL::VARCHAR AS done FROM par
      UNION ALL SELECT doc_id, raw, i + 1, CASE WHEN cur = '' OR full_ THEN raw[i + 1] ELSE cur || chr(10) || chr(10) || raw[i + 1] END,
        CASE WHEN full_ THEN trim(cur, {WS}) END
      FROM (SELECT *, length(cur) + length(raw[i + 1]) > 300 AND cur <> '' AS full_ FROM s WHERE i < len(raw))),
    e AS (SELECT doc_id, i, 0 AS last, done AS segment FROM s WHERE done IS NOT NULL
      UNION ALL SELECT doc_id, i, 1, trim(cur, {WS}) FROM s WHERE i = len(raw) AND trim(cur, {WS}) <> ''),
    seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, last) - 1 AS seg_no, segment FROM e)"""


@query("f2_segment", f"WITH RECURSIVE {SEGMENT_SQL} SELECT doc_id, seg_no, segment FROM seg")
def f2(spark, d):
    return ck.segment_rows(_paragraphs(spark, d), "doc_id", "text", 300)


@query(
    "f3_route_segments",
    f"""WITH RECURSIVE {SEGMENT_SQL} SELECT doc_id, seg_no, CASE WHEN starts_with(segment, '```') AND suffix(segment, '```') THEN 'code'
      WHEN length(segment) < 10 THEN 'short' ELSE 'translate' END AS route FROM seg""",
)
def f3(spark, d):
    return ck.route_segments(ck.segment_rows(_paragraphs(spark, d), "doc_id", "text", 300)).select("doc_id", "seg_no", "route")


@query(
    "f4_merge_plan",
    """WITH c AS (SELECT doc_id, greatest(1, ceil(n_chars / 500))::BIGINT AS drafts FROM documents)
    SELECT doc_id, drafts, CASE WHEN drafts <= 1 THEN 0 WHEN drafts <= 3 THEN 1 WHEN drafts <= 9 THEN 2 WHEN drafts <= 27 THEN 3 WHEN drafts <= 81 THEN 4
      WHEN drafts <= 243 THEN 5 WHEN drafts <= 729 THEN 6 WHEN drafts <= 2187 THEN 7 ELSE 8 END::BIGINT AS rounds FROM c""",
)
def f4(spark, d):
    drafts = F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 500)).cast("long")
    rows = table(spark, d, "documents").select("doc_id", drafts.alias("drafts"))
    return rows.withColumn("rounds", pb.merge_rounds(F.col("drafts")))


@query(
    "f5_chunk_targets",
    """SELECT doc_id, greatest(300, ceil(4000 / greatest(ceil(n_chars / 500), 1)))::BIGINT AS target FROM documents""",
)
def f5(spark, d):
    target = pb.chunk_target(F.lit(4000), F.ceil(F.col("n_chars") / 500))
    return table(spark, d, "documents").select("doc_id", target.alias("target"))


# --- retrieval -----------------------------------------------------------------------


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _label_queries(spark, d):
    """The first vector of every label is a query."""
    first = F.min_by("embedding", "id").alias("embedding")
    return _vectors(spark, d).groupBy(F.col("label").cast("long").alias("qid")).agg(first)


VECTOR_SQL = """cos AS (SELECT q.qid, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM q, embeddings e),
    vec AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cos)"""


@query(
    "k1_vector_topk",
    f"""WITH q AS (SELECT label::BIGINT AS qid, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label), {VECTOR_SQL}
    SELECT * FROM vec WHERE rank <= 10""",
)
def k1(spark, d):
    return vt.vector_topk(_label_queries(spark, d), _vectors(spark, d))


def _lists_sql() -> str:
    """The quantiser in SQL: sample, centroids after each round, level values, lists looked at."""
    near = "round(list_dot_product(u, c) - list_dot_product(c, c) / 2, 9)"
    rounds = ""
    for r in range(vt.ROUNDS):
        rounds += f"""
    a{r} AS (SELECT i, min(struct_pack(d := -{near}, j := j)).j AS j FROM s, c{r} GROUP BY i),
    m{r} AS (SELECT j, list(x ORDER BY p) AS c FROM (SELECT j, p, round(avg(x), 6) AS x
      FROM (SELECT j, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM a{r} JOIN s USING (i)) GROUP BY j, p) GROUP BY j),
    c{r + 1} AS (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (j)),"""
    return f"""v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
    u AS (SELECT id, e, list_transform(e, lambda x: coalesce(round(x / nullif(sqrt(list_dot_product(e, e)), 0), 7), 0)) AS u FROM v),
    size AS (SELECT count(*) AS n, greatest(1, least({vt.MAX_LISTS}, round(sqrt(count(*)) / 2))) AS lists FROM u),
    s AS (SELECT u, row_number() OVER (ORDER BY h, id) AS i FROM (SELECT *, id % 2147483648 * 2654435761 % 4294967296 AS h FROM u), size
      WHERE h < {vt.SAMPLE} * 4294967296.0::DOUBLE / n),
    c0 AS (SELECT i - 1 AS j, u AS c FROM s, size WHERE i <= lists),{rounds}
    lv AS (SELECT p, list_transform(range(1, {vt.LEVELS}), lambda k: o[(k * m // {vt.LEVELS} + 1)::INT]) AS edges,
                  list_transform(range({vt.LEVELS}), lambda k: o[((2 * k + 1) * m // {2 * vt.LEVELS} + 1)::INT]) AS vals
      FROM (SELECT p, list(x ORDER BY x) AS o, count(*) AS m FROM (SELECT unnest(u) AS x, generate_subscripts(u, 1) AS p FROM s) GROUP BY p)),
    coded AS (SELECT id, list(y ORDER BY p) AS code FROM (
        SELECT id, p, vals[1 + len(list_filter(edges, lambda b: b <= x))] AS y
        FROM (SELECT id, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM u) JOIN lv USING (p)) GROUP BY id),
    home AS (SELECT id, min(struct_pack(d := -{near}, j := j)).j AS j FROM u, c{vt.ROUNDS} GROUP BY id),
    tried AS (SELECT a.i, b.i AS o, row_number() OVER (PARTITION BY a.i ORDER BY round(list_dot_product(a.u, b.u), 6) DESC, b.i) AS place
      FROM s a, s b WHERE a.i <= {vt.TRIALS} AND a.i <> b.i),
    order_ AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY {near} DESC, j) AS place FROM s, c{vt.ROUNDS}),
    first_ AS (SELECT i, j FROM order_ WHERE place = 1),
    looked AS (SELECT list(w.place ORDER BY w.place)[ceil({vt.COVERED} * count(*))::INT] AS probes
      FROM tried t JOIN first_ f ON f.i = t.o JOIN order_ w ON w.i = t.i AND w.j = f.j WHERE t.place <= 10)"""


@query(
    "k5_approx_vector_topk",
    f"""WITH {_lists_sql()},
    q AS (SELECT id AS qid, e AS qe, u FROM u WHERE id % 20 = 0),
    asked AS (SELECT qid, qe, u, j FROM (SELECT qid, qe, u, j, row_number() OVER (PARTITION BY qid
        ORDER BY round(list_dot_product(u, c) - list_dot_product(c, c) / 2, 9) DESC, j) AS place FROM q, c{vt.ROUNDS}), looked WHERE place <= probes),
    found AS (SELECT qid, qe, h.id, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(a.u, d.code), 6) DESC, h.id) AS place
      FROM asked a JOIN home h USING (j) JOIN coded d ON d.id = h.id),
    r AS (SELECT qid, f.id, round(list_cosine_similarity(qe, e), 6) AS score FROM found f JOIN v ON v.id = f.id WHERE place <= {10 * vt.CANDIDATES}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM r)
    SELECT * FROM ranked WHERE rank <= 10""",
)
def k5(spark, d):
    asked = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return vt.approx_vector_topk(asked, _vectors(spark, d))


BM25_SQL = """dt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents),
    dl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS dl FROM documents),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    bm AS (SELECT qt.qid, tf.doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY ALL),
    kw AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm)"""
QT_SQL = f"qt AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM benchmark"


def _keyword_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), tx.word_tokens(F.col("text")).alias("tokens"))


def _doc_chunks(spark, d):
    """Chunks of the documents; they have no blank lines, so one each."""
    chunks = ck.chunk_rows(documents(spark, d), "doc_id", "text")
    return chunks.select(F.col("doc_id").alias("id"), "chunk_no", F.col("chunk").alias("text"))


@query("k2_keyword_topk", f"WITH {QT_SQL}), {BM25_SQL} SELECT qid, id, 0::BIGINT AS chunk_no, score, rank FROM kw WHERE rank <= 10")
def k2(spark, d):
    return rt.keyword_topk(_keyword_queries(spark, d), _doc_chunks(spark, d))


@query(
    "k3_hybrid_topk",
    f"""WITH {QT_SQL}), {BM25_SQL},
    q AS (SELECT item_id AS qid, embedding FROM benchmark JOIN embeddings ON vec_id = item_id), {VECTOR_SQL},
    both_ AS (SELECT qid, id, rank FROM vec WHERE rank <= 20 UNION ALL SELECT qid, id, rank FROM kw WHERE rank <= 20),
    fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM both_ WHERE qid IN (SELECT qid FROM kw) GROUP BY ALL),
    top AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, 'hybrid' AS mode FROM fused)
    SELECT * FROM top WHERE rank <= 10 UNION ALL
    SELECT qid, id, score, rank, 'naive' FROM vec WHERE rank <= 10 AND qid NOT IN (SELECT qid FROM kw)""",
)
def k3(spark, d):
    keyed = _keyword_queries(spark, d)
    vectors = _vectors(spark, d)
    asked = keyed.select("qid").join(vectors, F.col("qid") == F.col("id")).select("qid", "embedding")
    return rt.hybrid_topk(vt.vector_topk(asked, vectors, 20), rt.keyword_topk(keyed, _doc_chunks(spark, d), 20))


@query(
    "k4_index_text",
    f"""WITH t AS (SELECT doc_id AS id, source, trim('来源: ' || source || chr(10) || '主题: ' || lang, {WS}) AS head, text, trim(text, {WS}) AS body,
       '来源: ' || source || chr(10) || '主题: ' || lang || chr(10) || chr(10) || text AS full_ FROM documents)
    SELECT id, source, 0::BIGINT AS chunk_no, CASE WHEN length(full_) <= 6000 THEN full_ WHEN length(head) + length(body) + 4 <= 6000 THEN head || chr(10) || chr(10) || body
       ELSE head END AS chunk FROM t
    UNION ALL SELECT id, source, 1, head || chr(10) || chr(10) || body FROM t WHERE length(full_) > 6000 AND length(head) + length(body) + 4 > 6000""",
)
def k4(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("topic"), F.col("text").alias("content"))
    return rt.index_text(rows, scratch_path(spark, "index"))


# --- replies and conversations --------------------------------------------------------


@query(
    "d21_conversation_flatten",
    f"""SELECT conv_id, turn // 1000 AS part, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system'), '') AS system_text,
      coalesce(string_agg('[' || role || ']' || chr(10) || trim(text, {WS}), chr(10) || chr(10) ORDER BY turn)
        FILTER (role <> 'system' AND trim(text, {WS}) <> ''), '') AS prompt FROM conversations GROUP BY conv_id, turn // 1000""",
)
def d21(spark, d):
    return rs.flatten_conversations(table(spark, d, "conversations"))


def _fake_model(prompt: str) -> tuple[str, str]:
    """Deterministic stand-in for a model: refuses prompts with an accent."""
    if "é" in prompt:
        raise ValueError("accent")
    return prompt[:20].upper(), str(len(prompt))


@query(
    "l1_run_model",
    """SELECT conv_id * 1000 + turn AS id, NOT contains(text, 'é') AS success, CASE WHEN contains(text, 'é') THEN '' ELSE length(text)::VARCHAR END AS data,
      CASE WHEN contains(text, 'é') THEN 'Worker fake failed (2 retries): accent' ELSE '' END AS error,
      CASE WHEN contains(text, 'é') THEN 3 ELSE 1 END::BIGINT AS attempts FROM conversations""",
)
def l1(spark, d):
    prompts = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("prompt"))
    out = rs.run_model(prompts, _fake_model, retries=2, name="fake")
    return out.select("id", "success", "data", "error", "attempts")


def _turns(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("flat")
    )


FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def _reviews(spark, d):
    lit, w = F.lit, F.col("flat")
    reply = F.concat(
        lit("SCORE: 3/5\nPASSED: "), F.when(F.col("role") == "user", "Yes").otherwise("no"), lit("\nIssues:\n- first "), w,
        lit("\n -  second\n* not a bullet\nSUGGESTIONS:\n- more "), w, lit("\n"),
    )
    return rs.parse_reviews(_turns(spark, d).withColumn("reply", reply))


@query(
    "l2_parse_reviews",
    f"""SELECT conv_id * 1000 + turn AS id, role = 'user' AS passed, 'first ' || {FLAT} || '|second' AS issues, 'more ' || {FLAT} AS suggestions FROM conversations""",
)
def l2(spark, d):
    return _reviews(spark, d).select(
        "id", "passed", F.concat_ws("|", "issues").alias("issues"), F.concat_ws("|", "suggestions").alias("suggestions")
    )


@query(
    "d20_review_rollup",
    """SELECT conv_id, count(*) AS reviews, round(avg((role = 'user')::INT), 6) AS pass_rate, (2 * count(*))::BIGINT AS issues FROM conversations GROUP BY 1""",
)
def d20(spark, d):
    return rs.review_rollup(_reviews(spark, d), ["conv_id"])


@query(
    "l3_parse_gap_sections",
    f"""SELECT conv_id * 1000 + turn AS id, {FLAT} || '|again' AS gaps, 'topic: ' || role AS suggestions FROM conversations""",
)
def l3(spark, d):
    lit = F.lit
    reply = F.concat(lit("- ignored\n## 知识缺口\n- "), "flat", lit("\n-- again\n## 建议补充\n- topic: "), "role", lit("\nend"))
    out = rs.parse_gap_sections(_turns(spark, d).withColumn("reply", reply))
    return out.select("id", F.concat_ws("|", "gaps").alias("gaps"), F.concat_ws("|", "suggestions").alias("suggestions"))


def _short_sql(max_len: int, marks: str) -> str:
    """Lines of a reply that are short enough, without their marks."""
    clean = f"trim(trim(trim(x, '-'), {WS}), '•')"
    clean = f"trim({clean}, '#')" if "#" in marks else clean
    return f"""list_transform(list_filter(list_transform(raw, lambda x: trim(x, {WS})), lambda x: x <> '' AND length(x) < {max_len}),
        lambda x: trim({clean}, {WS}))"""


@query(
    "l4_parse_bullets",
    f"""WITH f AS (SELECT conv_id * 1000 + turn AS id, {FLAT} AS flat FROM conversations),
    p AS (SELECT id, flat, list_transform(string_split_regex(flat, '[.,;] '), lambda x, i: CASE WHEN i = 1 THEN x ELSE '- ' || x END) AS phrases FROM f),
    terms AS (SELECT id, {_short_sql(50, '•')} AS t FROM (SELECT id, ['- GPU'] || phrases || ['• gpu', repeat('x', 60)] AS raw FROM p)),
    tags AS (SELECT id, {_short_sql(30, '•#')} AS t FROM (SELECT id, ['#deep'] || phrases || ['- a', '', 'b', 'c', 'd'] AS raw FROM p))
    SELECT p.id, 'one ' || flat || '|two' AS outline,
      array_to_string(list_filter(terms.t, lambda x, i: list_position(list_transform(terms.t, lambda y: lower(y)), lower(x)) = i)[:20], '|') AS terms,
      array_to_string(tags.t[:5], '|') AS tags FROM p JOIN terms USING (id) JOIN tags USING (id)""",
)
def l4(spark, d):
    """The whole text of every turn as the lines of a reply, a line per phrase."""
    lit = F.lit
    phrases = F.regexp_replace("flat", "[.,;] ", "\n- ")
    outline = F.concat(lit("intro\n - one "), "flat", lit("\n** two\nend"))
    terms = F.concat(lit("- GPU\n"), phrases, lit("\n• gpu\n"), F.repeat(lit("x"), 60))
    tags = F.concat(lit("#deep\n"), phrases, lit("\n- a\n\nb\nc\nd"))
    return _turns(spark, d).select(
        "id", F.concat_ws("|", rs.parse_outline(outline)).alias("outline"), F.concat_ws("|", rs.parse_terms(terms)).alias("terms"),
        F.concat_ws("|", rs.parse_tags(tags)).alias("tags"),
    )


@query(
    "l5_align_code_comments",
    """SELECT doc_id, unnest([0, 1, 2])::BIGINT AS i, unnest(['about ' || source, '', 'third']) AS comment FROM documents""",
)
def l5(spark, d):
    lit = F.lit
    docs = table(spark, d, "documents")
    blocks = docs.select("doc_id", F.explode(F.array(*[lit(i).cast("long") for i in range(3)])).alias("i"))
    reply = F.concat(lit("BLOCK_0: about "), "source", lit("\nso BLOCK_2: third\nBLOCK_0: too late\n"))
    return rs.align_code_comments(blocks, docs.select("doc_id", reply.alias("reply")), "doc_id")


@query(
    "l6_parse_fact_issues",
    """SELECT doc_id, 'conflict' AS kind, 0::BIGINT AS pos, 'RAG 交叉验证: ' || source || ' differs' AS issue FROM documents WHERE lang = 'en'
    UNION ALL SELECT doc_id, 'conflict', 2, 'RAG 交叉验证: a longer remark' FROM documents WHERE lang = 'en'
    UNION ALL SELECT doc_id, 'source', 1, '来源归属: no source for ' || source FROM documents WHERE lang = 'fr'""",
)
def l6(spark, d):
    lit, lang = F.lit, F.col("lang")
    kind = F.when(lang.isin("en", "de"), "conflict").otherwise("source")
    reply = (
        F.when(lang == "en", F.concat(lit("矛盾|"), "source", lit(" differs\nshort\na longer remark\n其他矛盾的说明文字")))
        .when(lang == "fr", F.concat(lit("checked\n归属问题|no source for "), "source"))
        .when(lang == "de", lit("无矛盾\n矛盾|not counted")).otherwise(lit("归属充分"))
    )
    rows = table(spark, d, "documents").select("doc_id", kind.alias("kind"), reply.alias("reply"))
    return rs.parse_fact_issues(rows, "doc_id")


@query(
    "l7_normalize_topics",
    f"""WITH t AS (SELECT conv_id, turn, trim(CASE role WHEN 'system' THEN ' ' ELSE {FLAT} END) AS name FROM conversations),
    f AS (SELECT conv_id, name, min(turn) AS turn FROM t WHERE name <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS topic_rank FROM f)
    SELECT conv_id, name, turn, 'pending' AS status, 'intermediate' AS difficulty, topic_rank FROM r WHERE topic_rank <= 4""",
)
def l7(spark, d):
    """Turns as proposed topics; system turns have no name."""
    name = F.when(F.col("role") == "system", " ").otherwise(F.trim(F.regexp_replace("text", r"\s+", " ")))
    none = F.lit(None).cast("string")
    topics = table(spark, d, "conversations").select(
        "conv_id", "turn", name.alias("name"), none.alias("status"), none.alias("difficulty"), none.alias("description"), none.alias("topic_count")
    )
    return rs.normalize_topics(topics, "conv_id", "turn").select("conv_id", "name", "turn", "status", "difficulty", "topic_rank")


@query(
    "l8_parse_category_decision",
    """SELECT doc_id, CASE WHEN lang = 'de' THEN 'Category ' || source ELSE NULL END AS new_category,
      CASE WHEN lang = 'de' THEN NULL ELSE '01_src2' END AS dir_name FROM documents""",
)
def l8(spark, d):
    """The first decision line counts, whatever stands around it."""
    lit = F.lit
    text = F.when(F.col("lang") == "de", F.concat(lit("hm\n  NEW| 03_Category "), "source", lit("|about\nEXISTING|01_src2"))).otherwise(
        lit("EXISTING|01_src2\nNEW|x|y")
    )
    return ct.assign_category(table(spark, d, "documents").select("doc_id", text.alias("decision")), TOC).select("doc_id", "dir_name", "new_category")


# --- files -----------------------------------------------------------------------------


def _book(spark, d):
    """Sections of the outline written as files; returns the folder."""
    numbered = pb.number_sections(_outline(spark, d), "item_id", F.floor(F.col("item_id") / 65536))
    sections = pb.section_quality(
        numbered.select("*", F.col("text").alias("content"), F.lit(1).alias("chunk_count"), F.lit(True).alias("passed")), 300
    )
    out = scratch_path(spark, "book")
    report = sections.agg(F.lit("Sample").alias("title"), F.count(F.lit(1)).alias("completed_sections"))
    bk.write_book(sections, report, out)
    return out


FILE_SQL = """'chapter_dir=' || lpad(chapter_no::VARCHAR, 2, '0') || '_' || replace(chapter, ' ', '_')"""
CONTENT_SQL = f"""'# ' || section || chr(10) || chr(10) || '> 出版质量信息' || chr(10) || '> - 字符数: ' || length(text) || chr(10) || '> - 估算长度单位: '
    || len(regexp_extract_all(text, '[A-Za-z0-9_]+')) || chr(10) || '> - 写作分块: 1' || CASE WHEN {QUALITY_SQL.replace('content', 'text')}) <> '' THEN chr(10) || '> - 风险标记: ' || replace({QUALITY_SQL.replace('content', 'text')}), ',', ', ') ELSE '' END
    || chr(10) || rtrim(text, {WS}) || chr(10)"""


@query(
    "a11_write_book",
    f"""WITH {OUTLINE_SQL}, n AS (SELECT *, dense_rank() OVER (ORDER BY chapter) AS chapter_no FROM outline)
    SELECT lpad(chapter_no::VARCHAR, 2, '0') || '_' || replace(chapter, ' ', '_') AS chapter_dir, {CONTENT_SQL} AS content FROM n""",
)
def a11(spark, d):
    book = fs.read_markdown(spark, _book(spark, d) + "/sections")
    return book.select(F.regexp_extract("path", r"chapter_dir=([^/]+)", 1).alias("chapter_dir"), "content")


@query("a10_read_markdown", f"WITH {OUTLINE_SQL} SELECT length({CONTENT_SQL})::BIGINT AS chars, md5({CONTENT_SQL}) AS body FROM outline")
def a10(spark, d):
    book = fs.read_markdown(spark, _book(spark, d) + "/sections")
    return book.select(F.length("content").alias("chars"), F.md5("content").alias("body"))


TREE_SQL = f"""named AS (SELECT dense_rank() OVER (ORDER BY chapter) AS ch, row_number() OVER (PARTITION BY chapter ORDER BY item_id) AS sec, chapter,
    substr(replace(trim(regexp_replace(regexp_replace(section, '^第?\\d+[章节.]\\s*', ''), '[<>:"/\\\\|?*]', '', 'g'), {WS}), ' ', '_'), 1, 40) AS safe FROM outline),
    paths AS (SELECT 'chapter_dir=' || lpad(ch::VARCHAR, 2, '0') || '_' || replace(chapter, ' ', '_') AS dir,
      'section_file=' || lpad(sec::VARCHAR, 2, '0') || '_' || CASE WHEN safe = '' THEN 'untitled' ELSE safe END || '.md' AS file FROM named),
    nodes AS (SELECT DISTINCT dir AS name, dir AS path, 'directory' AS type FROM paths
      UNION ALL SELECT file, dir || '/' || file, 'directory' FROM paths
      UNION ALL SELECT 'part.txt', dir || '/' || file || '/part.txt', 'file' FROM paths)"""


def _tree(spark, d):
    """Folders and files of the written book; the names Spark gave the files are cut to ``part.txt``."""
    tree = fs.read_kb_tree(spark, _book(spark, d) + "/sections")
    plain = lambda c: F.regexp_replace(c, r"part-[^/]*(\.[a-z]+)$", "part$1").alias(c)
    return tree.select(plain("name"), plain("path"), "type").distinct()


@query("a9_read_kb_tree", f"WITH {OUTLINE_SQL}, {TREE_SQL} SELECT * FROM nodes")
def a9(spark, d):
    return _tree(spark, d)


@query("b31_kb_filter", f"WITH {OUTLINE_SQL}, {TREE_SQL} SELECT * FROM nodes WHERE contains(lower(path), 'part_1')")
def b31(spark, d):
    return fs.kb_filter(_tree(spark, d), " PART_1 ")


@query(
    "a13_export_code_blocks",
    f"""WITH c AS ({CODE_SQL}) SELECT doc_id::VARCHAR AS id, unnest([0, 1])::BIGINT AS i, unnest(['block_0.' || lang, 'block_1.txt']) AS file_name, unnest([code, source]) AS code FROM c""",
)
def a13(spark, d):
    blocks = F.array(
        F.struct(F.col("lang").alias("language"), F.col("code").alias("code")), F.struct(F.lit("").alias("language"), F.col("source").alias("code"))
    )
    out = scratch_path(spark, "code")
    tb.export_code_blocks(_code(spark, d).select(F.col("doc_id").cast("string").alias("id"), blocks.alias("code_blocks")), out)
    return spark.read.parquet(out).select("id", "i", "file_name", "code")


@query(
    "a14_image_mime",
    """SELECT doc_id::VARCHAR AS path, (CASE lang WHEN 'de' THEN 8 WHEN 'es' THEN 6 ELSE 12 END + length(source))::BIGINT AS length,
      CASE lang WHEN 'en' THEN 'image/jpeg' WHEN 'fr' THEN 'image/webp' WHEN 'de' THEN 'image/png' ELSE 'image/gif' END AS mime FROM documents""",
)
def a14(spark, d):
    """Image heads by language; the type comes from the bytes alone."""
    lang = F.col("lang")
    head = F.when(lang == "en", "FFD8FF000000000000000000").when(lang == "fr", "524946460000000057454250").when(lang == "de", "89504E470D0A1A0A").otherwise("474946383961")
    content = F.concat(F.unhex(head), F.to_binary("source", F.lit("utf-8")))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return fs.with_mime(rows.withColumn("length", F.octet_length("content").cast("long")))
