"""Queries over the materials table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import quality, text as tx
from ..operators import materials as mt
from ..operators.ordering import first_per_key
from ..session import scratch_path
from ..sources import tables
from .binding import ASSESSED_SQL, MATERIALS_SQL, documents, materials, table
from .registry import query

TOP = 100


def assessed(spark, d):
    return quality.assess(materials(spark, d))


@query(
    "publish_ready_topk",
    f"""WITH {ASSESSED_SQL},
    firsts AS (SELECT * FROM assessed WHERE order_index IN
               (SELECT min(order_index) FROM assessed GROUP BY content_hash))
    SELECT id, content_hash, title, score, grade, order_index FROM firsts WHERE ready
    ORDER BY score DESC, order_index, created_at DESC, id LIMIT {TOP}""",
)
def publish_ready_topk(spark, d):
    """Deduplicate by content, assess, keep what is ready and rank it.

    The score needs a few narrow values per row, so the bodies never shuffle:
    the first row of a hash is found by a map-side combined minimum.
    """
    narrow = assessed(spark, d).select(
        "content_hash", "order_index", "id", "title", "score", "grade", "ready", "created_at"
    )
    firsts = first_per_key(narrow, ["content_hash"], ["order_index", "id"])
    best = firsts.where("ready").orderBy(F.col("score").desc(), "order_index", F.col("created_at").desc(), "id")
    return best.limit(TOP).select("id", "content_hash", "title", "score", "grade", "order_index")


@query(
    "a1_read_materials",
    f"""WITH {MATERIALS_SQL}
    SELECT id, source_url, source_type, content_hash, title, language, array_to_string(tags, ',') AS tags,
           len(terms)::BIGINT AS n_terms, order_index FROM materials""",
)
def a1(spark, d):
    return materials(spark, d).select(
        "id", "source_url", "source_type", "content_hash", "title", "language",
        F.concat_ws(",", "tags").alias("tags"), F.size("terms").alias("n_terms"), "order_index",
    )


@query(
    "a2_decode_json_cols",
    """SELECT event_id, coalesce(try_cast(json_extract_string(
                CASE WHEN event_type = 'error' THEN NULL ELSE props END, '$.k') AS BIGINT), -1) AS k,
              event_type <> 'error' AS decoded FROM events""",
)
def a2(spark, d):
    """Props of error events are damaged on purpose: the first brace is cut."""
    ev = table(spark, d, "events").withColumn(
        "props", F.when(F.col("event_type") == "error", F.expr("substr(props, 2)")).otherwise(F.col("props"))
    )
    out = tables.decode_json_cols(ev, {"props": "map<string,bigint>"})
    k = F.try_element_at("props", F.lit("k"))
    return out.select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), (F.size("props") > 0).alias("decoded"))


@query(
    "a3_append_materials",
    f"""WITH {MATERIALS_SQL},
    store AS (SELECT * FROM materials WHERE len(tags) > 0),
    incoming AS (SELECT * FROM materials WHERE len(tags) = 0),
    kept AS (SELECT min(order_index) AS o FROM incoming
             WHERE content_hash NOT IN (SELECT content_hash FROM store) GROUP BY content_hash)
    SELECT id, source_type, content_hash FROM store WHERE order_index IN
           (SELECT min(order_index) FROM store GROUP BY content_hash)
    UNION ALL SELECT id, source_type, content_hash FROM incoming WHERE order_index IN (SELECT o FROM kept)""",
)
def a3(spark, d):
    """Labelled documents form the table, the others arrive as a second batch."""
    path = scratch_path(spark, "materials")
    rows = materials(spark, d)
    tables.append_materials(rows.where(F.size("tags") > 0), path)
    tables.append_materials(rows.where(F.size("tags") == 0), path)
    return spark.read.parquet(path).select("id", "source_type", "content_hash")


@query(
    "a4_delete_materials",
    """SELECT doc_id::VARCHAR AS id, source AS source_type, n_chars FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def a4(spark, d):
    path = scratch_path(spark, "materials")
    docs = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_type"), "n_chars"
    )
    docs.write.partitionBy("source_type").parquet(path)
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    tables.delete_materials(path, gone)
    return spark.read.parquet(path).select("id", "source_type", "n_chars")


@query(
    "a12_export_meta",
    f"""WITH {MATERIALS_SQL}
    SELECT id, title, language, order_index, array_to_string(tags, ',') AS tags FROM materials""",
)
def a12(spark, d):
    path = scratch_path(spark, "meta")
    keep = ["id", "title", "language", "order_index", "tags", "content"]
    tables.export_meta(materials(spark, d).select(*keep), path)
    schema = "id string, title string, language string, order_index bigint, tags array<string>"
    return spark.read.schema(schema).json(path).withColumn("tags", F.concat_ws(",", "tags"))


@query(
    "b1_filter_materials",
    f"""WITH {MATERIALS_SQL}
    SELECT id, source_type, title FROM materials
    WHERE source_type = 'src1' AND parent_id = 'src1' AND list_contains(tags, 'quality_1')
      AND list_contains(tags, 'toxic_0')
      AND (contains(lower(title), 'th') OR contains(lower(summary), 'th'))""",
)
def b1(spark, d):
    return mt.filter_materials(
        materials(spark, d, heavy=False), "src1", "src1", ["quality_1", "toxic_0"], "TH"
    ).select("id", "source_type", "title")


@query(
    "b7_content_hash",
    """SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, substr(md5(source || doc_id), 1, 12) AS thread_id,
              sha256(text) AS page_hash FROM documents""",
)
def b7(spark, d):
    return documents(spark, d).select(
        "doc_id",
        tx.content_hash(F.col("text")).alias("content_hash"),
        tx.thread_id(F.concat("source", F.col("doc_id").cast("string"))).alias("thread_id"),
        tx.page_hash(F.col("text")).alias("page_hash"),
    )


@query(
    "b12_completeness",
    f"""WITH {ASSESSED_SQL}
    SELECT id, missing_fields, missing_fields = '' AS is_complete, length(body)::BIGINT AS content_chars,
           len(tags)::BIGINT AS tag_count, len(terms)::BIGINT AS term_count, 0::BIGINT AS reference_count,
           0::BIGINT AS image_count, 0::BIGINT AS code_block_count FROM assessed""",
)
def b12(spark, d):
    return quality.completeness(materials(spark, d)).select(
        "id", F.concat_ws(",", "missing_fields").alias("missing_fields"), "is_complete", "content_chars",
        "tag_count", "term_count", "reference_count", "image_count", "code_block_count",
    )


@query(
    "b13_quality_score",
    f"""WITH {ASSESSED_SQL}
    SELECT id, score, grade, concat_ws(',', nullif(missing_fields, ''), 'missing_references', 'no_images',
           'no_code_blocks', CASE WHEN foreign_lang THEN 'non_chinese_content' END) AS flags FROM assessed""",
)
def b13(spark, d):
    scored = quality.quality_score(quality.completeness(materials(spark, d)))
    return scored.select("id", "score", "grade", F.concat_ws(",", "flags").alias("flags"))


@query(
    "b14_readiness",
    f"""WITH {ASSESSED_SQL}
    SELECT id, ready, concat_ws(',', nullif(missing_fields, ''),
           CASE WHEN score < 60 THEN 'quality_score_below_threshold' END) AS reasons FROM assessed""",
)
def b14(spark, d):
    return assessed(spark, d).select("id", "ready", F.concat_ws(",", "reasons").alias("reasons"))


@query(
    "c3_resolve_by_hash",
    f"""WITH {MATERIALS_SQL},
    store AS (SELECT content_hash, arg_min(id, (order_index, id)) AS sid FROM materials
              WHERE len(tags) > 0 GROUP BY 1),
    incoming AS (SELECT *, first_value(id) OVER (PARTITION BY content_hash ORDER BY order_index, id) AS first_id
                 FROM materials WHERE len(tags) = 0)
    SELECT id, content_hash, coalesce(sid, first_id) AS resolved_id, sid IS NULL AND first_id = id AS inserted
    FROM incoming LEFT JOIN store USING (content_hash)""",
)
def c3(spark, d):
    rows = materials(spark, d)
    return mt.resolve_by_hash(rows.where(F.size("tags") == 0), rows.where(F.size("tags") > 0))


@query(
    "c4_skip_known_urls",
    """WITH store AS (SELECT url, min(page_id) AS pid FROM pages WHERE url LIKE 'https://%' GROUP BY url)
    SELECT p.page_id, p.url FROM pages p WHERE p.url NOT IN (SELECT url FROM store)""",
)
def c4(spark, d):
    """The store holds the pages fetched over https; all pages are offered."""
    rows = table(spark, d, "pages").select("page_id", "url")
    store = rows.where(F.col("url").startswith("https://")).select(F.col("url").alias("source_url"))
    return mt.skip_known_urls(rows, store)


@query(
    "c5_fetch_by_ids",
    f"""WITH {MATERIALS_SQL},
    lists AS (SELECT item_id AS list_id, unnest([item_id * 2, item_id + 3, item_id * 1000003 + 7]) AS n,
                     unnest([0, 1, 2]) AS pos FROM benchmark)
    SELECT list_id, pos::BIGINT AS pos, id, m.title, m.source_type
    FROM lists JOIN materials m ON m.id = lists.n::VARCHAR""",
)
def c5(spark, d):
    return mt.fetch_by_ids(_id_lists(spark, d), materials(spark, d, heavy=False)).select(
        "list_id", "pos", "id", "title", "source_type"
    )


def _id_lists(spark, d):
    item = F.col("item_id")
    ids = F.array(*[c.cast("string") for c in (item * 2, item + 3, item * 1000003 + 7)])
    return table(spark, d, "benchmark").select(item.alias("list_id"), ids.alias("material_ids"))


@query(
    "c5_dangling_ids",
    """WITH lists AS (SELECT item_id AS list_id, unnest([item_id * 2, item_id + 3, item_id * 1000003 + 7]) AS n,
                     unnest([0, 1, 2]) AS pos FROM benchmark)
    SELECT list_id, pos::BIGINT AS pos, n::VARCHAR AS id FROM lists WHERE n NOT IN (SELECT doc_id FROM documents)""",
)
def c5_dangling(spark, d):
    store = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return mt.dangling_ids(_id_lists(spark, d), store)


@query(
    "c6_children",
    """WITH ranked AS (SELECT source AS parent_id, doc_id, row_number() OVER (PARTITION BY source
                     ORDER BY doc_id) AS child_rank FROM documents)
    SELECT parent_id, doc_id::VARCHAR AS id, child_rank FROM ranked WHERE child_rank <= 500""",
)
def c6(spark, d):
    rows = materials(spark, d, heavy=False).select("parent_id", "id", "order_index", "created_at")
    return mt.children(rows).select("parent_id", "id", "child_rank")


@query(
    "d1_count_by_type",
    """WITH vocab(source_type) AS (VALUES ('course'), ('course_page'), ('wechat'), ('github'), ('arxiv'),
           ('doc_page'), ('web'), ('src0'), ('src1'), ('src2'), ('src3'))
    SELECT v.source_type, count(d.doc_id) AS n FROM vocab v LEFT JOIN documents d ON d.source = v.source_type
    GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM documents""",
)
def d1(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("source_type"))
    return mt.count_by_type(rows, [*vocab.CLI_SOURCE_TYPES, "src0", "src1", "src2", "src3"])


def _label_tags(spark, d):
    tags = F.array(
        F.concat(F.lit("quality_"), F.col("quality").cast("string")),
        F.concat(F.lit("toxic_"), F.col("toxic").cast("string")),
    )
    return table(spark, d, "labels").select(tags.alias("tags"))


@query(
    "d2_all_tags",
    """SELECT DISTINCT tag FROM (SELECT 'quality_' || quality AS tag FROM labels
    UNION ALL SELECT 'toxic_' || toxic FROM labels)""",
)
def d2(spark, d):
    return mt.all_tags(_label_tags(spark, d))


@query(
    "d22_tag_cloud",
    """WITH t AS (SELECT 'quality_' || quality AS tag FROM labels UNION ALL SELECT 'toxic_' || toxic FROM labels)
    SELECT tag, count(*) AS n, round(count(*) / (SELECT count(*) FROM t)::DOUBLE, 6) AS share FROM t GROUP BY tag""",
)
def d22(spark, d):
    return mt.tag_cloud(_label_tags(spark, d))


@query(
    "e1_first_wins",
    f"""WITH {MATERIALS_SQL}
    SELECT id, content_hash, title FROM materials
    WHERE order_index IN (SELECT min(order_index) FROM materials GROUP BY content_hash)""",
)
def e1(spark, d):
    rows = materials(spark, d).select("id", "content_hash", "order_index", "title")
    return first_per_key(rows, ["content_hash"], ["order_index", "id"]).select("id", "content_hash", "title")


@query(
    "h1_query_materials",
    f"""WITH {ASSESSED_SQL},
    picked AS (SELECT * FROM assessed ORDER BY order_index, created_at DESC, id LIMIT {TOP})
    SELECT id, title, score, ready, row_number() OVER (ORDER BY ready DESC, score DESC, order_index,
           created_at DESC, id) AS pos FROM picked""",
)
def h1(spark, d):
    return _with_pos(mt.query_materials(assessed(spark, d), TOP))


@query(
    "h1_query_materials_global",
    f"""WITH {ASSESSED_SQL}
    SELECT id, title, score, ready, row_number() OVER (ORDER BY ready DESC, score DESC, order_index,
           created_at DESC, id) AS pos FROM assessed ORDER BY pos LIMIT {TOP}""",
)
def h1_global(spark, d):
    return _with_pos(mt.query_materials(assessed(spark, d), TOP, mode="global"))


def _with_pos(listing):
    """Number a listing, which is never longer than its limit."""
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.orderBy(*mt.priority_order()))
    return listing.select("id", "title", "score", "ready", pos.alias("pos"))


@query(
    "h2_prioritize",
    f"""WITH {ASSESSED_SQL}
    SELECT id, score, ready, row_number() OVER (ORDER BY ready DESC, score DESC, order_index,
           created_at DESC, id) AS priority FROM assessed""",
)
def h2(spark, d):
    rows = assessed(spark, d).select("id", "score", "ready", "order_index", "created_at")
    return mt.prioritize(rows).select("id", "score", "ready", "priority")


@query(
    "h9_outline_input",
    f"""WITH {ASSESSED_SQL}
    SELECT id, '[' || source_type || '] ' || title
           || CASE WHEN len(tags) > 0 THEN ' | 标签: ' || array_to_string(tags, ', ') ELSE '' END
           || ' | 质量:' || score || CASE WHEN ready THEN ' | 可出版' ELSE ' | 待整理' END
           || CASE WHEN summary <> '' THEN ' | ' || substr(summary, 1, 100) ELSE '' END AS summary_line
    FROM assessed ORDER BY ready DESC, score DESC, order_index, created_at DESC, id LIMIT 50""",
)
def h9(spark, d):
    return mt.outline_input(assessed(spark, d))
