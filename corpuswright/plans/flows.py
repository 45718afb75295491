"""Whole flows put together from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quality
from ..functions import text as tx
from ..functions import urls as ur
from ..operators import publish as pb
from ..operators import terms as tm
from ..operators import web as wb
from ..operators.materials import fetch_by_ids, first_wins, new_materials
from ..operators.related import related_sections
from ..session import materialize


def ingest_pages(pages: DataFrame, dictionary: DataFrame, store: DataFrame | None = None, source_type: str = "course_page") -> DataFrame:
    """Pages to assessed, deduplicated materials.

    Extraction is the only step in Python. Copies, and what ``store`` holds, are
    dropped before anything else is computed. References are read from the
    extracted text; terms and tags come from token counts and the keyword
    dictionary over the new pages, at most twenty and five per page. The
    language follows the script of the text.
    """
    content = F.col("content")
    extracted = materialize(
        wb.pages_to_materials(pages).select(
            F.col("page_id").cast("string").alias("id"),
            F.col("url").alias("source_url"),
            F.lit(source_type).alias("source_type"),
            F.when(content != "", tx.content_hash(content)).alias("content_hash"),
            "title", "content", "images", "code_blocks", "headings",
            F.col("page_id").alias("order_index"),
        ),
        "extracted",
    )
    fresh = materialize(first_wins(extracted) if store is None else new_materials(extracted, store), "fresh")
    terms = tm.key_terms(fresh, "id", "content").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("term_rank", "term"))), lambda x: x["term"]).alias("terms")
    )
    tags = tm.topic_tags(fresh, dictionary, "id", "content").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("tag_rank", "tag"))), lambda x: x["tag"]).alias("tags")
    )
    none = F.array().cast("array<string>")
    rows = fresh.join(terms, "id", "left").join(tags, "id", "left").withColumns(
        {
            "summary": F.substring("content", 1, 200),
            "language": F.when(tx.cjk_dominant(content, "worker"), "zh").otherwise("en"),
            "tags": F.coalesce("tags", none),
            "terms": F.coalesce("terms", none),
            "parent_id": ur.authority(F.col("source_url")),
            "references": ur.references_in(content),
            "created_at": F.lit(0.0),
        }
    )
    return quality.assess(rows)


def publish(materials: DataFrame, outline: DataFrame, min_words: int, order: str = "section_id") -> tuple[DataFrame, DataFrame]:
    """Sections with content, type, quality and related titles, and the report.

    ``outline(section_id, chapter, section, material_ids)``. Sections without
    any usable material are missing. Content and quality are those of all parts.
    """
    numbered = materialize(pb.number_sections(outline, order, F.floor(F.col(order) / 65536)), "outline")
    placed = fetch_by_ids(numbered.select(order, "material_ids"), materials, order)
    texts = materialize(pb.whole_sections(pb.combine_materials(placed, [order]), [order]), "sections")
    kinds = pb.section_content_type(placed, [order])
    judged = pb.section_quality(texts.withColumn("passed", F.lit(True)), min_words)
    sections = numbered.join(judged, order).join(kinds, order)
    titles = numbered.select(F.col(order).alias("ord"), F.col("section").alias("title"))
    asked = sections.select(F.col(order).alias("id"), F.col("section").alias("title"), "content")
    related = related_sections(asked, titles).groupBy(F.col("id").alias(order)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("related_rank", "related_title"))), lambda x: x["related_title"]).alias("related")
    )
    sections = sections.join(related, order, "left")
    done = sections.select("chapter_no", "section_no", "content", F.lit(None).cast("string").alias("reason"))
    report = pb.publish_status(sections, numbered, pb.missing_sections(numbered, done))
    return sections, report
