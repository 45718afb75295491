"""Outline coverage, section assembly and publish reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from .materials import prioritize, summary_line
from .ordering import ordered_concat, row_numbers


def _two_digits(n: Column) -> Column:
    s = n.cast("string")
    return F.when(n < 10, F.concat(F.lit("0"), s)).otherwise(s)


def number_sections(sections: DataFrame, order: str, part: Column | None = None) -> DataFrame:
    """Chapter and section numbers (from 1) and ``NN_chapter/NN_section.md`` paths.

    ``sections(chapter, section, order)``; chapters are numbered by name.
    """
    chapters = row_numbers(sections.select("chapter").distinct(), [], ["chapter"], "chapter_no")
    numbered = row_numbers(sections, ["chapter"], [order], "section_no", part)
    return numbered.join(chapters, "chapter").withColumn("file_path", section_path())


def section_path() -> Column:
    return F.concat(
        _two_digits(F.col("chapter_no")), F.lit("_"), tx.safe_filename(F.col("chapter")), F.lit("/"),
        _two_digits(F.col("section_no")), F.lit("_"), tx.safe_filename(F.col("section")), F.lit(".md"),
    )


def fallback_outline(assessed: DataFrame, topic: str) -> DataFrame:
    """One section per material in priority order, when there is no outline."""
    ranked = prioritize(assessed)
    line = summary_line()
    return ranked.select(
        F.lit(f"第1章 {topic}").alias("chapter"),
        F.concat(F.lit("1."), F.col("priority").cast("string"), F.lit(" "), F.substring(line, 1, 30)).alias("section"),
        F.col("priority").alias("section_no"),
        F.array("id").alias("material_ids"),
        line.alias("description"),
    )


def unassigned_materials(assessed: DataFrame, outline: DataFrame) -> DataFrame:
    """Appendix sections for the materials no section names, in priority order."""
    named = outline.select(F.explode("material_ids").alias("id"))
    rest = prioritize(assessed.join(named, "id", "left_anti"))
    return rest.select(
        F.lit(vocab.APPENDIX_TITLE).alias("chapter"),
        F.concat(
            F.lit(vocab.APPENDIX_ITEM + " "), F.col("priority").cast("string"), F.lit(": "), F.substring(summary_line(), 1, 32)
        ).alias("section"),
        F.col("priority").alias("section_no"),
        "id",
    )


def coverage(materials: DataFrame, outline: DataFrame) -> DataFrame:
    """Totals: materials, assigned by the outline, added by the appendix."""
    named = outline.select(F.explode("material_ids").alias("id")).distinct().withColumn("_in", F.lit(True))
    joined = materials.select("id").join(named, "id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total_materials"),
        F.count_if(F.col("_in")).alias("assigned_materials"),
        F.count_if(F.col("_in").isNull()).alias("auto_assigned_materials"),
    )


def missing_sections(expected: DataFrame, done: DataFrame) -> DataFrame:
    """Expected sections that were not produced, with the reason.

    ``done(chapter_no, section_no, content, reason)``; no row or no content
    means missing.
    """
    produced = done.select("chapter_no", "section_no", "content", "reason")
    joined = expected.join(produced, ["chapter_no", "section_no"], "left")
    empty = F.coalesce("content", F.lit("")) == ""
    return joined.where(empty).withColumn("reason", F.coalesce("reason", F.lit("章节未生成"))).drop("content")


def provenance() -> Column:
    """Source header of a material with its first eight references."""
    kind = F.when(F.coalesce("source_type", F.lit("")) == "", "unknown").otherwise(F.col("source_type"))
    url = F.coalesce("source_url", F.lit(""))
    refs = F.transform(F.slice("references", 1, 8), lambda r: _reference_line(r, "- "))
    return F.concat_ws(
        "\n",
        F.concat(F.lit(vocab.PROVENANCE_TYPE), kind),
        F.when(url != "", F.concat(F.lit(vocab.PROVENANCE_URL), url)),
        F.when(F.size("references") > 0, F.lit(vocab.PROVENANCE_REFS)),
        F.when(F.size("references") > 0, F.concat_ws("\n", refs)),
    )


def _reference_line(ref: Column, mark: str) -> Column:
    def given(name: str) -> Column:
        return F.nullif(ref[name], F.lit(""))

    title = F.coalesce(given("title"), given("url"), F.lit(vocab.UNNAMED_REFERENCE))
    kind = F.coalesce(given("type"), F.lit("reference"))
    link = F.when(given("url").isNotNull(), F.concat(F.lit(" - "), ref["url"])).otherwise("")
    return F.concat(F.lit(mark + "["), kind, F.lit("] "), title, link)


def sources_block(materials: Column, source_urls: Column) -> Column:
    """Sources of a section: ten materials with five references each, then other URLs."""
    first = F.slice(materials, 1, 10)

    def given(m: Column, name: str) -> Column:
        return F.nullif(m[name], F.lit(""))

    def lines(m: Column) -> Column:
        title = F.coalesce(given(m, "title"), given(m, "source_url"), given(m, "id"), F.lit(vocab.UNNAMED_MATERIAL))
        kind = F.coalesce(given(m, "source_type"), F.lit("source"))
        link = F.when(given(m, "source_url").isNotNull(), F.concat(F.lit(" - "), m["source_url"])).otherwise("")
        refs = F.transform(
            F.slice(m["references"], 1, 5), lambda r: _reference_line(r, f"  - {vocab.SOURCES_FURTHER} ")
        )
        return F.concat(F.array(F.concat(F.lit("- ["), kind, F.lit("] "), title, link)), refs)

    shown = F.flatten(
        F.transform(
            first, lambda m: F.concat(F.array(m["source_url"]), F.transform(F.slice(m["references"], 1, 5), lambda r: r["url"]))
        )
    )
    extra = F.filter(F.array_except(F.slice(source_urls, 1, 10), shown), lambda u: u != "")
    body = F.concat(F.flatten(F.transform(first, lines)), F.transform(extra, lambda u: F.concat(F.lit("- [source] "), u)))
    return F.when(F.size(body) > 0, F.concat(F.lit(vocab.SOURCES_HEADING + "\n"), F.concat_ws("\n", body))).otherwise("")


def inline_hint(materials: Column) -> Column:
    """Short source hint naming the first three materials."""

    def label(m: Column) -> Column:
        title = F.coalesce(F.nullif(m["title"], F.lit("")), F.nullif(m["source_url"], F.lit("")), m["id"])
        kind = F.coalesce(F.nullif(m["source_type"], F.lit("")), F.lit("source"))
        return F.concat(F.lit("["), kind, F.lit("] "), title)

    labels = F.transform(F.slice(materials, 1, 3), label)
    joined = F.concat(F.lit("_" + vocab.HINT_PREFIX), F.concat_ws("；", labels), F.lit("_"))
    return F.when(F.size(labels) > 0, joined).otherwise("")


def inject_hint(content: Column, hint: Column) -> Column:
    """Put the hint below a leading heading, else in front."""
    head = F.substring_index(content, "\n\n", 1)
    tail = F.substring(content, F.length(head) + 3, F.length(content))
    split = F.contains(content, F.lit("\n\n")) & tx.lstrip(head).startswith("#")
    return (
        F.when((hint == "") | F.contains(content, hint), content)
        .when(split, F.concat(head, F.lit("\n\n"), hint, F.lit("\n\n"), tail))
        .otherwise(F.concat(hint, F.lit("\n\n"), content))
    )


def material_part() -> Column:
    """A material as it enters a section: heading, provenance, body."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("id", F.lit("")), F.lit(vocab.UNNAMED_MATERIAL))
    return F.concat_ws(
        "\n",
        F.concat(F.lit(vocab.PROVENANCE_MATERIAL), title, F.lit(" ---")),
        provenance(),
        F.lit(vocab.PROVENANCE_BODY),
        tx.strip(F.col("content")),
    )


def combine_materials(placed: DataFrame, keys: list[str], part_size: int = 1000) -> DataFrame:
    """Section texts in list order, blank bodies skipped.

    ``placed`` holds the fetched materials with ``pos``. A section of more than
    ``part_size`` materials continues in further rows (``part``).
    """
    texts = placed.where(~tx.is_blank(F.col("content"))).select(*keys, "pos", material_part().alias("_text"))
    return ordered_concat(texts, keys, "pos", "_text", "\n\n", "content", part_size)


def whole_sections(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per section: its parts joined in order. A section's text is one value, however many materials it has."""
    rows = parts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("part", "content"))).alias("_parts"), F.sum("pieces").alias("pieces")
    )
    content = F.array_join(F.transform("_parts", lambda p: p["content"]), "\n\n")
    return rows.withColumn("content", content).drop("_parts")


def section_content_type(placed: DataFrame, keys: list[str]) -> DataFrame:
    """paper, code, tutorial or default, by the kinds of the materials."""

    def any_of(kind: str) -> Column:
        return F.bool_or(F.col("source_type") == kind)

    kind = F.when(any_of("arxiv"), "paper").when(any_of("github"), "code").when(any_of("course_page"), "tutorial")
    return placed.groupBy(*keys).agg(kind.otherwise("default").alias("content_type"))


def collect_assets(placed: DataFrame, keys: list[str], part_size: int = 1000) -> DataFrame:
    """Images, code blocks and URLs of a section, in material order.

    As with texts, a long section continues in further rows.
    """
    part = F.floor(F.col("pos") / part_size).cast("long").alias("part")
    rows = F.array_sort(F.collect_list(F.struct("pos", "images", "code_blocks", "source_url")))
    urls = F.filter(F.transform("_rows", lambda x: x["source_url"]), lambda u: F.coalesce(u, F.lit("")) != "")
    return placed.groupBy(*keys, part).agg(rows.alias("_rows")).select(
        *keys, "part",
        F.flatten(F.transform("_rows", lambda x: x["images"])).alias("images"),
        F.flatten(F.transform("_rows", lambda x: x["code_blocks"])).alias("code_blocks"),
        urls.alias("source_urls"),
    )


def discovered_sources(topics: DataFrame, produced: DataFrame, store: DataFrame) -> DataFrame:
    """Sources of the materials each topic produced, to append to the topic."""
    rows = topics.select("topic_id").join(produced, "topic_id").join(store, "id")
    return rows.where(F.coalesce("source_url", F.lit("")) != "").select(
        "topic_id", F.col("source_url").alias("url"), F.col("source_type").alias("type"), "title"
    )


def section_quality(sections: DataFrame, min_words: int) -> DataFrame:
    """Characters, length units, chunk count and ordered distinct flags.

    ``sections(content, chunk_count, passed)``; a failed review adds a flag.
    """
    failed = F.when(~F.coalesce("passed", F.lit(True)), F.lit("review_failed"))
    flags = F.array_distinct(
        F.concat(tx.section_flags(F.col("content"), min_words), F.array_compact(F.array(failed)))
    )
    return sections.withColumns(
        {
            "chars": F.length("content").cast("long"),
            "estimated_length_units": tx.length_units(F.col("content")),
            "flags": flags,
        }
    )


def publish_status(sections: DataFrame, expected: DataFrame, missing: DataFrame) -> DataFrame:
    """One-row report: status and counts."""
    done = sections.agg(
        F.count(F.lit(1)).alias("completed_sections"), F.count_if(F.size("flags") > 0).alias("flagged_sections")
    )
    n_expected = expected.agg(F.count(F.lit(1))).scalar()
    n_missing = missing.agg(F.count(F.lit(1))).scalar()
    report = done.withColumns({"expected_sections": n_expected, "missing_sections": n_missing})
    status = (
        F.when(F.col("completed_sections") == 0, "error")
        .when((F.col("missing_sections") > 0) | (F.col("flagged_sections") > 0), "partial")
        .otherwise("success")
    )
    return report.withColumn("status", status)


def quality_summary(sections: DataFrame) -> DataFrame:
    """Flagged sections with their flags."""
    return sections.where(F.size("flags") > 0).select("chapter", "section", "flags")


def merge_rounds(n: Column, batch: int = 3) -> Column:
    """Rounds needed to merge ``n`` drafts, ``batch`` at a time."""
    rounds = F.lit(0)
    # 3^40 exceeds any count of drafts; integer powers keep the result exact
    for r in range(40):
        rounds = rounds + F.when(n > batch**r, 1).otherwise(0)
    return rounds.cast("long")


def chunk_target(max_words: Column, chunks: Column) -> Column:
    return F.greatest(F.lit(300), F.ceil(max_words / F.greatest(chunks, F.lit(1)))).cast("long")
