"""Text predicates and transformations as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab

CJK = r"[\x{4e00}-\x{9fff}]"
CJK_EXT = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"


def strip(col: Column) -> Column:
    """Trim every Unicode white-space character on both sides."""
    return F.btrim(col, F.lit(vocab.WHITESPACE))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(vocab.WHITESPACE))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(vocab.WHITESPACE))


def is_blank(col: Column) -> Column:
    return strip(F.coalesce(col, F.lit(""))) == ""


def content_hash(col: Column) -> Column:
    return F.substring(F.sha2(col, 256), 1, 16)


def thread_id(col: Column) -> Column:
    return F.substring(F.md5(col), 1, 12)


def page_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def has_cjk(col: Column) -> Column:
    return col.rlike(CJK)


def split_by_script(queries: Column, cjk: bool) -> Column:
    """Keep the queries with (or without) CJK characters, order kept."""
    return F.filter(queries, lambda q: has_cjk(q) if cjk else ~has_cjk(q))


def cjk_dominant(col: Column, policy: str = "worker") -> Column:
    """CJK share test; a text without letters counts as dominant."""
    if policy == "worker":
        cjk = F.regexp_count(col, F.lit(CJK))
        letters = F.length(F.regexp_replace(col, r"[^\p{L}\p{N}_]+", ""))
        return F.when(letters == 0, True).otherwise(cjk / letters > 0.3)
    if policy == "agent":
        cjk = F.regexp_count(col, F.lit(CJK_EXT))
        latin = F.length(F.regexp_replace(col, r"[^A-Za-z]+", ""))
        return F.when(cjk + latin == 0, True).otherwise(cjk / (cjk + latin) >= 0.30)
    raise ValueError(f"unknown policy {policy!r}")


def length_units(col: Column) -> Column:
    """CJK characters plus runs of ASCII word characters."""
    return (F.regexp_count(col, F.lit(CJK)) + F.regexp_count(col, F.lit("[A-Za-z0-9_]+"))).cast("long")


def section_flags(col: Column, min_words: int) -> Column:
    """Ordered flags too_short, abrupt_end, missing_headings."""
    floor_units = max(200, int(min_words * 0.65))
    return F.array_compact(
        F.array(
            F.when(length_units(col) < floor_units, F.lit("too_short")),
            F.when(~rstrip(col).rlike(r"[。！？.`|]\z"), F.lit("abrupt_end")),
            F.when(~F.contains(col, F.lit("## ")), F.lit("missing_headings")),
        )
    )


def sample_windows(col: Column, window: int = 2200) -> Column:
    """Whole text up to three windows, else head, middle and tail windows."""
    n = F.length(col)
    middle = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - window // 2)
    joined = F.concat(
        F.lit("[开头]\n"),
        F.substring(col, 1, window),
        F.lit("\n\n...\n\n[中间]\n"),
        F.substring(col, middle + 1, F.lit(window)),
        F.lit("\n\n...\n\n[结尾]\n"),
        F.substring(col, n - window + 1, F.lit(window)),
    )
    return F.when(n <= window * 3, col).otherwise(joined)


def strip_think(col: Column) -> Column:
    """Drop closed think blocks, cut at an unclosed one, trim if any was there."""
    closed = F.regexp_replace(col, r"(?s)<think>.*?</think>", "")
    cut = F.substring_index(closed, "<think>", 1)
    return F.when(F.contains(col, F.lit("<think>")), strip(cut)).otherwise(col)


def extract_fenced(col: Column, anchor: str) -> Column:
    """First fenced block, else everything from ``anchor`` on, else the text."""
    text = strip_think(col)
    fenced = F.regexp_extract(text, r"(?is)```(?:yaml|yml)?\s*(.*?)```", 1)
    has_fence = text.rlike(r"(?is)```(?:yaml|yml)?\s*.*?```")
    at = F.locate(anchor, text)
    return (
        F.when(has_fence, strip(fenced))
        .when((at > 0) & ~lstrip(text).startswith(anchor), strip(F.substring(text, at, F.length(text))))
        .otherwise(strip(text))
    )


def safe_filename(col: Column, max_len: int = 40) -> Column:
    """File-name form of a title: numbering and forbidden characters dropped."""
    name = F.regexp_replace(col, r"^第?\d+[章节\.]\s*", "")
    name = F.regexp_replace(name, r'[<>:"/\\|?*]', "")
    name = F.replace(strip(name), F.lit(" "), F.lit("_"))
    name = F.substring(name, 1, max_len)
    return F.when(name == "", F.lit("untitled")).otherwise(name)


def safe_article_name(col: Column, max_len: int = 50) -> Column:
    """File-name form used for single articles (forbidden characters become blanks)."""
    name = F.regexp_replace(col, r"[\n\r]", " ")
    name = F.regexp_replace(name, r"^[\s\-#=]+", "")
    name = F.regexp_replace(name, r"[\s\-#=]+$", "")
    name = F.regexp_replace(name, r'[\\/:*?"<>|]', "_")
    name = F.substring(strip(F.regexp_replace(name, r"[_\s]+", " ")), 1, max_len)
    return F.when(name == "", F.lit("未命名文章")).otherwise(name)


def summarise_text(col: Column, limit: int = 240) -> Column:
    """Collapse white space; cut with an ellipsis beyond ``limit``."""
    flat = strip(F.regexp_replace(col, r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)


def first_error_line(col: Column, limit: int = 320) -> Column:
    """First non-blank line, trimmed and cut."""
    lines = F.filter(F.transform(F.split(col, r"\r\n|\n|\r"), strip), lambda x: x != "")
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    return F.when(F.length(first) > limit, F.concat(F.substring(first, 1, limit), F.lit("..."))).otherwise(first)


def first_line(col: Column, max_len: int = 60) -> Column:
    return F.substring(F.substring_index(col, "\n", 1), 1, max_len)


def word_tokens(col: Column) -> Column:
    """Lower-cased runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def bullets(col: Column, marks: str = "-*") -> Column:
    """Bullet lines without their marks, in order."""
    lines = F.transform(F.split(col, "\n"), strip)
    marked = F.filter(lines, lambda x: x.rlike("^[" + "".join("\\" + m for m in marks) + "]"))
    return F.transform(marked, lambda x: strip(F.ltrim(x, F.lit(marks))))


def code_language(col: Column) -> Column:
    """First language, in fixed order, with at least two of its indicators."""
    result = None
    for language, patterns in vocab.CODE_INDICATORS.items():
        hits = sum((col.rlike("(?m)" + p).cast("int") for p in patterns), F.lit(0))
        result = F.when(hits >= 2, language) if result is None else result.when(hits >= 2, language)
    return result.otherwise("")


def comment_density(code: Column, language: Column) -> Column:
    """Comment lines over non-blank lines; null when there is no line."""
    marker = F.lit("#")
    for name, mark in vocab.COMMENT_MARKERS.items():
        marker = F.when(language == name, F.lit(mark)).otherwise(marker)
    lines = F.filter(F.transform(F.split(code, "\n"), strip), lambda x: x != "")
    comments = F.filter(lines, lambda x: x.startswith(marker))
    return F.when(F.size(lines) > 0, F.size(comments) / F.size(lines))


def finish_reason_ok(col: Column) -> Column:
    return ~F.coalesce(col, F.lit("")).isin(*vocab.TRUNCATED_REASONS)
