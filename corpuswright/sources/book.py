"""Book output: one text file per section, the contents page and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def section_file() -> Column:
    """File body: title, quality notes, content; the writer ends the last line."""
    flags = F.when(F.size("flags") > 0, F.concat(F.lit("> - 风险标记: "), F.concat_ws(", ", "flags")))
    chunks = F.when(F.coalesce("chunk_count", F.lit(0)) > 0, F.concat(F.lit("> - 写作分块: "), F.col("chunk_count").cast("string")))
    notes = F.concat_ws(
        "\n",
        F.lit("> 出版质量信息"),
        F.concat(F.lit("> - 字符数: "), F.col("chars").cast("string")),
        F.concat(F.lit("> - 估算长度单位: "), F.col("estimated_length_units").cast("string")),
        chunks,
        flags,
    )
    return F.concat(F.lit("# "), "section", F.lit("\n\n"), notes, F.lit("\n"), tx.rstrip(F.col("content")))


def contents_lines(sections: DataFrame) -> DataFrame:
    """Lines of the contents page: a heading per chapter, a link per section."""
    flags = F.when(F.size("flags") > 0, F.concat(F.lit("  _"), F.concat_ws(", ", "flags"), F.lit("_"))).otherwise("")
    link = F.concat(F.lit("- ["), "section", F.lit("]("), "file_path", F.lit(")"), flags)
    heads = sections.select("chapter_no", F.lit(0).cast("long").alias("section_no"), F.concat(F.lit("\n## "), "chapter", F.lit("\n")).alias("line"))
    return heads.distinct().unionByName(sections.select("chapter_no", "section_no", link.alias("line")))


def write_book(sections: DataFrame, report: DataFrame, out: str) -> None:
    """Write ``sections/``, ``contents/`` and ``report/`` below ``out``.

    The logical path of a section is its pair of partition keys; Spark names
    the part files. ``sections`` carries numbers, paths and quality columns.
    """
    parts = F.split("file_path", "/")
    files = sections.select(parts[0].alias("chapter_dir"), parts[1].alias("section_file"), section_file().alias("value"))
    # a file is written by one task, the files by all of them
    n = int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files.repartition(n, "chapter_dir", "section_file").write.partitionBy("chapter_dir", "section_file").text(f"{out}/sections")
    contents = contents_lines(sections)
    contents.orderBy("chapter_no", "section_no").select(F.col("line").alias("value")).write.text(f"{out}/contents")
    report.write.json(f"{out}/report")
