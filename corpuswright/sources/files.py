"""File sources: logs, knowledge-base trees, markdown, images, task history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.images import mime_type

LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - (.*?) - ([A-Z]+) - (.*)$"
TASK_SCHEMA = (
    "version int, tasks array<struct<id:string,kind:string,status:string,created_at:double,updated_at:double,"
    "message:string,error:string,progress:int,result:string,retry_of:string>>"
)


def parse_log_line(line: Column) -> dict[str, Column]:
    """Fields of a log line; all null for lines of another form (tracebacks)."""
    matched = line.rlike(LOG_LINE)

    def part(i: int) -> Column:
        return F.when(matched, F.regexp_extract(line, LOG_LINE, i))

    ts = F.to_timestamp_ntz(F.concat(part(1), F.lit("."), part(2)), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))
    return {"ts": ts, "logger": part(3), "level": part(4), "message": part(5)}


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their file and place.

    Splits arrive in any order, so the place of a line is its file, the offset
    of its split and its number inside the split.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
    )
    return raw.withColumns(parse_log_line(F.col("line")))


def log_filter(logs: DataFrame, level: str | None = None) -> DataFrame:
    """Lines containing the level name (all without one), newest first."""
    kept = logs if level is None else logs.where(F.contains("line", F.lit(level)))
    return kept.orderBy(F.col("file").desc(), F.col("block").desc(), F.col("line_no").desc())


def log_tail(logs: DataFrame, n: int = 300) -> DataFrame:
    """Last ``n`` lines, newest first."""
    return logs.orderBy(F.col("file").desc(), F.col("block").desc(), F.col("line_no").desc()).limit(n)


def write_logs(lines: DataFrame, order: str, path: str) -> None:
    """Daily log files; a busy day is several files whose names keep the order."""
    ranged = lines.repartitionByRange("day", order).sortWithinPartitions("day", order)
    ranged.select("day", F.col("line").alias("value")).write.partitionBy("day").text(path)


def read_task_history(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Tasks of stored histories; in-flight ones are marked interrupted."""
    docs = spark.read.schema(TASK_SCHEMA).json(path, multiLine=multi_line)
    return interrupt_open(docs.select(F.explode("tasks").alias("t")).select("t.*"))


def interrupt_open(tasks: DataFrame) -> DataFrame:
    """Rows without id or kind are dropped; open states become interrupted."""
    status = F.coalesce("status", F.lit("pending"))
    open_ = status.isin(*vocab.INTERRUPTIBLE)
    error = F.coalesce("error", F.lit(""))
    kept = tasks.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("kind", F.lit("")) != ""))
    return kept.withColumns(
        {
            "error": F.when(open_ & (error == ""), vocab.INTERRUPTED_ERROR).otherwise(error),
            "message": F.when(open_, vocab.INTERRUPTED_MESSAGE).otherwise(F.coalesce("message", F.lit(""))),
            "progress": F.when(open_, 100).otherwise(F.coalesce("progress", F.lit(0))).cast("long"),
            "status": F.when(open_, "interrupted").otherwise(status),
        }
    )


def read_kb_tree(spark: SparkSession, root: str) -> DataFrame:
    """Folders and files below ``root``: folders first, then by lower-case name.

    Only paths are read; the contents column is pruned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return kb_tree(files, root)


def kb_tree(files: DataFrame, root: str) -> DataFrame:
    rel = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    segments = F.split(rel, "/")
    depth = F.explode(F.sequence(F.lit(1), F.size("segments"))).alias("n")
    nodes = files.select(segments.alias("segments")).select("segments", depth)
    rows = nodes.select(
        F.element_at("segments", F.col("n")).alias("name"),
        F.concat_ws("/", F.slice("segments", 1, F.col("n"))).alias("path"),
        F.when(F.col("n") == F.size("segments"), "file").otherwise("directory").alias("type"),
    ).distinct()
    return rows.orderBy(F.col("type") == "file", F.lower("name"), "path")


def kb_filter(tree: DataFrame, term: str) -> DataFrame:
    """Nodes whose name or path contains the term in any case."""
    needle = F.lit(term.strip().lower())
    return tree.where(F.contains(F.lower("name"), needle) | F.contains(F.lower("path"), needle))


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """Whole body per document."""
    return (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def load_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files up to the size limit with the type their bytes show."""
    return with_mime(spark.read.format("binaryFile").load(path))


def with_mime(files: DataFrame) -> DataFrame:
    return files.where(F.col("length") <= vocab.MAX_IMAGE_BYTES).select(
        "path", "length", mime_type(F.col("content")).alias("mime")
    )
