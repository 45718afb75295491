"""The given tables replayed as streams; each equals its batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.urls import url_normalize
from ..session import scratch_path
from ..sources.tables import read_materials
from ..streaming import jobs
from .binding import EPOCH
from .registry import query
from .task_queries import LATEST_SQL, LINES_SQL, TASK, VERSIONS_SQL, _status, _status_sql
from .text_queries import NORM
from .web_queries import QUEUE_SQL, _queue

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, d):
    rows = jobs.file_stream(spark, d, "events.parquet", EVENTS)
    return rows.withColumn("ts_us", F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)"))


def _paths(spark, label):
    return scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")


@query(
    "m1_changed_pages_stream",
    f"""WITH {VERSIONS_SQL} SELECT 'user/' || user_id AS url, event_id, hash, CASE WHEN prev IS NULL THEN 'new' ELSE 'updated' END AS change
    FROM v WHERE prev IS DISTINCT FROM hash""",
)
def m1(spark, d):
    out, checkpoint = _paths(spark, "changed")
    versions = _events(spark, d).select(
        F.concat(F.lit("user/"), F.col("user_id")).alias("url"), "event_id", "ts_us",
        F.sha2("event_type", 256).alias("hash"), F.struct("ts_us", "event_id").alias("at"),
    )
    jobs.changed_pages_stream(versions, out, checkpoint).awaitTermination()
    return jobs.changed_pages(spark, out).select("url", "event_id", "hash", "change")


@query(
    "m2_enqueue_stream",
    f"""WITH {QUEUE_SQL} SELECT DISTINCT {NORM.format(c='url')} AS url, 'pending' AS state FROM pages
    WHERE {NORM.format(c='url')} NOT IN (SELECT url FROM queue)""",
)
def m2(spark, d):
    out, checkpoint = _paths(spark, "queued")
    pages = jobs.file_stream(spark, d, "pages.parquet", "page_id long, url string")
    urls = pages.select(
        url_normalize(F.col("url")).alias("url"), F.col("page_id").alias("seq"), F.timestamp_seconds(F.col("page_id") + 1_700_000_000).alias("ts")
    )
    jobs.enqueue_stream(urls, _queue(spark, d), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("url", "state")


@query(
    "m3_ingest_stream",
    """SELECT doc_id::VARCHAR AS id, source AS source_type, substr(sha256(text), 1, 16) AS content_hash FROM documents
    WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY sha256(text))""",
)
def m3(spark, d):
    path, checkpoint = _paths(spark, "ingested")
    docs = jobs.file_stream(spark, d, "documents.parquet", "doc_id long, text string, lang string, source string, n_chars long")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_type"), F.col("text").alias("content"),
        tx.content_hash(F.col("text")).alias("content_hash"), F.col("doc_id").alias("order_index"),
    )
    jobs.ingest_stream(rows, path, checkpoint).awaitTermination()
    return read_materials(spark, path).select("id", "source_type", "content_hash")


@query(
    "m4_task_window_stream",
    f"""SELECT (epoch_us(ts) // 3600000000) AS hour, {_status_sql(*TASK)} AS status, count(*) AS n FROM events GROUP BY ALL""",
)
def m4(spark, d):
    out, checkpoint = _paths(spark, "windows")
    updates = _events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), _status(*TASK).alias("status"))
    jobs.task_window_stream(updates, out, checkpoint).awaitTermination()
    hours = F.floor(F.unix_seconds("start") / 3600).cast("long")
    return jobs.window_counts(spark, out).select(hours.alias("hour"), "status", "n")


@query("m4_task_latest_stream", LATEST_SQL)
def m4_latest(spark, d):
    out, checkpoint = _paths(spark, "latest")
    updates = _events(spark, d).select("user_id", "event_id", "event_type", "props", "ts_us")
    order = ["ts_us", "event_id"]
    jobs.task_latest_stream(updates, "user_id", order, out, checkpoint).awaitTermination()
    return jobs.latest_tasks_view(spark, "user_id", out).drop("ts_us")


@query(
    "m5_log_stream",
    f"""WITH {LINES_SQL} SELECT line, 'ERROR' AS level FROM lines WHERE contains(line, ' ERROR ')""",
)
def m5(spark, d):
    from ..sources.files import write_logs
    from .task_queries import LEVEL

    rows = spark.read.schema(EVENTS).parquet(f"{d}/events.parquet")
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - user."), F.col("user_id").cast("string"), F.lit(" - "),
        _status(*LEVEL), F.lit(" - "), "event_type", F.lit(" "), "props",
    )
    logs = scratch_path(spark, "logs")
    write_logs(rows.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", line.alias("line")), "event_id", logs)
    out, checkpoint = _paths(spark, "tailed")
    jobs.log_stream(spark, logs, out, checkpoint, " ERROR ").awaitTermination()
    return spark.read.parquet(out).select("line", "level")


@query(
    "m6_activity_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS first_
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(first_) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g),
    a AS (SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, no)
    SELECT * FROM a""",
)
def m6(spark, d):
    out, checkpoint = _paths(spark, "sessions")
    updates = _events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    jobs.activity_sessions(updates, "user_id", out, checkpoint).awaitTermination()
    return jobs.session_view(spark, "user_id", out).select(
        "user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n"
    )
