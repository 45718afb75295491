"""Queries over task logs, graphs, curricula and log files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import materials as mt
from ..operators import tasks as tk
from ..operators.ordering import previous_values, row_numbers
from ..session import scratch_path
from ..sources import files as fs
from ..sources.config import read_curriculum
from .binding import events, hour, table
from .registry import query

TS = "epoch_us(ts)"


def _status(kinds: dict[str, str], default: str):
    col = None
    for kind, status in kinds.items():
        col = F.when(F.col("event_type") == kind, status) if col is None else col.when(F.col("event_type") == kind, status)
    return col.otherwise(default)


def _status_sql(kinds: dict[str, str], default: str) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items()) + f" ELSE '{default}' END"


TASK = {"error": "failed", "click": "running", "view": "completed", "purchase": "canceled"}, "queued"
TOPIC = {"view": "done", "click": "studying", "error": "failed", "purchase": "done"}, "pending"
RUN = {"view": "completed", "error": "failed", "click": "skipped"}, "completed"
NODE = {"click": "pending", "error": "failed", "signup": "completed", "view": "running"}, "completed"
STATE = {"view": "paused", "error": "error", "click": "running"}, "completed"


@query(
    "b23_task_action_flags",
    f"""WITH t AS (SELECT event_id, {_status_sql(*TASK)} AS status FROM events)
    SELECT event_id, status, status IN ('queued', 'running') AS can_cancel,
           status IN ('failed', 'canceled', 'interrupted') AS can_retry FROM t""",
)
def b23(spark, d):
    rows = table(spark, d, "events").select("event_id", _status(*TASK).alias("status"))
    return tk.task_action_flags(rows)


@query(
    "d3_curriculum_progress",
    f"""WITH t AS (SELECT user_id, {_status_sql(*TOPIC)} AS s FROM events)
    SELECT user_id, count(*) AS total, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'studying') AS studying,
      count(*) FILTER (s NOT IN ('done', 'studying')) AS pending, count(*) FILTER (s = 'failed') AS failed FROM t GROUP BY 1""",
)
def d3(spark, d):
    rows = table(spark, d, "events").select("user_id", _status(*TOPIC).alias("status"))
    return tk.curriculum_progress(rows, ["user_id"])


@query(
    "d4_curriculum_status",
    f"""WITH t AS (SELECT user_id, {TS} // 86400000000 AS day, {_status_sql(*TOPIC)} AS s FROM events)
    SELECT user_id, day, CASE WHEN NOT bool_and(s IN ('done', 'failed')) THEN 'in_progress' WHEN bool_or(s = 'failed')
      THEN 'completed_with_errors' ELSE 'completed' END AS status FROM t GROUP BY ALL""",
)
def d4(spark, d):
    day = F.floor(F.col("ts_us") / 86_400_000_000).cast("long").alias("day")
    rows = events(spark, d).select("user_id", day, _status(*TOPIC).alias("status"))
    return tk.curriculum_status(rows, ["user_id", "day"])


@query(
    "d5_run_stats",
    f"""WITH t AS (SELECT user_id, {_status_sql(*RUN)} AS s FROM events)
    SELECT user_id, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed,
      count(*) FILTER (s = 'skipped') AS skipped, count(*) AS total FROM t GROUP BY 1""",
)
def d5(spark, d):
    return tk.run_stats(table(spark, d, "events").select("user_id", _status(*RUN).alias("status")), ["user_id"])


@query(
    "d6_dag_summary",
    f"""WITH t AS (SELECT user_id AS dag_id, {_status_sql(*NODE)} AS s FROM events), c AS (SELECT dag_id,
      count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'running') AS running, count(*) FILTER (s = 'completed') AS completed,
      count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'skipped') AS skipped FROM t GROUP BY 1)
    SELECT *, CASE WHEN failed > 0 THEN 'partial_failure' WHEN pending + running = 0 THEN 'completed' ELSE 'running' END AS dag_status FROM c""",
)
def d6(spark, d):
    return tk.dag_summary(table(spark, d, "events").select(F.col("user_id").alias("dag_id"), _status(*NODE).alias("status")))


@query(
    "d18_dashboard",
    f"""SELECT 'materials' AS section, source AS name, count(*) AS n FROM documents GROUP BY source
    UNION ALL SELECT 'materials', 'total', count(*) FROM documents
    UNION ALL SELECT 'curriculum', unnest(['total', 'done', 'studying', 'pending']), unnest([count(*), count(*) FILTER (s = 'done'),
      count(*) FILTER (s = 'studying'), count(*) FILTER (s NOT IN ('done', 'studying'))]) FROM (SELECT {_status_sql(*TOPIC)} AS s FROM events)
    UNION ALL SELECT * FROM (SELECT 'log', strftime(ts, '%Y-%m-%d') || '.log' AS f, count(*) FROM events GROUP BY f ORDER BY f DESC LIMIT 5)""",
)
def d18(spark, d):
    """Material counts, curriculum progress and the five newest log files."""
    docs = table(spark, d, "documents")
    counts = docs.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    total = docs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("name"), "n")
    ev = table(spark, d, "events")
    progress = tk.curriculum_progress(ev.select(_status(*TOPIC).alias("status")))
    unpivoted = progress.unpivot([], ["total", "done", "studying", "pending"], "name", "n")
    logs = ev.groupBy(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".log")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    newest = logs.orderBy(F.col("name").desc()).limit(5)
    parts = [("materials", counts), ("materials", total), ("curriculum", unpivoted), ("log", newest)]
    out = None
    for section, df in parts:
        rows = df.select(F.lit(section).alias("section"), "name", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "d19_queue_stats",
    """SELECT count(*) FILTER (event_type IN ('click', 'view')) AS pending, count(*) FILTER (event_type NOT IN ('click', 'view')) AS processed,
      round(count(*) FILTER (event_type IN ('purchase', 'signup', 'error')) / count(*)::DOUBLE, 6) AS finished_share FROM events""",
)
def d19(spark, d):
    kind = F.col("event_type")
    run = F.when(kind == "purchase", "success").when(kind == "signup", "partial").when(kind == "error", "error").otherwise("waiting")
    state = F.when(kind.isin("click", "view"), "pending").otherwise("processed")
    return tk.queue_stats(table(spark, d, "events").select(state.alias("state"), run.alias("run_status")))


VERSIONS_SQL = f"""v AS (SELECT event_id, user_id, {TS} AS ts_us, sha256(event_type) AS hash,
    lag(sha256(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"""


def _versions(spark, d):
    """Versions in time order; the event id makes the order unique."""
    return events(spark, d).select(
        F.concat(F.lit("user/"), F.col("user_id")).alias("url"), "event_id", "ts_us",
        F.sha2("event_type", 256).alias("hash"), F.struct("ts_us", "event_id").alias("at"),
    )


@query(
    "e4_changed_versions",
    f"""WITH {VERSIONS_SQL} SELECT 'user/' || user_id AS url, event_id, hash, CASE WHEN prev IS NULL THEN 'new' ELSE 'updated' END AS change
    FROM v WHERE prev IS DISTINCT FROM hash""",
)
def e4(spark, d):
    out = tk.changed_versions(_versions(spark, d), "at")
    return out.where("change IS NOT NULL").select("url", "event_id", "hash", "change")


@query(
    "e4_skipped_versions",
    f"""WITH {VERSIONS_SQL} SELECT 'user/' || user_id AS url, count(*) FILTER (prev IS DISTINCT FROM hash) AS kept,
      count(*) FILTER (prev IS NOT DISTINCT FROM hash) AS skipped FROM v GROUP BY 1""",
)
def e4_skipped(spark, d):
    out = tk.changed_versions(_versions(spark, d), "at")
    return out.groupBy("url").agg(
        F.count_if(F.col("change").isNotNull()).alias("kept"), F.count_if(F.col("change").isNull()).alias("skipped")
    )


LATEST_SQL = f"""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type,
    arg_max(props, (ts, event_id)) AS props FROM events GROUP BY user_id"""


@query("e5_latest_state", LATEST_SQL)
def e5(spark, d):
    rows = events(spark, d).select("user_id", "event_id", "event_type", "props", "ts_us")
    return tk.latest_state(rows, "user_id", ["ts_us", "event_id"]).drop("ts_us")


@query("a15_state_snapshot", LATEST_SQL)
def a15(spark, d):
    """States are appended, never updated in place; the view takes the latest."""
    path = scratch_path(spark, "states")
    rows = events(spark, d).select("user_id", "event_id", "event_type", "props", "ts_us")
    rows.write.mode("append").parquet(path)
    return tk.latest_state(spark.read.parquet(path), "user_id", ["ts_us", "event_id"]).drop("ts_us")


@query(
    "e6_progress_pct",
    """WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p,
      count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT event_id, user_id, p::BIGINT AS processed, (10 + floor(p / n * 82))::BIGINT AS study_pct,
      (15 + floor((p - 1) / n * 70))::BIGINT AS publish_pct, (25 + floor((p - 1) / n * 50))::BIGINT AS curriculum_pct FROM r""",
)
def e6(spark, d):
    rows = events(spark, d).select("event_id", "user_id", "ts_us")
    out = tk.study_progress(rows, "user_id", ["ts_us", "event_id"])
    return out.select("event_id", "user_id", "processed", "study_pct", "publish_pct", "curriculum_pct")


@query(
    "e7_next_free_index",
    """WITH m AS (SELECT max(doc_id) + 1 AS n FROM documents), r AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS k,
      substr(replace(trim(regexp_replace(split_part(text, chr(10), 1), '[<>:"/\\\\|?*]', '', 'g')), ' ', '_'), 1, 30) AS safe FROM benchmark)
    SELECT item_id, k + n AS idx, CASE WHEN k + n < 10 THEN '0' ELSE '' END || (k + n) || '_' || safe AS dir_name FROM r, m""",
)
def e7(spark, d):
    existing = table(spark, d, "documents").select(F.concat(F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit("_"), "source").alias("name"))
    new = table(spark, d, "benchmark").select("item_id", F.substring_index("text", "\n", 1).alias("name"))
    return tk.assign_indexes(new, existing, "item_id", F.floor(F.col("item_id") / 65536)).select("item_id", "idx", "dir_name")


def _graph(spark, d):
    """Events as nodes; each depends on the event of the user before it."""
    ev = events(spark, d).select("event_id", "user_id", "ts_us", "event_type", "value", F.struct("ts_us", "event_id").alias("at"))
    nodes = ev.select(F.col("event_id").alias("node_id"), F.col("event_type").alias("name"), _status(*NODE).alias("status"))
    edges = previous_values(ev, ["user_id"], "at", {"dep_id": "event_id"}, hour())
    return nodes, edges.where("dep_id IS NOT NULL").select(F.col("event_id").alias("node_id"), "dep_id")


GRAPH_SQL = f"""g AS (SELECT event_id AS node_id, {_status_sql(*NODE)} AS status,
    lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dep_id FROM events)"""


@query(
    "j1_ready_nodes",
    f"""WITH {GRAPH_SQL} SELECT g.node_id FROM g LEFT JOIN g p ON p.node_id = g.dep_id
    WHERE g.status = 'pending' AND coalesce(p.status, 'completed') = 'completed'""",
)
def j1(spark, d):
    return tk.ready_nodes(*_graph(spark, d)).select("node_id")


@query(
    "j2_blocked_closure",
    f"""WITH RECURSIVE {GRAPH_SQL}, b AS (
      SELECT g.node_id, 1 AS level FROM g JOIN g p ON p.node_id = g.dep_id WHERE g.status = 'pending' AND p.status IN ('failed', 'skipped')
      UNION ALL SELECT g.node_id, b.level + 1 FROM b JOIN g ON g.dep_id = b.node_id WHERE g.status = 'pending')
    SELECT node_id, level::BIGINT AS level FROM b""",
)
def j2(spark, d):
    return tk.blocked_closure(*_graph(spark, d))


@query(
    "j3_resume_plan",
    f"""WITH n AS (SELECT event_id AS node_id, {_status_sql(*NODE)} AS status, props FROM events)
    SELECT node_id, CASE WHEN status IN ('failed', 'running', 'skipped') THEN 'pending' ELSE status END AS status,
      CASE WHEN status IN ('failed', 'running', 'skipped') THEN '' ELSE props END AS error FROM n""",
)
def j3(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("node_id"), _status(*NODE).alias("status"), F.col("props").alias("error"))
    return tk.resume_plan(rows)


@query(
    "j4_stage_durations",
    f"""WITH n AS (SELECT event_type AS name, (value * 100)::BIGINT AS spent FROM events)
    SELECT name, count(*) AS runs, sum(spent)::BIGINT AS total, min(spent) AS shortest, max(spent) AS longest FROM n GROUP BY 1""",
)
def j4(spark, d):
    """A stage runs for its value in hundredths."""
    spent = F.round(F.col("value") * 100).cast("long")
    rows = events(spark, d).select(F.col("event_type").alias("name"), F.col("ts_us").alias("started_at"), (F.col("ts_us") + spent).alias("finished_at"))
    return tk.stage_durations(rows)


@query(
    "j5_resumable_runs",
    f"""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1),
    s AS (SELECT user_id, {_status_sql(*STATE)} AS status, json_extract(props, '$.k')::BIGINT // 10 AS current_step FROM l)
    SELECT user_id, status, current_step, coalesce(list_extract({list(vocab.STEP_NAMES)}, current_step + 1), 'done') AS step_name
    FROM s WHERE status IN ('paused', 'running', 'error')""",
)
def j5(spark, d):
    rows = events(spark, d).select("user_id", "event_id", "event_type", "props", "ts_us")
    latest = tk.latest_state(rows, "user_id", ["ts_us", "event_id"])
    step = F.floor(F.get_json_object("props", "$.k").cast("long") / 10).cast("long")
    return tk.resumable_runs(latest.select("user_id", _status(*STATE).alias("status"), step.alias("current_step")))


@query(
    "h5_latest_tasks",
    f"""SELECT event_id AS id, {_status_sql(*TASK)} AS status, {TS} AS updated_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 200""",
)
def h5(spark, d):
    rows = events(spark, d).select(F.col("event_id").alias("id"), _status(*TASK).alias("status"), F.col("ts_us").alias("updated_at"))
    return tk.latest_tasks(rows)


@query(
    "c14_retry_lineage",
    f"""WITH RECURSIVE t AS (SELECT event_id AS id, CASE WHEN event_type IN ('error', 'click') THEN
      lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS up FROM events),
    w AS (SELECT id, id AS root, 1 AS attempt FROM t WHERE up IS NULL
      UNION ALL SELECT t.id, w.root, w.attempt + 1 FROM w JOIN t ON t.up = w.id)
    SELECT id, root, attempt::BIGINT AS attempt FROM w""",
)
def c14(spark, d):
    """Error and click events retry the event before them."""
    ev = events(spark, d).select("event_id", "user_id", "ts_us", "event_type", F.struct("ts_us", "event_id").alias("at"))
    linked = previous_values(ev, ["user_id"], "at", {"prev": "event_id"})
    retry = F.when(F.col("event_type").isin("error", "click"), F.col("prev"))
    return tk.retry_lineage(linked.select(F.col("event_id").alias("id"), retry.alias("retry_of")))


@query(
    "a7_read_task_history",
    f"""WITH t AS (SELECT event_id::VARCHAR AS id, {_status_sql(*TASK)} AS status, event_type, props FROM events WHERE event_type <> 'signup')
    SELECT id, CASE WHEN status IN ('queued', 'running') THEN 'interrupted' ELSE status END AS status,
      CASE WHEN status IN ('queued', 'running') THEN 100 ELSE 50 END::BIGINT AS progress,
      CASE WHEN status IN ('queued', 'running') AND event_type <> 'error' THEN '{vocab.INTERRUPTED_ERROR}'
           WHEN event_type = 'error' THEN props ELSE '' END AS error FROM t""",
)
def a7(spark, d):
    """Histories written as JSON; sign-up records lack a kind and are dropped."""
    kind = F.when(F.col("event_type") != "signup", F.lit("study"))
    task = F.struct(
        F.col("event_id").cast("string").alias("id"), kind.alias("kind"), _status(*TASK).alias("status"), F.lit(50).alias("progress"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )
    path = scratch_path(spark, "history")
    table(spark, d, "events").select(F.to_json(F.struct(F.lit(1).alias("version"), F.array(task).alias("tasks"))).alias("value")).write.text(path)
    return fs.read_task_history(spark, path, multi_line=False).select("id", "status", "progress", "error")


@query(
    "a6_read_curriculum",
    """SELECT 'doc ' || doc_id AS goal, unnest(['main', 'side'])  AS domain, unnest([CASE lang WHEN 'en' THEN 1 ELSE 99 END, 99])::BIGINT AS priority,
      unnest([source, '']) AS topic, unnest([CASE lang WHEN 'fr' THEN 'done' ELSE 'pending' END, 'pending']) AS status, 'intermediate' AS difficulty,
      unnest([lang, '']) AS queries FROM documents""",
)
def a6(spark, d):
    """One curriculum per document, written as JSON: a domain with a topic, one without."""
    lang, src, lit = F.col("lang"), F.col("source"), F.lit
    topic = F.struct(F.concat(lit(" "), src, lit(" ")).alias("name"), F.when(lang == "fr", "done").alias("status"), F.array(lang).alias("search_queries"))
    none = F.array().cast("array<struct<name:string,status:string,search_queries:array<string>>>")
    main = F.struct(lit("main").alias("name"), F.when(lang == "en", 1).alias("priority"), F.array(topic).alias("topics"))
    side = F.struct(lit("side").alias("name"), lit(None).cast("int").alias("priority"), none.alias("topics"))
    doc = F.struct(F.concat(lit("doc "), F.col("doc_id").cast("string")).alias("goal"), F.array(main, side).alias("domains"))
    path = scratch_path(spark, "curricula")
    table(spark, d, "documents").select(F.to_json(doc).alias("value")).write.text(path)
    out = read_curriculum(spark, path, multi_line=False)
    return out.select("goal", "domain", "priority", "topic", "status", "difficulty", F.concat_ws(",", "search_queries").alias("queries"))


LEVEL = {"error": "ERROR", "click": "WARNING"}, "INFO"
LINE_SQL = f"""strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || strftime(ts, '%g') || ' - user.' || user_id || ' - ' || {_status_sql(*LEVEL)} || ' - ' || event_type || ' ' || props"""
LINES_SQL = f"""lines AS (SELECT event_id, 0 AS k, ts, strftime(ts, '%Y-%m-%d') AS day, {LINE_SQL} AS line FROM events
    UNION ALL SELECT event_id, 1, ts, strftime(ts, '%Y-%m-%d'), 'Traceback of ' || event_id FROM events WHERE event_type = 'error')"""


def _logs(spark, d):
    """Events written as daily log files and read back; errors add a traceback line."""
    ev = events(spark, d)
    head = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - user."), F.col("user_id").cast("string"), F.lit(" - "),
        _status(*LEVEL), F.lit(" - "), "event_type", F.lit(" "), "props",
    )
    trace = F.when(F.col("event_type") == "error", F.concat(F.lit("Traceback of "), F.col("event_id").cast("string")))
    lines = ev.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts_us", "event_id", F.posexplode(F.array_compact(F.array(head, trace))).alias("k", "line")
    )
    path = scratch_path(spark, "logs")
    fs.write_logs(lines.withColumn("at", F.struct("ts_us", "event_id", "k")), "at", path)
    return fs.read_logs(spark, path)


@query(
    "a8_read_logs",
    f"""WITH {LINES_SQL} SELECT day, line, CASE WHEN k = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || strftime(ts, '%g') END AS ts,
      CASE WHEN k = 0 THEN regexp_extract(line, ' - (user\\.\\d+) - ', 1) END AS logger,
      CASE WHEN k = 0 THEN regexp_extract(line, ' - ([A-Z]+) - ', 1) END AS level,
      CASE WHEN k = 0 THEN regexp_extract(line, ' - [A-Z]+ - (.*)$', 1) END AS message FROM lines""",
)
def a8(spark, d):
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    return _logs(spark, d).select(
        F.regexp_extract("file", r"day=([\d\-]+)", 1).alias("day"), "line", ts.alias("ts"), "logger", "level", "message"
    )


@query("b29_log_filter", f"""WITH {LINES_SQL} SELECT line FROM lines WHERE contains(line, 'ERROR')""")
def b29(spark, d):
    return fs.log_filter(_logs(spark, d), "ERROR").select("line")


@query(
    "h8_log_tail",
    f"""WITH {LINES_SQL} SELECT line, (SELECT count(*) FROM lines) AS total_lines FROM lines ORDER BY ts DESC, event_id DESC, k DESC LIMIT 300""",
)
def h8(spark, d):
    logs = _logs(spark, d)
    total = logs.agg(F.count(F.lit(1))).scalar()
    return fs.log_tail(logs).select("line", total.alias("total_lines"))


@query(
    "e3_numbering",
    """WITH r AS (SELECT doc_id, lang, source, dense_rank() OVER (ORDER BY lang) AS ch, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS sec FROM documents)
    SELECT doc_id, ch AS chapter_no, sec AS section_no, printf('%02d', ch) || '_' || lang || '/' || CASE WHEN sec < 10 THEN '0' ELSE '' END || sec
      || '_' || source || '.md' AS file_path FROM r""",
)
def e3(spark, d):
    """Languages are chapters; a chapter may hold a third of all sections."""
    from ..operators.publish import number_sections

    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("chapter"), F.col("source").alias("section"))
    return number_sections(rows, "doc_id", F.floor(F.col("doc_id") / 65536)).select("doc_id", "chapter_no", "section_no", "file_path")
