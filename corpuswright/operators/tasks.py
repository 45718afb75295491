"""Task logs, task graphs, curricula and page versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..session import materialize
from .ordering import previous_values, row_numbers, running_sums


def _count_if(test: Column) -> Column:
    return F.count_if(test).cast("long")


def task_action_flags(df: DataFrame, handlers: Sequence[str] | None = None) -> DataFrame:
    """What the task list offers for each task; retry needs a known handler."""
    known = F.lit(True) if handlers is None else F.col("kind").isin(*handlers)
    return df.withColumns(
        {
            "can_cancel": F.col("status").isin(*vocab.CANCELABLE),
            "can_retry": F.col("status").isin(*vocab.RETRYABLE) & known,
        }
    )


def curriculum_progress(topics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Topics per state; whatever is neither done nor studying is pending."""
    s = F.col("status")
    return topics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        _count_if(s == "done").alias("done"),
        _count_if(s == "studying").alias("studying"),
        _count_if(~s.isin("done", "studying")).alias("pending"),
        _count_if(s == "failed").alias("failed"),
    )


def curriculum_status(topics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """completed, completed_with_errors or in_progress."""
    finished = F.bool_and(F.col("status").isin("done", "failed"))
    failed = F.bool_or(F.col("status") == "failed")
    status = F.when(finished & failed, "completed_with_errors").when(finished, "completed").otherwise("in_progress")
    return topics.groupBy(*keys).agg(status.alias("status"))


def run_stats(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Completed, failed, skipped and total topics of each run."""
    s = F.col("status")
    return runs.groupBy(*keys).agg(
        *[_count_if(s == name).alias(name) for name in ("completed", "failed", "skipped")],
        F.count(F.lit(1)).alias("total"),
    )


def dag_summary(nodes: DataFrame, keys: Sequence[str] = ("dag_id",)) -> DataFrame:
    """Nodes per status (zero filled) and the state of each graph."""
    s = F.col("status")
    counts = nodes.groupBy(*keys).agg(*[_count_if(s == name).alias(name) for name in vocab.NODE_STATUSES])
    state = (
        F.when(F.col("failed") > 0, "partial_failure")
        .when(F.col("pending") + F.col("running") == 0, "completed")
        .otherwise("running")
    )
    return counts.withColumn("dag_status", state)


def queue_stats(queue: DataFrame) -> DataFrame:
    """Pending, processed and the finished share of the run log."""
    return queue.agg(
        _count_if(F.col("state") == "pending").alias("pending"),
        _count_if(F.col("state") == "processed").alias("processed"),
        F.round(_count_if(F.col("run_status").isin("success", "partial", "error")) / F.count(F.lit(1)), 6).alias(
            "finished_share"
        ),
    )


def changed_versions(versions: DataFrame, order: str, part: Column | None = None) -> DataFrame:
    """New and updated page versions; a version equal to the one before is skipped.

    ``versions(url, hash, ...)``; a null hash is a value like any other. A page
    that holds a third of all versions is read in ranges (or the given parts),
    and the last hash of a range is carried to the next.
    """
    seen = previous_values(versions, ["url"], order, {"prev_hash": "hash", "_prev_url": "url"}, part)
    kind = F.when(F.col("_prev_url").isNull(), "new").when(~F.col("hash").eqNullSafe(F.col("prev_hash")), "updated")
    return seen.withColumn("change", kind).drop("_prev_url")


def latest_state(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Latest record per key; a map-side combined maximum."""
    rest = [c for c in df.columns if c != key]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(key).agg(picked).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def progress_pct(done: Column, total: Column, start: int, span: int) -> Column:
    """``start + int(done / max(total, 1) * span)`` kept within 0..100."""
    raw = start + F.floor(done / F.greatest(total, F.lit(1)) * span)
    return F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("long")


def study_progress(topics: DataFrame, key: str, order: Sequence[str], part: Column | None = None) -> DataFrame:
    """Progress after every processed topic of a run."""
    counted = running_sums(topics, [key], order, {"processed": F.lit(1)}, part, totals=True)
    done, total = F.col("processed"), F.col("processed_total")
    return counted.withColumns(
        {
            "study_pct": progress_pct(done, total, 10, 82),
            "publish_pct": progress_pct(done - 1, total, 15, 70),
            "curriculum_pct": progress_pct(done - 1, total, 25, 50),
        }
    )


def next_free_index(names: DataFrame, column: str = "name") -> Column:
    """Highest ``NN_`` prefix plus one, as a scalar; 0 when there is none."""
    found = F.max(F.regexp_extract(column, r"^(\d+)_", 1).try_cast("long"))
    return names.agg(F.coalesce(found, F.lit(-1)) + 1).scalar()


def assign_indexes(new: DataFrame, existing: DataFrame, order: str, part: Column | None = None) -> DataFrame:
    """Directory names for new entries, numbered on from the existing ones."""
    numbered = row_numbers(new, [], [order], "_n", part, start=0)
    idx = (F.col("_n") + next_free_index(existing)).cast("long")
    safe = F.regexp_replace(F.col("name"), r'[<>:"/\\|?*]', "")
    safe = F.substring(F.replace(F.trim(safe), F.lit(" "), F.lit("_")), 1, 30)
    return numbered.withColumn("idx", idx).withColumn(
        "dir_name", F.concat(F.when(F.col("idx") < 10, F.lit("0")).otherwise(""), F.col("idx").cast("string"), F.lit("_"), safe)
    ).drop("_n")


# --- task graphs -------------------------------------------------------------------


def ready_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending nodes whose known dependencies are all completed."""
    open_deps = nodes.where("status <> 'completed'").select(F.col("node_id").alias("dep_id"))
    unmet = edges.join(open_deps, "dep_id").select("node_id")
    return nodes.where("status = 'pending'").join(unmet, "node_id", "left_anti")


def blocked_closure(nodes: DataFrame, edges: DataFrame, patience: int = 8, growth: int = 4) -> DataFrame:
    """Pending nodes to skip: downstream of a failed or skipped node.

    ``level`` is the distance to the nearest such node. Only edges into pending
    nodes can spread a skip, so only those enter the loop. The first
    ``patience`` rounds go one step each. Deeper graphs then join the edges with
    themselves, which doubles the distance a round covers: a chain of n nodes
    takes log2(n) more rounds. Where doubled edges would outgrow ``growth`` times
    the given ones (many nodes with many dependencies), steps go on. Every round
    is written to the shared folder.
    """
    waiting = nodes.where("status = 'pending'").select("node_id")
    live = materialize(edges.join(waiting, "node_id", "left_semi").select("node_id", "dep_id").distinct(), "edges")
    zero = F.lit(0).cast("long").alias("level")
    known = materialize(nodes.where("status IN ('failed', 'skipped')").select("node_id", zero), "blocked")
    source, steps, hops, limit = known, live, 1, None
    rounds = 0
    while True:
        reached = (
            steps.join(source.select(F.col("node_id").alias("dep_id"), "level"), "dep_id")
            .groupBy("node_id").agg((F.min("level") + hops).alias("level"))
        )
        fresh = materialize(reached.join(known.select("node_id"), "node_id", "left_anti"), "blocked")
        if fresh.isEmpty():
            return known.where("level > 0")
        known = known.unionByName(fresh)
        rounds += 1
        if rounds < patience:
            source = fresh
            continue
        if limit is None:
            limit = growth * live.count()
        open_ = steps.join(known.select("node_id"), "node_id", "left_anti")
        if limit > 0 and _joined_size(open_, steps) <= limit:
            onward = steps.select(F.col("node_id").alias("dep_id"), F.col("dep_id").alias("_far"))
            longer = open_.join(onward, "dep_id").select("node_id", F.col("_far").alias("dep_id"))
            source, steps, hops = known, materialize(longer.distinct(), "edges"), 2 * hops
        else:
            # what one step can still reach hangs below the newest nodes
            source, steps, hops, limit = fresh, live, 1, 0


def _joined_size(left: DataFrame, right: DataFrame) -> int:
    """Rows of the join of two edge tables, counted from the degrees."""
    degree = right.groupBy(F.col("node_id").alias("dep_id")).agg(F.count(F.lit(1)).alias("n"))
    return left.join(degree, "dep_id").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def apply_skips(nodes: DataFrame, blocked: DataFrame) -> DataFrame:
    """Node table after skipping the blocked nodes."""
    hit = blocked.select("node_id", F.lit(True).alias("_hit"))
    status = F.when(F.col("_hit"), "skipped").otherwise(F.col("status"))
    return nodes.join(hit, "node_id", "left").withColumn("status", status).drop("_hit")


def resume_plan(nodes: DataFrame) -> DataFrame:
    """Failed, running and skipped nodes go back to pending without an error."""
    again = F.col("status").isin("failed", "running", "skipped")
    return nodes.withColumn("error", F.when(again, "").otherwise(F.col("error"))).withColumn(
        "status", F.when(again, "pending").otherwise(F.col("status"))
    )


def stage_durations(nodes: DataFrame) -> DataFrame:
    """Runs and time per node name."""
    spent = F.col("finished_at") - F.col("started_at")
    return nodes.groupBy("name").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(spent).alias("total"), F.min(spent).alias("shortest"), F.max(spent).alias("longest")
    )


def resumable_runs(states: DataFrame) -> DataFrame:
    """Unfinished runs with the name of the step they stand at."""
    steps = F.array(*[F.lit(s) for s in vocab.STEP_NAMES])
    name = F.coalesce(F.try_element_at(steps, F.col("current_step").cast("int") + 1), F.lit("done"))
    return states.where(F.col("status").isin(*vocab.RESUMABLE)).withColumn("step_name", name)


def latest_tasks(tasks: DataFrame, cap: int = 200) -> DataFrame:
    """Newest tasks by update time; the history limit."""
    return tasks.orderBy(F.col("updated_at").desc(), F.col("id").desc()).limit(cap)


def retry_lineage(tasks: DataFrame) -> DataFrame:
    """First attempt and attempt number of every task, along ``retry_of``.

    Links are doubled each round, so a chain of n retries takes log2(n) rounds;
    rows that have reached their first attempt leave the loop. A row still on
    its way when the distance passes the number of tasks is on or behind a
    cycle: it has no first attempt, so ``root`` and ``attempt`` are null.
    """
    links = materialize(tasks.select("id", F.col("retry_of").alias("up")), "links")
    known = links.select("id")
    links = links.join(known.select(F.col("id").alias("up"), F.lit(True).alias("_ok")), "up", "left").select(
        "id", F.when(F.col("_ok"), F.col("up")).alias("up")
    )
    done = links.where("up IS NULL").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("dist"))
    open_ = materialize(links.where("up IS NOT NULL").withColumn("dist", F.lit(1).cast("long")), "open")
    finished = materialize(done, "finished")
    rounds = links.count().bit_length() + 1
    while rounds and not open_.isEmpty():
        rounds -= 1
        roots = finished.select(F.col("id").alias("up"), "root", F.col("dist").alias("_d"))
        jumps = open_.select(F.col("id").alias("up"), F.col("up").alias("_up2"), F.col("dist").alias("_d2"))
        step = open_.join(roots, "up", "left").join(jumps, "up", "left")
        step = materialize(
            step.select(
                "id",
                F.coalesce("_up2", "up").alias("up"),
                "root",
                (F.col("dist") + F.coalesce("_d", "_d2", F.lit(0))).alias("dist"),
            ),
            "jump",
        )
        finished = finished.unionByName(step.where("root IS NOT NULL").select("id", "root", "dist"))
        open_ = step.where("root IS NULL").select("id", "up", "dist")
    endless = open_.select("id", F.lit(None).cast(links.schema["id"].dataType).alias("root"), F.lit(None).cast("long").alias("dist"))
    return finished.unionByName(endless).select("id", "root", (F.col("dist") + 1).alias("attempt"))
