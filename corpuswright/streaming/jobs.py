"""Incremental jobs over arriving pages, URLs, materials, task updates and logs.

Every job takes a streaming DataFrame, an output folder and a checkpoint folder
and returns the started query. A run that was interrupted restarts from its
checkpoint; outputs of a batch are keyed by the batch id, so a repeated batch
replaces what it wrote before. No job drops late rows.

What a batch has to know of earlier ones (the last hash of a page, the queued
URLs, running counts, the latest update of a task) is keyed state in RocksDB,
so a batch costs what its own rows cost. State is never timed out, because no
row is too late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordering import merged_runs, previous_values
from ..operators.tasks import latest_state
from ..session import materialize
from ..sources.files import parse_log_line
from ..sources.tables import _has_rows, _is_folder, append_materials

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Batches whose changes are merged into one table.
MERGED = 16


def file_stream(spark: SparkSession, folder: str, name: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; a table of the name may be one file, or a folder of part files or of partitions."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # values of partitions are read off the path below a folder that is named as it is; a file may be named by a pattern only
    path = f"{folder}/{name}"
    return reader.parquet(path if _is_folder(spark, path) else f"{folder}/{{{name}}}")


def _start(df: DataFrame, sink: Callable, checkpoint: str, mode: str = "append", live: str | None = None) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.trigger(processingTime=live) if live else writer.trigger(availableNow=True)
    conf = df.sparkSession.conf  # a query keeps the settings it was started with
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        return writer.start()
    finally:
        conf.set(STORE, before) if before else conf.unset(STORE)


def _write_batch(df: DataFrame, out: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def _newest(spark: SparkSession, folder: str) -> int | None:
    """Largest batch number of the finished tables of a folder."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=None)


def current(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest row of every key: the last merged table and the batches after it."""
    newest = _newest(spark, f"{out}/merged")
    after = -1 if newest is None else newest
    rows = spark.read.option("basePath", f"{out}/changes").parquet(f"{out}/changes/batch=*").where(F.col("batch") > after)
    if newest is not None:
        merged = spark.read.parquet(f"{out}/merged/batch={newest}").withColumn("batch", F.lit(newest))
        rows = rows.unionByName(merged)
    named = rows.select(F.struct(*keys).alias("_key"), *[c for c in rows.columns if c not in keys])
    return latest_state(named, "_key", ["batch"]).select("_key.*", *[c for c in named.columns if c not in ("_key", "batch")])


def _keep_current(keys: list[str], out: str) -> Callable:
    """Sink of changed rows by key; every so often they are merged, so that reading stays cheap."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, f"{out}/changes", batch_id)
        if batch_id % MERGED == MERGED - 1:
            _write_batch(current(batch.sparkSession, out, keys), f"{out}/merged", batch_id)

    return sink


def _decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the first version of a page in a batch is, next to the last one of the batch before."""
    rows = pd.concat(list(frames)).sort_values("batch_no")
    last, done = state.get if state.exists else (None, None)
    for first_hash, last_hash, no in zip(rows["hash"], rows["last_hash"], rows["batch_no"], strict=True):
        if done is not None and no <= done:  # this batch was seen before it was repeated
            continue
        change = "new" if done is None else "updated" if first_hash != last else None
        last, done = last_hash, int(no)
        if change:
            yield pd.DataFrame({"url": [key[0]], "batch_no": [no], "change": [change]})
    state.update((last, done))


def changed_pages_stream(versions: DataFrame, out: str, checkpoint: str, live: str | None = None) -> StreamingQuery:
    """Emit a page version only when its hash differs from the one before.

    ``versions(url, hash, at, ...)`` with ``at`` unique per URL; a null hash is a
    value like any other. Two queries: the first compares the versions inside a
    batch (a URL that fills a batch is split into ranges) and writes the first and
    last of every URL. The second keeps the last hash of every URL as state and
    meets one row per URL and batch. ``changed_pages`` reads both outputs.
    Returns the second query; without ``live`` the first has ended by then.
    """
    spark = versions.sparkSession

    def compare(batch: DataFrame, batch_id: int) -> None:
        seen = previous_values(batch, ["url"], "at", {"_prev_url": "url", "_prev_hash": "hash"})
        seen = materialize(seen, "versions")
        inside = seen.where(F.col("_prev_url").isNotNull() & ~F.col("hash").eqNullSafe(F.col("_prev_hash")))
        _write_batch(inside.drop("_prev_url", "_prev_hash").withColumn("change", F.lit("updated")), f"{out}/inside", batch_id)
        last = batch.groupBy("url").agg(F.max_by(F.struct("hash"), "at")["hash"].alias("last_hash"))
        first = seen.where("_prev_url IS NULL").drop("_prev_url", "_prev_hash")
        edges = first.join(last, "url").withColumn("batch_no", F.lit(batch_id).cast("long"))
        edges.write.mode("overwrite").parquet(f"{out}/edges/{batch_id}")

    def settle(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch, "settled")
        numbers = [r[0] for r in batch.select("batch_no").distinct().collect()]  # batches that arrived together
        if numbers:
            edges = spark.read.schema(edge_schema).parquet(*[f"{out}/edges/{n}" for n in numbers])
            _write_batch(edges.drop("last_hash").join(batch, ["url", "batch_no"]).drop("batch_no"), f"{out}/firsts", batch_id)

    edge_schema = versions.withColumns({"last_hash": F.col("hash"), "batch_no": F.lit(0).cast("long")}).schema
    comparing = _start(versions, compare, f"{checkpoint}/compare", live=live)
    if not live:
        comparing.awaitTermination()
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/edges").getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()
    ).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/edges"))
    edges = spark.readStream.schema(edge_schema).option("recursiveFileLookup", "true").parquet(f"{out}/edges")
    decided = edges.select("url", "hash", "last_hash", "batch_no").groupBy("url").applyInPandasWithState(
        _decide, "url string, batch_no long, change string", "hash string, batch_no long", "append", GroupStateTimeout.NoTimeout
    )
    return _start(decided, settle, f"{checkpoint}/settle", live=live)


def changed_pages(spark: SparkSession, out: str) -> DataFrame:
    """The new and updated versions of all batches."""
    parts = [spark.read.parquet(f"{out}/{name}/batch=*") for name in ("inside", "firsts") if _newest(spark, f"{out}/{name}") is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _distinct_urls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A URL that fills a batch becomes a row per Arrow batch ahead of the shuffle."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pc.unique(b.column(0))], ["url"])


def enqueue_stream(
    urls: DataFrame, queue: DataFrame, out: str, checkpoint: str, live: str | None = None
) -> StreamingQuery:
    """Queue arriving URLs once. ``urls(url, ...)``, ``queue(url, state)``; null URLs are left out.

    A URL is new when neither the queue nor what was queued before has it; how
    late it arrives does not matter. The URLs seen are state, not output read again.
    """
    seen = urls.select("url").where("url IS NOT NULL").mapInArrow(_distinct_urls, "url string").dropDuplicates(["url"])

    def sink(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.join(queue.select("url"), "url", "left_anti")
        _write_batch(fresh.withColumn("state", F.lit("pending")), out, batch_id)

    return _start(seen, sink, checkpoint, live=live)


def ingest_stream(materials: DataFrame, path: str, checkpoint: str, live: str | None = None) -> StreamingQuery:
    """Append arriving materials the table does not hold, by content hash.

    A repeated batch adds nothing: its ids are in the table by then.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _has_rows(spark, path):
            batch = batch.join(spark.read.parquet(path).select("id"), "id", "left_anti")
        append_materials(batch, path)

    return _start(materials, sink, checkpoint, live=live)


def task_window_stream(
    updates: DataFrame, out: str, checkpoint: str, width: str = "1 hour", slide: str | None = None, live: str | None = None
) -> StreamingQuery:
    """Updates per window and status. ``updates(ts, status)``.

    The counts are state; a batch writes the new totals of the windows it met.
    """
    counts = updates.groupBy(F.window("ts", width, slide), "status").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.select(F.col("window.start").alias("start"), "status", "n")
    return _start(totals, _keep_current(["start", "status"], out), checkpoint, "update", live)


def window_counts(spark: SparkSession, out: str) -> DataFrame:
    return current(spark, out, ["start", "status"])


def task_latest_stream(updates: DataFrame, key: str, order: list[str], out: str, checkpoint: str, live: str | None = None) -> StreamingQuery:
    """Latest state per task, kept as state; a batch writes the tasks it met."""
    return _start(latest_state(updates, key, order), _keep_current([key], out), checkpoint, "update", live)


def latest_tasks_view(spark: SparkSession, key: str, out: str) -> DataFrame:
    return current(spark, out, [key])


def log_stream(spark: SparkSession, path: str, out: str, checkpoint: str, level: str | None = None, live: str | None = None) -> StreamingQuery:
    """Parsed log lines as they are written, of one level or all."""
    lines = spark.readStream.option("recursiveFileLookup", "true").text(path).select(F.col("value").alias("line"))
    parsed = lines.withColumns(parse_log_line(F.col("line")))
    if level:
        parsed = parsed.where(F.contains("line", F.lit(level)))
    writer = parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=live) if live else writer.trigger(availableNow=True)).start()


def activity_sessions(
    updates: DataFrame, key: str, out: str, checkpoint: str, gap: str = "30 minutes", live: str | None = None
) -> StreamingQuery:
    """Bursts of activity per key. ``updates(ts, key)``; null times are left out.

    Each batch writes the sessions of its own rows; ``session_view`` merges those
    of all batches. No row is too late, and sessions still open are there as far
    as they have come. A key with very many rows is cut into ranges of time.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        bursts = batch.where("ts IS NOT NULL").select(
            key, F.col("ts").alias("start"), (F.col("ts") + F.expr(f"INTERVAL {gap}")).alias("end"), F.lit(1).cast("long").alias("n")
        )
        _write_batch(merged_runs(bursts, [key], "start", "end", "n"), out, batch_id)

    return _start(updates, sink, checkpoint, live=live)


def session_view(spark: SparkSession, key: str, out: str) -> DataFrame:
    """Sessions of all batches, overlapping ones as one."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
    return merged_runs(rows, [key], "start", "end", "n")
