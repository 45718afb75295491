"""Streams fed in several batches equal the batch operators on all rows."""

import collections

import pandas as pd
from pyspark.sql import functions as F

from corpuswright.plans import catalog
from corpuswright.streaming import jobs


def feed(spark, tmp_path, batches, schema):
    """One parquet file per batch, read one file at a time in name order."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        staged = str(tmp_path / f"staged{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(staged)
        folder.mkdir(exist_ok=True)
        part = next((tmp_path / f"staged{i}").glob("*.parquet"))
        target = folder / f"b{i}.parquet"
        target.write_bytes(part.read_bytes())
        import os

        os.utime(target, (1_700_000_000 + i * 10,) * 2)
    return str(folder)


def test_changed_pages(spark, rows, tmp_path):
    """Five files in order, a hash that is null, a hot page, and a restart with one more file."""
    schema = "url string, hash string, at long, note struct<n: long>"
    data = [[("u", h, b * 10 + i) for i, h in enumerate(part)] for b, part in enumerate(["aab", "bb", "ba", "c", ""])]
    data[1].append(("v", "z", 11))
    data[3] += [("v", "z", 31), ("w", None, 32)]
    data[4] += [("w", None, 41), ("v", "y", 42), ("u", "c", 43), ("w", "q", 44)] + [("hot", "ab"[i // 30 % 2], 100 + i) for i in range(300)]
    data = [[(*r, (i,)) for i, r in enumerate(part)] for part in data]
    folder = feed(spark, tmp_path, data, schema)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream = jobs.file_stream(spark, folder, "*.parquet", schema, files_per_batch=1)

    def expected():
        last, out = {}, []
        for url, h, at, note in sorted(rows(spark.read.parquet(folder), "url", "hash", "at", "note.n"), key=lambda r: r[2]):
            if url not in last or last[url] != h:
                out.append((url, h, at, "updated" if url in last else "new", note))
            last[url] = h
        return sorted(map(repr, out))

    def found():
        return sorted(map(repr, rows(jobs.changed_pages(spark, out), "url", "hash", "at", "change", "note.n")))

    jobs.changed_pages_stream(stream, out, check).awaitTermination()
    assert found() == expected()
    # a restart with nothing new adds nothing, one with a new file goes on where it stood
    jobs.changed_pages_stream(stream, out, check).awaitTermination()
    assert found() == expected()
    spark.createDataFrame([("u", "c", 500, (0,)), ("u", "d", 501, (1,)), ("x", "a", 502, (2,))], schema).coalesce(1).write.parquet(str(tmp_path / "late"))
    (tmp_path / "in" / "b9.parquet").write_bytes(next((tmp_path / "late").glob("*.parquet")).read_bytes())
    jobs.changed_pages_stream(stream, out, check).awaitTermination()
    assert found() == expected() and "updated" in repr(found())


def test_a_repeated_batch_is_not_counted_twice():
    class State:
        def __init__(self):
            self.get, self.exists = None, False

        def update(self, value):
            self.get, self.exists = value, True

    state = State()
    frame = lambda *r: pd.DataFrame([r], columns=["hash", "last_hash", "batch_no"])
    decide = lambda *frames: [r.change[0] for r in jobs._decide(("u",), iter(frames), state)]
    assert decide(frame("b", "c", 1), frame("a", "a", 0)) == ["new", "updated"]
    assert decide(frame("b", "c", 1)) == [] and state.get == ("c", 1)
    assert decide(frame("c", "c", 2)) == [] and state.get == ("c", 2)


def test_queue(spark, rows, tmp_path):
    schema = "url string, seq long, t long"
    folder = feed(spark, tmp_path, [[("a", 0, 1), ("b", 1, 2), ("a", 2, 3)], [("b", 3, 4), ("c", 4, 5), ("old", 5, 6)]], schema)
    queue = spark.createDataFrame([("old", "processed")], "url string, state string")
    stream = jobs.file_stream(spark, folder, "*.parquet", schema, 1).withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_000_000))
    out = str(tmp_path / "out")
    for _ in range(2):  # a restart queues nothing again
        jobs.enqueue_stream(stream, queue, out, str(tmp_path / "check")).awaitTermination()
    assert sorted(rows(spark.read.parquet(out), "url", "state")) == [("a", "pending"), ("b", "pending"), ("c", "pending")]


def test_ingest(spark, rows, tmp_path):
    schema = "id string, content string, content_hash string, order_index long, source_type string"
    folder = feed(
        spark, tmp_path,
        [[("1", "x", None, 1, "w"), ("2", "x", None, 2, "w"), ("3", "", None, 3, "w")], [("4", "x", None, 1, "w"), ("5", "y", None, 2, "d")]],
        schema,
    )
    path = str(tmp_path / "table")
    stream = jobs.file_stream(spark, folder, "*.parquet", schema, 1)
    jobs.ingest_stream(stream, path, str(tmp_path / "c1")).awaitTermination()
    assert {r[0] for r in rows(spark.read.parquet(path), "id")} == {"1", "3", "5"}
    # the same input again, as after a lost checkpoint, changes nothing
    jobs.ingest_stream(stream, path, str(tmp_path / "c2")).awaitTermination()
    assert sorted(r[0] for r in rows(spark.read.parquet(path), "id")) == ["1", "3", "5"]


def test_task_windows_and_latest(spark, rows, tmp_path):
    schema = "task string, status string, t long"
    data = [[("a", "queued", 0), ("b", "queued", 10)], [("a", "running", 20), ("b", "running", 4000)], [("a", "completed", 4100)]]
    folder = feed(spark, tmp_path, data, schema)
    stream = jobs.file_stream(spark, folder, "*.parquet", schema, 1)
    timed = stream.withColumn("ts", F.timestamp_seconds(F.col("t") + 1_700_006_400))
    out = str(tmp_path / "win")
    jobs.task_window_stream(timed.select("ts", "status"), out, str(tmp_path / "c1"), "1 hour").awaitTermination()
    base = 1_700_006_400
    got = {(r[0] - base, r[1]): r[2] for r in rows(jobs.window_counts(spark, out), F.unix_seconds("start"), "status", "n")}
    want = {}
    for part in data:
        for _, s, t in part:
            key = ((base + t) // 3600 * 3600 - base, s)
            want[key] = want.get(key, 0) + 1
    assert got == want
    latest = str(tmp_path / "latest")
    jobs.task_latest_stream(stream, "task", ["t"], latest, str(tmp_path / "c2")).awaitTermination()
    assert sorted(rows(jobs.latest_tasks_view(spark, "task", latest), "task", "status")) == [("a", "completed"), ("b", "running")]


def test_counts_are_merged_now_and_then(spark, rows, tmp_path, monkeypatch):
    """Six batches, merged every two; a state that was merged is not read batch by batch again."""
    monkeypatch.setattr(jobs, "MERGED", 2)
    schema = "task string, status string, t long"
    data = [[(f"t{i % 3}", "queued" if i % 2 else "done", 3600 * (i % 4)), ("hot", "queued", i)] for i in range(5)] + [[(None, None, 7)]]
    folder = feed(spark, tmp_path, data, schema)
    timed = jobs.file_stream(spark, folder, "*.parquet", schema, 1).withColumn("ts", F.timestamp_seconds("t"))
    out = str(tmp_path / "win")
    jobs.task_window_stream(timed.select("ts", "status"), out, str(tmp_path / "c1")).awaitTermination()
    everything = [r for part in data for r in part]
    want = collections.Counter((t // 3600 * 3600, s) for _, s, t in everything)
    assert {(r[0], r[1]): r[2] for r in rows(jobs.window_counts(spark, out), F.unix_seconds("start"), "status", "n")} == want
    assert jobs._newest(spark, f"{out}/merged") == 5
    jobs.task_latest_stream(timed, "task", ["t"], str(tmp_path / "latest"), str(tmp_path / "c2")).awaitTermination()
    last = {}
    for task, status, t in everything:
        last[task] = max(last.get(task, (-1, "")), (t, status or ""))
    got = {r[0]: (r[1], r[2] or "") for r in rows(jobs.latest_tasks_view(spark, "task", str(tmp_path / "latest")), "task", "t", "status")}
    assert got == last


def test_log_stream(spark, rows, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "1.log").write_text("2026-01-02 03:04:05,678 - app - INFO - a\ntrace\n2026-01-02 03:04:06,678 - app - ERROR - b\n")
    out = str(tmp_path / "out")
    jobs.log_stream(spark, str(logs), out, str(tmp_path / "c"), "ERROR").awaitTermination()
    assert rows(spark.read.parquet(out), "level", "message") == [("ERROR", "b")]


def test_sessions_and_late_urls_over_batches(spark, rows, tmp_path):
    folder = tmp_path / "in"
    batches = [[("a", 0), ("a", 600), ("b", 0)], [("a", 9000), ("a", 1500)], [("b", 1800), ("b", 1799 + 1800)]]
    for i, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, "user string, sec long").coalesce(1)
        frame.select(F.col("sec").cast("timestamp").alias("ts"), "user", F.col("user").alias("url"), F.col("sec").alias("seq")).write.parquet(
            str(folder / f"b{i}")
        )
        (folder / f"b{i}").touch()
    reader = spark.readStream.schema("ts timestamp, user string, url string, seq long").option("recursiveFileLookup", "true")
    stream = reader.option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = str(tmp_path / "out")
    jobs.activity_sessions(stream.select("ts", "user"), "user", out, str(tmp_path / "c")).awaitTermination()
    got = rows(jobs.session_view(spark, "user", out).orderBy("user", "start"), "user", F.unix_seconds("start"), F.unix_seconds("end"), "n")
    assert got == [("a", 0, 3300, 3), ("a", 9000, 10800, 1), ("b", 0, 1800, 1), ("b", 1800, 5399, 2)]
    queue = spark.createDataFrame([], "url string, state string")
    out = str(tmp_path / "queued")
    jobs.enqueue_stream(stream.select("url", "seq", "ts"), queue, out, str(tmp_path / "c2")).awaitTermination()
    assert sorted(rows(spark.read.parquet(out), "url")) == [("a",), ("b",)]


def _part_files(spark, folder, name, data, schema):
    """A table as a folder of several part files, as larger tables are written."""
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")


def test_enqueue_query_reads_a_folder_of_part_files(spark, rows, tmp_path):
    """Pages under https are queued before, the others are new."""
    urls = [f"{'http' if i % 3 else 'https'}://p{i // 2}.example/a" for i in range(12)]
    _part_files(spark, tmp_path, "pages", [(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string")
    found = rows(catalog.queries()["m2_enqueue_stream"](spark, str(tmp_path)), "url", "state")
    assert sorted(found) == sorted({(u, "pending") for u in urls if u.startswith("http:")})


def test_ingest_query_reads_a_folder_of_part_files(spark, rows, tmp_path):
    texts = ["one text", "another", "one text", "third", "another", "fourth"]
    data = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    _part_files(spark, tmp_path, "documents", data, "doc_id long, text string, lang string, source string, n_chars long")
    found = rows(catalog.queries()["m3_ingest_stream"](spark, str(tmp_path)), "id", "source_type")
    assert sorted(found) == [("0", "web"), ("1", "web"), ("3", "web"), ("5", "web")]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def _documents(texts, source="web"):
    return [(i, t, "de" if i % 2 else "en", source, len(t)) for i, t in enumerate(texts)]


def test_ingest_query_reads_a_folder_of_partitions(spark, rows, tmp_path):
    """Folders of a column of the table, and below them of one it does not have."""
    data = spark.createDataFrame(_documents(["one text", "another", "one text", "third", "another", "fourth"]), DOCUMENTS)
    parted = data.withColumns({"copy": F.col("doc_id") % 2, "by": F.col("source")}).drop("source").withColumnRenamed("by", "source")
    parted.write.partitionBy("source", "copy").parquet(str(tmp_path / "documents.parquet"))
    found = rows(catalog.queries()["m3_ingest_stream"](spark, str(tmp_path)), "id", "source_type")
    assert sorted(found) == [("0", "web"), ("1", "web"), ("3", "web"), ("5", "web")]


def test_ingest_query_without_documents(spark, tmp_path):
    _part_files(spark, tmp_path, "documents", [], DOCUMENTS)
    found = catalog.queries()["m3_ingest_stream"](spark, str(tmp_path))
    assert found.dtypes == [("id", "string"), ("source_type", "string"), ("content_hash", "string")] and found.isEmpty()


def test_ingest_query_keeps_sources_as_text(spark, rows, tmp_path):
    _part_files(spark, tmp_path, "documents", _documents(["a text", "b text"], "007"), DOCUMENTS)
    assert sorted(rows(catalog.queries()["m3_ingest_stream"](spark, str(tmp_path)), "id", "source_type")) == [("0", "007"), ("1", "007")]


def test_ingest_goes_on_after_a_batch_without_rows(spark, rows, tmp_path):
    schema = "id string, content string, content_hash string, order_index long, source_type string"
    folder = feed(spark, tmp_path, [[], [("1", "x", None, 1, "w"), ("2", "x", None, 2, "w")], [], [("3", "y", None, 1, "w")]], schema)
    path = str(tmp_path / "table")
    jobs.ingest_stream(jobs.file_stream(spark, folder, "*.parquet", schema, 1), path, str(tmp_path / "check")).awaitTermination()
    assert sorted(r[0] for r in rows(spark.read.parquet(path), "id")) == ["1", "3"]


def test_ingest_goes_on_after_an_append_that_broke_off(spark, rows, tmp_path):
    """Only the committer's folder is there; the restart writes what is missing."""
    schema = "id string, content string, content_hash string, order_index long, source_type string"
    folder = feed(spark, tmp_path, [[("1", "x", None, 1, "w")]], schema)
    (tmp_path / "table" / "_temporary" / "0").mkdir(parents=True)
    stream = jobs.file_stream(spark, folder, "*.parquet", schema)
    jobs.ingest_stream(stream, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "table")), "id") == [("1",)]
