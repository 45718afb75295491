"""Task graphs, curricula, versions, retries."""

import random

import pytest
from pyspark.sql import functions as F

from corpuswright.operators import tasks as tk


def graph(spark, statuses, deps):
    nodes = spark.createDataFrame([(k, v) for k, v in statuses.items()], "node_id string, status string")
    edges = spark.createDataFrame([(n, d) for n, ds in deps.items() for d in ds], "node_id string, dep_id string")
    return nodes, edges


def test_ready_and_blocked(spark, rows):
    nodes, edges = graph(
        spark,
        {
            "a": "completed", "b": "pending", "c": "failed", "d": "pending", "e": "pending", "f": "pending",
            "g": "pending", "h": "running", "i": "pending", "j": "completed", "k": "pending",
        },
        # d waits for a failure, e for d, f for both sides, g has an unknown dependency,
        # k hangs below a completed node that itself hangs below the failure
        {"b": ["a"], "d": ["c"], "e": ["d"], "f": ["a", "e"], "g": ["zz"], "i": ["h"], "j": ["c"], "k": ["j"]},
    )
    assert {r[0] for r in rows(tk.ready_nodes(nodes, edges), "node_id")} == {"b", "g", "k"}
    blocked = tk.blocked_closure(nodes, edges)
    assert dict(rows(blocked)) == {"d": 1, "e": 2, "f": 3}
    after = dict(rows(tk.apply_skips(nodes, blocked)))
    assert [after[n] for n in "defgk"] == ["skipped"] * 3 + ["pending"] * 2


def test_cycles_end(spark, rows):
    nodes, edges = graph(spark, {"a": "failed", "b": "pending", "c": "pending"}, {"b": ["a", "c"], "c": ["b"]})
    assert dict(rows(tk.blocked_closure(nodes, edges))) == {"b": 1, "c": 2}


@pytest.mark.parametrize(("patience", "growth"), [(8, 4), (1, 4), (1, 0)])
def test_blocked_levels_are_distances(spark, rows, patience, growth):
    """Random graphs and a long chain, by doubling and one step at a time."""
    rng = random.Random(13)
    states = {i: rng.choice(["pending"] * 8 + ["failed", "completed", "skipped"]) for i in range(120)}
    deps = {i: rng.sample(range(120), rng.randrange(0, 3)) for i in states}
    chain = 40 if growth else 8
    states |= {1000: "failed", **{1000 + i: "pending" for i in range(1, chain)}}
    deps |= {1000 + i: [999 + i] for i in range(1, chain)}
    want, front, level = {}, {n for n, s in states.items() if s in ("failed", "skipped")}, 0
    while front:
        level += 1
        front = {n for n, ds in deps.items() if states[n] == "pending" and n not in want and front & set(ds)}
        want |= {n: level for n in front}
    nodes = spark.createDataFrame(list(states.items()), "node_id long, status string")
    edges = spark.createDataFrame([(n, d) for n, ds in deps.items() for d in ds], "node_id long, dep_id long")
    assert dict(rows(tk.blocked_closure(nodes, edges, patience, growth), "node_id", "level")) == want


def test_summary_and_resume(spark, rows):
    data = [("x", "completed"), ("x", "skipped"), ("y", "failed"), ("y", "pending"), ("z", "running")]
    df = spark.createDataFrame(data, "dag_id string, status string")
    got = {r[0]: r[1:] for r in rows(tk.dag_summary(df), "dag_id", "pending", "failed", "skipped", "dag_status")}
    assert got == {"x": (0, 0, 1, "completed"), "y": (1, 1, 0, "partial_failure"), "z": (0, 0, 0, "running")}
    nodes = spark.createDataFrame([(s, "e") for s in ("failed", "running", "skipped", "completed")], "status string, error string")
    assert rows(tk.resume_plan(nodes), "status", "error") == [("pending", "")] * 3 + [("completed", "e")]


def test_curricula(spark, rows):
    data = [("a", "done"), ("a", "failed"), ("b", "done"), ("c", "done"), ("c", "studying"), ("c", "odd"), ("c", None)]
    df = spark.createDataFrame(data, "k string, status string").fillna("pending")
    assert dict(rows(tk.curriculum_status(df, ["k"]))) == {"a": "completed_with_errors", "b": "completed", "c": "in_progress"}
    assert rows(tk.curriculum_progress(df)) == [(7, 3, 1, 3, 1)]


@pytest.mark.parametrize("splits", [1, 6])
def test_retry_chains(spark, rows, splits):
    data = [(i, i - 1 if i % 100 else None) for i in range(300)] + [(900, 12345)]
    df = spark.createDataFrame(data, "id long, retry_of long").repartition(splits)
    got = {r[0]: r[1:] for r in rows(tk.retry_lineage(df))}
    assert got == {**{i: (i - i % 100, i % 100 + 1) for i in range(300)}, 900: (900, 1)}


def test_changed_versions(spark, rows):
    data = [("u", h, t) for t, h in enumerate("aabbab")] + [("v", "z", 3)]
    df = spark.createDataFrame(data, "url string, hash string, at long")
    for part in (None, F.lit(0), F.floor(F.col("at") / 2)):
        got = rows(tk.changed_versions(df, "at", part).where("change IS NOT NULL"), "url", "at", "change")
        assert sorted(got) == [("u", 0, "new"), ("u", 2, "updated"), ("u", 4, "updated"), ("u", 5, "updated"), ("v", 3, "new")]


def test_a_page_with_most_versions_of_one_hour(spark, rows):
    """A third of all versions in one hour of one page are many ranges; a null hash is a hash."""
    rng = random.Random(3)
    data = [("hot", rng.choice(["a", "b", None]), t) for t in range(600)]
    data += [(f"p{rng.randrange(300)}", rng.choice("xyz"), 3600 * rng.randrange(1, 500) + i) for i, _ in enumerate(range(1200))]
    df = spark.createDataFrame(data, "url string, hash string, at long").repartition(6)
    want, last = [], {}
    for url, h, t in sorted(data, key=lambda r: r[2]):
        if url not in last or last[url] != h:
            want.append((url, t, "updated" if url in last else "new"))
        last[url] = h
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(tk.changed_versions(df, "at").where("change IS NOT NULL"), "url", "at", "change")
        done = rows(tk.study_progress(df, "url", ["at"]).where("url = 'hot'"), "at", "processed", "processed_total")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(got) == sorted(want)
    assert sorted(done) == [(t, t + 1, 600) for t in range(600)]


def test_progress(spark, rows):
    df = spark.createDataFrame([("r", i) for i in range(3)], "run string, at long")
    got = sorted(rows(tk.study_progress(df, "run", ["at"], F.lit(0)), "at", "study_pct", "publish_pct", "curriculum_pct"))
    assert got == [(0, 37, 15, 25), (1, 64, 38, 41), (2, 92, 61, 58)]


def test_indexes(spark, rows):
    have = spark.createDataFrame([("00_a",), ("07_b",), ("no",)], "name string")
    new = spark.createDataFrame([("B: x y", 2), ("A", 1)], "name string, seq long")
    got = rows(tk.assign_indexes(new, have, "seq", F.lit(0)).orderBy("seq"), "dir_name")
    assert got == [("08_A",), ("09_B_x_y",)]
    assert rows(tk.assign_indexes(new, have.where("name = 'no'"), "seq", F.lit(0)).orderBy("seq"), "idx") == [(0,), (1,)]


def test_resumable(spark, rows):
    df = spark.createDataFrame([("a", "paused", 0), ("b", "error", 8), ("c", "completed", 3)], "id string, status string, current_step int")
    assert rows(tk.resumable_runs(df), "id", "step_name") == [("a", "rag_insert"), ("b", "done")]


def test_actions(spark, rows):
    df = spark.createDataFrame([("k", "queued"), ("k", "failed"), ("x", "failed")], "kind string, status string")
    assert rows(tk.task_action_flags(df, ["k"]), "can_cancel", "can_retry") == [(True, False), (False, True), (False, False)]


def test_retry_lineage_ends_on_cycles(spark, rows):
    links = [("a", None), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s")]
    found = tk.retry_lineage(spark.createDataFrame(links, "id string, retry_of string"))
    assert sorted(rows(found, "id", "root", "attempt")) == [
        ("a", "a", 1), ("b", "a", 2), ("s", None, None), ("x", None, None), ("y", None, None), ("z", None, None)
    ]
