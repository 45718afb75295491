"""Ordered operators against plain windows, with a group of a third of all rows."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuswright.operators import ordering as od


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        group = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"g{rng.randrange(40)}")
        rows.append((i, group, rng.randrange(10_000) * 1000 + i, rng.randrange(5)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, g string, at long, v long")


def part_of(kind):
    return None if kind is None else F.floor(F.col("at") / 500_000).cast("long")


@pytest.mark.parametrize("kind", [None, "given"])
@pytest.mark.parametrize("splits", [1, 7])
def test_row_numbers(data, rows, kind, splits):
    got = od.row_numbers(data.repartition(splits), ["g"], ["at"], "n", part_of(kind))
    want = data.withColumn("n", F.row_number().over(W.partitionBy("g").orderBy("at")))
    assert sorted(rows(got, "id", "n")) == sorted(rows(want, "id", "n"))


@pytest.mark.parametrize("kind", [None, "given"])
def test_global_row_numbers(data, rows, kind):
    got = od.row_numbers(data, [], ["at"], "n", part_of(kind), start=0)
    order = [r[0] for r in sorted(rows(data, "at", "id"))]
    assert sorted(rows(got, "at", "n")) == [(at, i) for i, at in enumerate(order)]


@pytest.mark.parametrize("kind", [None, "given"])
def test_running_sums(data, rows, kind):
    got = od.running_sums(data, ["g"], ["at"], {"s": F.col("v")}, part_of(kind))
    window = W.partitionBy("g").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    want = data.withColumn("s", F.sum("v").over(window))
    assert sorted(rows(got, "id", "s")) == sorted(rows(want, "id", "s"))


@pytest.mark.parametrize("kind", [None, "given"])
def test_previous_values(data, rows, kind):
    got = od.previous_values(data, ["g"], "at", {"p": "v", "q": "id"}, part_of(kind))
    window = W.partitionBy("g").orderBy("at")
    want = data.withColumns({"p": F.lag("v").over(window), "q": F.lag("id").over(window)})
    assert set(rows(got, "id", "p", "q")) == set(rows(want, "id", "p", "q"))


def test_previous_null_value_is_not_skipped(spark, rows):
    df = spark.createDataFrame([("a", 1, None), ("a", 9, "x")], "g string, at long, v string")
    got = od.previous_values(df, ["g"], "at", {"p": "v", "q": "at"}, F.col("at"))
    assert set(rows(got, "at", "p", "q")) == {(1, None, None), (9, None, 1)}


def test_first_per_key_takes_least_order(data, rows):
    got = od.first_per_key(data, ["g"], ["at"])
    want = {}
    for g, at, i in rows(data, "g", "at", "id"):
        if g not in want or at < want[g][0]:
            want[g] = (at, i)
    assert {g: (at, i) for g, at, i in rows(got, "g", "at", "id")} == want


def test_top_per_key_limits_before_the_shuffle(data):
    top = od.top_per_key(data, ["g"], [F.col("at")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top.where("g = 'hot'").count() == 3


def test_ordered_concat_loses_nothing(spark, rows):
    texts = [("k", i, f"t{i}") for i in range(25)] + [("one", 0, "x")]
    df = spark.createDataFrame(texts, "k string, pos long, t string").repartition(5)
    whole = {k: c for k, c in rows(od.ordered_concat(df, ["k"], "pos", "t", "|", "c"), "k", "c")}
    assert whole == {"k": "|".join(f"t{i}" for i in range(25)), "one": "x"}
    parts = sorted(rows(od.ordered_concat(df, ["k"], "pos", "t", "|", "c", part_size=10), "k", "part", "c", "pieces"))
    assert "|".join(c for k, _, c, _ in parts if k == "k") == whole["k"]
    assert [p[3] for p in parts if p[0] == "k"] == [10, 10, 5]


def test_large_top_per_key_is_numbered_in_parts(data, rows, monkeypatch):
    order = [F.col("v").desc(), F.col("id")]
    want = sorted(rows(od.top_per_key(data, ["g"], order, 20), "id", "rank"))
    monkeypatch.setattr(od, "GROUP_LIMIT", 5)
    assert sorted(rows(od.top_per_key(data, ["g"], order, 20), "id", "rank")) == want


def plain_runs(data):
    out = []
    for g in sorted({r[0] for r in data}, key=str):
        for s, e, n in sorted((s, e, n) for h, s, e, n in data if h == g):
            if out and out[-1][0] == g and s < out[-1][2]:
                out[-1] = (g, out[-1][1], max(out[-1][2], e), out[-1][3] + n)
            else:
                out.append((g, s, e, n))
    return sorted(out, key=str)


def test_merged_runs(spark, rows):
    """A group with a third of all rows over many ranges, one interval that spans several, ties, a null group."""
    rng = random.Random(11)
    data = [(rng.choice(["a", "b", "c", None]), s, s + rng.randrange(1, 40), 1) for s in (rng.randrange(20_000) for _ in range(600))]
    data += [("hot", s, s + 6, 2) for s in (rng.randrange(4_000) for _ in range(400))]
    data += [("hot", 900, 2_500, 5), ("long", 0, 9_000, 1), ("long", 10, 20, 1), ("long", 9_000, 9_001, 1), ("one", 5, 6, 1), ("one", 5, 6, 1)]
    df = spark.createDataFrame(data, "g string, s long, e long, n long").repartition(7)
    for name, value in (("coalescePartitions.enabled", "false"), ("advisoryPartitionSizeInBytes", "1k")):  # small ranges stay apart
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    try:
        _check_runs(spark, rows, data, df)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _check_runs(spark, rows, data, df):
    assert sorted(rows(od.merged_runs(df, ["g"], "s", "e", "n"), "g", "s", "e", "n"), key=str) == plain_runs(data)
    ranged = od.with_parts(df, ["g"], ["s"], None).where("g = 'hot'")
    assert ranged.select(od.PART).distinct().count() > 1
    assert od.merged_runs(df.where("false"), ["g"], "s", "e", "n").count() == 0
