"""Sharding by balanced label propagation: linked documents share a shard, shards have equal sizes.

Links are a bipartite table of documents and hubs (equal texts, a site, a group
of near duplicates, or a hub of two for a single link), so a group of ``n``
linked documents costs ``n`` rows, never its pairs. Documents begin in shards
drawn by hash. In each round a hub asks its documents to come to the shards
that hold most of it; a hub larger than a shard asks for as many shards as it
fills. Moves are granted by quotas: the share of the wishes to enter a shard
that it has room for, counting those who leave. When few wishes are left, the
documents beyond a shard's equal part, those without links first, go to where
room is left.

Nulls: a null text has no bytes and is equal to the empty text; null and
repeated ids are rows like any other. A document larger than a shard's part
fills its shard alone. Empty tables give no rows. Other columns are not looked
at, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordering import row_numbers, running_sums
from ..session import materialize

SHARDS = 40
ROUNDS = 12
#: Bytes a document takes besides its text.
OVERHEAD = 16
#: Shards may be this much over their part while labels move; levelling takes it off in whole groups.
SLACK = 0.1
#: Rounds end when less than this share of all bytes would still move.
SETTLED = 0.0005


def _draw(*keys: Column | str) -> Column:
    """Pseudorandom number of [0, 1), a function of the keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)).cast("double") / float(1 << 30)


def text_hub(text: Column) -> Column:
    """128-bit hash that names a text."""
    return F.md5(F.coalesce(text, F.lit("")))


def measured(docs: DataFrame) -> DataFrame:
    """``row, doc_id, size, text_crc32, hub`` of every document; what moves later is this, not the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
        text_hub(text).alias("hub"),
    )
    # the row number holds once it is written
    return materialize(narrow.withColumn("row", F.monotonically_increasing_id()), "measured")


def _quotas(flows: list, loads: dict[int, int], room: float, shards: int) -> list[float]:
    """Share of the wishes granted to enter each shard, lowered until none takes more than room and leavers allow.

    ``flows`` has a row for each pair of shards at most.
    """
    grant = [1.0] * shards
    for _ in range(100):
        entering, leaving = [0.0] * shards, [0.0] * shards
        for f in flows:
            entering[f["to"]] += f["bytes"]
            leaving[f["shard"]] += f["bytes"] * grant[f["to"]]
        free = [max(0.0, room - loads.get(j, 0) + leaving[j]) for j in range(shards)]
        lower = [min(g, f / e) if e else g for g, f, e in zip(grant, free, entering, strict=True)]
        if max(g - x for g, x in zip(grant, lower, strict=True)) < 1e-4:
            return lower
        grant = lower
    return grant


def _per_shard(values: list[float], shard: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col(shard))


def _calls(links: DataFrame, at: DataFrame, room: float, grant: list[float]) -> DataFrame:
    """``hub, shard, to, weight``: where a hub wants its documents of a shard to go, and how much of it is there.

    A hub has an entry per shard at most, so ranking its shards is bounded. Shards
    that granted few wishes in the round before count less for hubs with little there.
    """
    held = links.join(at, "row").groupBy("hub", "shard").agg(F.sum("size").alias("held"))
    open_share = F.when(F.col("held") * 2 < room, 0.05 + 0.95 * _per_shard(grant, "shard")).otherwise(1.0)
    place = F.struct((-F.col("held") * open_share).alias("rank"), F.xxhash64("hub", "shard").alias("tie"), "shard", "held")
    hubs = held.groupBy("hub").agg(F.array_sort(F.collect_list(place)).alias("places"), F.sum("held").alias("whole"))
    fills = F.greatest(F.lit(1), F.ceil(F.col("whole") / room)).cast("int")
    asked = F.transform(
        "places", lambda x, i: F.struct(x["shard"].alias("shard"), F.get("places", i % F.col("fills")).alias("asked"))
    )
    calls = hubs.withColumn("fills", fills).select("hub", F.explode(asked).alias("c"))
    return calls.select("hub", "c.shard", F.col("c.asked.shard").alias("to"), F.col("c.asked.held").alias("weight"))


def _wishes(links: DataFrame, at: DataFrame, calls: DataFrame) -> DataFrame:
    """``at`` with the shard that calls each row loudest (``to``) and the hub that calls (``caller``)."""
    heard = links.join(at.select("row", "shard"), "row").join(calls, ["hub", "shard"])
    votes = heard.groupBy("row", "to").agg(F.struct(F.sum("weight").alias("votes"), F.max("hub").alias("caller")).alias("vote"))
    loudest = F.max(F.struct("vote", "to")).alias("best")
    best = votes.groupBy("row").agg(loudest).select("row", F.col("best.to").alias("to"), F.col("best.vote.caller").alias("caller"))
    return at.join(best, "row")


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``row, shard, anchor`` for the rows of ``nodes(row, doc_id, size)`` that ``links(row, hub)`` connects.

    ``anchor`` is the hub that has called the row to its shard. A row may have
    several hubs; it follows the shard for which they call with most bytes.
    """
    total = nodes.agg(F.sum("size")).first()[0] or 0
    room = max(total / shards, 1.0)
    shared = links.groupBy("hub").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b")
    links = materialize(links.join(shared, "hub", "left_semi").select("row", "hub"), "links")
    start = F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int").alias("shard")
    linked = nodes.join(links.groupBy("row").agg(F.min("hub").alias("anchor")), "row")
    at = materialize(linked.select("row", "size", start, "anchor"), "shards")
    grant = [1.0] * shards
    for turn in range(rounds):
        wish = materialize(_wishes(links, at, _calls(links, at, room, grant)), "wishes")
        flows = wish.where("`to` <> shard").groupBy("shard", "to").agg(F.sum("size").alias("bytes")).collect()
        if sum(f["bytes"] for f in flows) <= SETTLED * total:
            break
        loads = {r["shard"]: r["load"] for r in at.groupBy("shard").agg(F.sum("size").alias("load")).collect()}
        grant = _quotas(flows, loads, room * (1 + SLACK), shards)
        # a small block moves as one or stays; of a large one goes what fits
        blocks = wish.groupBy("caller", "shard").agg(F.sum("size").alias("block"))
        luck = F.when(F.col("block") * 100 < room, _draw("caller", "shard", F.lit(turn))).otherwise(_draw("row", F.lit(turn)))
        goes = luck < _per_shard(grant, "to")
        moved = wish.join(blocks, ["caller", "shard"]).select(
            "row", "size", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"), F.col("caller").alias("anchor")
        )
        at = materialize(moved, "shards")
    return at.select("row", "shard", "anchor")


def level(placed: DataFrame, shards: int = SHARDS, passes: int = 2) -> DataFrame:
    """``placed(row, size, shard, anchor, ...)`` with shards of equal size; a null ``shard`` is not placed yet.

    What stands beyond a shard's equal part leaves it, rows with an anchor last
    and small rows first; all that is outside fills what is free, shard after
    shard. Later passes move ever smaller rows, so sizes differ by little.
    """
    part = (placed.agg(F.sum("size")).first()[0] or 0) / shards
    rest = [c for c in placed.columns if c != "shard"]
    waiting = placed.where("shard IS NULL")
    placed = placed.where("shard IS NOT NULL")
    for turn in range(passes):
        order = [F.col("anchor").isNull(), F.col("anchor"), F.col("size").desc(), F.col("row")]
        summed = running_sums(placed, ["shard"], order, {"_upto": F.col("size")})
        stays = F.when((F.col("_upto") <= part) | (F.col("_upto") == F.col("size")), F.col("shard"))
        stood = materialize(summed.select(*rest, stays.alias("shard")), "standing")
        loads = {r["shard"]: r["load"] for r in stood.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("size").alias("load")).collect()}
        ends, end = [], 0.0
        for j in range(shards - 1):
            end += max(0.0, part - loads.get(j, 0))
            ends.append(end)
        outside = stood.where("shard IS NULL")
        if turn == 0:
            outside = outside.unionByName(waiting)
        outside = running_sums(outside.drop("shard"), [], ["anchor", _draw("row", F.lit(turn)), "row"], {"_upto": F.col("size")})
        begins = F.col("_upto") - F.col("size")
        passed = F.filter(F.array(*[F.lit(e) for e in ends]).cast("array<double>"), lambda e: e <= begins)
        placed = stood.where("shard IS NOT NULL").unionByName(outside.select(*rest, F.size(passed).alias("shard")))
    return placed


def shard_documents(docs: DataFrame, shards: int = SHARDS, links: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: all documents in shards of equal bytes, slots gapless from 0.

    ``links(doc_id, hub)`` names further hubs (strings) besides equal texts.
    """
    nodes = measured(docs)
    hubs = nodes.select("row", "hub")
    if links is not None:
        more = links.where("doc_id IS NOT NULL").select("doc_id", F.concat(F.lit("link:"), F.col("hub").cast("string")).alias("hub"))
        hubs = hubs.unionByName(nodes.select("row", "doc_id").join(more, "doc_id").select("row", "hub"))
    placed = nodes.join(propagate(nodes, hubs, shards, rounds), "row", "left")
    levelled = level(materialize(placed, "propagated"), shards)
    return row_numbers(levelled, ["shard"], ["doc_id", "hub", "row"], "slot", start=0).select("doc_id", "size", "text_crc32", "shard", "slot")
