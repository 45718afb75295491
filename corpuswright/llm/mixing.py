"""Mixing sources to target weights by fixed-length blocks.

Each source is one stream of words (documents in order of id) cut into blocks of
``block`` words. Every output shard draws its source counts from a multinomial;
the n-th slot drawn for a source takes the n-th block of that source's
pseudorandom permutation (one permutation per pass over the source). Nothing
depends on partitioning, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import row_numbers, running_sums
from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, and the most of one source, as multiples of the sizes.
SHARE = 1.5
MOST = 2
#: Words of a block and slots of an output shard.
BLOCK = 128
SHARD_SLOTS = 4096
#: Bins of the lookup from a drawn number to its source.
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source``, ``rank``, ``source_size``, ``weight``, ``target`` of every source.

    ``sizes`` has ``source`` and ``size``. Sources are ranked by code point, null
    last. Targets are ``weight * level``, at most ``most`` times the source's
    size; the level that spends the whole share is found by raising it until no
    further source reaches its limit (one small aggregation a step).
    """
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = row_numbers(sources, [], [F.col("source").asc_nulls_last()], "rank", start=0)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = materialize(ranked.withColumn("weight", weight), "sources")
    limit = F.col("source_size") * most
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= limit
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, limit)).alias("spent"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if not row["open"] or not row["all"]:
            break
        raised = (share * row["all"] - (row["spent"] or 0)) / row["open"]
        if raised <= level:
            break
        level = raised
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target)


def offsets(docs: DataFrame, targets: DataFrame, text: str | None = None) -> DataFrame:
    """Documents with ``rank``, ``first`` and ``last`` (their words' places in the source's stream, last excluded).

    ``docs`` has ``doc_id``, ``source``, ``size``, ``tie`` and, if named, the text.
    Repeated ids are ordered by ``tie``; rows equal in both can stand for each other.
    """
    kept = ["doc_id", "size", "tie", *([text] if text else [])]
    joined = docs.join(targets, docs["source"].eqNullSafe(targets["source"])).select(
        *kept, "rank", "source_size", "target"
    )
    placed = running_sums(joined, ["rank"], ["doc_id", "tie"], {"last": F.col("size")})
    return placed.withColumn("first", F.col("last") - F.col("size"))


def draw_slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """``shard``, ``slot``, ``rank``, ``block``, ``words``: the plan of the mix, one row a slot.

    Every slot draws its source with the sources' shares as probabilities, which
    makes the counts of a shard multinomial. What a source was drawn beyond its
    share goes to the sources drawn too rarely, so each source ends within one
    block of its target and no block is used more than ``MOST`` times.
    """
    spark = targets.sparkSession
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    wanted = F.floor("target").cast("long")
    passes = F.floor(wanted / F.col("source_size")).cast("long")
    rest = wanted - passes * F.col("source_size")
    plan = targets.where("source_size > 0").select(
        "rank",
        blocks.alias("blocks"),
        (passes * blocks + F.ceil(rest / block).cast("long")).alias("quota"),
        F.when(rest % block == 0, F.lit(block)).otherwise(rest % block).cast("long").alias("tail"),
        (rest > 0).alias("cut"),
    )
    plan = materialize(running_sums(plan, [], ["rank"], {"upto": F.col("quota")}), "plan")
    total = plan.agg(F.sum("quota")).first()[0] or 0
    width = max(1, -(-total // BINS))
    # quota ranges by bins, so that a drawn number finds its source by an equi join
    binned = plan.where("quota > 0").select(
        "rank",
        (F.col("upto") - F.col("quota")).alias("_from"),
        F.col("upto").alias("_to"),
        F.explode(F.sequence(F.floor((F.col("upto") - F.col("quota")) / width), F.floor((F.col("upto") - 1) / width))).alias("bin"),
    )
    number = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1)))
    drawn = spark.range(total).select(F.col("id").alias("slot"), number.alias("_n"), F.floor(number / width).alias("bin"))
    drawn = drawn.join(binned, "bin").where("_n >= _from AND _n < _to").select("slot", "rank")
    drawn = materialize(row_numbers(drawn, ["rank"], ["slot"], "index", start=0), "drawn")

    counts = plan.join(drawn.groupBy("rank").agg(F.count(F.lit(1)).alias("got")), "rank", "left").fillna(0, ["got"])
    counts = counts.withColumns(
        {"over": F.greatest(F.col("got") - F.col("quota"), F.lit(0)), "under": F.greatest(F.col("quota") - F.col("got"), F.lit(0))}
    )
    counts = materialize(running_sums(counts, [], ["rank"], {"over_to": F.col("over"), "under_to": F.col("under")}), "counts")
    joined = drawn.join(counts, "rank")
    fits = joined.where("index < quota").select("slot", "rank", "index")
    spare = joined.where("index >= quota").select("slot", (F.col("over_to") - F.col("over") + F.col("index") - F.col("quota")).alias("_m"))
    lacking = counts.where("under > 0").select(
        "rank", "got", (F.col("under_to") - F.col("under")).alias("_base"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)).alias("_j")
    )
    lacking = lacking.select("rank", (F.col("got") + F.col("_j")).alias("index"), (F.col("_base") + F.col("_j")).alias("_m"))
    slots = fits.unionByName(spare.join(lacking, "_m").select("slot", "rank", "index"))

    # one pseudorandom order of the blocks for every pass over a source
    rounds = F.ceil(F.col("quota") / F.col("blocks")).cast("long")
    every = plan.where("quota > 0").select(
        "rank", "blocks", "quota", "tail", "cut", F.explode(F.sequence(F.lit(0).cast("long"), rounds - 1)).alias("round")
    ).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = every.withColumn("_h", F.xxhash64(F.lit(seed), "rank", "round", "block"))
    order = row_numbers(every, ["rank", "round"], ["_h", "block"], "_pos", start=0)
    order = order.withColumn("index", F.col("round") * F.col("blocks") + F.col("_pos")).where("index < quota")
    words = F.when(F.col("cut") & (F.col("index") == F.col("quota") - 1), F.col("tail")).otherwise(block)
    order = order.select("rank", "index", "block", words.cast("long").alias("words"))
    shard = F.floor(F.col("slot") / shard_slots).cast("long").alias("shard")
    return slots.join(order, ["rank", "index"]).select(shard, "slot", "rank", "block", "words")


def taken_words(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every document of ``placed`` with ``taken``, the words the mix takes from it, repeats counted."""
    used = slots.groupBy("rank", "block").agg(
        F.sum((F.col("words") == block).cast("long")).alias("_full"),
        F.sum(F.when(F.col("words") < block, F.col("words")).otherwise(0)).alias("_part"),
    )
    kept = ["doc_id", "size", "source_size", "target"]
    spans = placed.where("size > 0").select(
        *kept, "rank", "first", "last",
        F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block))).alias("block"),
    )
    start = F.col("block") * block
    within = lambda size: F.greatest(F.least(F.col("last"), start + size) - F.greatest(F.col("first"), start), F.lit(0))
    taken = F.coalesce(within(F.lit(block)) * F.col("_full") + within(F.col("_part")), F.lit(0))
    # rank and last name a document that has words
    counted = spans.join(used, ["rank", "block"], "left").groupBy("rank", "last").agg(
        *[F.first(c).alias(c) for c in kept], F.sum(taken).cast("long").alias("taken")
    )
    empty = placed.where("size = 0").select(*kept, F.lit(0).cast("long").alias("taken"))
    return counted.select(*kept, "taken").unionByName(empty)


def sized(docs: DataFrame, text: str | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``size`` and a tie-breaker of every document; null texts have no words."""
    tie = F.xxhash64("text", "lang") if "lang" in docs.columns else F.xxhash64("text")
    kept = [F.col("text").alias(text)] if text else []
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), tie.alias("tie"), *kept)


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` of every row of ``docs``.

    Null ids come first in their stream, a null source is a source of its own
    (the last), null and empty texts have size 0 and are taken 0 times, repeated
    rows are documents of their own, an empty table gives no rows. Other columns
    are not read.
    """
    rows = materialize(sized(docs), "sized")
    targets = materialize(source_targets(rows), "targets")
    placed = materialize(offsets(rows, targets), "placed")
    return taken_words(placed, draw_slots(targets, block, shard_slots, seed), block)


def mixed_blocks(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """The mixed stream itself: ``shard``, ``slot``, ``source``, ``text`` (the slot's words, one space between)."""
    rows = materialize(sized(docs, "body"), "sized")
    targets = materialize(source_targets(rows.select("source", "size")), "targets")
    placed = offsets(rows, targets, "body").where("size > 0")
    words = F.regexp_extract_all("body", F.lit(WORD), F.lit(0))
    numbers = F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block))
    cut = F.transform(
        numbers,
        lambda b: F.struct(
            b.alias("block"),
            F.greatest(b * block, F.col("first")).alias("from"),
            F.slice(
                F.col("w"),
                (F.greatest(b * block - F.col("first"), F.lit(0)) + 1).cast("int"),
                (F.least((b + 1) * block, F.col("last")) - F.greatest(b * block, F.col("first"))).cast("int"),
            ).alias("words"),
        ),
    )
    pieces = placed.withColumn("w", words).select("rank", F.inline(cut))
    packed = pieces.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("from", "words"))).alias("p"))
    packed = packed.select("rank", "block", F.flatten(F.transform("p", lambda x: x["words"])).alias("all"))
    slots = draw_slots(targets, block, shard_slots, seed)
    return slots.join(packed, ["rank", "block"]).join(targets.select("rank", "source"), "rank").select(
        "shard", "slot", "source", F.array_join(F.slice("all", F.lit(1), F.col("words").cast("int")), " ").alias("text")
    )
