"""Ordered computations that hold when one group has a third of all rows.

A plain window sends a whole group to one task. Here a group is first cut into
ordered parts of bounded size; the window runs inside ``(group, part)`` and a
small table of per-part totals carries the result from part to part. Parts are
either a given monotone column (an hour, an id range) or the ranges Spark's own
range partitioning chooses from the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

PART = "_part"
KEY = "_group_part"

#: Spark's default for spark.sql.optimizer.windowGroupLimitThreshold.
GROUP_LIMIT = 1000


def _columns(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def with_parts(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], part: Column | None) -> DataFrame:
    """Add the part number. Without a given part the rows are range partitioned.

    The ranged rows are written out once, because the part numbers must be the
    same in every branch that reads them. Group and part together form one
    struct key: the carry join and the window then share one shuffle of the
    rows, and null groups compare equal.
    """
    if part is not None:
        parts = df.withColumn(PART, part)
    else:
        keys = [F.col(g) for g in group] + _columns(order)
        parts = materialize(df.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id()), "ranged")
    return parts.withColumn(KEY, F.struct(*group, PART))


def _within(order: Sequence[str | Column]):
    return W.partitionBy(KEY).orderBy(*_columns(order))


def _across(group: Sequence[str]):
    """Parts of a group in order: one row per part, not per row of data."""
    return W.partitionBy(*(group or [F.lit(0)])).orderBy(PART)


def _per_part(parts: DataFrame, group: Sequence[str], *aggs: Column) -> DataFrame:
    return parts.groupBy(*group, PART).agg(*aggs).withColumn(KEY, F.struct(*group, PART))


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    values: dict[str, Column],
    part: Column | None = None,
    totals: bool = False,
) -> DataFrame:
    """Running totals (this row included) of ``values`` within each group.

    With ``totals`` each value also gets ``<name>_total``, its sum over the group.
    """
    parts = with_parts(df.withColumns({f"_v_{n}": v for n, v in values.items()}), group, order, part)
    before = _across(group).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*(group or [F.lit(0)]))
    carry = _per_part(parts, group, *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values]).select(
        KEY,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in values],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in values if totals],
    )
    window = _within(order).rowsBetween(W.unboundedPreceding, 0)
    joined = parts.join(carry, KEY)
    out = joined.withColumns({n: F.sum(f"_v_{n}").over(window) + F.col(f"_c_{n}") for n in values})
    return out.drop(PART, KEY, *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def row_numbers(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    name: str,
    part: Column | None = None,
    start: int = 1,
) -> DataFrame:
    """Position of every row within its group (the whole table when no group)."""
    parts = with_parts(df, group, order, part)
    before = _across(group).rowsBetween(W.unboundedPreceding, -1)
    carry = _per_part(parts, group, F.count(F.lit(1)).alias("_n")).select(
        KEY, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    rank = (F.row_number().over(_within(order)) + F.col("_offset") + (start - 1)).cast("long")
    return parts.join(carry, KEY).withColumn(name, rank).drop(PART, KEY, "_offset")


def previous_values(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    values: dict[str, str],
    part: Column | None = None,
) -> DataFrame:
    """Value of the previous row of the group, for each ``{new: source}``.

    ``order`` must be unique within a group.
    """
    parts = with_parts(df, group, [order], part)
    row = F.struct(*values.values())
    carry = _per_part(parts, group, F.max_by(row, F.col(order)).alias("_last")).select(
        KEY, F.lag("_last").over(_across(group)).alias("_carry")
    )
    prev = F.coalesce(F.lag(row).over(_within([order])), F.col("_carry"))
    out = parts.join(carry, KEY).withColumn("_prev", prev)
    return out.withColumns({new: F.col(f"_prev.{src}") for new, src in values.items()}).drop(
        PART, KEY, "_carry", "_prev"
    )


def merged_runs(df: DataFrame, group: Sequence[str], start: str, end: str, count: str) -> DataFrame:
    """Overlapping intervals of a group as one: ``group``, ``start``, ``end`` and the summed ``count``.

    Intervals are half open; one that starts where another ends is not merged.
    Each range of a group finds the runs inside it. Its first rows may go on with
    a run of the ranges before, which reach and number of runs, one row per
    range, tell.
    """
    parts = with_parts(df.select(*group, start, end, count), group, [start, end], None)
    before = _across(group).rowsBetween(W.unboundedPreceding, -1)
    earlier = _within([start, end]).rowsBetween(W.unboundedPreceding, -1)
    reach = _per_part(parts, group, F.max(end).alias("_end")).select(KEY, F.max("_end").over(before).alias("_reach"))
    fresh = F.coalesce(F.col(start) >= F.greatest(F.max(end).over(earlier), F.col("_reach")), F.lit(True)).cast("int")
    marked = parts.join(reach, KEY).withColumn("_fresh", fresh)
    numbered = marked.withColumn("_no", F.sum("_fresh").over(_within([start, end]).rowsBetween(W.unboundedPreceding, 0)))
    local = numbered.groupBy(*group, PART, "_no").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.sum(count).alias(count)
    )
    local = materialize(local, "runs")
    begun = F.when(F.max("_no") > 0, F.struct(F.col(PART).alias("p"), F.max("_no").alias("no")))
    open_run = _per_part(local, group, begun.alias("_begun")).select(KEY, F.max("_begun").over(before).alias("_open"))
    joined = local.withColumn(KEY, F.struct(*group, PART)).join(open_run, KEY)
    run = F.when(F.col("_no") > 0, F.struct(F.col(PART).alias("p"), F.col("_no").alias("no"))).otherwise(F.col("_open"))
    out = joined.withColumn("_run", run).groupBy(*group, "_run").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.sum(count).alias(count)
    )
    return out.drop("_run")


def sparse_left_join(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join on a key that most rows may lack.

    Rows without the key are spread by another column; null keys would all
    meet in one task.
    """
    filled = F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.xxhash64(spread).cast("string")))
    renamed = right.withColumnRenamed(key, "_rk")
    return left.withColumn("_lk", filled).join(renamed, F.col("_lk") == F.col("_rk"), "left").drop("_lk", "_rk")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of every key: a map-side combined minimum, no per-key sort.

    ``df`` should hold only the columns the result needs.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, F.struct(*rest).alias("_rest"))).alias("_best") if rest else F.min(
        F.struct(*order)
    ).alias("_best")
    out = df.groupBy(*keys).agg(best)
    cols = [*keys, *[F.col(f"_best.{o}").alias(o) for o in order]]
    return out.select(*cols, *[F.col(f"_best._rest.{c}").alias(c) for c in rest])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of every key.

    Spark turns ``row_number() <= k`` into a group limit ahead of the shuffle,
    so a hot key ships at most ``k`` rows per input partition. It does so up to
    a threshold; a larger ``k`` is numbered in parts.
    """
    if k > GROUP_LIMIT:
        return row_numbers(df, keys, order, name).where(F.col(name) <= k)
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))


def ordered_concat(
    df: DataFrame, keys: Sequence[str], pos: str, text: str, sep: str, out: str, part_size: int = 1000
) -> DataFrame:
    """Join texts in order, at most ``part_size`` of them per output row.

    ``pos`` counts from 0. ``part`` numbers the rows of a key; a key with no more
    than ``part_size`` texts has one row. Joining the rows of a key in ``part``
    order with ``sep`` gives the whole text, so nothing is cut and no group
    grows past the part size.
    """
    part = F.floor(F.col(pos) / part_size).cast("long").alias("part")
    items = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    joined = F.concat_ws(sep, F.transform(items, lambda x: x["t"]))
    return df.groupBy(*keys, part).agg(joined.alias(out), F.count(F.lit(1)).alias("pieces"))
