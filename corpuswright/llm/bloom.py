"""Blocked Bloom filters in DataFrame operations.

A filter is one array of longs, ``WORDS`` per block; a key sets one bit in each
word of its block. It never has more than ``MAX_BLOCKS`` blocks (1 MB), so it
may reach every task whatever the size of the list: a longer list lets more
false hits through, which an exact join behind the filter removes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 4
BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 15


class BloomFilter:
    """Membership test for 64-bit hashes; ``bits`` is a scalar subquery, so not for use inside a lambda."""

    def __init__(self, bits: Column, blocks: int):
        self.bits = bits
        self.blocks = blocks

    def might_contain(self, key: Column) -> Column:
        """False only when ``key`` (a 64-bit hash) was never added; false for null."""
        base = F.pmod(key, F.lit(self.blocks)).cast("int") * WORDS
        found = F.lit(True)
        for i in range(WORDS):
            word = F.get(self.bits, base + i)
            found = found & (F.call_function("shiftright", word, _bit(key, i)).bitwiseAND(F.lit(1)) == 1)
        return F.coalesce(found, F.lit(False))


def _bit(key: Column, i: int) -> Column:
    """Bits 40 and up of the hash, six per word; the block is taken from all of it."""
    return F.shiftrightunsigned(key, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int")


def build(keys: DataFrame) -> BloomFilter:
    """Filter of the one column of ``keys`` (64-bit hashes; nulls and repeats do nothing)."""
    spark = keys.sparkSession
    key = F.col(keys.columns[0])
    keys = keys.where(key.isNotNull())
    wanted = keys.count() * BITS_PER_KEY // (64 * WORDS) + 1
    blocks = min(1 << (wanted - 1).bit_length(), MAX_BLOCKS)
    set_words = keys.groupBy(F.pmod(key, F.lit(blocks)).alias("block")).agg(
        *[F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(key, i))).alias(f"w{i}") for i in range(WORDS)]
    )
    every = spark.range(blocks).withColumnRenamed("id", "block").join(set_words, "block", "left")
    words = F.array(*[F.coalesce(F.col(f"w{i}"), F.lit(0).cast("long")) for i in range(WORDS)])
    row = every.agg(F.array_sort(F.collect_list(F.struct("block", words.alias("w")))).alias("all"))
    return BloomFilter(row.select(F.flatten(F.transform("all", lambda b: b["w"]))).scalar(), blocks)
