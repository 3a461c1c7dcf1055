"""Bloom filters in DataFrame operations only, of a stated size.

A filter is a table of blocks, each an array of 64-bit words. It is broadcast, so
its size is bounded by ``max_bits`` (an eighth in bytes). A hash belongs to one
word and sets two bits of it. Testing is one broadcast join on the block and two
bit tests, within the stage that reads the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter per hash; most bits of a filter, 128 MB when broadcast; words of a block.
BITS_PER_ROW, MAX_BITS, BLOCK = 16, 1 << 30, 256


def filter_words(rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    """Words of a filter for so many hashes: a power of two."""
    bits = BLOCK * 64
    while bits < rows * bits_per_row and bits < max_bits:
        bits *= 2
    return bits // 64


def _word(h: Column, words: int) -> Column:
    return h.bitwiseAND(F.lit(words - 1))


def _bits(h: Column) -> tuple[Column, Column]:
    first = F.shiftrightunsigned(h, 40).bitwiseAND(63)
    return first.cast("int"), ((first + 1 + F.shiftrightunsigned(h, 48) % 63) % 64).cast("int")


def build_filter(hashes: DataFrame, h: str, words: int, least: int = 1) -> DataFrame:
    """(block, bits) of the bits that ``least`` or more rows of ``hashes`` hit; counted in each task before the shuffle."""
    first, second = _bits(F.col(h))
    place = _word(F.col(h), words) * 64
    hits = hashes.select(F.explode(F.array(place + first, place + second)).alias("bit"))
    often = hits.groupBy("bit").count().where(F.col("count") >= least)
    masks = often.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("mask"))
    every = masks.unionByName(hashes.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask")))
    whole = every.groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))
    blocks = whole.groupBy(F.floor(F.col("word") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("bits"))
    return blocks.select("block", F.transform("bits", lambda b: b["mask"]).alias("bits"))


def test_filter(df: DataFrame, h: str, blocks: DataFrame, words: int, name: str) -> DataFrame:
    """``df`` with the boolean ``name``: whether the filter has both bits of the hash; false is certain."""
    first, second = _bits(F.col(h))
    there = blocks.select(F.col("block").alias(f"{name}_block"), F.col("bits").alias(f"{name}_bits"))
    word = _word(F.col(h), words)
    # bounded: max_bits / 8 bytes
    tested = df.withColumn(f"{name}_at", F.floor(word / BLOCK)).join(F.broadcast(there), F.col(f"{name}_at") == F.col(f"{name}_block"), "left")
    mask = F.get(F.col(f"{name}_bits"), (word % BLOCK).cast("int"))
    both = (F.getbit(mask, first) == 1) & (F.getbit(mask, second) == 1)
    return tested.withColumn(name, F.coalesce(both, F.lit(False))).drop(f"{name}_block", f"{name}_bits", f"{name}_at")
