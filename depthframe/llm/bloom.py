"""A Bloom filter of bounded size made and asked with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 512
BITS_PER_ROW = 16
PROBES = 4
MAX_BLOCKS = 1 << 18


def block_count(rows: int) -> int:
    """Power of two that gives ``BITS_PER_ROW`` bits to each row, up to ``MAX_BLOCKS`` (16 MB)."""
    wanted, blocks = max(1, rows * BITS_PER_ROW // BLOCK_BITS), 1
    while blocks < wanted and blocks < MAX_BLOCKS:
        blocks *= 2
    return blocks


def _block(key: Column, blocks: int) -> Column:
    return F.xxhash64(key, F.lit(0)).bitwiseAND(F.lit(blocks - 1))


def _bits(key: Column) -> Column:
    g = F.xxhash64(key, F.lit(1))
    return F.array(
        *[F.shiftright(g, 9 * j).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for j in range(PROBES)]
    )


def filter_words(keys: DataFrame, column: str, blocks: int, at_least: int = 1) -> DataFrame:
    """(block, words): the bits that at least ``at_least`` rows set, as 64-bit words."""
    key = F.col(column)
    bits = keys.select(
        _block(key, blocks).alias("block"), F.explode(F.array_distinct(_bits(key))).alias("bit")
    )
    often = bits.groupBy("block", "bit").count().filter(F.col("count") >= at_least)
    word = [
        F.coalesce(
            F.bit_or(F.when(F.shiftright("bit", 6) == i, F.expr("shiftleft(1L, bit & 63)"))),
            F.lit(0).cast("bigint"),
        )
        for i in range(BLOCK_BITS // 64)
    ]
    return often.groupBy("block").agg(F.array(*word).alias("words"))


def mark(rows: DataFrame, column: str, words: DataFrame, blocks: int) -> DataFrame:
    """Add ``maybe``: false only if the filter cannot hold ``column``. The filter is broadcast."""
    joined = (
        rows.withColumn("block", _block(F.col(column), blocks))
        .withColumn("bits", _bits(F.col(column)))
        .join(F.broadcast(words), "block", "left")
    )
    hit = F.expr("forall(bits, b -> shiftright(words[shiftright(b, 6)], b & 63) & 1 = 1)")
    return joined.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("block", "bits", "words")
