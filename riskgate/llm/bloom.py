"""A blocked Bloom filter as a small table.

One 512-bit block per key, one bit in each of its eight 64-bit words. The filter is
built by a Spark aggregation (bit_or per block) and has at most MAX_BLOCKS rows of 72
bytes however many keys there are, so it can always be broadcast: too many keys only
let more rows pass. A key that was put in always passes. All steps are DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
BLOCK_BITS = 512
WORDS = 8
MAX_BLOCKS = 1 << 17


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: str) -> list[Column]:
    """One bit in each word, by six bits of a second hash."""
    return [F.expr(f"shiftleft(1L, int(shiftrightunsigned(xxhash64({key}, 7), {6 * i}) & 63))") for i in range(WORDS)]


def blocked_bloom(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """The filter as a table (block, w0..w7), and its number of blocks."""
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * BLOCK_BITS < n_keys * BITS_PER_KEY:
        blocks *= 2
    rows = keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(key))])
    return rows.groupBy("block").agg(*[F.expr(f"bit_or(w{i})").alias(f"w{i}") for i in range(WORDS)]), blocks


def may_contain(rows: DataFrame, key: str, filtered: tuple[DataFrame, int], name: str) -> DataFrame:
    """`rows` with a boolean column `name`: false only where the key is surely not in
    the filter (a null key never is)."""
    bloom, blocks = filtered
    bloom = bloom.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(WORDS)])
    probe = rows.withColumn("__block", _block(F.col(key), blocks)).join(F.broadcast(bloom), "__block", "left")
    passes = F.col(key).isNotNull()
    for i, mask in enumerate(_masks(key)):
        passes = passes & (F.col(f"__w{i}").bitwiseAND(mask) != 0)
    return probe.select(*rows.columns, F.coalesce(passes, F.lit(False)).alias(name))
