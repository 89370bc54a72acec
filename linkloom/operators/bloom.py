"""Bloom filter over URLs as a table of bitmap blocks.

A URL hashes to one block and, by double hashing, to k bits inside it, so
building is one aggregation and probing is one equi-join on the block number.
Block numbers come from a hash, so blocks fill evenly, and a task gets as many
of them as hold some ``ROWS_PER_TASK`` rows, whatever the number of rows. Rows
of blocks that are too large for that, for a URL that repeats very often or a
filter that is too small, are found first and take another way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.rows import per_element

BLOCK_BITS = 32768  # size of the bitmaps of bitmap_construct_agg
BROADCAST_BLOCKS = 2048  # 8 MB of bitmaps
ROWS_PER_TASK = 200_000
LARGE_BLOCK_ROWS = 1_000_000


@dataclass(frozen=True)
class BloomSize:
    """Filter size for ``items`` expected keys at false-positive rate ``rate``."""

    bits: int
    hashes: int

    @staticmethod
    def of(items: int = 1_000_000, rate: float = 0.01) -> BloomSize:
        items = items if items > 0 else 1_000_000
        rate = rate if 0 < rate < 1 else 0.01
        bits = math.ceil(-items * math.log(rate) / math.log(2) ** 2)
        return BloomSize(bits, math.ceil(bits / items * math.log(2)))

    @property
    def blocks(self) -> int:
        return math.ceil(self.bits / BLOCK_BITS)


def _hash(part: int) -> Column:
    return F.conv(F.substring("_digest", 8 * part + 1, 8), 16, 10).cast("bigint")


def _hashed(df: DataFrame, size: BloomSize, key: str) -> DataFrame:
    """Add ``_block`` of the key, null for a null key, and ``_h1`` and ``_h2``, from which its bits follow."""
    hashed = df.withColumn("_digest", F.md5(key)).withColumns(
        {"_block": _hash(0) % size.blocks, "_h1": _hash(1), "_h2": _hash(2).bitwiseOR(F.lit(1))}
    )
    return hashed.drop("_digest")


def _bits(size: BloomSize) -> Column:
    return F.array(*[(F.col("_h1") + i * F.col("_h2")) % BLOCK_BITS for i in range(size.hashes)])


def with_bits(df: DataFrame, size: BloomSize, key: str) -> DataFrame:
    """Add ``block`` and ``bits``, the k bit positions of the key in its block."""
    hashed = _hashed(df, size, key).withColumns({"block": F.col("_block"), "bits": _bits(size)})
    return hashed.drop("_block", "_h1", "_h2")


@dataclass(frozen=True)
class _Deal:
    """How rows go to tasks by their block: the number of tasks, and the blocks with too many rows for one.

    There are fewer of those than rows by a factor of ``LARGE_BLOCK_ROWS``.
    """

    tasks: int
    large: list[int]

    @staticmethod
    def of(rows: DataFrame, size: BloomSize) -> _Deal:
        counted = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n"))
        large = F.collect_list(F.when(F.col("n") > LARGE_BLOCK_ROWS, F.col("_block")))
        n, large = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), large).first()
        least = rows.sparkSession.sparkContext.defaultParallelism
        return _Deal(max(1, min(size.blocks, max(least, math.ceil(n / ROWS_PER_TASK)))), large)


def _placed(df: DataFrame, size: BloomSize, key: str) -> DataFrame:
    """``_hashed`` with null keys in block -1, which no filter has."""
    return _hashed(df, size, key).withColumn("_block", F.coalesce("_block", F.lit(-1)).cast("bigint"))


def _distinct(df: DataFrame, size: BloomSize, key: str) -> list[DataFrame]:
    """``(key, _block)`` of the distinct keys; no block is in two of the tables.

    Repeats are dropped where the rows of a block arrive, so that no task holds
    the keys of its whole input; those of large blocks are dropped before.
    """
    placed = _placed(df.select(key), size, key).select(key, "_block")
    deal = _Deal.of(placed, size)
    if not deal.large:
        return [placed.repartition(deal.tasks, "_block").distinct()]
    large = F.col("_block").isin(deal.large)
    return [placed.filter(~large).repartition(deal.tasks, "_block").distinct(), placed.filter(large).distinct()]


def build(df: DataFrame, size: BloomSize, key: str = "url") -> DataFrame:
    """The filter: one row per non-empty block with its bitmap and the number of keys added."""
    built = []
    for keys in _distinct(df.filter(F.col(key).isNotNull()), size, key):
        # The block that the rows came by stays as it is, so that they need not move again.
        hashed = _hashed(keys.withColumnRenamed("_block", "block"), size, key)
        bit = per_element(hashed, ["block"], _bits(size), "bit", "i")
        built.append(bit.groupBy("block").agg(
            F.bitmap_construct_agg("bit").alias("bitmap"), F.count_if(F.col("i") == 0).alias("added")
        ))
    return reduce(DataFrame.unionByName, built)


def _words(bitmap: str) -> Column:
    """The bitmap as 64-bit words, which can be tested without touching text."""
    return F.expr(
        f"transform(sequence(0, {BLOCK_BITS // 64 - 1}), "
        f"w -> CAST(conv(hex(substring({bitmap}, w * 8 + 1, 8)), 16, -10) AS BIGINT))"
    )


def _with_words(rows: DataFrame, bloom: DataFrame, size: BloomSize) -> DataFrame:
    """Add the words of the block, null where the filter has none."""
    side = bloom.select(F.col("block").cast("bigint").alias("_block"), "bitmap")

    def words(blocks: DataFrame) -> DataFrame:
        return blocks.select("_block", _words("bitmap").alias("_words"))

    if size.blocks <= BROADCAST_BLOCKS:
        return rows.join(F.broadcast(words(side)), "_block", "left")
    deal = _Deal.of(rows, size)
    if not deal.large:
        return rows.repartition(deal.tasks, "_block").join(words(side.repartition(deal.tasks, "_block")), "_block", "left")
    large = F.col("_block").isin(deal.large)
    few = rows.filter(~large).repartition(deal.tasks, "_block")
    found = few.join(words(side.filter(~large).repartition(deal.tasks, "_block")), "_block", "left")
    # The rows of large blocks stay where they are, and their bitmaps come to them.
    return found.unionByName(rows.filter(large).join(F.broadcast(words(side.filter(large))), "_block", "left"))


def might_contain(df: DataFrame, bloom: DataFrame, size: BloomSize, key: str = "url") -> DataFrame:
    """Add ``maybe``: False means the key is certainly not in the filter."""
    probed = _with_words(_placed(df, size, key), bloom, size).withColumn("_bits", _bits(size))
    # Bitmaps number bits from the low end of each byte, words from the high end of the first byte.
    hit = F.lit(True)
    for i in range(size.hashes):
        bit = f"_bits[{i}]"
        shift = f"(7 - ({bit} div 8) % 8) * 8 + {bit} % 8"
        hit = hit & F.expr(f"shiftright(_words[CAST({bit} div 64 AS INT)], CAST({shift} AS INT)) & 1 = 1")
    return probed.withColumn("maybe", F.coalesce(hit, F.lit(False))).select(*df.columns, "maybe")


def dedup(new: DataFrame, seen: DataFrame, size: BloomSize, key: str = "url", exact: bool = True) -> DataFrame:
    """Distinct keys of ``new`` that are not in ``seen``.

    With ``exact`` the keys the filter cannot rule out are checked by an
    anti-join, so none is lost; without it they are dropped as the filter alone
    would, at the rate of its false positives.
    """
    fresh = reduce(DataFrame.unionByName, _distinct(new, size, key)).select(key)
    probed = might_contain(fresh, build(seen, size, key), size, key)
    if not exact:
        return probed.filter(~F.col("maybe")).select(key)
    history = seen.select(F.col(key).alias("_seen"))
    return probed.join(history, F.col("maybe") & (F.col(key) == F.col("_seen")), "left_anti").select(key)
