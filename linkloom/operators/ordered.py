"""Order-dependent columns that hold up when one key owns a large share of the rows.

A window sorts a whole key in one task. Where a key is larger than a task
should take, the rows are range-partitioned by (key, order) instead, so a hot
key spreads over many sorted blocks; each block is worked on alone and a carry
per key and block, whose number is bounded by the number of blocks, joins the
blocks up. The blocks are checkpointed so both passes see the same borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.session import materialized

ROWS_PER_TASK = 5_000_000
_BLOCK, _POS = "_block", "_pos"


def has_hot_key(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> bool:
    """True when some key holds more rows than one task should sort."""
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return (largest or 0) > rows_per_task


def ordered_blocks(df: DataFrame, columns: list[str], blocks: int | None = None) -> DataFrame:
    """Rows in range partitions of ``columns``, sorted, with block number and position in the block."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row_id = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns).withColumn("_id", row_id)
    return materialized(
        ranged.select(
            *df.columns,
            F.shiftright("_id", 33).cast("int").alias(_BLOCK),
            F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias(_POS),
        )
    )


def _numbered_blocks(df: DataFrame, order: list[str], number: str, total: str) -> DataFrame:
    rows = ordered_blocks(df, order)
    sizes = rows.groupBy(_BLOCK).agg(F.count(F.lit(1)).alias("_size"))
    # One row per block: bounded by the number of shuffle partitions, whatever the data.
    by_block = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        _BLOCK,
        F.coalesce(F.sum("_size").over(by_block), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy(F.lit(1))).alias(total),
    )
    rank = F.col("_offset") + F.col(_POS) + 1
    return rows.join(F.broadcast(offsets), _BLOCK).withColumn(number, rank).drop("_offset")


def numbered(df: DataFrame, order: list[str], number: str = "n", total: str = "total") -> DataFrame:
    """Rows numbered from 1 in a global total order, with the number of all rows."""
    return _numbered_blocks(df, order, number, total).select(number, *df.columns, total)


def _with_carry(rows: DataFrame, keys: list[str], summary: Column, carry: Column) -> DataFrame:
    """Add ``_carry``: per key and block, ``carry`` over the summaries of the key's earlier blocks."""
    per_block = rows.groupBy(*keys, _BLOCK).agg(summary.alias("_summary"))
    spread = per_block.withColumn("_blocks", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    # Keys in more than one block share block borders, so at most two such rows exist per block.
    carries = (
        spread.filter("_blocks > 1")
        .withColumn("_carry", carry)
        .filter("_carry IS NOT NULL")
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(_BLOCK).alias("_k_block"), "_carry")
    )
    match = F.col(_BLOCK) == F.col("_k_block")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(F.broadcast(carries), match, "left").drop(*[f"_k_{k}" for k in keys], "_k_block")


def running_max(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, rows_per_task: int = ROWS_PER_TASK,
    hot: bool | None = None,
) -> DataFrame:
    """Add the maximum of ``value`` over the rows of the key up to and including this one.

    ``value`` may use ``_rank``, the row's number in an order that agrees with
    (key, order); ranks are consecutive within a key. ``hot`` says whether some
    key is too large for a task, where that is known.
    """
    by_key = Window.partitionBy(*keys).orderBy(*order)
    if not (has_hot_key(df, keys, rows_per_task) if hot is None else hot):
        ranked = df.withColumn("_rank", F.row_number().over(by_key).cast("long"))
        return ranked.withColumn(out, F.max(value).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    rows = _numbered_blocks(df, [*keys, *order], "_rank", "_total").drop("_total").withColumn("_value", value)
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = _with_carry(rows, keys, F.max("_value"), F.max("_summary").over(earlier))
    local = Window.partitionBy(*keys, _BLOCK).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    return carried.withColumn(out, F.greatest(F.max("_value").over(local), "_carry")).drop(
        _BLOCK, _POS, "_value", "_carry"
    )


def previous(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str, rows_per_task: int = ROWS_PER_TASK,
    hot: bool | None = None,
) -> DataFrame:
    """Add ``value`` of the preceding row of the key, NULL on its first row; ``hot`` as in ``running_max``."""
    if not (has_hot_key(df, keys, rows_per_task) if hot is None else hot):
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    rows = ordered_blocks(df, [*keys, *order])
    by_block = Window.partitionBy(*keys).orderBy(_BLOCK)
    carried = _with_carry(rows, keys, F.max_by(F.col(value), F.col(_POS)), F.lag("_summary").over(by_block))
    local = Window.partitionBy(*keys, _BLOCK).orderBy(_POS)
    first = F.row_number().over(local) == 1
    return carried.withColumn(out, F.when(first, F.col("_carry")).otherwise(F.lag(value).over(local))).drop(
        _BLOCK, _POS, "_carry"
    )


def running_sums(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], rows_per_task: int = ROWS_PER_TASK,
    hot: bool | None = None,
) -> DataFrame:
    """The columns replaced by their sums over the rows of the key up to and including this one; ``hot`` as above."""
    if not (has_hot_key(df, keys, rows_per_task) if hot is None else hot):
        so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.sum(c).over(so_far) for c in columns})
    rows = ordered_blocks(df, [*keys, *order])
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    block_sums = F.struct(*[F.sum(c).alias(c) for c in columns])
    carry = F.struct(*[F.sum(F.col("_summary")[c]).over(earlier).alias(c) for c in columns])
    carried = _with_carry(rows, keys, block_sums, carry)
    local = Window.partitionBy(*keys, _BLOCK).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    sums = {c: F.sum(c).over(local) + F.coalesce(F.col("_carry")[c], F.lit(0)) for c in columns}
    return carried.withColumns(sums).drop(_BLOCK, _POS, "_carry")
