"""Exact URL de-duplication: first wins, last wins, against a history, per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key.

    Catalyst turns ``row_number() = 1`` into a group limit before the shuffle,
    so a hot key sends one row per map task, not all its rows.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def last_per_key(df: DataFrame, keys: list[str], version: str, ties: list[str] | None = None) -> DataFrame:
    """Last write wins: the row of each key with the highest version; ``ties`` decide between equal ones, highest first."""
    return first_per_key(df, keys, [F.col(c).desc() for c in [version, *(ties or [])]])


def not_seen(candidates: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key is not in ``seen``."""
    return candidates.join(seen.select(*keys), keys, "left_anti")


def push(items: DataFrame, seen: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """New frontier rows: non-empty URLs, first of each key, not in ``seen``."""
    fresh = first_per_key(items.filter(F.col(keys[-1]) != ""), keys, [seq])
    return not_seen(fresh, seen, keys)


def flag_pushed(items: DataFrame, seen: DataFrame, keys: list[str], seq: str, flag: str = "pushed") -> DataFrame:
    """Every item with a flag telling whether ``push`` takes it.

    The flag comes back over (key, seq), so the copies of a hot URL spread over
    all tasks. Of rows that repeat a (key, seq) only one is flagged.
    """
    firsts = items.filter(F.col(keys[-1]) != "").groupBy(*keys).agg(F.min(seq).alias(seq))
    taken = not_seen(firsts, seen, keys).withColumn(flag, F.lit(True))
    nth = F.row_number().over(Window.partitionBy(*keys, seq).orderBy(F.lit(0)))
    joined = items.withColumn("_nth", nth).join(taken, [*keys, seq], "left")
    return joined.withColumn(flag, F.coalesce(F.col(flag) & (F.col("_nth") == 1), F.lit(False))).drop("_nth")
