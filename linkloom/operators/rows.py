"""One row per array element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_element(df: DataFrame, columns: list[str], array: Column, element: str, position: str | None = None) -> DataFrame:
    """``columns`` with one row per non-NULL array element.

    The outer form matters: for the inner one the optimizer adds a filter on
    the size of the array, which computes a costly array twice.
    """
    if position is None:
        return df.select(*columns, F.explode_outer(array).alias(element)).filter(F.col(element).isNotNull())
    return df.select(*columns, F.posexplode_outer(array).alias(position, element)).filter(F.col(element).isNotNull())
