"""The store overview as JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import frontier


def json_rows(df: DataFrame, name: str = "entry") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def overview(rows: DataFrame, archive: DataFrame, status: str = "") -> DataFrame:
    """Frontier domains with their counts and archive domains with their files, one JSON text per entry.

    ``archive`` is the archive listing. Without a status the domain is cut from
    the URL; with one it is the stored domain of the rows in that status.
    """
    counts = frontier.domain_counts_with_status(rows, status) if status else frontier.domain_counts(rows)
    return (
        json_rows(counts).withColumn("section", F.lit("frontier_domains"))
        .unionByName(json_rows(archive).withColumn("section", F.lit("warc_domains")))
        .select("section", "entry")
    )
