"""Tables the jobs write: crawl records and the frontier."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from linkloom.operators.fetch import crawl_records
from linkloom.operators.frontier import upsert
from linkloom.session import materialized

#: Buckets of a stored frontier: the least share of it that an update rewrites.
BUCKETS = 256


def stamped_records(results: DataFrame) -> DataFrame:
    """Crawl records with the time of writing, the rows of a domain side by side and in URL order.

    One pass: adaptive execution splits a domain above its advisory partition size.
    """
    stamped = crawl_records(results).withColumn("created_at", F.current_timestamp())
    return stamped.hint("rebalance", F.col("domain")).sortWithinPartitions("domain", "url")


def append_crawl_records(results: DataFrame, path: str) -> None:
    """Append the crawl record of every fetched row, stamped with the time of writing.

    Each row group keeps its domains' dictionary or Bloom filter, so a read of
    one domain skips the row groups without it.
    """
    writer = stamped_records(results).write.mode("append")
    writer.option("parquet.bloom.filter.enabled#domain", "true").parquet(path)


def compact_crawl_records(spark: SparkSession, path: str, target: str) -> None:
    """The records of many appends as few files at a new path, in order of domain and URL.

    A range of a large domain is a task of its own; so files cover narrow ranges
    of domains, and their bounds alone tell a reader which to skip.
    """
    rows = spark.read.parquet(path).repartitionByRange("domain", "url", "created_at")
    ordered = rows.sortWithinPartitions("domain", "url", "created_at").write.mode("errorifexists")
    ordered.option("parquet.bloom.filter.enabled#domain", "true").parquet(target)


def domain_records(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """Crawl records of one domain; the filter reaches the scan."""
    return spark.read.parquet(path).filter(F.col("domain") == domain)


def append_crawl_records_jdbc(results: DataFrame, url: str, table: str = "crawl_records", **options: str) -> None:
    """The same into a SQL table, whose id and creation time default on the server."""
    crawl_records(results).write.mode("append").options(**options).jdbc(url, table)


def write_frontier(spark: SparkSession, current: str | None, changes: DataFrame, target: str) -> None:
    """Write the frontier with changes applied to a new path, in URL order so that scans skip row groups."""
    rows = changes if current is None else spark.read.parquet(current)
    merged = upsert(rows, changes.limit(0) if current is None else changes)
    merged.repartitionByRange("url").sortWithinPartitions("url").write.mode("errorifexists").parquet(target)


def _bucket(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _write_buckets(rows: DataFrame, path: str, mode: str) -> None:
    placed = rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "url")
    placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")


def create_frontier(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store a frontier in hash buckets of its URLs, one row per URL, with its layout beside it.

    ``rows`` has ``url`` and ``version``; of several rows of a URL the highest
    version stays. A row without a URL has the bucket of the null URL.
    """
    if buckets < 1:
        raise ValueError("buckets must be positive")
    layout = [(buckets, rows.schema.json())]
    rows.sparkSession.createDataFrame(layout, "buckets INT, columns STRING").write.mode("errorifexists").json(f"{path}/layout")
    _write_buckets(upsert(rows, rows.limit(0)).withColumn("bucket", _bucket(F.col("url"), buckets)), path, "errorifexists")


def _layout(spark: SparkSession, path: str) -> tuple[int, StructType]:
    row = spark.read.schema("buckets INT, columns STRING").json(f"{path}/layout").first()
    return row["buckets"], StructType.fromJson(json.loads(row["columns"]))


def read_frontier(spark: SparkSession, path: str, url: str | None = None) -> DataFrame:
    """A stored frontier with its ``bucket``; with ``url`` its row, looked for in one bucket."""
    buckets, columns = _layout(spark, path)
    rows = spark.read.schema(columns.add("bucket", IntegerType())).parquet(f"{path}/rows")
    if url is None:
        return rows
    return rows.filter((F.col("bucket") == _bucket(F.lit(url), buckets)) & (F.col("url") == url))


def update_frontier(spark: SparkSession, path: str, changes: DataFrame) -> int:
    """Apply changes to a stored frontier, reading and writing only the buckets of their URLs; gives their number.

    The highest version of a URL stays, on a tie the change; so applying changes
    again alters nothing. No changes, no writes. The numbers of touched buckets
    are all that reaches the driver. One writer at a time: the commit replaces
    bucket by bucket, and a reader who must not see that reads before or after.
    """
    buckets, columns = _layout(spark, path)
    named = changes.select(*columns.names)
    placed = materialized(named.withColumn("bucket", _bucket(F.col("url"), buckets)))
    touched = [row["bucket"] for row in placed.select("bucket").distinct().collect()]
    if touched:
        current = read_frontier(spark, path).filter(F.col("bucket").isin(touched))
        _write_buckets(upsert(current, placed), path, "overwrite")
    return len(touched)
