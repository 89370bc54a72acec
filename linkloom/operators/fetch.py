"""Fetch results from a captured snapshot, their outcome and their crawl records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Error texts.
NOT_CAPTURED = "fetch error: no response captured"
TOO_LARGE = "fetch error: body size exceeds the given limit"


def fetch(frontier: DataFrame, snapshot: DataFrame, max_body_bytes: int | None = None) -> DataFrame:
    """Fetch result of each frontier row, from rows ``(url, status_code, content_type, headers, n_bytes, fetch_time_ns)``.

    A URL without a captured response carries an error text and no headers; so
    does one with a body over ``max_body_bytes``, if that is given. Sizes decide
    everything, so bodies stay out of the join; a snapshot with a ``body``
    column passes it on.
    """
    bodies = ["body"] if "body" in snapshot.columns else []
    sized = snapshot if "n_bytes" in snapshot.columns else snapshot.withColumn("n_bytes", F.octet_length("body").cast("bigint"))
    captured = sized.select(
        "url", "status_code", "content_type", "headers", "n_bytes", *bodies, "fetch_time_ns", F.lit(True).alias("_hit")
    )
    joined = frontier.join(captured, "url", "left")
    large = F.lit(False) if max_body_bytes is None else F.coalesce(F.col("n_bytes") > max_body_bytes, F.lit(False))
    error = F.when(F.col("_hit").isNull(), NOT_CAPTURED).when(large, TOO_LARGE).otherwise("")
    ok = error == ""
    return joined.select(
        *frontier.columns,
        F.coalesce("status_code", F.lit(0)).alias("status_code"),
        F.when(ok, F.col("content_type")).otherwise("").alias("content_type"),
        F.when(ok, F.col("headers")).alias("headers"),
        *[F.when(ok, F.col(c)).alias(c) for c in ["n_bytes", *bodies]],
        F.coalesce("fetch_time_ns", F.lit(0)).cast("bigint").alias("fetch_time_ns"),
        error.alias("error"),
    )


def headers_map(entries: Column) -> Column:
    """Header map of an array of (name, value) structs; the later header of a name wins."""
    names = F.array_distinct(F.transform(entries, lambda e: e["name"]))
    last = lambda n: F.element_at(F.filter(entries, lambda e: e["name"] == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def is_error(status_code: str = "status_code", error: str = "error") -> Column:
    return (F.col(error) != "") | (F.col(status_code) >= 400)


def outcome(max_depth: Column | int, allowed: str = "allowed", depth: str = "depth") -> Column:
    """SKIPPED beyond the depth limit, BLOCKED by robots, ERROR, else the status code as text."""
    limit = F.lit(max_depth) if isinstance(max_depth, int) else max_depth
    return (
        F.when(F.col(depth) > limit, "SKIPPED")
        .when(~F.col(allowed), "BLOCKED")
        .when(is_error(), "ERROR")
        .otherwise(F.col("status_code").cast("string"))
    )


def status_label(status_code: Column) -> Column:
    """Status code as text, ERROR for 0."""
    return F.when(status_code == 0, "ERROR").otherwise(status_code.cast("string"))


def archivable(results: DataFrame) -> DataFrame:
    """Successful results with a body and a status."""
    return results.filter(~is_error() & (F.octet_length("body") > 0) & (F.col("status_code") != 0))


def crawl_records(results: DataFrame) -> DataFrame:
    """Crawl-record columns of every fetched row; the duration in whole milliseconds."""
    return results.select(
        "url",
        "domain",
        "status_code",
        "depth",
        F.expr("fetch_time_ns div 1000000").alias("fetch_time_ms"),
        "error",
    )
