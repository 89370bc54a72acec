"""Seed requests: validation and first frontier rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import canonical_self, trimmed, url_hostname
from linkloom.operators.dedup import flag_pushed

# Depth of a request that names none, and the messages of rejected requests.
DEFAULT_DEPTH = 3
URL_REQUIRED, URL_INVALID = "URL is required", "Invalid URL format"
ALREADY_KNOWN, QUEUED_AS = "URL already crawled or queued in frontier", "Seed URL queued: %s (Depth: %d)"

REQUEST_SCHEMA = "url STRING, depth INT, workers INT"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Seed requests from JSON files."""
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def normalize(requests: DataFrame) -> DataFrame:
    """Add ``seed_url``, ``domain``, ``max_depth`` and ``reason`` (empty when accepted)."""
    text = F.expr(trimmed("coalesce(url, '')"))
    schemed = F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    parses = canonical_self("_seed").isNotNull()
    bad = F.when(F.col("_seed").isNull(), URL_REQUIRED).when(~parses | (F.col("_host") == ""), URL_INVALID).otherwise("")
    limit = F.when(F.coalesce("depth", F.lit(0)) <= 0, DEFAULT_DEPTH).otherwise(F.col("depth"))
    # One step per value: each is used several times by the next and should be computed once.
    seeded = requests.withColumn("_seed", F.when(text != "", schemed))
    judged = seeded.withColumn("_host", url_hostname(F.col("_seed"))).withColumn("reason", bad)
    accepted = F.col("reason") == ""
    return judged.select(
        *requests.columns,
        F.when(accepted, F.col("_seed")).alias("seed_url"),
        F.when(accepted, F.col("_host")).alias("domain"),
        limit.alias("max_depth"),
        "reason",
    )


def seed_items(normalized: DataFrame, added_at: str, canonical: bool = True) -> DataFrame:
    """Frontier rows of the accepted seeds: depth 1, priority 1, queued."""
    url = canonical_self("seed_url") if canonical else F.col("seed_url")
    return normalized.filter("reason = ''").select(
        url.alias("url"),
        "domain",
        F.lit(1).alias("depth"),
        F.lit(1).alias("priority"),
        F.lit(0).alias("retry_count"),
        F.lit("QUEUED").alias("status"),
        F.col(added_at).alias("added_at"),
        "max_depth",
    )


def submit(requests: DataFrame, seen: DataFrame, seq: str) -> DataFrame:
    """Answer each request: ``accepted``, ``message`` and the label of its log event.

    A request is accepted when it is valid, the first for its canonical URL, the
    form that is stored, by ``seq``, and that URL is not in ``seen``. Rejected
    requests have no log event.
    """
    items = normalize(requests).withColumn("_valid", F.coalesce(canonical_self("seed_url"), F.lit("")))
    history = seen.select(F.col("url").alias("_valid"))
    answered = flag_pushed(items, history, ["_valid"], seq, "accepted")
    valid = F.col("reason") == ""
    message = (
        F.when(~valid, F.col("reason"))
        .when(F.col("accepted"), F.format_string(QUEUED_AS, "seed_url", "max_depth"))
        .otherwise(ALREADY_KNOWN)
    )
    label = F.when(valid & F.col("accepted"), "QUEUED").when(valid, "ALREADY IN FRONTIER")
    return answered.select(*items.drop("_valid").columns, "accepted", message.alias("message"), label.alias("log_status"))
