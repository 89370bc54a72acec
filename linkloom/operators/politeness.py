"""Per-host politeness: when each request may go out, and audits of a fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.ordered import ROWS_PER_TASK, previous, running_max

# Fixed value: default delay between two requests to a host.
DEFAULT_DELAY_US = 500_000


def plan(
    requests: DataFrame,
    host: str,
    arrival_us: str,
    tie: str,
    delay_us: int = DEFAULT_DELAY_US,
    extra_us: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``release_us``: one request per host and delay, in order of arrival, none before its arrival.

    ``r(i) = max(a(i), r(i-1) + d)`` equals ``d*i + max over j <= i of (a(j) - d*j)``,
    so no state has to pass from row to row. ``extra_us`` (a robots delay) is added
    to the arrival.
    """
    delay = delay_us if delay_us > 0 else DEFAULT_DELAY_US
    shifted = requests.withColumn("_arrival", F.col(arrival_us) + (F.lit(0) if extra_us is None else extra_us))
    slack = F.col("_arrival") - F.col("_rank") * delay
    with_max = running_max(shifted, [host], ["_arrival", tie], slack, "_ahead", rows_per_task)
    release = (F.col("_rank") * delay + F.col("_ahead")).alias("release_us")
    return with_max.select(*requests.columns, release)


def violations(
    log: DataFrame, host: str, at_us: str, tie: str, delay_us: int = DEFAULT_DELAY_US, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Fetches that came sooner than ``delay_us`` after the preceding one of their host."""
    paired = previous(log, [host], [at_us, tie], at_us, "_before", rows_per_task)
    gap = F.col(at_us) - F.col("_before")
    return paired.withColumn("gap_us", gap).filter(F.col("gap_us") < delay_us).drop("_before")
