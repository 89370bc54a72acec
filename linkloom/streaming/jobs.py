"""Streaming forms: unbounded inputs, state kept by Spark, sinks safe to repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle, TimerValues

from linkloom.operators.bloom import BLOCK_BITS, BloomSize, with_bits
from linkloom.operators.dedup import not_seen
from linkloom.operators.fetch import status_label
from linkloom.operators.politeness import DEFAULT_DELAY_US
from linkloom.operators.telemetry import stats_per_window
from linkloom.sources.stores import stamped_records
from linkloom.sources.warc import write_warc


def new_urls(urls: DataFrame, at: str | None = None, keep: str | None = None) -> DataFrame:
    """First occurrence of each URL; with ``at`` and ``keep`` the state forgets URLs after that long."""
    seen = urls.filter(F.col("url") != "")
    if at is None or keep is None:
        return seen.dropDuplicates(["url"])
    return seen.withWatermark(at, keep).dropDuplicatesWithinWatermark(["url"])


class _BloomBlock(StatefulProcessor):
    """The bitmap of one block of the filter."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bitmap = handle.getValueState("bitmap", "bitmap BINARY")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        stored = self.bitmap.get()[0] if self.bitmap.exists() else bytes(BLOCK_BITS // 8)
        bitmap = np.frombuffer(stored, np.uint8).copy()
        for chunk in rows:
            urls = chunk.drop_duplicates("url")
            bits = np.stack(urls["bits"].to_list())
            place, bit = bits >> 3, (1 << (bits & 7)).astype(np.uint8)
            yield pd.DataFrame({"url": urls["url"], "maybe": (bitmap[place] & bit != 0).all(axis=1)})
            np.bitwise_or.at(bitmap, place.ravel(), bit.ravel())
        self.bitmap.update((bitmap.tobytes(),))

    def close(self) -> None:
        pass


def flag_urls(urls: DataFrame, size: BloomSize) -> DataFrame:
    """``(url, maybe)`` of the URLs as they come in; ``maybe`` is False where a URL certainly was not there before.

    The state is a Bloom filter, 4 KB for each of its blocks however many URLs
    come, where ``new_urls`` keeps every URL. Null and empty URLs are passed
    over. Repeats are dropped inside an Arrow batch before the shuffle, so a hot
    URL sends a row per batch; repeats further apart are maybe known. A filter
    that outgrows its size calls ever more URLs maybe known, and never calls a
    known one new. Needs the RocksDB state store.
    """
    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop_duplicates()

    once = urls.filter(F.col("url") != "").select("url").mapInPandas(distinct, "url STRING")
    return with_bits(once, size, "url").groupBy("block").transformWithStateInPandas(
        statefulProcessor=_BloomBlock(), outputStructType="url STRING, maybe BOOLEAN", outputMode="Append", timeMode="None"
    )


def new_url_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Batch function that keeps each URL of ``flag_urls`` once, as files below ``path``; none is lost.

    URLs that are certainly new are written; those maybe known are looked up
    among the written ones. The lookup scans these and shuffles them only where
    the batch is too large for Spark to broadcast. A repeated batch replaces its
    own output.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.filter("NOT maybe").select("url").write.mode("overwrite").parquet(f"{path}/batch={batch_id}/kind=new")
        written = batch.sparkSession.read.schema("url STRING, batch BIGINT, kind STRING").parquet(path)
        known = written.filter((F.col("batch") < batch_id) | (F.col("kind") == "new"))
        doubtful = batch.filter("maybe").select("url").distinct()
        hits = known.join(doubtful, "url", "left_semi")
        found = not_seen(doubtful, hits, ["url"])
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}/kind=checked")
        batch.unpersist()

    return save


def stored_new_urls(urls: DataFrame, size: BloomSize, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that stores the first occurrence of each URL with a state of fixed size."""
    return flag_urls(urls, size).writeStream.foreachBatch(new_url_sink(path)).option("checkpointLocation", checkpoint)


def stats(log: DataFrame, at: str, every: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Counters per tumbling window."""
    return stats_per_window(log.withWatermark(at, late), at, every)


def idle_sessions(log: DataFrame, crawl: str, at: str, gap: str, late: str = "10 seconds") -> DataFrame:
    """Closed activity sessions per crawl."""
    sessions = log.withWatermark(at, late).groupBy(crawl, F.session_window(at, gap).alias("_session"))
    closed = sessions.agg(F.max(at).alias("end_at"), F.count(F.lit(1)).alias("pages"))
    return closed.select(crawl, F.col("_session.start").alias("start_at"), "end_at", "pages")


def url_status(changes: DataFrame, at: str = "ts") -> DataFrame:
    """Latest status of each URL; of several at one time the last by name."""
    return changes.groupBy("url").agg(F.max_by("status", F.struct(at, "status")).alias("status"), F.max(at).alias(at))


def counters(log: DataFrame) -> DataFrame:
    """Running pages and bytes by status label; rows with the outcome BLOCKED, if the log has outcomes, count as such."""
    label = status_label(F.col("status_code"))
    if "outcome" in log.columns:
        label = F.when(F.col("outcome") == "BLOCKED", "BLOCKED").otherwise(label)
    return log.groupBy(label.alias("status")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("bytes").cast("bigint")).alias("bytes")
    )


def releases(
    requests: DataFrame, host: str, arrival_us: str, tie: str, delay_us: int = DEFAULT_DELAY_US, late: str | None = None
) -> DataFrame:
    """Release time of each request as it comes in: one per host and delay.

    The state of a host is one number, and its requests are worked on chunk by
    chunk, so a hot host is never held whole. Inside a chunk they are taken in
    order of arrival. With ``late``, requests more than that behind the newest
    are dropped, and a host is forgotten once the watermark has passed its last
    release by the delay: no later request could have to wait for it.
    """

    def release(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        for chunk in batches:
            rows = chunk.sort_values([arrival_us, tie])
            steps = pd.RangeIndex(len(rows)).to_series(index=rows.index) * delay_us
            ahead = (rows[arrival_us] - steps).cummax()
            if state.exists:
                ahead = ahead.clip(lower=state.get[0] + delay_us)
            at = ahead + steps
            state.update((int(at.iloc[-1]),))
            if late is not None:
                free = -(-(int(at.iloc[-1]) + delay_us) // 1000)
                state.setTimeoutTimestamp(max(free, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({host: key[0], tie: rows[tie], arrival_us: rows[arrival_us], "release_us": at})

    fields = {f.name: f.dataType.simpleString() for f in requests.schema}
    out = f"{host} {fields[host]}, {tie} {fields[tie]}, {arrival_us} BIGINT, release_us BIGINT"
    known, timeout = requests.select(host, tie, arrival_us), GroupStateTimeout.NoTimeout
    if late is not None:
        known = known.withColumn("_at", F.timestamp_micros(arrival_us)).withWatermark("_at", late)
        timeout = GroupStateTimeout.EventTimeTimeout
    return known.groupBy(host).applyInPandasWithState(release, out, "last_us BIGINT", "append", timeout)


def completions(ticks: DataFrame, crawl: str, at: str, late: str = "10 seconds") -> DataFrame:
    """Ticks at which an active crawl is first found idle; the state of a crawl is one flag.

    The ticks of a crawl are worked on chunk by chunk, so a backlog is never
    held whole. Inside a chunk they are taken in order of time.
    """

    def edges(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        for chunk in batches:
            rows = chunk.sort_values([at, "active_workers", "queue_length", "in_flight"], ignore_index=True)
            active = (rows["active_workers"] > 0) | (rows["queue_length"] > 0)
            settled = rows[active | (rows["in_flight"] == 0)]
            if settled.empty:
                continue
            now = active[settled.index]
            before = now.shift(fill_value=state.get[0] if state.exists else False)
            state.update((bool(now.iloc[-1]),))
            ended = settled[~now & before]
            yield pd.DataFrame({crawl: key[0], at: ended[at]})

    fields = {f.name: f.dataType.simpleString() for f in ticks.schema}
    return ticks.withWatermark(at, late).groupBy(crawl).applyInPandasWithState(
        edges, f"{crawl} {fields[crawl]}, {at} TIMESTAMP", "active BOOLEAN", "append", GroupStateTimeout.NoTimeout
    )


class _OrderedEdges(StatefulProcessor):
    """Holds the settled ticks of a crawl until the watermark has passed them, then takes them in order."""

    def __init__(self, crawl: str, at: str, tie: str, tie_type: str):
        self.crawl, self.at, self.tie, self.tie_type = crawl, at, tie, tie_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at_us BIGINT, tie {self.tie_type}, active BOOLEAN")
        self.active = handle.getValueState("active", "active BOOLEAN")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for chunk in rows:
            active = (chunk["active_workers"] > 0) | (chunk["queue_length"] > 0)
            settled = active | (chunk["in_flight"] == 0)
            ticks = chunk[settled]
            if len(ticks):
                self.waiting.appendList(list(zip(
                    ticks["event_at_us"].astype(int).tolist(), ticks[self.tie].tolist(), active[settled].astype(bool).tolist(), strict=True
                )))
                newest = int(ticks["event_at_us"].max())
                latest = newest if latest is None else max(latest, newest)
        if latest is not None:
            self.handle.registerTimer(-(-latest // 1000))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(row) for row in self.waiting.get()] if self.waiting.exists() else []
        ready, rest = sorted(r for r in held if r[0] <= passed), [r for r in held if r[0] > passed]
        if not ready:
            return
        was = bool(self.active.get()[0]) if self.active.exists() else False
        ended = []
        for at_us, _, active in ready:
            if was and not active:
                ended.append(at_us)
            was = active
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if was:
            self.active.update((True,))
        else:
            self.active.clear()  # an idle crawl leaves nothing behind
        if ended:
            yield pd.DataFrame({self.crawl: [key[0]] * len(ended), self.at: pd.to_datetime(pd.Series(ended), unit="us")})

    def close(self) -> None:
        pass


def ordered_completions(ticks: DataFrame, crawl: str, at: str, tie: str, late: str = "10 seconds") -> DataFrame:
    """As ``completions``, exact for ticks in any order: those up to ``late`` behind the newest count in order of time.

    Ticks wait in the state until the watermark has passed them, so an edge
    comes out ``late`` after its time; ticks that are later still are dropped by
    the watermark. ``tie`` orders ticks of one time. Needs the RocksDB state store.
    """
    fields = {f.name: f.dataType.simpleString() for f in ticks.schema}
    known = ticks.withWatermark(at, late).withColumn("event_at_us", F.unix_micros(at))
    return known.groupBy(crawl).transformWithStateInPandas(
        statefulProcessor=_OrderedEdges(crawl, at, tie, fields[tie]),
        outputStructType=f"{crawl} {fields[crawl]}, {at} TIMESTAMP", outputMode="Append", timeMode="EventTime",
    )


def record_sink(records_path: str, archive_path: str, at: str) -> Callable[[DataFrame, int], None]:
    """Batch function that saves crawl records and archives; a repeated batch replaces its own output."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        stamped_records(batch).write.mode("overwrite").parquet(f"{records_path}/batch={batch_id}")
        write_warc(batch, f"{archive_path}/batch={batch_id}", at, mode="overwrite")
        batch.unpersist()

    return save


def saved(results: DataFrame, records_path: str, archive_path: str, at: str, checkpoint: str) -> DataStreamWriter:
    """Writer that saves each finished fetch as a crawl record and an archive record."""
    return results.writeStream.foreachBatch(record_sink(records_path, archive_path, at)).option(
        "checkpointLocation", checkpoint
    )


def feed(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Live feed of event texts as files; delivery is checkpointed, nothing is lost to a slow reader."""
    return events.writeStream.format("text").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    )
