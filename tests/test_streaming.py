"""Streams over files, run to the end, must agree with the batch form and survive a restart."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import politeness, telemetry
from linkloom.operators.bloom import BLOCK_BITS, BloomSize
from linkloom.sources import warc
from linkloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def log(spark, tmp_path):
    """A fetch log in three files, in order of time."""
    pick = random.Random(2)
    rows = []
    for i in range(300):
        host = pick.choice(["hot", "hot", "b", "c"])
        rows.append((i, T0 + dt.timedelta(milliseconds=400 * i), host, f"https://{host}/{pick.randint(0, 20)}",
                     pick.choice([200, 200, 404, 0]), "", pick.choice(["QUEUED", "CRAWLED"]), 10))
    schema = "id BIGINT, ts TIMESTAMP, host STRING, url STRING, status_code INT, error STRING, status STRING, bytes INT"
    folder = str(tmp_path / "log")
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.read.parquet(folder)
    return folder, spark.read.schema(schema).parquet(folder)


def stream(spark, log):
    folder, batch = log
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)


def run(df, tmp_path, mode, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / f"cp-{name}")
    ).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def bag(df):
    return sorted(map(tuple, df.collect()))


def test_new_urls(spark, log, tmp_path):
    got = run(jobs.new_urls(stream(spark, log)), tmp_path, "append", "fresh").select("url")
    assert bag(got) == bag(log[1].select("url").distinct())
    bounded = run(jobs.new_urls(stream(spark, log), "ts", "1 hour"), tmp_path, "append", "fresh_bounded").select("url")
    assert bag(bounded) == bag(log[1].select("url").distinct())


def test_stats(spark, log, tmp_path):
    got = run(jobs.stats(stream(spark, log), "ts", "5 seconds", "1 second"), tmp_path, "complete", "stats")
    assert bag(got) == bag(telemetry.stats_per_window(log[1], "ts", "5 seconds"))


def test_idle_sessions(spark, log, tmp_path):
    got = run(jobs.idle_sessions(stream(spark, log), "host", "ts", "2 seconds"), tmp_path, "complete", "sessions")
    batch = telemetry.idle_sessions(log[1].withColumn("us", F.unix_micros("ts")), "host", "us", 2_000_000)
    assert bag(got.select("host", F.unix_micros("start_at"), F.unix_micros("end_at"), "pages")) == bag(batch)


def test_url_status_and_counters(spark, log, tmp_path):
    got = run(jobs.url_status(stream(spark, log)), tmp_path, "complete", "url_status")
    assert bag(got) == bag(jobs.url_status(log[1]))
    got = run(jobs.counters(stream(spark, log)), tmp_path, "complete", "counters")
    assert bag(got.select("status", "pages")) == bag(telemetry.pages_by_status(log[1]))


def test_histogram(spark, log, tmp_path):
    def histogram(df):
        return telemetry.latency_histogram(df, F.col("id") / 100)

    assert bag(run(histogram(stream(spark, log)), tmp_path, "complete", "histogram")) == bag(histogram(log[1]))


def test_releases(spark, log, tmp_path):
    requests = stream(spark, log).select("host", "id", F.unix_micros("ts").alias("at"))
    got = run(jobs.releases(requests, "host", "at", "id", 900_000), tmp_path, "append", "releases").select("host", "id", "at", "release_us")
    gaps = politeness.violations(got, "host", "release_us", "id", 900_000)
    assert got.count() == 300 and got.filter("release_us < at").count() == 0 and gaps.count() == 0


def test_releases_in_order_agree_with_the_plan(spark, tmp_path):
    rows = [(h, i, 1000 * i + 100 * (i % 7)) for i in range(200) for h in ("a", "b")]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "host STRING, id BIGINT, at BIGINT").coalesce(1).write.parquet(folder)
    batch = spark.read.parquet(folder)
    got = run(jobs.releases(spark.readStream.schema(batch.schema).parquet(folder), "host", "at", "id", 1500), tmp_path, "append", "planned")
    want = politeness.plan(batch, "host", "at", "id", 1500)
    assert bag(got.select("host", "id", "at", "release_us")) == bag(want.select("host", "id", "at", "release_us"))


def test_completions(spark, log, tmp_path):
    def ticks(df):
        active = F.when(F.col("status_code") == 200, 1).otherwise(0)
        return df.select(
            F.col("host").alias("crawl"), "ts", "id", active.alias("active_workers"), F.lit(0).alias("queue_length"),
            F.when(F.col("status_code") == 404, 1).otherwise(0).alias("in_flight"),
        )

    got = run(jobs.completions(ticks(stream(spark, log)), "crawl", "ts"), tmp_path, "append", "ended")
    assert bag(got) == bag(telemetry.completions(ticks(log[1]), "crawl", "ts", "id"))


def test_saved_batches_are_repeatable(spark, log, tmp_path):
    def results(df):
        return df.select(
            "url", F.col("host").alias("domain"), "status_code", F.lit(1).alias("depth"), F.lit(5_000_000).cast("bigint").alias("fetch_time_ns"),
            "error", F.lit("text/html").alias("content_type"), F.col("url").cast("binary").alias("body"), "ts",
        )

    records, archive = str(tmp_path / "records"), str(tmp_path / "archive")
    query = jobs.saved(results(stream(spark, log)), records, archive, "ts", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(records).count() == 300
    good = results(log[1]).filter("status_code = 200")
    assert warc.read_warc(spark, archive).count() == good.count()
    # A repeated batch replaces its own output.
    jobs.record_sink(records, archive, "ts")(results(log[1].filter("id < 100")), 0)
    assert spark.read.parquet(records).count() == 300
    assert warc.read_warc(spark, archive).count() == good.count()


def test_feed_goes_on_after_a_restart(spark, log, tmp_path):
    events = telemetry.log_events(stream(spark, log).withColumn("depth", F.lit(1)))
    out, checkpoint = str(tmp_path / "feed"), str(tmp_path / "feed-cp")
    for _ in range(2):
        query = jobs.feed(events, out, checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.read.text(out).count() == 300


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    chunk = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(chunk)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set(chunk, 7)  # many chunks per trigger
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(chunk, before)


def test_ordered_completions_of_late_and_reversed_ticks(spark, rocks, tmp_path):
    pick = random.Random(21)
    schema = "crawl STRING, ts TIMESTAMP, id BIGINT, active_workers INT, queue_length INT, in_flight INT"
    rows = []
    for i in range(600):
        state = pick.choice([(1, 0, 1), (0, 2, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0)])
        rows.append((pick.choice(["hot", "hot", "hot", "b"]), T0 + dt.timedelta(milliseconds=100 * (i // 2)), i, *state))
    folder = str(tmp_path / "ticks")
    for part in range(4):  # ticks come up to 9 seconds late, and each file in reverse
        mine = sorted((r for k, r in enumerate(rows) if min(3, max(0, k // 150 + (1 if k % 11 == 0 and k % 150 > 70 else 0))) == part), key=lambda r: -r[2])
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(folder)
    end = T0 + dt.timedelta(hours=1)
    for last in range(2):  # later ticks move the watermark past all others
        flush = [(c, end + dt.timedelta(seconds=last), 10_000 + last, 1, 0, 0) for c in ("hot", "b")]
        spark.createDataFrame(flush, schema).coalesce(1).write.mode("append").parquet(folder)
    batch = spark.read.schema(schema).parquet(folder)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run(jobs.ordered_completions(source, "crawl", "ts", "id", "20 seconds"), tmp_path, "append", "ordered")
    want = telemetry.completions(batch, "crawl", "ts", "id")
    assert bag(got) == bag(want) and want.count() > 20


def test_hosts_are_forgotten_when_nothing_has_to_wait(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "host STRING, id BIGINT, at BIGINT"
    for part in range(4):
        rows = [(f"h{part}-{k % 20}", part * 100 + k, 10**12 + part * 60_000_000 + k * 1000) for k in range(60)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    requests = jobs.releases(source, "host", "at", "id", 500_000, "1 second")
    query = requests.writeStream.format("memory").queryName("released").outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "cp")
    ).start()
    query.awaitTermination(120)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) <= 40 and states[-1] <= 20  # 80 hosts came
    batch = spark.read.parquet(folder)
    assert bag(spark.table("released").select("host", "id", "release_us")) == bag(
        politeness.plan(batch, "host", "at", "id", 500_000).select("host", "id", "release_us")
    )


@pytest.mark.parametrize("size", [BloomSize(1, 1), BloomSize(4 * BLOCK_BITS, 5)])
def test_new_urls_with_a_state_of_fixed_size(spark, tmp_path, size):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        folder, path, pick = str(tmp_path / "in"), str(tmp_path / "out"), random.Random(5)
        for part in range(3):
            rows = [(f"u{pick.randint(0, 4000 * (part + 1))}",) for _ in range(6000)] + [("hot",)] * 3000 + [("",), (None,)]
            spark.createDataFrame(rows, "url STRING").coalesce(2).write.mode("append").parquet(folder)
        source = spark.readStream.schema("url STRING").option("maxFilesPerTrigger", 2).parquet(folder)
        query = jobs.stored_new_urls(source, size, path, str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert len(states) == 3 and max(states) <= size.blocks  # some 10,000 URLs came
        stored = spark.read.parquet(path)
        want = spark.read.parquet(folder).filter("url <> ''").distinct()
        assert stored.count() == want.count() and stored.select("url").exceptAll(want).count() == 0
        sure = stored.filter("kind = 'new'").count()
        assert sure > 0.99 * want.count() if size.blocks > 1 else sure < 0.95 * want.count()
        jobs.new_url_sink(path)(spark.createDataFrame([("hot", True), ("more", True), ("more", True)], "url STRING, maybe BOOLEAN"), 9)
        jobs.new_url_sink(path)(spark.createDataFrame([("hot", True), ("more", True)], "url STRING, maybe BOOLEAN"), 9)
        assert spark.read.parquet(path).filter("url IN ('hot', 'more')").count() == 2
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
