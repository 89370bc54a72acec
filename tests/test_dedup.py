from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import bloom, dedup


def test_push_takes_the_first_of_each_new_url(spark):
    items = spark.createDataFrame(
        [("https://a/1", 3), ("https://a/1", 1), ("", 2), ("https://a/2", 4), ("https://a/3", 5)], "url STRING, seq INT"
    )
    seen = spark.createDataFrame([("https://a/2",)], "url STRING")
    assert sorted(map(tuple, dedup.push(items, seen, ["url"], "seq").collect())) == [("https://a/1", 1), ("https://a/3", 5)]
    flags = {(r["url"], r["seq"]): r["pushed"] for r in dedup.flag_pushed(items, seen, ["url"], "seq").collect()}
    assert flags == {
        ("https://a/1", 3): False, ("https://a/1", 1): True, ("", 2): False, ("https://a/2", 4): False,
        ("https://a/3", 5): True,
    }


def test_last_write_wins(spark):
    rows = spark.createDataFrame([("u", 1, "QUEUED"), ("u", 2, "CRAWLED"), ("v", 1, "QUEUED")], "url STRING, version INT, status STRING")
    assert {(r["url"], r["status"]) for r in dedup.last_per_key(rows, ["url"], "version").collect()} == {
        ("u", "CRAWLED"), ("v", "QUEUED")
    }


def test_a_session_sees_a_url_again(spark):
    rows = spark.createDataFrame([("s1", "u", 1), ("s1", "u", 2), ("s2", "u", 3)], "session_id STRING, url STRING, seq INT")
    got = dedup.push(rows, rows.limit(0), ["session_id", "url"], "seq")
    assert sorted(r["seq"] for r in got.collect()) == [1, 3]


def test_bloom_size():
    size = bloom.BloomSize.of(1_000_000, 0.01)
    assert (size.bits, size.hashes) == (9585059, 7)
    assert bloom.BloomSize.of(0, 1.5) == size
    assert bloom.BloomSize.of(-3, 0) == size


def test_bloom_sequence(spark):
    size = bloom.BloomSize.of(1000, 0.01)
    page1, page2 = "https://example.com/page1", "https://example.com/page2"
    urls = spark.createDataFrame([(page1,), (page2,)], "url STRING")
    empty = bloom.build(urls.limit(0), size)
    assert {r["maybe"] for r in bloom.might_contain(urls, empty, size).collect()} == {False}
    added = urls.filter(F.col("url") == page1)
    built = bloom.build(added.union(added), size)
    assert built.agg(F.sum("added")).first()[0] == 1
    got = {r["url"]: r["maybe"] for r in bloom.might_contain(urls, built, size).collect()}
    assert got == {page1: True, page2: False}


def test_bloom_errors(spark, monkeypatch):
    size = bloom.BloomSize.of(20_000, 0.01)
    members = spark.range(20_000).select(F.concat(F.lit("https://in/"), "id").alias("url"))
    others = spark.range(20_000).select(F.concat(F.lit("https://out/"), "id").alias("url"))
    built = bloom.build(members, size)
    assert bloom.might_contain(members, built, size).filter("NOT maybe").count() == 0
    wrong = bloom.might_contain(others, built, size).filter("maybe").count()
    assert wrong <= 2 * 0.01 * 20_000
    monkeypatch.setattr(bloom, "BROADCAST_BLOCKS", 0)
    assert bloom.might_contain(others, built, size).filter("maybe").count() == wrong


def test_bloom_dedup_is_exact_unless_told_otherwise(spark):
    tiny = bloom.BloomSize(bits=64, hashes=1)
    seen = spark.range(30_000).select(F.concat(F.lit("https://s/"), "id").alias("url"))
    new = spark.range(29_000, 31_000).select(F.concat(F.lit("https://s/"), "id").alias("url"))
    exact = bloom.dedup(new.union(new), seen, tiny)
    assert exact.count() == exact.distinct().count() == 1000
    loose = bloom.dedup(new, seen, tiny, exact=False)
    assert loose.count() < 1000 and loose.join(seen, "url").count() == 0


def test_repeated_sequence_numbers_flag_one_row(spark):
    items = spark.createDataFrame([("u", 1), ("u", 1), ("v", 2)], "url STRING, seq INT")
    seen = spark.createDataFrame([], "url STRING")
    flagged = dedup.flag_pushed(items, seen, ["url"], "seq").filter("pushed")
    assert sorted(r["url"] for r in flagged.collect()) == ["u", "v"] and dedup.push(items, seen, ["url"], "seq").count() == 2


def most_and_tasks(df):
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes), len(sizes)


def test_bloom_tasks_follow_the_rows(spark, monkeypatch):
    # far more tasks than shuffle partitions, and no task with more than some blocks
    monkeypatch.setattr(bloom, "ROWS_PER_TASK", 2000)
    monkeypatch.setattr(bloom, "BROADCAST_BLOCKS", 0)
    size = bloom.BloomSize.of(200_000, 0.01)
    urls = spark.range(200_000).select(F.concat(F.lit("https://in/"), "id").alias("url"))
    built = bloom.build(urls, size)
    blocks, tasks = most_and_tasks(built)
    assert blocks <= 10 and tasks > 20 and built.count() == size.blocks
    rows, tasks = most_and_tasks(bloom.might_contain(urls, built, size))
    assert rows < 40_000 and tasks > 20


def test_bloom_with_blocks_too_large_for_a_task(spark, monkeypatch):
    size = bloom.BloomSize.of(20_000, 0.01)
    once = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://in/"), "id")).alias("url"))
    often = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("https://hot/"), F.col("id") % 3)).alias("url"))
    urls, others = once.union(often), spark.range(5000).select(F.concat(F.lit("https://out/"), "id").alias("url")).union(often)
    plain = bloom.build(urls, size)
    maybe = [sorted(map(tuple, bloom.might_contain(others, plain, size).fillna("").collect()))]
    fresh = [sorted(map(tuple, bloom.dedup(others, once, size).fillna("").collect()))]
    monkeypatch.setattr(bloom, "BROADCAST_BLOCKS", 0)
    for most in (1_000_000, 3000):  # at the second the blocks of the URLs that repeat are large, and the null URLs are
        monkeypatch.setattr(bloom, "LARGE_BLOCK_ROWS", most)
        built = bloom.build(urls, size)
        assert built.exceptAll(plain).count() == 0 and built.count() == plain.count()
        assert built.agg(F.sum("added")).first()[0] == 10_002
        maybe.append(sorted(map(tuple, bloom.might_contain(others, built, size).fillna("").collect())))
        fresh.append(sorted(map(tuple, bloom.dedup(others, once, size).fillna("").collect())))
    assert maybe[0] == maybe[1] == maybe[2] and len(maybe[0]) == 14_000
    assert {m for u, m in maybe[0] if u == ""} == {False} and {m for u, m in maybe[0] if u.startswith("https://hot/")} == {True}
    assert fresh[0] == fresh[1] == fresh[2] and len(fresh[0]) == 5003
