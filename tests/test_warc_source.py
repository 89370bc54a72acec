"""The warc format by name, as a stream, and random access through the index."""

from __future__ import annotations

import gzip
import io
import os
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringStartsWith

from linkloom.sources import warc, warc_format
from linkloom.sources.files import opened, store_of
from linkloom.sources.members import Unzipped, lines, records


@pytest.fixture(scope="module")
def results(spark):
    """Three domains, one of them hot; bodies that do not compress, of which some hold record ends."""
    return spark.range(400).selectExpr(
        "concat('https://', CASE WHEN id % 4 < 2 THEN 'hot.org' WHEN id % 4 = 2 THEN 'b.com:80' ELSE '' END, '/p', id div 2) AS url",
        "CASE WHEN id % 4 < 2 THEN 'hot.org' WHEN id % 4 = 2 THEN 'b.com:80' ELSE '' END AS domain", "200 AS status_code",
        "'text/html' AS content_type",
        "CAST(concat(sha2(string(id), 512), '\\r\\n\\r\\nWARC/1.0\\r\\n', sha2(string(-id), 512)) AS BINARY) AS body", "'' AS error",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS at",
    )


@pytest.fixture(scope="module")
def archive(spark, results, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc"))
    warc.write_warc(results, path, "at", run="20240101_000000")
    return path


@pytest.fixture(scope="module")
def indexed(spark, results, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("indexed"))
    warc.write_indexed(results, path, "at", run="20240101_000000")
    return path


def bodies(df, url="target_uri", body="payload"):
    return sorted((r[url], bytes(r[body])) for r in df.select(url, body).collect())


def test_by_name_and_in_sql(spark, results, archive):
    warc_format.register(spark)
    rows = spark.read.format("warc").load(archive)
    assert [f.name for f in rows.schema] == [p.split()[0] for p in warc_format.SCHEMA.split(", ")]
    assert bodies(rows) == bodies(results, "url", "body")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW archived USING warc OPTIONS (path '{archive}')")
    got = spark.sql("SELECT domain, count(*) AS n, min(warc_date) AS first FROM archived GROUP BY domain").collect()
    assert {r["domain"]: r["n"] for r in got} == {"hot.org": 200, "b.com:80": 100, "unsorted": 100}
    assert min(r["first"] for r in got) == datetime(2024, 1, 1)
    same = ["domain", "warc_type", "record_id", "target_uri", "content_length", "http_status", "http_content_type", "payload"]
    assert sorted(map(tuple, rows.select(same).collect())) == sorted(map(tuple, warc.read_warc(spark, archive).select(same).collect()))


def test_filters_leave_out_files_and_records(spark, archive):
    warc_format.register(spark)
    rows = spark.read.format("warc").load(archive)
    files = rows.rdd.getNumPartitions()
    one = rows.filter("domain = 'b.com:80'")
    assert one.count() == 100 and one.rdd.getNumPartitions() < files
    late = rows.filter("warc_date >= timestamp'2024-01-01 00:05:00' AND warc_date < timestamp'2024-01-01 00:06:00'")
    assert late.count() == 60 and rows.filter("target_uri LIKE 'https://hot.org/p1_'").count() == 10
    assert rows.filter("domain IN ('b.com:80', 'none') AND warc_date <= timestamp'2024-01-01 00:00:10'").count() == 3
    assert rows.filter("domain = 'none'").count() == 0


def test_pushed_filters_one_by_one(archive):
    reader = warc_format.WarcReader({"path": archive})
    at = datetime(2024, 1, 1, 0, 1)
    asked = [EqualTo(("domain",), "b.com:80"), GreaterThan(("warc_date",), at), StringStartsWith(("target_uri",), "x"), EqualTo(("http_status",), 200)]
    assert list(reader.pushFilters(asked)) == asked[2:]
    parts = reader.partitions()
    assert parts and {f.domain for f in parts} == {"b.com:80"}
    found = [r for f in parts for batch in reader.read(f) for r in batch.to_pylist()]
    assert found and all(r["warc_date"] > at.replace(tzinfo=timezone.utc) for r in found)
    assert list(reader.pushFilters([In(("domain",), ("hot.org",)), LessThanOrEqual(("warc_date",), at)])) == [] and reader.partitions() == []
    with pytest.raises(ValueError, match="path"):
        warc_format.WarcReader({})
    with pytest.raises(FileNotFoundError):
        warc_format.WarcReader({"path": archive + "/none"}).partitions()


def test_broken_files_fail_unless_told_otherwise(spark, tmp_path):
    warc_format.register(spark)
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Date: no date\r\nContent-Length: 19\r\n\r\nHTTP/1.1 204 x\r\n\r\nb\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one + one[:-9]))
    with pytest.raises(Exception, match="ends inside a record"):
        spark.read.format("warc").load(str(tmp_path)).collect()
    rows = spark.read.format("warc").option("strict", "false").load(str(tmp_path)).collect()
    assert [(r["http_status"], r["payload"], r["warc_date"], r["domain"]) for r in rows] == [(204, b"b", None, "unsorted")]
    (tmp_path / "a.warc.gz").write_bytes(b"plain text")
    with pytest.raises(Exception, match="not a gzip archive"):
        spark.read.format("warc").load(str(tmp_path)).collect()


def test_stream_reads_new_files_once_in_any_order(spark, results, tmp_path):
    warc_format.register(spark)
    path, checkpoint, out = str(tmp_path / "w"), str(tmp_path / "cp"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.format("warc").load(path).select("target_uri", "payload")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return bodies(spark.read.parquet(out))

    first, second, third = (results.filter(f"pmod(hash(url), 3) = {k}") for k in (0, 1, 2))
    warc.write_warc(first, path, "at", run="1")
    assert run() == bodies(first, "url", "body")
    warc.write_warc(second, path, "at", run="2")
    for file in Path(path).rglob("run=2/*.gz"):  # older than files already read
        os.utime(file, (1, 1 + os.stat(file).st_mtime - 3600))
    warc.write_warc(third, path, "at", run="3")
    assert run() == bodies(results, "url", "body")
    assert run() == bodies(results, "url", "body")  # nothing twice


def test_indexed_archives_are_plain_archives(spark, results, indexed):
    assert bodies(warc.read_warc(spark, f"{indexed}/records")) == bodies(results, "url", "body")
    files = [f for f in Path(indexed, "records").rglob("part-*") if f.stat().st_size]
    found = [r for f in files for r in records(Unzipped(io.BytesIO(f.read_bytes()), "x"))]
    assert len(found) == 400 and all(r.length for r in found)
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Type: response") for f in files) == 400  # by another reader


def test_fetch_reads_the_bytes_of_the_wanted_records_only(spark, results, indexed):
    places = warc.read_index(spark, indexed)
    assert places.count() == 400 and places.filter("offset IS NULL OR length IS NULL").count() == 0
    wanted = spark.createDataFrame([("https://hot.org/p6",), ("https://hot.org/p6",), ("https://b.com:80/p1",), ("https://none/",)], "url STRING")
    got = warc.fetch_records(places, wanted)
    assert bodies(got) == bodies(results.filter("url IN ('https://hot.org/p6', 'https://b.com:80/p1')"), "url", "body")
    rows = got.collect()
    assert all(r["bytes_read"] == r["length"] < r["content_length"] + 600 for r in rows)
    stored = sum(f.stat().st_size for f in Path(indexed, "records").rglob("part-*"))
    assert sum(r["bytes_read"] for r in rows) < stored / 50
    assert {r["domain"] for r in rows} == {"hot.org", "b.com:80"}
    every = warc.fetch_records(places, results.select("url"))
    assert bodies(every) == bodies(results, "url", "body")
    assert warc.fetch_records(places, wanted.limit(0)).count() == 0


def test_later_runs_add_to_the_index(spark, results, tmp_path):
    path = str(tmp_path)
    warc.write_indexed(results.limit(5), path, "at", run="1")
    warc.write_indexed(results.limit(3), path, "at", run="2")
    places = warc.read_index(spark, path)
    assert places.count() == 8 and places.select("path").distinct().count() >= 2
    again = warc.fetch_records(places, results.limit(3).select("url"))
    assert again.count() >= 6  # both runs have them


def test_a_wanted_table_is_joined_not_the_archive_read(spark, indexed, results):
    places = warc.read_index(spark, indexed)
    plan = warc.fetch_records(places, results.select("url"))._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" not in plan and "LeftSemi" in plan and "ReadSchema: struct<domain:string,url:string,path:string,offset:bigint,length:bigint>" in plan


def test_lines_stop_at_the_last_one(tmp_path):
    data = os.urandom(3_000_000).hex().encode()
    file = tmp_path / "big.gz"
    file.write_bytes(gzip.compress(b"one\r\ntwo\nthree\n" + data)[:-50])  # a broken end, never reached
    with opened(str(file)) as raw:
        stream = Unzipped(raw, str(file))
        assert list(lines(stream, 2, 3)) == [(2, b"two"), (3, b"three")] and stream.bytes_read <= 256 << 10
    with opened(f"file://{file}") as raw, pytest.raises(EOFError, match="unexpected end"):
        list(lines(Unzipped(raw, "x"), 1, 9))


def test_preview_does_not_read_to_the_end(spark, tmp_path):
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"a\nb\nc\n" + os.urandom(2_000_000))[:-99])
    got = warc.preview(spark, str(tmp_path), 1, 2).collect()
    assert [(r["line_no"], r["line"]) for r in got] == [(1, "a"), (2, "b")]


def test_members_and_records_at_every_size():
    one = lambda n: b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (n, b"x" * n)
    sizes = [0, 1, 5_000_000, 3, 262_144, 17]
    file = b"".join(gzip.compress(one(n)) + gzip.compress(b"") for n in sizes)
    found = list(records(Unzipped(io.BytesIO(file), "x")))
    assert [r.content_length for r in found] == sizes
    for r in found:
        again = list(records(Unzipped(io.BytesIO(file[r.offset : r.offset + r.length]), "x")))
        assert len(again) == 1 and again[0].payload == r.payload
    joined = list(records(Unzipped(io.BytesIO(gzip.compress(b"".join(map(one, sizes)))), "x")))
    assert [r.content_length for r in joined] == sizes and {r.length for r in joined} == {None}


def test_store_paths():
    assert store_of("file:///a/b c")[1:] == ("/a/b c", "file:") and store_of("/a%20b")[1:] == ("/a%20b", "") and store_of("file:/x")[1] == "/x"


def test_manifest_counts_records_per_file(spark, archive):
    rows = warc.manifest(spark, archive, with_records=True).collect()
    assert sum(r["records"] for r in rows) == 400 and all(r["bytes"] > 0 and r["content_bytes"] > 256 * r["records"] for r in rows)
    counts = {r["domain"]: r["records"] for r in warc.record_counts(spark, archive).collect()}
    assert counts == {"hot.org": 200, "b.com:80": 100, "unsorted": 100}
