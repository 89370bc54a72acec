"""WARC archives: write, list, scan and preview.

Writing uses Spark's own gzip text writer with the record end as line
separator, so files go through Spark's commit protocol to any file system it
knows, and a lost executor only repeats its task. Spark lists the files and
deals them out to tasks, which stream them record by record.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import decoded
from linkloom.operators.archive import UNSORTED, archive_domain, size_text, time_text, with_record_text
from linkloom.operators.dedup import not_seen
from linkloom.operators.fetch import archivable
from linkloom.sources.files import opened
from linkloom.sources.members import Unzipped, lines, records
from linkloom.sources.warc_format import ARROW, BATCH_BYTES, SCHEMA, File, as_row, moment, read_file, register

RECORD_END = "\r\n\r\n"
RECORD_SCHEMA = (
    "domain STRING, warc_type STRING, record_id STRING, warc_date TIMESTAMP, target_uri STRING, "
    "content_length BIGINT, http_status INT, http_content_type STRING, payload BINARY"
)

#: Reads of one file beyond so many bytes apart may go to different tasks.
RANGE_BYTES = 64 << 20
FETCHED = ARROW.append(pa.field("bytes_read", pa.int64()))


def write_warc(results: DataFrame, path: str, at: str, run: str | None = None, mode: str = "append") -> None:
    """Write the archivable results under ``path/domain=<domain>/run=<YYYYMMDD_HHMMSS>/*.gz`` in one pass.

    The run is the time of writing unless named. Rows are rebalanced by domain:
    small domains share a task, and adaptive execution splits a domain above its
    advisory partition size into several files, whatever its URLs.
    """
    run = run or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    rows = archivable(results).withColumn("domain", archive_domain(F.col("domain")))
    record = F.concat("header", "http", F.col("body").cast("string"))
    text = with_record_text(rows, at).select("domain", "url", F.col(at).alias("at"), record.alias("value"))
    placed = text.hint("rebalance", F.col("domain")).sortWithinPartitions("domain", "url", "at")
    writer = placed.select("domain", F.lit(run).alias("run"), "value").write.mode(mode).partitionBy("domain", "run")
    writer.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """File path, length and time below an archive root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")


def _domain_of(path: str, root: str) -> Column:
    """Domain of a file below the root: its ``domain=`` folder, else its first folder, else ''."""
    whole, start = F.regexp_replace(path, r"^[a-z0-9]+:/+", "/"), root.rstrip("/") + "/"
    inside = F.when(F.startswith(whole, F.lit(start)), F.substring(whole, len(start) + 1, 1 << 30)).otherwise(whole)
    named = F.regexp_extract(inside, r"(?:^|/)domain=([^/]*)/", 1)
    first = F.when(F.instr(inside, "/") > 0, F.substring_index(inside, "/", 1)).otherwise("")
    return decoded(F.when(named != "", named).otherwise(first))


def _root(path: str) -> str:
    return re.sub(r"^[a-z0-9]+:/+", "/", path)


def manifest(spark: SparkSession, path: str, with_records: bool = False) -> DataFrame:
    """Written archive files: path, domain and size; ``with_records`` reads them and adds records and their bytes."""
    files = _listed(spark, path).select(
        "path", archive_domain(_domain_of("path", _root(path))).alias("domain"), F.col("length").alias("bytes")
    )
    if not with_records:
        return files

    def count(file: str) -> Iterator[pa.RecordBatch]:
        n, size = 0, 0
        with opened(file) as data:
            for record in records(Unzipped(data, file)):
                n, size = n + 1, size + record.content_length
        yield pa.record_batch({"path": [file], "records": pa.array([n], pa.int64()), "content_bytes": pa.array([size], pa.int64())})

    counted = _listed_work(files, count, "path STRING, records BIGINT, content_bytes BIGINT")
    return files.join(counted, "path")


def record_counts(spark: SparkSession, path: str) -> DataFrame:
    """Records and their bytes per domain, counted by reading the archives."""
    counts = manifest(spark, path, with_records=True).groupBy("domain")
    return counts.agg(F.sum("records").alias("records"), F.sum("content_bytes").alias("content_bytes"))


def list_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per domain with its files in order of name; ``unsorted`` is always present."""
    domain = _domain_of("path", _root(path))
    file = F.struct(
        F.regexp_extract("path", r"[^/]+$", 0).alias("name"),
        size_text(F.col("length")).alias("size_mb"),
        time_text(F.col("modificationTime")).alias("mod_time"),
    )
    inside = _listed(spark, path).withColumn("domain", domain).filter("domain <> ''")
    groups = inside.groupBy("domain").agg(F.sort_array(F.collect_list(file)).alias("files"))
    none = F.array().cast("array<struct<name:string,size_mb:string,mod_time:string>>")
    always = spark.range(1).select(F.lit(UNSORTED).alias("domain"), none.alias("files"))
    return groups.unionByName(not_seen(always, groups, ["domain"]))


def _listed_work(files: DataFrame, work: Callable[[str], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows that ``work`` gives for every listed file; Spark deals out the files by size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                yield from work(file)

    return files.select("path").mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Response records of all gzip archives below ``path``, cut by their Content-Length; one in memory at a time.

    A file that ends inside a record, or has one without a length, fails the
    read; with ``strict=False`` its rest is passed over. ``spark.read.format("warc")``
    gives the same rows with their places in the files.
    """

    def cut(file: str) -> Iterator[pa.RecordBatch]:
        yield from (batch.drop_columns(["domain", "offset", "length"]) for batch in read_file(File(file, ""), strict))

    schema = RECORD_SCHEMA.split(", ", 1)[1] + ", path STRING"
    found = _listed_work(_listed(spark, path), cut, schema)
    rows = found.withColumn("domain", archive_domain(_domain_of("path", _root(path))))
    return rows.select("domain", *[part.split(" ")[0] for part in schema.split(", ")[:-1]])


def archive_file(root: str, domain: str, file: str) -> str:
    """Path of one archive file; domain and file count by their last path part only."""
    domain, file = domain.rstrip("/").rsplit("/", 1)[-1], file.rstrip("/").rsplit("/", 1)[-1]
    if file in ("", "."):
        raise ValueError("file is required")
    return "/".join([root.rstrip("/"), *([domain] if domain not in ("", ".") else []), file])


def preview(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Lines ``start`` to ``end`` of every archive below ``path``, with path and line number.

    A file is unzipped no further than its last line wanted.
    """

    def numbered(file: str) -> Iterator[pa.RecordBatch]:
        with opened(file) as data:
            found = lines(Unzipped(data, file), start, end)
            while part := list(islice(found, 1000)):
                numbers, texts = zip(*part, strict=True)
                yield pa.record_batch({
                    "path": pa.array([file] * len(part)), "line_no": pa.array(numbers, pa.int64()), "line": pa.array(texts, pa.binary()),
                })

    rows = _listed_work(_listed(spark, path), numbered, "path STRING, line_no BIGINT, line BINARY")
    return rows.select("path", "line_no", F.regexp_replace(F.make_valid_utf8(F.col("line").cast("string")), r"\r\z", "").alias("line"))


#: An empty gzip member. It ends every record of an indexed archive, as the line separator of Spark's writer.
_EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
INDEX_SCHEMA = "domain STRING, url STRING, warc_date TIMESTAMP, path STRING, offset BIGINT, length BIGINT"


def write_indexed(results: DataFrame, path: str, at: str, run: str | None = None) -> None:
    """As ``write_warc``, with one gzip member per record, and the index of the new files beside them.

    Records go to ``path/records/domain=<domain>/run=<run>``, the index, sorted
    by URL, to ``path/index/run=<run>``. Any WARC reader can read the files.
    """
    run = run or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    rows = archivable(results).withColumn("domain", archive_domain(F.col("domain")))
    record = F.concat(F.concat("header", "http").cast("binary"), "body", F.lit(RECORD_END).cast("binary"))
    text = with_record_text(rows, at).select("domain", "url", F.col(at).alias("at"), record.alias("record"))
    placed = text.hint("rebalance", F.col("domain")).sortWithinPartitions("domain", "url", "at").select("domain", "record")

    def zip_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                zipped = [gzip.compress(r, 6, mtime=0) for r in part.column(1).to_pylist()]
                yield pa.record_batch({"domain": part.column(0), "member": pa.array(zipped, pa.binary())})

    members = placed.mapInArrow(zip_each, "domain STRING, member BINARY")
    value = members.select("domain", F.lit(run).alias("run"), F.col("member").cast("string").alias("value"))
    writer = value.write.mode("append").partitionBy("domain", "run").option("maxRecordsPerFile", 0)
    writer.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER).text(f"{path}/records")
    found = index(spark=results.sparkSession, path=f"{path}/records", run=run)
    found.repartitionByRange("url").sortWithinPartitions("url", "warc_date").write.mode("overwrite").parquet(f"{path}/index/run={run}")


def index(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """``(domain, url, warc_date, path, offset, length)`` of every record below ``path`` that is gzip members of its own."""
    register(spark)
    source = spark.read.format("warc").option("within", f"/run={run}/" if run else "")
    rows = source.load(path).filter("length IS NOT NULL")
    return rows.select("domain", F.col("target_uri").alias("url"), "warc_date", "path", "offset", "length")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all runs of an indexed archive."""
    return spark.read.parquet(f"{path}/index").select("domain", "url", "warc_date", "path", "offset", "length")


def fetch_records(index_rows: DataFrame, wanted: DataFrame, url: str = "url") -> DataFrame:
    """Records of the wanted URLs, by reads of their own bytes alone; ``bytes_read`` is what a record took.

    Index rows are joined with the distinct URLs; Spark broadcasts whichever side
    its measured size allows. Reads are dealt out by file and done in order of
    offset, so a file is opened once per task; a hot file is split by its offsets.
    """
    asked = wanted.select(F.col(url).alias("url")).distinct()
    places = index_rows.join(asked, "url", "left_semi")
    slot = F.floor(F.col("offset") / F.lit(RANGE_BYTES))
    tasks = int(index_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = places.repartition(tasks, "path", slot).sortWithinPartitions("path", "offset").select("domain", "path", "offset", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        try:
            for batch in batches:
                rows, held = [], 0
                for place in batch.to_pylist():
                    if place["path"] != name:
                        if file is not None:
                            file.close()
                        name, file = place["path"], opened(place["path"])
                    raw = file.read_at(place["length"], place["offset"])
                    record = next(records(Unzipped(io.BytesIO(raw), name)))
                    row = as_row(File(name, place["domain"]), record, moment(record.warc_date))
                    rows.append(row | {"offset": place["offset"], "length": place["length"], "bytes_read": len(raw)})
                    held += len(record.payload) + 500
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, FETCHED)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, FETCHED)
        finally:
            if file is not None:
                file.close()

    return dealt.mapInArrow(read, SCHEMA + ", bytes_read BIGINT")
