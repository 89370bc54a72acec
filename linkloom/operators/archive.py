"""Archive records and archive queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.rows import per_element

UNSORTED = "unsorted"
CRLF = "\r\n"
# Fixed value: lines of a preview that names no number.
PREVIEW_LINES = 100


def archive_domain(domain: Column) -> Column:
    return F.when(domain == "", UNSORTED).otherwise(domain)


def record_id(url: Column, at: Column) -> Column:
    """UUID-shaped id that is the same for the same URL and time."""
    digest = F.md5(F.concat_ws(" ", url, F.unix_micros(at).cast("string")))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def http_block(status_code: Column, content_type: Column, body: Column) -> Column:
    return F.concat(
        F.lit("HTTP/1.1 "), status_code.cast("string"), F.lit(" OK" + CRLF + "Content-Type: "), content_type,
        F.lit(CRLF + "Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF),
    )


def record_header(url: Column, at: Column, http: Column, body: Column) -> Column:
    """WARC header of a response record; lengths are in bytes."""
    return F.concat(
        F.lit("WARC/1.0" + CRLF + "WARC-Type: response" + CRLF + "WARC-Record-ID: <urn:uuid:"),
        record_id(url, at),
        F.lit(">" + CRLF + "WARC-Date: "),
        F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(CRLF + "WARC-Target-URI: "),
        url,
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "),
        (F.octet_length(http) + F.octet_length(body)).cast("string"),
        F.lit(CRLF + CRLF),
    )


def with_record_text(results: DataFrame, at: str) -> DataFrame:
    """Add ``header`` and ``http`` texts of each result; ``at`` names the time column."""
    http = http_block(F.col("status_code"), F.col("content_type"), F.col("body"))
    return results.withColumn("http", http).withColumn(
        "header", record_header(F.col("url"), F.col(at), F.col("http"), F.col("body"))
    )


def size_text(n_bytes: Column) -> Column:
    return F.format_string("%.2f MB", n_bytes.cast("double") / 1024 / 1024)


def time_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def publish_plan(manifest: DataFrame, bucket: str, scheme: str = "r2") -> DataFrame:
    """Object key, URI and content type per archive file.

    The key keeps the domain; ``collides`` marks files whose bare name is not
    unique, which would overwrite each other under a key of the name alone.
    """
    name = F.regexp_extract("path", r"[^/]+$", 0)
    named = manifest.withColumn("name", name)
    shared = named.groupBy("name").agg((F.count(F.lit(1)) > 1).alias("collides"))
    key = F.concat_ws("/", F.lit("warc"), archive_domain(F.col("domain")), F.col("name"))
    return named.join(shared, "name").select(
        "path",
        "domain",
        key.alias("key"),
        F.concat(F.lit(f"{scheme}://{bucket}/"), key).alias("uri"),
        F.lit("application/gzip").alias("content_type"),
        "collides",
    )


def line_span(from_: int | None = None, to: int | None = None, lines: int | None = None) -> tuple[int, int]:
    """First and last line of a preview: what is asked for, else 100 lines."""
    start = from_ if from_ and from_ > 0 else 1
    count = lines if lines and lines > 0 else PREVIEW_LINES
    end = to if to and to >= start else start + count - 1
    return start, end


def text_lines(df: DataFrame, key: str, text: str, start: int, end: int) -> DataFrame:
    """Lines ``start`` to ``end`` of a text column, numbered from 1, without line ends."""
    body = F.regexp_replace(text, r"\n\z", "")
    taken = F.slice(F.split(body, "\n"), start, end - start + 1)
    return per_element(df, [key], taken, "line", "pos").select(
        key,
        (F.col("pos") + start).alias("line_no"),
        F.regexp_replace("line", r"\r\z", "").alias("line"),
    )
