"""Listing of archive folders by tasks, empty folders and empty files included."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import decoded
from linkloom.operators.archive import UNSORTED, size_text, time_text
from linkloom.operators.dedup import not_seen
from linkloom.session import materialized
from linkloom.sources.files import store_of

_ROWS = 10_000
_ENTRIES = "domain STRING, name STRING, path STRING, is_folder BOOLEAN, bytes BIGINT, modified_us BIGINT"


def _entries(folders: DataFrame) -> DataFrame:
    """What lies directly in each folder of ``(domain, path)``; names with a leading dot or underscore are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.to_pylist():
                store, inside, before = store_of(folder["path"])
                found = [f for f in store.get_file_info(fs.FileSelector(inside)) if f.base_name[:1] not in (".", "_")]
                for k in range(0, len(found), _ROWS):
                    part = found[k : k + _ROWS]
                    yield pa.record_batch({
                        "domain": pa.array([folder["domain"]] * len(part), pa.string()),
                        "name": pa.array([f.base_name for f in part], pa.string()),
                        "path": pa.array([before + f.path for f in part], pa.string()),
                        "is_folder": pa.array([f.type == fs.FileType.Directory for f in part], pa.bool_()),
                        "bytes": pa.array([f.size for f in part], pa.int64()),
                        "modified_us": pa.array([f.mtime_ns and f.mtime_ns // 1000 for f in part], pa.int64()),
                    })

    return folders.select("domain", "path").mapInArrow(run, _ENTRIES)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per archive file of each domain: ``domain, run, name, bytes, size_mb, mod_time, path``.

    A domain is a folder of the root, named by itself or as ``domain=<domain>``;
    its files lie in it or in its ``run=<run>`` folders, other folders in it are
    passed over. A domain without files is a row without a name, and so is the
    domain ``unsorted`` where it is missing. Files without bytes are listed,
    files in the root are not. One task names the folders of the root; they are
    dealt out, and so are the runs, whatever domain they belong to.
    """
    root = spark.createDataFrame([(None, path)], "domain STRING, path STRING")
    named = decoded(F.regexp_replace("name", "^domain=", ""))
    domains = materialized(_entries(root).filter("is_folder").select(named.alias("domain"), "path"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = materialized(_entries(domains.repartition(tasks, "path")))
    runs = inside.filter("is_folder AND startswith(name, 'run=')")
    below = _entries(runs.repartition(tasks, "path")).filter("NOT is_folder")
    run = F.regexp_extract("path", "/run=([^/]*)/[^/]*$", 1)
    files = inside.filter("NOT is_folder").unionByName(below).select(
        "domain", F.when(run != "", run).alias("run"), "name", "bytes", size_text(F.col("bytes")).alias("size_mb"),
        time_text(F.timestamp_micros("modified_us")).alias("mod_time"), "path",
    )
    every = domains.select("domain").unionByName(spark.range(1).select(F.lit(UNSORTED).alias("domain"))).distinct()
    return files.unionByName(not_seen(every, files, ["domain"]), allowMissingColumns=True)
