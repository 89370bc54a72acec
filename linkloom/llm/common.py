"""Helpers of the corpus operators: Arrow slices of bounded size, word hashes, sampling, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.session import materialized, scratch_path

#: Text bytes that a Python worker looks at in one go; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: What an entry of a dictionary takes besides its key and value.
ENTRY_BYTES = 100

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def strings(column: pa.Array) -> pa.Array:
    """Text column with nulls as empty texts."""
    return pc.fill_null(column.cast(pa.string()), "")


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by text bytes, so that memory follows the longest text and not the row count."""
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
            ends, start = np.cumsum(sizes, dtype=np.int64), 0
            while start < batch.num_rows:
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
                yield batch.slice(start, stop - start)
                start = stop
            batch = None
    finally:
        give_back()


def map_slices(
    docs: DataFrame, columns: list[str], work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
    at_end: Callable[[], None] | None = None, limit: int = SLICE_BYTES,
) -> DataFrame:
    """``work`` on every slice of the named columns, the last of them the text; ``at_end`` after a task's last slice."""

    def run(batches):
        try:
            for part in slices(batches, columns[-1], limit):
                out = work(part)
                if out is not None:
                    yield out
        finally:
            if at_end is not None:
                at_end()

    return docs.select(*columns).mapInArrow(run, schema)


def keep_rows(docs: DataFrame, text: str, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The documents for which ``keep`` holds, with all their columns and without a shuffle."""

    def run(batches):
        for part in slices(batches, text):
            yield part.filter(pa.array(keep(part)))

    return docs.mapInArrow(run, docs.schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to Parquet in the shared folder and read from there: cuts lineage as a checkpoint does.

    Columnar and compressed, so it suits wide rows and texts better.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Words:
    """Words of a slice of texts: maximal runs of 0-9, a-z and non-ASCII bytes after lower-casing.

    ``hash`` is a 64-bit hash per word, ``row`` its text, ``first``/``count``
    the words of each text. ``start`` and ``length`` locate a word in ``chars``.
    """

    POWERS = random_words(64, 7) | np.uint64(1)
    BYTES = random_words(256, 11)

    def __init__(self, column: pa.Array, ascii_only: bool = False):
        text = strings(column)
        low = pc.ascii_lower(text) if ascii_only else pc.utf8_lower(text)
        buffers = low.buffers()
        ends = np.frombuffer(buffers[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
        raw = np.frombuffer(buffers[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        inside = _WORD[raw]
        edge = np.empty(len(raw), bool)
        edge[:1] = True
        edge[1:] = ~inside[:-1]
        edge[ends[:-1][ends[:-1] < len(raw)]] = True
        places = np.flatnonzero(inside)
        self.chars = raw[places]
        self.start = np.flatnonzero(edge[places])
        n = len(places)
        self.length = np.diff(np.append(self.start, n))
        self.byte_at = places[self.start]
        bounds = np.searchsorted(self.byte_at, ends)
        self.first, self.count = bounds[:-1], np.diff(bounds)
        self.row = np.repeat(np.arange(len(low)), self.count)

    @cached_property
    def hash(self) -> np.ndarray:
        n = len(self.chars)
        at = np.arange(n) - np.repeat(self.start, self.length)
        values = Words.BYTES[self.chars] * self._powers(int(self.length.max(initial=0)))[at]
        return mix(np.add.reduceat(values, self.start) if n else np.zeros(0, np.uint64))

    @classmethod
    def _powers(cls, n: int) -> np.ndarray:
        """Factors of the first ``n`` bytes of a word; those of a very long word are not kept."""
        return cls.POWERS if n <= len(cls.POWERS) else random_words(n, 7) | np.uint64(1)


_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_hash(word: str) -> int:
    return int(Words(pa.array([word])).hash[0])


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _least(key: str, bounds: dict, label: str) -> Column:
    """Whether the hash of a row's key is at most the bound of its label."""
    bound = F.lit(None).cast("long")
    for value, most in bounds.items():
        bound = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(most)).otherwise(bound)
    return F.xxhash64(key) <= bound


def sample_rows(rows: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows of each label, those with the least hash of the key: the same rows at every run.

    ``rows`` has a row per key and label. The size of a label gives a hash below
    which there are little more rows than wanted; only these are ranked, so no
    task gets a whole label. Should they be too few after all, the bound is raised.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1))).collect()}
    room = {v: min(1.0, (per_label + 8 * per_label**0.5 + 16) / n) for v, n in sizes.items()}
    while True:
        bounds = {v: min((1 << 63) - 1, int(share * 2**64) - (1 << 63)) for v, share in room.items()}
        few = rows.filter(_least(key, bounds, label))
        short = [v for v, share in room.items() if share < 1]
        if short:
            found = {r[0]: r[1] for r in few.groupBy(label).agg(F.count(F.lit(1))).collect()}
            short = [v for v in short if found.get(v, 0) < per_label]
        if not short:
            break
        room |= {v: min(1.0, 2 * room[v]) for v in short}
    order = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    return few.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= per_label).drop("_nth")


def known_labels(labels: DataFrame, label: str, train: Column, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, label)`` with one row per document: label 1 if any of its rows says so."""
    known = labels.select(F.col(doc_id), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    return known.filter(train).groupBy(doc_id).agg(F.max("label").alias("label"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, per_label: int, max_bytes: int,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Bounded training sample ``(doc_id, label, text)``: ``per_label`` rows per label of texts up to ``max_bytes``.

    Of several texts under one id the smallest counts. The choice is made on
    narrow rows; texts join it last, under a broadcast of at most
    ``2 * per_label`` ids.
    """
    fit = train & (F.octet_length(text) <= max_bytes)
    ids = docs.filter(fit).select(doc_id).distinct()
    rows = materialized(known_labels(labels, label, train, doc_id).join(ids, doc_id))
    chosen = sample_rows(rows, doc_id, "label", per_label)
    bodies = docs.filter(fit).select(doc_id, text).join(F.broadcast(chosen.select(doc_id, "label")), doc_id)
    return bodies.groupBy(doc_id, "label").agg(F.min(text).alias(text))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic model with an intercept last, by Newton's method."""
    full = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(full.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        h = (full * (p * (1 - p))[:, None]).T @ full + ridge * np.eye(len(w))
        step = np.linalg.solve(h, full.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node of an edge list; the component is its smallest node.

    Large-star and small-star steps in turn until nothing changes. A step sends
    every edge once and its minimum is pre-aggregated, so a node with very many
    edges is no single group; adaptive execution splits its side of the join.
    Each round is checkpointed.
    """
    edges = materialized(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    known = _fingerprint(edges)
    while known[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        edges = materialized(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = _fingerprint(edges)
        if now == known:
            break
        known = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
