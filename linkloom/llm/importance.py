"""Resampling documents towards a target distribution, by hashed n-gram weights and an exact distributed cutoff."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Words, slices, stored
from linkloom.operators.ordered import numbered

BUCKETS = 10_000
SEED = 42
LEAST_WORDS = 20
PERCENT = 5

#: Bytes of a word that the tables cover; longer words go through zlib one by one.
_NEAR = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """``shift[n]`` moves a crc32 register past ``n`` zero bytes, a table per register byte; ``step[d, b]`` is byte b, d from the end."""
    base = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        base = np.where(base & 1, (base >> 1) ^ np.uint32(0xEDB88320), base >> 1)
    shift = np.empty((_NEAR, 4, 256), np.uint32)
    shift[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _NEAR):
        shift[n] = (shift[n - 1] >> np.uint32(8)) ^ base[shift[n - 1] & 255]
    step = np.empty((_NEAR, 256), np.uint32)
    step[0] = base
    for d in range(1, _NEAR):
        step[d] = (step[d - 1] >> np.uint32(8)) ^ base[step[d - 1] & 255]
    return shift, step


_SHIFT, _STEP = _tables()


#: crc32 of so many zero bytes.
_ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(_NEAR + 1)], np.uint32)
_SPACE = np.uint32(zlib.crc32(b" "))


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & 255]
    for byte in range(1, 4):
        out = out ^ table[byte][(crc >> np.uint32(8 * byte)) & 255]
    return out


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc32 registers moved past ``n`` zero bytes each, however many."""
    near, far = n % _NEAR, n // _NEAR
    out = _SHIFT[near, 0, crc & 255]
    for byte in range(1, 4):
        out = out ^ _SHIFT[near, byte, (crc >> np.uint32(8 * byte)) & 255]
    table = _SHIFT[_NEAR // 2]
    while far.any():
        table = _through(table, table)  # twice as far
        odd = np.flatnonzero(far & 1)
        out[odd] = _through(table, out[odd])
        far = far >> 1
    return out


def word_crcs(words: Words) -> np.ndarray:
    """crc32 of the bytes of every word."""
    short = words.length <= _NEAR
    near = np.repeat(short, words.length)
    size = words.length[short]
    out = np.zeros(len(words.start), np.uint32)
    if len(size):
        ends = np.cumsum(size)
        from_end = np.repeat(ends, size) - 1 - np.arange(int(ends[-1]))
        parts = _STEP[from_end, words.chars[near]]
        out[short] = np.bitwise_xor.reduceat(parts, ends - size) ^ _ZEROS[size]
    for i in np.flatnonzero(~short):
        out[i] = zlib.crc32(words.chars[words.start[i] : words.start[i] + words.length[i]])
    return out


def features(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every run of one to three words, repeats included.

    A run's crc32 follows from those of its words, as crc32(ab) is crc32(a)
    moved past the bytes of b, combined with crc32(b).
    """
    one, size, row = word_crcs(words), words.length, words.row
    spaced = shifted(one, np.ones(len(one), np.int64)) ^ _SPACE
    two = shifted(spaced[:-1], size[1:]) ^ one[1:]
    three = shifted(spaced[:-2], size[1:-1] + 1 + size[2:]) ^ two[1:]
    inside_two, inside_three = row[:-1] == row[1:], row[:-2] == row[2:]
    crc = np.concatenate([one, two[inside_two], three[inside_three]])
    return (crc % np.uint32(buckets)).astype(np.int64), np.concatenate([row, row[:-1][inside_two], row[:-2][inside_three]])


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket; a task sends one row per bucket."""

    def work(batches):
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, "text"):
            total += np.bincount(features(Words(part.column(0), ascii_only=True), buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(some, pa.int32()), "n": pa.array(total[some], pa.int64())})

    counts = docs.select(F.col(text).alias("text")).mapInArrow(work, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log ratio of the smoothed shares of each bucket in the target and in the source, rounded down."""
    buckets, in_source, in_target = len(source), float(source.sum()), float(target.sum())
    ratios = ((target + 1.0) * (in_source + buckets)) / ((source + 1.0) * (in_target + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios.tolist()], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """Gumbel noise of a document, in thousandths, from the hash of its id; a null id is an empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of every document; a null text has no words."""

    def work(batches):
        for part in slices(batches, text):
            words = Words(part.column(1), ascii_only=True)
            bucket, row = features(words, len(gain))
            by_row = np.argsort(row, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[bucket[by_row]])])
            ends = np.searchsorted(row[by_row], np.arange(part.num_rows), side="right")
            starts = np.append(0, ends[:-1])
            weight = sums[ends] - sums[starts]
            luck = np.array([noise(i, seed) for i in part.column(0).to_pylist()], np.int64)
            yield pa.record_batch({
                "doc_id": part.column(0), "n_words": pa.array(words.count, pa.int64()),
                "n_features": pa.array(ends - starts, pa.int64()), "weight": pa.array(weight, pa.int64()),
                "score": pa.array(weight + luck, pa.int64()),
            })

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(
        work, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint"
    )


#: A null id sorts last among equal scores.
_LAST = 2**63 - 1


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """Sort keys of a batch, best first in ascending order: negated score, then id."""
    out = np.empty(batch.num_rows, [("score", np.int64), ("id", np.int64)])
    out["score"] = -batch.column(0).to_numpy()
    out["id"] = batch.column(1).to_numpy()
    return out


def _round(candidates: DataFrame, pivot: tuple[int, int] | None) -> list:
    """Per partition: keys before, at and after the pivot, and the middle key of those before and of those after."""

    def work(batches):
        keys = np.concatenate([np.empty(0, [("score", np.int64), ("id", np.int64)]), *map(_keys, batches)])
        keys = keys[np.lexsort((keys["id"], keys["score"]))]
        at = np.array([pivot], keys.dtype)[0] if pivot else None
        first, last = (_place(keys, at, False), _place(keys, at, True)) if pivot else (0, 0)
        row = {"before": first, "same": last - first, "after": len(keys) - last}
        for name, side in (("low", keys[:first]), ("high", keys[last:])):
            middle = side[len(side) // 2].tolist() if len(side) else (None, None)
            row |= {f"{name}_score": middle[0], f"{name}_id": middle[1]}
        if len(keys):
            yield pa.record_batch({name: pa.array([value], pa.int64()) for name, value in row.items()})

    names = ("before", "same", "after", "low_score", "low_id", "high_score", "high_id")
    return candidates.mapInArrow(work, ", ".join(f"{n} bigint" for n in names)).collect()


def _place(keys: np.ndarray, key: np.void, after: bool) -> int:
    """Number of sorted keys before this one, or up to and including it."""
    a, b = (np.searchsorted(keys["score"], key["score"], side=s) for s in ("left", "right"))
    return int(a + np.searchsorted(keys["id"][a:b], key["id"], side="right" if after else "left"))


def _weighted_median(medians: list[tuple[tuple[int, int], int]]) -> tuple[int, int]:
    """The key at which the weights of the keys so far first reach half of all."""
    medians, total, run = sorted(medians), sum(n for _, n in medians), 0
    for key, n in medians:
        run += n
        if 2 * run >= total:
            return key
    raise ValueError("no medians")


def cutoff(rows: DataFrame, k: int) -> tuple[int, int] | None:
    """``(-score, id)`` of the ``k``-th best row of ``(score, id)``, exactly; None where there are fewer rows.

    Each partition names the middle of its remaining keys; the median of these,
    weighted by how many remain, has at least a quarter of all on either side,
    so every round discards that share or ends. The driver sees one row per
    partition and round. Rows outside the remaining range are filtered in the scan.
    """
    low = high = pivot = None
    taken = 0
    while True:
        remaining = rows
        if low:
            remaining = remaining.filter((F.col("score") < -low[0]) | ((F.col("score") == -low[0]) & (F.col("id") > low[1])))
        if high:
            remaining = remaining.filter((F.col("score") > -high[0]) | ((F.col("score") == -high[0]) & (F.col("id") < high[1])))
        parts = _round(remaining, pivot)
        before, same = sum(r["before"] for r in parts), sum(r["same"] for r in parts)
        if pivot and taken + before < k <= taken + before + same:
            return pivot
        if pivot and k <= taken + before:
            high, side, count = pivot, "low", "before"
        else:
            low, side, count = pivot, "high", "after"
            taken += before + same
        medians = [((r[f"{side}_score"], r[f"{side}_id"]), r[count]) for r in parts if r[count]]
        if not medians:
            return None
        pivot = _weighted_median(medians)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document; ``rank`` numbers the drawn ones, best first.

    Of the documents with at least ``least_words`` words, ``percent`` in a
    hundred are drawn, rounded down, by score and then by smaller id. A null or
    empty text has no features and is never drawn. Repeated rows are rows of
    their own and share a score; at the cutoff as many are drawn as fit. Ids are
    integers, a null one sorts last. An empty table gives no rows. Other columns
    are ignored, whatever their names.

    Texts are read twice: for the counts of the buckets, of which one row per
    bucket and task leaves a task, and for the scores, which are kept as a
    narrow table. The cutoff is found on that table without a sort; only the
    drawn rows are sorted.
    """
    gain = gains(bucket_counts(docs, buckets, text), bucket_counts(target, buckets, target_text))
    rows = stored(scored(docs, gain, seed, doc_id, text), "scored")
    fit = rows.filter(F.col("n_words") >= least_words)
    draw = percent * fit.count() // 100
    key = fit.select("score", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"))
    edge = cutoff(key, draw) if draw else None
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if edge is None:
        return rows.select(*columns, none)
    score, last = -edge[0], edge[1]
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    drawn = (F.col("n_words") >= least_words) & ((F.col("score") > score) | ((F.col("score") == score) & (at <= last)))
    ranked = numbered(rows.filter(drawn).select(*columns, at.alias("_at")), [F.desc("score"), F.asc("_at")], "rank", "_total")
    rank = F.when(F.col("rank") <= draw, F.col("rank").cast("long"))
    return ranked.select(*columns, rank.alias("rank")).unionByName(rows.filter(~drawn).select(*columns, none))
