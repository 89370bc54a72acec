"""Ranked lexical search: impact lists per shard of documents, stopped by best positions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import Words, slices, stored

#: Distinct (item, term) pairs that are searched in one go; the vocabulary of a block is at most as large.
BLOCK_TERMS = 200_000
#: Postings of a shard, the unit that a task holds in memory; a longer document is a shard of its own.
SHARD_POSTINGS = 400_000
#: Places read from each list in the first step; every further step reads twice as many.
FIRST_READ = 4

_POSTINGS = "n bigint, terms array<int>, counts array<int>"


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, term, repeats)``: terms of the items; rows that repeat an item wholly count once.

    Several texts under one id are searched as one. A null id is an item like others.
    """

    def work(batches):
        for part in slices(batches, text):
            words = Words(part.column(1), ascii_only=True)
            ends = words.start + words.length
            raw = words.chars.tobytes()
            terms = [raw[a:b].decode() for a, b in zip(words.start.tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch({
                "item_id": part.column(0).take(pa.array(words.row)), "term": pa.array(terms, pa.string()),
            })

    kind = items.schema[item_id].dataType.simpleString()
    rows = items.select(item_id, text).distinct().mapInArrow(work, f"item_id {kind}, term string")
    return rows.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def postings(docs: DataFrame, vocabulary: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, terms, counts)`` of documents with a term: numbers of the vocabulary's terms and how often each occurs.

    ``n`` counts all terms of the whole text. Terms are told apart by 64-bit
    hashes; the vocabulary is not empty.
    """
    hashes = Words(pa.array(["\n".join(vocabulary)], pa.string()), ascii_only=True).hash
    by_hash = np.argsort(hashes)
    shared = docs.sparkSession.sparkContext.broadcast((hashes[by_hash], by_hash.astype(np.int32)))

    def work(batches):
        known, number = shared.value
        for part in slices(batches, text):
            words = Words(part.column(1), ascii_only=True)
            at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
            hit = np.flatnonzero(known[at] == words.hash)
            key, counts = np.unique(words.row[hit] * len(known) + number[at[hit]], return_counts=True)
            row, term = key // len(known), key % len(known)
            some = np.flatnonzero(words.count)
            ends = np.searchsorted(row, some, side="right")
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.record_batch({
                "doc_id": part.column(0).take(pa.array(some)), "n": pa.array(words.count[some], pa.int64()),
                "terms": pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                "counts": pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
            })

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(work, f"doc_id {kind}, {_POSTINGS}")


class Shard:
    """Impact lists of some documents: per term its documents by falling impact, and per document its terms."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, count: np.ndarray, documents: int, length: int):
        spread = 25 + (75 * n * documents) // length
        self.doc = np.repeat(np.arange(len(n)), sizes)
        count = count.astype(np.int64)
        self.term, self.impact = term, (1_000_000_000 * count) // (1000 * count + 8 * spread[self.doc])
        self.first, self.size = np.cumsum(sizes) - sizes, sizes
        self.order = np.lexsort((-self.impact, term))
        self.terms, self.start = np.unique(term[self.order], return_index=True)
        self.end = np.append(self.start[1:], len(term))

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of these terms, list by list, and the number of each one's list."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = np.flatnonzero(self.terms[at] == terms)
        start = self.start[at[there]]
        size = self.end[at[there]] - start
        return self.order[_ranges(start, size)], np.repeat(there, size)

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Whole scores of documents, by direct access to all their terms."""
        size = self.size[docs]
        at = _ranges(self.first[docs], size)
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], np.cumsum(size) - size)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of every range, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def best_positions(
    shard: Shard, terms: np.ndarray, weights: np.ndarray, weight: np.ndarray, k: int, least: int, rank: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of the shard that can be among the best ``k``, their scores, and how many were scored.

    Every step reads each list on from its best position, the end of the places
    seen without a gap, and scores what it finds by direct access. A document
    seen through one list counts as seen in all, so best positions run ahead of
    what was read. No unseen document scores more than the sum of the next
    unseen impacts; the search ends when this is strictly below the ``k``-th
    score, ``least`` (of earlier shards) or the shard's own.
    """
    at, number = shard.lists(terms)
    doc, value = shard.doc[at], shard.impact[at] * weights[number]
    seen = np.zeros(len(shard.size), bool)
    best_doc, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    step, scored = FIRST_READ, 0
    while len(doc):
        head = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        if value[head].sum() < least:
            break
        size = np.diff(np.append(head, len(doc)))
        fresh = np.unique(doc[_ranges(head, np.minimum(size, step))])
        score = shard.scores(fresh, weight)
        scored += len(fresh)
        seen[fresh] = True
        good = np.flatnonzero(score >= max(least, 1))
        best_doc, best_score = np.append(best_doc, fresh[good]), np.append(best_score, score[good])
        order = np.lexsort((rank[best_doc], -best_score))[:k]
        best_doc, best_score = best_doc[order], best_score[order]
        if len(best_doc) == k:
            least = max(least, int(best_score[-1]))
        left = ~seen[doc]
        doc, value, number = doc[left], value[left], number[left]
        step *= 2
    return best_doc, best_score, scored


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, start = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + SHARD_POSTINGS, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _place(found: tuple) -> tuple:
    """Order of ``(score, id)``: higher scores first, then smaller ids, a null id last."""
    return -found[0], found[1] is None, 0 if found[1] is None else found[1]


def _search_block(
    rows: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], vocabulary: int, documents: int, length: int, k: int
) -> DataFrame:
    """``(query, doc_id, score)``: the best ``k`` documents per query and task."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def work(batches):
        best: list[list[tuple]] = [[] for _ in shared.value]
        weight, kind = np.zeros(vocabulary, np.int64), pa.null()
        for part in _shards(batches):
            ids, lists = part.column(0), part.column(2)
            kind = ids.type
            if not len(lists.flatten()):
                continue
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            terms, counts = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()
            shard = Shard(part.column(1).to_numpy(), sizes, terms, counts, documents, length)
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            for query, (terms, weights) in enumerate(shared.value):
                kept = best[query]
                weight[terms] = weights
                found, scores, _ = best_positions(
                    shard, terms, weights, weight, k, kept[-1][0] if len(kept) == k else 0, rank
                )
                weight[terms] = 0
                if len(found):
                    named = zip(scores.tolist(), ids.take(pa.array(found)).to_pylist(), strict=True)
                    best[query] = sorted([*kept, *named], key=_place)[:k]
        out = [(query, doc, score) for query, found in enumerate(best) for score, doc in found]
        if out:
            query, doc, score = zip(*out, strict=True)
            yield pa.record_batch({
                "query": pa.array(query, pa.int32()), "doc_id": pa.array(doc, kind), "score": pa.array(score, pa.int64()),
            })

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"query int, doc_id {kind}, score bigint")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item, ranks from 1.

    Equal scores go to smaller ids, a null id last. Documents that score 0 are
    not ranked, so an item may have fewer rows, or none: null and empty texts
    have no terms. Repeated rows of documents are documents of their own. Other
    columns are ignored, whatever their names.

    Items are worked through in blocks of ``BLOCK_TERMS`` distinct terms, which
    bounds what is broadcast; one item with more is a block alone. Per block
    the documents are read once and their postings of the block's terms kept as
    a table. Every task holds one shard of postings and the best documents so
    far; only the latter leave it.
    """
    spark = docs.sparkSession
    wanted = stored(item_terms(items, item_id, item_text), "items")
    blocks = -(-wanted.count() // BLOCK_TERMS)
    schema = f"query int, item_id {wanted.schema['item_id'].dataType.simpleString()}"
    kind, found = docs.schema[doc_id].dataType.simpleString(), None
    for block in range(blocks):
        pairs = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        vocabulary = sorted({r["term"] for r in pairs})
        if not vocabulary:
            continue
        number = {term: i for i, term in enumerate(vocabulary)}
        rows = stored(postings(docs, vocabulary, doc_id, text), "postings")
        documents, length = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not documents:
            break
        holding = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, df in holding}
        by_item: dict = {}
        for r in pairs:
            if weight.get(number[r["term"]]):
                by_item.setdefault(r["item_id"], []).append((number[r["term"]], r["repeats"] * weight[number[r["term"]]]))
        queries = [tuple(np.array(sorted(of)).T) for of in by_item.values()]
        if not queries:
            continue
        best = _search_block(rows, queries, len(vocabulary), documents, length, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(by_item)), schema)
        part = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"{schema.split(', ')[1]}, rank int, doc_id {kind}, score bigint")
    return found
