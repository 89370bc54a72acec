from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from linkloom.llm import lexical
from linkloom.llm.queries import op11_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    """Scores of all documents for all items, by the formulas alone."""
    terms = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n, length = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        found = []
        wanted = TERM.findall((text or "").translate(LOWER))
        for doc, c in terms:
            m = 100 - 75 + (75 * sum(c.values()) * n) // length
            score = 0
            for t in wanted:
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        found.sort()
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(found[:k])]
    return sorted(out, key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice(['Ab', 'ñ', 'z', 'É', '9'])}{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 20, 200]))) + rng.choice(["", ".", "\n\t-"]) for _ in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("postings", [50, 400_000])
def test_ranks_equal_plain_scores(spark, documents, monkeypatch, postings):
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    docs = list(enumerate(texts(300, 1))) + [(900, None), (901, ""), (902, " .,-"), (None, "ñ1 z2 ab3"), (1000, "x" * 3000)]
    docs += [(2000 + i, docs[7][1]) for i in range(40)]  # copies: equal scores go to smaller ids
    items = list(enumerate(texts(25, 2))) + [(50, None), (51, ""), (52, "unheardof"), (53, "ab0 AB0 ab0"), (54, "x" * 3000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id BIGINT, text STRING, rank INT")
    assert rows_of(lexical.search(documents(*docs).repartition(3), frame)) == plain(docs, items)


def test_repeated_and_empty_tables(spark, documents, monkeypatch):
    schema = "item_id BIGINT, text STRING"
    docs = documents((1, "a b"), (1, "a b"), (2, "a"))
    twice = spark.createDataFrame([(1, "b"), (1, "b"), (2, "a"), (None, "b")], schema)
    got = rows_of(lexical.search(docs, twice))
    assert got == sorted(
        [r for i in (1, None) for r in plain([(1, "a b"), (1, "a b"), (2, "a")], [(i, "b")])]
        + plain([(1, "a b"), (1, "a b"), (2, "a")], [(2, "a")]), key=repr,
    )
    none = spark.createDataFrame([], schema)
    assert lexical.search(docs, none).collect() == [] and lexical.search(docs, none).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(documents(), twice).collect() == []
    assert lexical.search(documents((1, None)), twice).collect() == []
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 1)  # items in several blocks
    assert rows_of(lexical.search(docs, twice)) == got


def test_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(3)
    n = 4000
    sizes = np.full(n, 3)
    term = np.tile(np.arange(3), n)
    count = rng.integers(1, 4, 3 * n)
    count[:30] = 400  # ten documents stand out
    shard = lexical.Shard(np.full(n, 50), sizes, term, count, n, 50 * n)
    weights = np.array([700, 300, 200])
    scores = shard.scores(np.arange(n), weights)
    found, best, scored = lexical.best_positions(shard, np.arange(3), weights, weights, 10, 0, np.arange(n))
    assert best.tolist() == sorted(scores.tolist(), reverse=True)[:10] and set(found.tolist()) == set(range(10))
    assert scored < n / 10
    # A bound of earlier shards that nothing here reaches ends the search at once.
    assert lexical.best_positions(shard, np.arange(3), weights, weights, 10, int(best[0]) * 10, np.arange(n))[2] == 0


def test_query_equals_plain_scores_on_the_given_tables(spark, table):
    docs = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table("benchmark").collect()]
    assert rows_of(op11_lexical_search(spark, "/root/testdata/sf0.001")) == plain(docs, items)
