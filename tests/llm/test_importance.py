from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm import importance
from linkloom.llm.common import Words
from linkloom.llm.queries import op12_importance_resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets_of(text):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, percent=5):
    """The whole draw by the formulas alone."""
    source, wanted = Counter(), Counter()
    for _, t in docs:
        source.update(buckets_of(t))
    for t in target:
        wanted.update(buckets_of(t))
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((source[b] + 1) * (t + 10000)))) for b in range(10000)]
    rows, fit = [], []
    for doc, text in docs:
        found = buckets_of(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(found), weight, score, None])
        if len(words_of(text)) >= 20:
            fit.append(rows[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(fit[: percent * len(fit) // 100]):
        row[4] = rank + 1
    return sorted(map(tuple, rows), key=repr)


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["", "É", "中文", "w" * 70, "Q"]) + f"{i}" for i in range(80)]
    return [rng.choice([" ", ", "]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 19, 20, 60]))) for _ in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_buckets_equal_crc32_of_the_joined_words():
    rng = random.Random(5)
    some = ["".join(rng.choices("aB9 ñ中-", k=rng.choice([0, 3, 500]))) for _ in range(60)] + [None, "a" * 1000 + " " + "é" * 64, "b" * 64, "c" * 65]
    bucket, row = importance.features(Words(pa.array(some, pa.string()), ascii_only=True))
    for i, text in enumerate(some):
        assert sorted(bucket[row == i].tolist()) == sorted(buckets_of(text))


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_draw_equals_a_plain_one(spark, documents, percent):
    docs = list(enumerate(texts(400, 1))) + [(900, None), (901, ""), (None, " ".join("abc" for _ in range(30)))]
    docs += [(1000 + i, docs[5][1]) for i in range(50)]
    target = spark.createDataFrame([(t, 1) for t in [*texts(20, 2), None, ""]], "text STRING, rank INT")
    got = importance.resample(documents(*docs).repartition(5), target, percent)
    assert rows_of(got) == plain(docs, [r["text"] for r in target.collect()], percent)


def test_empty_small_and_repeated_tables(spark, documents):
    target = spark.createDataFrame([("some words of a target",)], "text STRING")
    empty = importance.resample(documents(), target)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(importance.resample(documents((1, "few words"), (2, None)), target)) == plain([(1, "few words"), (2, None)], ["some words of a target"])
    same = [(7, " ".join(f"w{i}" for i in range(25)))] * 40
    ranks = [r["rank"] for r in importance.resample(documents(*same), target, 10).collect()]
    assert sorted(r for r in ranks if r) == [1, 2, 3, 4] and len(ranks) == 40  # as many as fit, each with its own rank
    no_target = spark.createDataFrame([], "text STRING")
    docs = list(enumerate(texts(50, 4)))
    assert rows_of(importance.resample(documents(*docs), no_target)) == plain(docs, [])


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_cutoff_is_the_exact_key(spark, partitions):
    rng = np.random.default_rng(9)
    score = rng.integers(-50, 50, 3000)  # many ties
    score[:1000] = 3
    pairs = [(int(s), int(i)) for i, s in enumerate(score)]
    rows = spark.createDataFrame(pairs, "score BIGINT, id BIGINT").repartition(partitions).cache()
    ordered = sorted((-s, i) for s, i in pairs)
    for k in (1, 2, 999, 1500, 3000):
        assert importance.cutoff(rows, k) == ordered[k - 1]
    assert importance.cutoff(rows, 3001) is None
    assert importance.cutoff(rows.filter(F.lit(False)), 1) is None


def test_query_equals_a_plain_draw_on_the_given_tables(spark, table):
    docs = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    target = [r["text"] for r in table("benchmark").collect()]
    assert rows_of(op12_importance_resampling(spark, "/root/testdata/sf0.001")) == plain(docs, target)
