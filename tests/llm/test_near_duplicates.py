"""MinHash and embedding near-duplicates against all pairs; components; the pipeline."""

from __future__ import annotations

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import hnsw, minhash
from linkloom.llm.common import components


def closure(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a BIGINT, b BIGINT")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = closure({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k != v or any(k in e and e[0] != e[1] for e in edges)}
    assert components(df.limit(0)).count() == 0


def brute_groups(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    idf = minhash.frequent(docs)
    row, shingle, count = minhash.shingles(pa.array([t for _, t in rows], pa.string()))
    weight = idf.weights(shingle, count)
    bounds = np.searchsorted(row, np.arange(len(rows) + 1))
    sets = [(shingle[a:b], weight[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    holders = defaultdict(list)
    for k, (s, _) in enumerate(sets):
        for x in s.tolist():
            holders[x].append(k)
    pairs = {(i, j) for h in holders.values() for i in h for j in h if i < j}
    links = [(rows[i][0], rows[j][0]) for i, j in pairs if minhash.similarity(sets[i], sets[j]) >= minhash.THRESHOLD]
    return closure([i for i, _ in rows], links)


def test_groups_equal_all_pairs(table):
    docs = table("documents", "0.01").select("doc_id", "text")
    got = {r["doc_id"]: r["component_id"] for r in minhash.groups(docs).collect()}
    want = brute_groups(docs)
    assert np.mean([got[k] == want[k] for k in want]) >= 0.995 and set(got) == set(want)


def test_chain_of_edits_and_odd_rows(documents):
    r = random.Random(9)
    words = [f"w{r.randrange(10_000)}" for _ in range(400)]
    rows, now = [], list(words)
    for k in range(30):  # neighbours are near, the ends are not
        rows.append((k, " ".join(now)))
        for _ in range(3):
            now[r.randrange(400)] = f"n{r.randrange(10_000)}"
    rows += [(100, None), (101, ""), (102, "!!!"), (103, "!!!"), (104, "one two"), (105, "One, two"), (None, "one two"), (104, "one two")]
    got = minhash.groups(documents(*rows)).collect()
    by = {g["doc_id"]: g for g in got}
    assert len(got) == len(rows) and all(by[k]["component_id"] == 0 for k in range(30))
    assert all(by[k]["kept"] for k in (100, 101, 102, 103)) and by[105]["component_id"] == 104 and not by[105]["kept"]
    assert by[None]["kept"] and by[None]["component_id"] is None
    kept = minhash.deduplicated(documents(*rows))
    assert kept.columns == documents().columns and {k["doc_id"] for k in kept.collect()} == {0, 100, 101, 102, 103, 104, None}
    assert minhash.groups(documents()).count() == 0


def test_samples_estimate_the_similarity():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 44, 3000).astype(np.uint64)
    for share in (0.3, 0.6, 0.9):
        n = int(3000 * 2 * share / (1 + share))
        other = np.concatenate([base[:n], r.integers(0, 1 << 44, 3000 - n).astype(np.uint64)])
        drawn = []
        for s in (base, other):
            s = np.sort(s)
            drawn.append(minhash.samples(np.zeros(len(s), np.int64), s, np.full(len(s), 2.5)))
        assert (drawn[0] == drawn[1]).mean() == pytest.approx(share, abs=0.25)


def test_frequent_shingles_are_counted_exactly(documents):
    rows = [(k, f"a common passage of words here and then unique{k} tail{k} end{k}") for k in range(300)]
    idf = minhash.frequent(documents(*rows))
    assert idf.documents == 300 and len(idf.shingle) >= 4 and set(idf.count.tolist()) == {300}


def test_copies_do_not_devalue_their_shingles(documents):
    r = random.Random(12)
    text = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    hot, warm = text(100), text(60)
    near, other = [*hot[:50], "changed", *hot[51:]], [*warm[:30], "changed", *warm[31:]]
    rows = [(k, " ".join(hot)) for k in range(100)] + [(200, " ".join(near))] + [(300 + k, " ".join(warm)) for k in range(12)]
    rows += [(400, " ".join(other))] + [(500 + k, " ".join(text(80))) for k in range(187)] + [(0, " ".join(hot))] * 40
    by = {g["doc_id"]: g["component_id"] for g in minhash.groups(documents(*rows)).collect()}
    assert by[99] == by[200] == 0 and by[400] == 300 and by[500] == 500
    idf = minhash.frequent(documents(*rows))
    assert idf.documents == 191 and idf.count.max(initial=0) == 2


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, n INT, component STRING")


def test_embedding_links_equal_all_pairs(spark):
    r = np.random.default_rng(3)
    centre = r.normal(size=(40, 16))
    x = [*r.normal(size=(800, 16)), *(c + 0.12 * r.normal(size=16) for c in centre for _ in range(12)), *([centre[0]] * 30)]
    rows = [(k, v.astype(float).tolist(), 0, "") for k, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, None] + [0.0] * 14), (5004, [1.0]), (5005, []), (5006, [float("inf")] * 16)]
    got = {g["vec_id"]: g for g in hnsw.near_duplicates(vectors(spark, rows + [(i, v, 0, "") for i, v in odd])).collect()}
    single = np.asarray([v for _, v, *_ in rows], np.float32).astype(float)
    unit = single / np.linalg.norm(single, axis=1)[:, None]
    near = unit @ unit.T >= hnsw.THRESHOLD
    np.fill_diagonal(near, False)
    want = closure(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(near)])
    found = sum(got[k]["n_links"] for k in want)
    assert 0.99 * near.sum() <= found <= near.sum() and all(got[k]["n_links"] <= near[k].sum() for k in want)
    assert np.mean([got[k]["component_id"] == want[k] for k in want]) > 0.99
    for i, _ in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_graph_search_recalls_tight_groups():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(2500, 32)), np.repeat(r.normal(size=(6, 32)), 100, axis=0) + 0.05 * r.normal(size=(600, 32))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    graph = hnsw.Graph(unit, np.arange(len(unit)))
    assert len(graph.layers) > 1
    pairs = sum(len(a) for a, _ in graph.links(unit, 0.9))
    true = (unit @ unit.T >= 0.9).sum()
    assert 0.99 * true <= pairs <= true


def hot_group(n, hot, dimension, spread):
    r = np.random.default_rng(7)
    x = r.normal(size=(n, dimension))
    x[: n // 2] = x[n // 2 : 2 * (n // 2)] + 0.05 * r.normal(size=(n // 2, dimension))  # pairs
    x = np.concatenate([x, np.ones(dimension) + spread * r.normal(size=(hot, dimension))])
    x = r.permutation(x)
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_audit_does_not_pool_searches():
    unit = hot_group(3000, 1500, 32, 0.1)
    graph = hnsw.Graph(unit, np.arange(len(unit)))
    true = (unit @ unit.T >= 0.9).sum(1)
    search = graph.search

    def poor(query, beam):  # finds nothing outside the hot group with the first beam
        found, score = search(query, beam)
        cold = query @ np.ones(32) < 0.9 * 32**0.5
        if beam <= hnsw.BEAM:
            found[cold], score[cold] = -1, -2
        return found, score

    graph.search = poor
    got = sum(np.bincount(line, minlength=len(unit)) for line, _ in graph.links(unit, 0.9))
    assert (got <= true).all() and np.mean(got == true) > 0.99


@pytest.mark.parametrize("spread", [0.1, 0.28])  # around one leader, and all of them leaders
def test_hot_groups_are_verified_in_bounded_memory(spread):
    unit = hot_group(3000, 3000, 64, spread)
    ids = np.arange(len(unit))
    graph = hnsw.Graph(unit, ids)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    part = pa.record_batch({"id": pa.array(ids), "v": pa.array(list(unit), pa.list_(pa.float64()))})
    tracemalloc.start()
    got = pa.Table.from_batches(hnsw._found(graph, np.ones(len(unit), int), part, 0.9)).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    counts, edges = got[got["b"].isna()].set_index("a")["n"], got[got["b"].notna()]
    assert np.mean([counts.get(k, 0) == n for k, n in enumerate(near.sum(1))]) > 0.99
    want, last = ids, None
    while last is None or (want != last).any():
        want, last = np.minimum(want, np.where(near, want, len(ids)).min(1)), want
    have = closure(ids.tolist(), [(int(a), int(b)) for a, b in zip(edges["a"], edges["b"], strict=True)])
    assert len(edges) < len(unit) and np.mean([have[k] == want[k] for k in ids]) > 0.99


def test_no_vectors(spark):
    assert hnsw.near_duplicates(vectors(spark, [])).count() == 0
    assert [g["kept"] for g in hnsw.near_duplicates(vectors(spark, [(None, [1.0, 2.0], 0, ""), (None, None, 0, "")])).collect()] == [True, True]


def plain_links(rows):
    """Links and component of every row, from all pairs; equal ids are one node."""
    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or not a:
            return -1
        a, b = np.asarray(a, float), np.asarray(b, float)
        return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if np.linalg.norm(a) and np.linalg.norm(b) else -1

    single = [(i, None if v is None else np.asarray(v, np.float32).astype(float).tolist()) for i, v in rows]
    links = [[k for k, (_, w) in enumerate(single) if k != j and cosine(v, w) >= hnsw.THRESHOLD] for j, (_, v) in enumerate(single)]
    near = closure([i for i, _ in rows], [(rows[j][0], rows[k][0]) for j, ks in enumerate(links) for k in ks])
    return sorted((i, len(ks), near[i], near[i] == i) for (i, _), ks in zip(rows, links, strict=True))


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_small_tables_equal_all_pairs(spark, partitions):
    r = np.random.default_rng(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for n in (1, 2, 3, 8, 60, 130):
            x = [np.ones(6) + 0.05 * r.normal(size=6) for _ in range(n // 2)] + [r.normal(size=6) for _ in range(n - n // 2)]
            rows = [(11 * k, v.tolist()) for k, v in enumerate(x)]
            got = hnsw.near_duplicates(vectors(spark, [(i, v, 0, "") for i, v in rows])).collect()
            assert sorted(tuple(g) for g in got) == plain_links(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_other_dimensions_and_repeated_ids_equal_all_pairs(spark):
    r = np.random.default_rng(12)
    rows = [(k, (np.ones(8) + 0.1 * r.normal(size=8)).tolist()) for k in range(80)]
    rows += [(100 + k, r.normal(size=8).tolist()) for k in range(40)]
    rows += [(200 + k, [1.0, 2.0, 3.0 + 0.1 * k]) for k in range(5)] + [(300, [4.0]), (301, [-4.0]), (302, [8.0])]
    rows += [(100, r.normal(size=8).tolist()), (101, rows[0][1]), (102, rows[82][1]), (102, rows[82][1]), (300, [1.0, 2.0, 3.0])]
    got = hnsw.near_duplicates(vectors(spark, [(i, v, 0, "") for i, v in rows])).collect()
    assert sorted(tuple(g) for g in got) == plain_links(rows)


def test_pipeline_stages(spark, table):
    docs = table("documents", "0.01")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "MinHash near-dedup", "best-fit packing"]
    ids = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.01")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = docs.cache()
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert 1000 >= len(ids[0]) > len(ids[1]) > len(ids[2]) and ids[0] >= ids[1] >= ids[2]
    want = brute_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id IN (" + ",".join(map(str, ids[1])) + ")"))
    assert len(ids[2] ^ {i for i in want if want[i] == i}) <= 3
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.01").select("doc_id").distinct()
    assert {r["doc_id"] for r in packed.collect()} == ids[2]


def test_pipeline_stages_on_odd_and_empty_tables(spark, documents, tmp_path):
    folder = str(tmp_path)
    words = ["the of and a in is it you that he was for on are with".split(), "der die und in den von zu das mit sich des auf".split()]
    rows = [(k, " ".join(words[k % 2][(k * 7 + j * (1 + k % 5)) % 12] for j in range(30)), ("en", "de")[k % 2]) for k in range(200)]
    odd = [(500, None), (501, ""), (502, "123 ... !!"), (None, rows[0][1]), (3, rows[3][1], "de"), (3, rows[3][1], "de"), (503, "the of and " * 30_000, "en")]
    spark.createDataFrame([(k, 1, 0) for k in range(100)] + [(5, 0, 0)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{folder}/labels.parquet")
    docs = documents(*rows, *odd)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{len(counts)}")
        docs = spark.read.parquet(f"{folder}/{len(counts)}")
        counts.append(docs.count())
        if name == "language ID":
            ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
            assert not {500, 501, 502} & set(ids) and ids.count(3) == 3 and ids.count(None) == 1 and 503 in ids
        if name == "MinHash near-dedup":
            ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
            assert None in ids and ids.count(3) in (0, 3)
    assert counts[0] >= counts[1] >= counts[2] > 0 and docs.filter("doc_id = 503").agg(F.sum("length")).first()[0] > 90_000
    empty = documents()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
