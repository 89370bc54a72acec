"""Fingerprints, byte-level BPE and packing against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from linkloom.llm import bpe, fingerprint, packing

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (5, "Ein Satz über Öl.\nUnd noch einer!  Zwei Leerzeichen"), (1, None), (2, ""), (9, "a" * 70_000), (3, "x"),
    (7, "don't  stop 　now é 🙂"), (7, "don't  stop 　now é 🙂"), (None, "no id here"), (4, "<|endoftext|> plain"),
]


def ordered(rows):
    return sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_fingerprints_against_plain_strings(documents):
    rows = ordered(TEXTS)
    got = [r.asDict() for r in fingerprint.fingerprints(documents(*TEXTS)).collect()]
    want = []
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1], strict=True):
        m = len(a) // 4
        edited = a[: len(a) - m] + b[:m]
        common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        want.append((i, len(a), hashlib.sha256(edited.encode()).hexdigest(), common(a, edited), common(a, b)))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(((g["doc_id"], g["n_chars"], g["edited_sha256"], g["lce_edited"], g["lce_next"]) for g in got), key=key) == sorted(want, key=key)
    assert all(0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1 for g in got)
    twice = {g["fingerprint"] for g in got if g["doc_id"] == 7}
    assert len(twice) == 1


def test_fingerprints_do_not_depend_on_the_ranges(spark, documents):
    rows = [(i, f"text number {i} " * (i % 7 + 1)) for i in range(60)]
    first = sorted(map(str, fingerprint.fingerprints(documents(*rows)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(str, fingerprint.fingerprints(documents(*rows)).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_likeness_follows_the_common_part():
    r = random.Random(3)
    a = "".join(r.choice("abcdefgh ") for _ in range(4000))
    of = lambda t: fingerprint.of(fingerprint.Prefixes(fingerprint.code_points(t)))
    assert fingerprint.likeness(of(a), of(a)) == 1
    assert fingerprint.likeness(of(a), of("zz" + a)) > 0.9  # moved spans still count
    assert fingerprint.likeness(of(a), of(a[:3000] + "".join(r.choice("mnop") for _ in range(1000)))) == pytest.approx(0.75, abs=0.12)
    assert fingerprint.likeness(of(a), of("".join(r.choice("mnop") for _ in range(4000)))) == 0
    assert fingerprint.likeness(of(""), of("")) == 1 and fingerprint.likeness(of(""), of("a")) == 0


def test_span_hashes_and_extensions():
    r = random.Random(1)
    text = "".join(r.choice("ab") for _ in range(300))
    p = fingerprint.Prefixes(fingerprint.code_points(text))
    for _ in range(300):
        i, j, n = r.randrange(290), r.randrange(290), r.randrange(1, 10)
        assert p.equal(i, p, j, n) == (text[i : i + n] == text[j : j + n])
        k = 0
        while max(i, j) + k < 300 and text[i + k] == text[j + k]:
            k += 1
        assert p.common_extension(i, p, j) == k


def test_bpe_equals_the_rank_library(documents):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}  # noqa: SIM115
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    rows = [*TEXTS, *((100 + k, "".join(r.choice("aeEtls' \n\té中🙂.,!?12 ") for _ in range(r.randrange(60)))) for k in range(400))]
    got = {(g["doc_id"], g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) for g in bpe.digest(documents(*rows), RANKS, public_tokenizers.PATTERN).collect()}
    want = set()
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want
    encoded = bpe.encode(documents(*TEXTS), RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(g["bytes"]) for g in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()) == sorted((t or "").encode() for _, t in TEXTS)


def test_bpe_of_mixed_white_space_equals_the_rank_library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}  # noqa: SIM115
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(11)
    texts = ["a \u00a0 \u00a0 b", "a \u00a0 \u00a0", "a\u00a0 ", "a\t \n b", " \u00a0 a", "one two  three   four", "a \u2003 \u2003 b c"]
    texts += ["".join(r.choice("ab'   \u00a0\u00a0\t\n\u3000\x1c\x85.1") for _ in range(r.randrange(40))) for _ in range(3000)]
    assert bpe.codec(RANKS, public_tokenizers.PATTERN).encode(texts) == [library.encode_ordinary(t) for t in texts]


def test_pieces_equal_the_tokenizer(documents):
    tool = Tokenizer.from_file(WORDS)
    tool.encode_special_tokens = True
    r = random.Random(6)
    rows = [*TEXTS, *((100 + k, "".join(r.choice("abcEe'stΣİ \n\té.,!?12 À") for _ in range(r.randrange(60)))) for k in range(400))]
    got = {(g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in packing.pieces(documents(*rows), WORDS).collect()}
    want = set()
    for i, text in rows:
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.add((i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert got == want


def test_stops_after_letters_that_do_not_compose():
    tool = Tokenizer.from_file(WORDS)
    tool.encode_special_tokens = True
    texts = ["\u09b9\u09df,", "\u0915\u095c,", "\u09b9\u09df. \u0915\u095c.", "\ufb2a\ufb35,", "caf\u00e9, cafe\u0301. \u0130."]
    got = packing.Encoder(WORDS).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tool.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_is_gapless_and_tight(documents, table):
    docs = table("documents").select("doc_id", "text")
    rows = packing.pack(docs, WORDS).toPandas()
    assert len(rows) == packing.pieces(docs, WORDS).count()
    for _, one in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert one["offset"].tolist() == [0, *one["length"].cumsum().tolist()[:-1]] and one["length"].sum() <= 2048
    assert rows["sequence_id"].nunique() <= 1.05 * rows["length"].sum() / 2048 + 1
    small = packing.pack(documents(*TEXTS), WORDS, capacity=64).toPandas()
    assert small.groupby("sequence_id")["length"].sum().max() <= 64


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_as_good_as_best_fit_of_single_pieces():
    r = random.Random(8)
    for _ in range(60):
        capacity = r.choice([10, 64, 100])
        lengths = [min(capacity, 1 + int(r.expovariate(1 / r.choice([3, 20, 50])))) for _ in range(r.randrange(1, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        planned = packing.plan(counts, capacity)
        placed = {}
        for copies, inside in planned:
            assert sum(n for n, _ in inside) <= capacity
            for n, _ in inside:
                placed[n] = placed.get(n, 0) + copies
        assert placed == counts
        assert sum(copies for copies, _ in planned) <= best_fit(lengths, capacity) + 1


def test_empty_tables(documents):
    none = documents()
    assert fingerprint.fingerprints(none).count() == bpe.digest(none, RANKS, public_tokenizers.PATTERN).count() == packing.pack(none, WORDS).count() == 0


def test_caches_stay_under_their_bounds_and_end_with_the_task(spark, documents, monkeypatch):
    import gc
    import random

    import pyarrow as pa
    import public_tokenizers

    r = random.Random(6)
    fresh = lambda n: " ".join("".join(r.choices("abcdefgh", k=9)) for _ in range(n))
    packer = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for module in (packing, bpe):
        monkeypatch.setattr(module, "CACHE_BYTES", 1 << 20)
    slice_bytes = 0
    for _ in range(12):
        text = fresh(4000)
        slice_bytes = max(slice_bytes, 4000 * 300)
        packer.encode([text])
        codec.encode([text])
        assert packer.held <= (1 << 20) + slice_bytes and max(codec.held) <= (1 << 20) + slice_bytes
    packer.forget()
    codec.forget()
    gc.collect()
    assert not packer.known and not codec.known and not codec.merged and packer.held == sum(codec.held) == 0
    path = "byte_bpe_50k.tiktoken"
    bpe.digest(documents(*((k, fresh(50)) for k in range(20))), public_tokenizers.path(path), public_tokenizers.PATTERN).collect()

    def left(batches):  # what a worker still holds in a later task
        tool = bpe.codec(public_tokenizers.path(path), public_tokenizers.PATTERN)
        for batch in batches:
            yield pa.record_batch({"n": pa.array([len(tool.known) + len(tool.merged)] * batch.num_rows, pa.int64())})

    assert {x["n"] for x in spark.range(40).repartition(4).mapInArrow(left, "n bigint").collect()} == {0}
