"""Features, gains, weights and the sample against plain counting."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
import pytest

from tempora.llm import importance as I

from . import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target):
    """(id, n_features, n_words, weight) of each row."""
    bucket = lambda g: crc32(g.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    return [(i, len(f), len(w), sum(gain(bucket(g)) for g in f)) for i, text in rows for w, f in [features(text)]]


def corpus():
    rng = random.Random(7)
    rows = [(r[0], r[1]) for r in cases.documents(7)]
    rows += [(5000 + i, t) for i, t in enumerate(["A-B_c 1,2;3", "ÉÈ é日本 x", "one", "Two words", "a" * 5000 + " b", "\x00a\x01b c", "w " * 3000, "x y x y x y x"])]
    rows += [(6000, "the same text of a hot row")] * 30
    target = [" ".join(cases.words(rng, 60)) for _ in range(5)] + [None, "", rows[3][1], "Two words x y"]
    return rows, target


def test_checksums():
    rng = random.Random(1)
    strings = [rng.randbytes(rng.randrange(40)) for _ in range(500)] + [b"", b"x" * 3000]
    assert I.crc32s(pa.array(strings)).tolist() == [crc32(x) for x in strings]
    assert I.crc32s(pa.array([], pa.binary())).tolist() == []


@pytest.mark.parametrize(("block", "shard"), [(6 << 20, 24 << 20), (700, 3000)])
def test_weights_are_those_of_counting(spark, block, shard):
    rows, target = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS weight", "1 AS n", "2 AS block")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = I.importance_weights(docs, wanted, block_bytes=block, shard_bytes=shard)
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows, target))


def drawn(weights, percent=5):
    score = {}
    for k, (i, _, _, w) in enumerate(weights):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score[k] = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
    enough = [k for k, r in enumerate(weights) if r[2] >= 20]
    by = sorted(enough, key=lambda k: (-score[k], weights[k][0] is None, weights[k][0] or 0, weights[k][3], weights[k][1]))
    rank = {k: n + 1 for n, k in enumerate(by[: len(enough) * percent // 100])}
    return [(*r, score[k], rank.get(k)) for k, r in enumerate(weights)]


@pytest.mark.parametrize("percent", [5, 50, 100, 0])
def test_the_sample(spark, percent):
    rng = random.Random(5)
    weights = [(rng.choice([i, i // 2, None if i % 50 == 0 else i]), 3, rng.choice([3, 19, 20, 500]), rng.randrange(-900, 900)) for i in range(900)]
    df = spark.createDataFrame(weights, "doc_id long, n_features long, n_words long, weight long")
    got = I.resample(df, percent=percent).select("doc_id", "n_features", "n_words", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == Counter(drawn(weights, percent))


def test_ranks_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(I, "RANGE_ROWS", 40)
    weights = [(i, 1, 30, i % 7) for i in range(500)] + [(3, 1, 30, 3)] * 5
    df = spark.createDataFrame(weights, "doc_id long, n_features long, n_words long, weight long")
    got = I.resample(df, percent=60).select("doc_id", "n_features", "n_words", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == Counter(drawn(weights, 60))


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    assert I.resample(I.importance_weights(docs, some)).count() == 0
    got = I.importance_weights(some, docs).collect()
    assert Counter(map(tuple, got)) == Counter(brute([(1, "a b c"), (None, None)], []))


def test_gains_of_a_block_need_no_dictionary(monkeypatch):
    """Weights summed from a block's rows are those of plain hashes, and the strings of a shard are put together in one pass only."""
    texts = ["The cat sat on the mat, the cat sat", "", None, "one", "two words", "x " * 300 + "été 日本 word", "the cat sat on"]
    rows = list(I._block(list(range(len(texts))), pa.array(texts, pa.string()), 0, 3))
    table = pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(I._ROW)})
    gain = [(7919 * k) % 10007 - 5000 for k in range(I.BUCKETS)]

    def unused(*_):
        raise AssertionError("a dictionary was built")

    monkeypatch.setattr(I, "_dictionary", unused)
    got = [0] * len(texts)
    for r in I._weighed(table, pa.table({"gains": [gain]})).to_pylist():
        for doc, weight in zip(I._unzip(r["doc"]).tolist(), r["weight"] or [], strict=True):
            got[doc] += weight
    for k, text in enumerate(texts):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        assert got[k] == sum(gain[crc32(b" ".join(w[i : i + n])) % I.BUCKETS] for n in (1, 2, 3) for i in range(len(w) - n + 1))
