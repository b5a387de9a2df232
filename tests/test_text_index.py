"""The persistent index: loads, merges, failures, coverage, BM25 and phrases against ranking the texts themselves."""

import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import retrieval as R
from tempora.operators import text_index as T

WORDS = ["luật", "thuế", "đất", "điều", "khoản", "a1", "b2", "ngân", "hàng", "vốn", "rare"]


def texts(rng, n):
    return {i: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame([(i, t) for i, t in docs.items()], "doc long, text string")


def checked(spark, index, docs, queries):
    asked = spark.createDataFrame(list(enumerate(queries)), "query long, text string")
    items = frame(spark, docs).select(F.col("doc").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    score = lambda df: {(r["query"], r["id"]): round(r["score"], 9) for r in df.collect()}
    assert score(index.bm25(asked)) == score(R.bm25(asked, items))
    want = {}
    for q, text in enumerate(queries):
        phrase = text.split()
        for i, t in docs.items():
            w = (t or "").split()
            times = sum(w[k : k + len(phrase)] == phrase for k in range(len(w) - len(phrase) + 1)) if phrase else 0
            if times:
                want[q, i] = times
    assert {(r["query"], r["id"]): r["times"] for r in index.phrases(asked).collect()} == want


QUERIES = ["luật thuế", "rare", "điều khoản điều", "a1 a1", "", "nowhere luật", "ngân hàng"]


def test_loads_changes_and_merges(spark, tmp_path):
    rng = random.Random(1)
    index = T.TextIndex(spark, f"file://{tmp_path}/index", buckets=4)
    docs = texts(rng, 60) | {60: None}
    assert index.load(frame(spark, docs)) == {"new": 61, "changed": 0, "gone": 0}
    assert index.load(frame(spark, docs)) == {"new": 0, "changed": 0, "gone": 0}
    assert index.manifest().version == 1
    checked(spark, index, docs, QUERIES)
    most = 0
    for step in range(5):
        for i in rng.sample(sorted(docs), 5):
            docs[i] = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(9)))
        for i in rng.sample(sorted(docs), 3):
            del docs[i]
        docs[100 + step] = "luật thuế rare rare"
        assert index.load(frame(spark, docs))["gone"] == 3
        most = max(most, max(s.level for s in index.manifest().segments))
    checked(spark, index, docs, QUERIES)
    assert most == 1 and len(index.manifest().segments) < 6
    known = {r["doc"] for r in index.lengths().collect()}
    assert known == set(docs)
    index.collect_garbage()
    checked(spark, index, docs, QUERIES)


def test_a_failed_load_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    index = T.TextIndex(spark, f"file://{tmp_path}/index", buckets=2)
    docs = {1: "luật thuế", 2: "đất"}
    index.load(frame(spark, docs))
    changed = {1: "vốn", 3: "rare"}
    publish = T.TextIndex._publish

    def broken(self, manifest):
        raise OSError("lost")

    monkeypatch.setattr(T.TextIndex, "_publish", broken)
    with pytest.raises(OSError):
        index.load(frame(spark, changed))
    checked(spark, index, docs, QUERIES)
    monkeypatch.setattr(T.TextIndex, "_publish", publish)
    assert index.load(frame(spark, changed)) == {"new": 1, "changed": 1, "gone": 1}
    checked(spark, index, changed, QUERIES)
    assert len(index.collect_garbage()) > 0
    checked(spark, index, changed, QUERIES)


def test_two_loads_at_once(spark, tmp_path):
    index = T.TextIndex(spark, f"file://{tmp_path}/index", buckets=2)
    index.load(frame(spark, {1: "a"}))
    with pytest.raises(T.Busy):
        index._publish(T.Manifest(1, 2, [], []))
    assert {r["doc"] for r in index.lengths().collect()} == {1}


def test_coverage(spark, tmp_path):
    index = T.TextIndex(spark, f"file://{tmp_path}/index", buckets=2)
    assert {r["state"]: r["docs"] for r in index.coverage(frame(spark, {1: "a"})).collect()} == {"missing": 1}
    index.load(frame(spark, {1: "a", 2: "b", 3: "c"}))
    got = {r["state"]: r["docs"] for r in index.coverage(frame(spark, {1: "a", 2: "x", 4: "d", 5: None})).collect()}
    assert got == {"indexed": 1, "stale": 1, "missing": 2, "extra": 1}


def test_no_text_is_read_for_a_query(spark, tmp_path):
    index = T.TextIndex(spark, f"file://{tmp_path}/index", buckets=4)
    index.load(frame(spark, {1: "luật thuế", 2: "đất"}))
    asked = spark.createDataFrame([(1, "luật")], "query long, text string")
    plan = index.bm25(asked)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("text" not in line.split("Batched")[0] for line in scans)
    assert not any("positions" in line for line in scans)


def test_pools_are_the_best_of_all_scores_where_ids_repeat_too(spark):
    words = [" ".join(f"w{(i * 7 + j * j) % 23}" for j in range(i % 9)) for i in range(200)]
    items = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(3, "w1 w2 w3"), (3, words[3]), (5, "w1"), (7, "")], "id long, text string")
    queries = spark.createDataFrame([("a", "w1 w2 w2 W3"), ("b", "w4 w22"), ("c", "none of it"), ("d", "")], "query string, text string")
    rows = lambda df: {(r["query"], r["id"], round(r["score"], 8)) for r in df.collect()}
    scores = R.bm25(queries, items).withColumn("score", F.round("score", 9))
    for some in (items, items.where("id NOT IN (3, 5, 7)")):
        scores = R.bm25(queries, some).withColumn("score", F.round("score", 9))
        assert rows(R.bm25_pool(queries, some, 7)) == rows(R.ranked(scores, 7))
        assert rows(R.bm25_pool(queries, some, 1000)) == rows(scores)
        pairs = spark.createDataFrame([("a", 3), ("a", 5), ("b", 9), ("zz", 3)], "query string, id long")
        assert rows(R.bm25_of(queries, some, pairs).withColumn("score", F.round("score", 9))) == {r for r in rows(scores) if r[:2] in {("a", 3), ("a", 5), ("b", 9)}}
