"""Sources, sinks and streams on small files."""

import json

import pytest

from tempora.sources import readers as R
from tempora.sources import writers as W
from tempora.streaming import changes as C

CORPUS = {
    "documents": [{"doc_id": "d1", "title": "T", "valid_from": "2024-01-01", "articles": [{"article": "Điều 1", "text": "x", "valid_from": ""}, {"article": "Điều 2", "text": "y", "valid_from": "2025-01-01", "superseded": True}]}],
    "relationships": [{"source_doc": "d1", "target_doc": "d0", "rel_type": "THAY_THE"}],
}


def test_corpus(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(CORPUS))
    docs, edges = R.read_corpus(spark, str(path))
    got = [(r["article"], r["valid_from"], r["superseded"]) for r in R.articles(docs).orderBy("ordinal").collect()]
    assert got == [("Điều 1", "2024-01-01", False), ("Điều 2", "2025-01-01", True)]
    assert edges.first()["target_doc"] == "d0"
    path.write_text(json.dumps(CORPUS | {"relationships": [{"source_doc": "a", "target_doc": "b", "rel_type": "X"}]}))
    with pytest.raises(R.UnknownRelation, match="THAY_THE"):
        R.read_corpus(spark, str(path))


def test_questions_are_strict(spark, tmp_path):
    path = tmp_path / "q.jsonl"
    path.write_text('{"query": "a", "as_of": "2024-01-01", "expected_doc": "d"}\n')
    assert R.read_questions(spark, str(path)).first()["relevant_docs"] == ["d"]
    path.write_text('{"query": " ", "as_of": "2024-01-01"}\n')
    with pytest.raises(R.BadQuestions):
        R.read_questions(spark, str(path))
    path.write_text("{not json\n")
    with pytest.raises(Exception, match="MALFORMED"):
        R.read_questions(spark, str(path)).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x &amp; <b>y</b></p><script>z</script>")
    (tmp_path / "b.txt").write_text("plain")
    assert {tuple(r) for r in R.read_texts(spark, str(tmp_path)).collect()} == {("a.html", "x & y"), ("b.txt", "plain")}
    (tmp_path / "u").mkdir()
    (tmp_path / "u/urls.txt").write_text("﻿http://a/x\n# no\n\nhttp://b\nhttp://a/x\nftp://c\n")
    assert [r["url"] for r in R.read_urls(spark, str(tmp_path / "u")).orderBy("ordinal").collect()] == ["http://a/x", "http://b"]
    (tmp_path / "k").mkdir()
    (tmp_path / "k/r.jsonl").write_text('{"id": "1", "v": "a"}\n{"id": "1", "v": "b"}\n')
    assert [tuple(r) for r in R.read_keyed(spark, str(tmp_path / "k"), "id string, v string", "id").collect()] == [("1", "b")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "doc string, n int")
    W.create_table(rows, str(tmp_path / "t"), "doc", 4)
    with pytest.raises(Exception, match="exists"):
        W.create_table(rows, str(tmp_path / "t"), "doc", 4)
    rows.write.parquet(str(tmp_path / "e"))
    W.append_ignore(spark, spark.createDataFrame([("a", 9), ("c", 3), ("c", 3)], rows.schema), str(tmp_path / "e"), ["doc"])
    assert spark.read.parquet(str(tmp_path / "e")).count() == 3
    with pytest.raises(W.DuplicateKeys):
        W.require_unique(rows.union(rows), ["doc"])
    status = spark.createDataFrame([("a", "pending"), ("b", "approved")], "doc_id string, status string")
    assert {tuple(r) for r in W.reviewed(W.reviewed(status, "a", "rejected"), "b", "rejected").collect()} == {("a", "rejected"), ("b", "approved")}


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 00:00:00", i % 4, "login" if i % 2 else "error", 1.0, "{}") for i in range(12)]
    spark.createDataFrame(rows + rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    stream = C.read_events(spark, str(tmp_path / "events.parquet"), "*.parquet")
    last = C.run_once(C.latest_state(stream), "latest", "complete", str(tmp_path / "c1"))
    assert {r["user_id"]: r["event_id"] for r in last.collect()} == {0: 8, 1: 5, 2: 2, 3: 11}
    once = C.run_once(C.distinct_changes(stream, ["event_id"]), "once", "append", str(tmp_path / "c2"))
    assert once.count() == 12
