"""Operators on hand-written tables, with expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tempora.operators import evaluation as E
from tempora.operators import graph as G
from tempora.operators import hierarchy as H
from tempora.operators import incremental as I
from tempora.operators import positional as P
from tempora.operators import retrieval as R
from tempora.operators import segments as S

EDGES = "source_key string, target_key string, op string, valid_from string, ord int"


def versions(spark, as_of):
    edges = spark.createDataFrame([("41#dieu_16", "40#dieu_41", "sua_doi", "2025-11-05", 1), ("99#dieu_1", "41#dieu_16", "bai_bo", "2026-05-19", 2), ("7#dieu_1", "40#dieu_4", "bai_bo", None, 3)], EDGES)
    keys = spark.createDataFrame([("40#dieu_41",), ("40#dieu_41#khoan_1",), ("40#dieu_4",)], "key string")
    return {r["key"]: r["status"] for r in H.current_version(keys, edges, as_of).collect()}


def test_a_repealed_amendment_counts_no_more(spark):
    assert versions(spark, "2026-08-05") == {"40#dieu_41": "intact", "40#dieu_41#khoan_1": "intact", "40#dieu_4": "intact"}
    assert versions(spark, "2026-01-01") == {"40#dieu_41": "amended", "40#dieu_41#khoan_1": "amended", "40#dieu_4": "intact"}
    assert set(versions(spark, "2025-11-04").values()) == {"intact"}


def test_ties_go_to_the_later_edge(spark):
    edges = spark.createDataFrame([("a", "k", "bai_bo", "2024-01-01", 1), ("b", "k", "sua_doi", "2024-01-01", 2)], EDGES)
    got = H.current_version(spark.createDataFrame([("k",)], "key string"), edges, "2024-01-01").first()
    assert (got["status"], got["last_source"], got["n_applied"]) == ("amended", "b", 2)
    assert {tuple(r) for r in H.overlay_nodes(edges).collect()} == {("a", "source"), ("b", "source"), ("k", "target")}


def test_rank_fusion_by_hand(spark):
    schema = "query int, id string, rank int"
    dense, sparse = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], schema), spark.createDataFrame([(1, "b", 0), (1, "c", 1)], schema)
    got = {r["id"]: r["score"] for r in R.rrf({"d": (dense, 1.0), "s": (sparse, 0.1)}).collect()}
    assert got == pytest.approx({"a": 1 / 60, "b": 1 / 61 + 0.1 / 60, "c": 0.1 / 61})
    assert {r["id"] for r in R.rrf({"d": (dense, 1.0), "s": (sparse, 0.0)}).collect()} == {"a", "b"}
    flat = spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0)], "query int, id string, score double")
    assert [r["score"] for r in R.min_max(flat).collect()] == [1.0, 1.0]


def test_bm25_prefers_the_rarer_term(spark):
    items = spark.createDataFrame([(1, "law law law"), (2, "law bank"), (3, "other words")], "id int, text string")
    queries = spark.createDataFrame([(1, "Bank LAW")], "query int, text string")
    got = {r["id"]: r["score"] for r in R.bm25(queries, items).collect()}
    assert set(got) == {1, 2} and got[2] > got[1]
    assert {r["id"] for r in R.phrase_bonus(queries, items, 1.0).collect()} == set()


def test_ranking_measures_by_hand(spark):
    results = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "b", 2), (2, "z", 0)], "query int, key string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "c"), (2, "q")], "query int, key string")
    got = {r["query"]: r for r in E.ranking_measures(results, gold, 2).collect()}
    assert (got[1]["recall"], got[1]["precision"], got[1]["rr"]) == (0.5, 0.5, 0.5)
    assert (got[2]["recall"], got[2]["precision"], got[2]["rr"], got[2]["f2"]) == (0, 0, 0, 0)
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    empty = pairs.limit(0)
    assert E.pair_measures(pairs, empty).first()["precision"] is None
    assert E.pair_measures(pairs, spark.createDataFrame([("b", "a")], "a string, b string")).first()["recall"] == 1.0


def test_scores_round_half_to_even(spark):
    votes = spark.createDataFrame([("pass",), ("warning",), ("not_assessed",)], "v string")
    assert votes.agg(E.weighted_score(F.col("v"))).first()[0] == 75
    assert votes.where("v = 'not_assessed'").agg(E.weighted_score(F.col("v"))).first()[0] == 0
    three = spark.createDataFrame([("a", "a", "b"), ("a", "b", "b"), ("a", "b", "c")], "x string, y string, z string")
    assert [r[0] for r in three.select(E.majority(*map(F.col, "xyz"))).collect()] == ["a", "b", "warning"]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "BAI_BO"), ("c", "b", "BAI_BO"), ("d", "e", "BAI_BO"), ("f", "e", "THAY_THE")], "source_doc string, target_doc string, rel_type string")
    assert [tuple(r) for r in G.void(edges).collect()] == [("b", ["a", "c"])]
    seeds = spark.createDataFrame([(1, "a"), (1, "b")], "query int, id string")
    assert {r["id"] for r in G.neighbours(edges, seeds).collect()} == {"a", "b", "c"}
    assert {r["id"] for r in G.expansion(edges, seeds).collect()} == {"c"}
    assert G.unknown_relations(edges.union(edges.selectExpr("source_doc", "target_doc", "'X'"))).first()["rel_type"] == "X"
    claims = spark.createDataFrame([("1/2024", "x"), ("2/2024", "y"), ("2/2024", "z"), (None, "w")], "number string, doc string")
    numbers = G.bridge(claims, "number", "doc")
    assert {r["number"]: r["doc_id"] for r in numbers.collect()} == {"1/2024": "x", "2/2024": None}
    moved = G.bridged(spark.createDataFrame([("1/2024", "2/2024", "BAI_BO")], edges.schema), numbers).first()
    assert (moved["source_doc"], moved["target_doc"], moved["unresolved"]) == ("x", "2/2024", True)


def test_fingerprints_and_scoped_replacement(spark, tmp_path):
    schema = "doc string, id string, text string"
    old = spark.createDataFrame([("a", "a1", "x"), ("a", "a2", "y"), ("b", "b1", ""), ("c", "c1", "q")], schema)
    new = spark.createDataFrame([("a", "a1", "x2"), ("b", "b1", None), ("d", "d1", "n")], schema)
    plan = I.difference(I.fingerprints(old, "doc", ["id", "text"]), I.fingerprints(new, "doc", ["id", "text"]))
    assert {tuple(r) for r in plan.collect()} == {("a", "changed"), ("b", "changed"), ("c", "extra"), ("d", "new")}
    assert I.difference(I.fingerprints(old, "doc", ["id", "text"]), I.fingerprints(old.union(old), "doc", ["id", "text"])).isEmpty()
    with pytest.raises(I.UnexpectedDocuments):
        I.refuse_extra(plan)
    for bad in ((0, None), (8, 10)):
        with pytest.raises(I.Shrunk):
            I.refuse_shrinking(*bad)
    path = str(tmp_path / "table")
    I.bucketed(old, "doc", 4).write.partitionBy("bucket").parquet(path)
    scope = spark.createDataFrame([("a",)], "doc string")
    for _ in range(2):
        I.replace_documents(spark, path, new.where("doc = 'a'"), scope, "doc", "id", 4)
        got = {(r["doc"], r["id"], r["text"]) for r in spark.read.parquet(path).collect()}
        assert got == {("a", "a1", "x2"), ("b", "b1", ""), ("c", "c1", "q")}
    I.replace_documents(spark, path, new.limit(0), spark.createDataFrame([("c",), ("zz",)], "doc string"), "doc", "id", 4)
    assert {r["id"] for r in spark.read.schema(I.bucketed(old, "doc", 4).schema).parquet(path).collect()} == {"a1", "b1"}
    I.replace_documents(spark, path, new.limit(0), spark.createDataFrame([("a",), ("b",)], "doc string"), "doc", "id", 4)
    assert spark.read.schema(I.bucketed(old, "doc", 4).schema).parquet(path).count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_positions(spark):
    df = spark.createDataFrame([(1, "ab\n\ncđ😀")], "id int, text string")
    assert [(r["line"], r["start"]) for r in P.lines_with_offsets(df, "text").orderBy("line_no").collect()] == [("ab", 0), ("", 3), ("cđ😀", 4)]
    sizes = spark.createDataFrame([([5, 4, 1, 20, 3],), ([],)], "s array<int>")
    assert [r[0] for r in sizes.select(P.packed_sizes(F.col("s"), 10)).collect()] == [[0, 0, 1, 2, 3], []]
    labels = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "i int, l string")
    assert [r["u"] for r in P.uniquified(labels, [], ["i"], "l", "u").orderBy("i").collect()] == ["x", "x (2)", "y"]
    taken = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x (2)"), (4, "x"), (5, "x (2)")], "i int, l string")
    assert [r["u"] for r in P.uniquified(taken, [], ["i"], "l", "u").orderBy("i").collect()] == ["x", "x (2)", "x (2) (2)", "x (3)", "x (2) (3)"]


def test_many_labels_that_repeat_are_named_in_linear_time(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "x").when(F.col("id") == 4_001, "y (2)").when(F.col("id") > 1, "y").alias("l"))
    got = [r["u"] for r in P.uniquified(rows, [], ["id"], "l", "u").orderBy("id").collect()]
    assert got[::2] == ["x", *(f"x ({n})" for n in range(2, 10_001))]
    # The mark that a label bears is taken by the time it comes; what is null stays null.
    assert got[1::2] == [None, "y", *(f"y ({n})" for n in range(2, 2_000)), "y (2) (2)", *(f"y ({n})" for n in range(2_000, 9_999))]


TEXT = "Chương I\nĐiều 1. Phạm vi\n1. Một\na) điểm a\nđ) điểm đ\n“Điều 9. trong\ntrích dẫn”\nMục 1\nĐiều 2. Hai\nChương II\nĐiều 3. Ba\nNơi nhận:\n- Điều 4. không"


def test_articles_keep_exact_offsets():
    got = list(S.articles(TEXT))
    assert [(g[0], g[2], g[3]) for g in got] == [("Điều 1", "Chương I", None), ("Điều 2", "Chương I", "Mục 1"), ("Điều 3", "Chương II", None)]
    assert all(TEXT[a:b] == body for _, body, _, _, a, b in got)
    units = list(S.units(got[0][1], "N#than/dieu_1"))
    assert [u[0] for u in units] == ["N#than/dieu_1#khoan_1", "N#than/dieu_1#khoan_1#diem_a", "N#than/dieu_1#khoan_1#diem_đ"]
    assert list(S.units("no clauses", "k")) == [("k#khoan_0", "virtual_clause", "k", 0, 10)]
    assert list(S.articles("")) == []


def test_quotes():
    assert S.quote_spans("a “b” c") == [(2, 5)]
    assert S.quote_spans("a “b") == [(2, 4)]
    assert not any(S.quote_mask("a “b"))
    assert S.quote_mask('a "b"') == [False, False, True, True, True]


def test_chunks_never_tear_and_never_exceed():
    clauses = "Điều 1. T\n" + "\n".join(f"{i}. " + "x" * 700 for i in range(1, 6))
    got = list(S.chunks("Điều 1", clauses))
    assert [label for label, _ in got] == ["Điều 1 Khoản 1-2", "Điều 1 Khoản 3-4", "Điều 1 Khoản 5"]
    assert "\n".join(body for _, body in got) == clauses
    words = " ".join(["word"] * 1000)
    assert all(len(body) <= S.CHUNK for _, body in S.chunks("Điều 2", words))
    assert " ".join(body for _, body in S.chunks("Điều 2", words)) == words
    assert list(S.chunks("Điều 3", "y" * 3000)) == [("Điều 3 (phần 1)", "y" * 3000)]


def test_table_functions(spark):
    S.register(spark)
    spark.createDataFrame([(1, TEXT), (2, None)], "id int, text string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT id, a.* FROM texts, LATERAL split_articles(text) a").collect()
    assert [(r["id"], r["article"]) for r in rows] == [(1, "Điều 1"), (1, "Điều 2"), (1, "Điều 3")]
