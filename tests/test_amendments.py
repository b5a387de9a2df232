"""Citations, amending commands and model hooks."""

from tempora.functions.citations import citations, node_keys
from tempora.operators import amendments as A
from tempora.operators import models as M


def one(text):
    return next(citations(text))


def test_citations():
    c = one("theo điểm a, b và đ khoản 1 Điều 3 Nghị định số 40/2024/NĐ-CP của")
    assert (c.points, c.clauses, c.articles, c.number) == (["a", "b", "đ"], ["1"], ["3"], "40/2024/NĐ-CP")
    c = one("khoản 2, khoản 3 Điều này")
    assert (c.clauses, c.this_article, c.this_clause) == (["2", "3"], True, False)
    assert one("các Điều 5, 6 và 7a").articles == ["5", "6", "7a"]
    assert one("khoản 2 đến khoản 4 Điều 9").clauses == ["2", "3", "4"]
    assert list(citations("không có gì, Thông tư 1/2020/TT-BTC")) == []
    text = "xem khoản này và Điều 12."
    assert [text[c.start : c.end] for c in citations(text)] == ["khoản này", "Điều 12"]


def test_keys_need_their_context():
    assert node_keys(one("điểm a, b khoản 1 Điều 3"), "N", None, None) == ["N#than/dieu_3#khoan_1#diem_a", "N#than/dieu_3#khoan_1#diem_b"]
    assert node_keys(one("khoản 2 Điều này"), "N", "7", "1") == ["N#than/dieu_7#khoan_2"]
    assert node_keys(one("khoản 2 Điều này"), "N", None, None) == []
    assert node_keys(one("điểm c khoản này"), "N", "7", "4") == ["N#than/dieu_7#khoan_4#diem_c"]
    assert node_keys(one("điểm c khoản này"), "N", "7", None) == []
    assert node_keys(one("Điều 1"), None, None, None) == []


ARTICLE = "Điều 1. Sửa đổi một số điều của Thông tư số 40/2024/TT-NHNN\n1. Sửa đổi khoản 2 Điều 5 như sau:\n“2. Nội dung mới theo khoản 9.\nBãi bỏ gì đó”\n2. Bãi bỏ Điều 7, Điều 8.\n3. Thay thế cụm từ."


def test_commands_become_edges(spark):
    got = list(A.edges_of(ARTICLE, "S#than/dieu_1", None, "2025-01-01"))
    assert [(e[1], e[2], e[7]) for e in got] == [("40/2024/TT-NHNN#than/dieu_5#khoan_2", "sua_doi", None), ("40/2024/TT-NHNN#than/dieu_7", "bai_bo", None), ("40/2024/TT-NHNN#than/dieu_8", "bai_bo", None), (None, "thay_the", "no target")]
    df = spark.createDataFrame([(ARTICLE, "S#than/dieu_1", None, "2025-01-01"), ("không có lệnh", "x", None, None)], "text string, source_key string, base string, valid_from string")
    rows = A.amendments(df).collect()
    assert len(rows) == 4 and rows[0]["new_text"].startswith("“2. Nội dung mới") and rows[1]["new_text"] is None


def test_models(spark):
    calls = []

    def flaky(prompts):
        calls.append(len(prompts))
        return M.stub(prompts)

    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(5)], "id string, prompt string")
    assert {r["id"]: r["answer"] for r in M.ask(prompts, flaky, batch=2).collect()} == {str(i): M.stub([f"p{i}"])[0] for i in range(5)}
    rows = {r["id"]: r["verdict"] for r in M.judged(spark.createDataFrame([("a", "p"), ("b", None)], "id string, prompt string")).collect()}
    assert rows["b"] == "not_assessed" and rows["a"] in M.VERDICTS
    chunks = spark.createDataFrame([(1, "i", "d1", "internal"), (1, "e", "d2", "external"), (2, "x", "d1", "internal"), (2, "y", "d1", "external")], "query int, id string, doc_id string, source string")
    assert [tuple(r) for r in M.conflict_pairs(chunks).collect()] == [(1, "i", "e")]
