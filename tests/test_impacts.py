"""Edges of amending articles: targets, wording, what is cut or missing, and the check against a list."""

import pytest

from tempora.operators import impacts as I

SCHEMA = "key string, text string, source_key string, base string, valid_from string"


#: The articles of each test, all judged in one job.
TEXTS = {
    "title": ["Điều 1. Sửa đổi Điều 5 và bổ sung phụ lục của Thông tư số 40/2024/TT-NHNN\n1. Bãi bỏ điểm c khoản 7.\n2. Sửa đổi khoản 2 như sau:\n“2. Mới theo Điều 9.”\n3. Không lệnh."],
    "whole": ["Điều 8. Bãi bỏ khoản 4 Điều 24", None, "", "Điều 2. Tên\nBãi bỏ Điều 3"],
    "recipients": ["Điều 6. Thi hành\n1. Có hiệu lực.\n2. Bãi bỏ Điều 16, Điều 17.\nNơi nhận:\n- Như Điều 5;"],
    "warnings": ["Điều 1. Sửa đổi\n1. Bổ sung Điều 4.\n2. Bãi bỏ quy định cũ.\n3. Bổ sung Điều 5 “a” và “b”.\n4. Thay thế một số phụ lục “c”“d” Điều 6.", "Điều 2. Sửa đổi\n1. Thay thế cụm từ “a” Điều 6.\n2. Sửa đổi Điều 7, Điều 7 “x”“y”."],
    # A quotation that isn't closed: nothing counts as quoted, and clause 2 begins inside it.
    "cut": ["Điều 1. Sửa đổi\n1. Sửa đổi Điều 3 “mới\n2. Bãi bỏ Điều 4."],
}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(f"{name}{i}", t, "S#than/dieu_1", "1/2020/NĐ-CP", "2025-01-01") for name, texts in TEXTS.items() for i, t in enumerate(texts)]
    found = I.impact_edges(spark.createDataFrame(rows, SCHEMA)).collect()
    return lambda name: sorted((r["key"].removeprefix(name), r["source_key"], r["target_key"] or "", r["op"], (r["span_start"], r["span_end"]), tuple(r["warnings"])) for r in found if r["key"][:-1] == name)


def test_clauses_are_commands_and_the_title_gives_base_and_article(edges):
    (text,), got = TEXTS["title"], edges("title")
    a, b = text.index("“"), text.index("”") + 1
    assert got == [("0", "S#than/dieu_1#khoan_1", "40/2024/TT-NHNN#than/dieu_5#khoan_7#diem_c", "bai_bo", (None, None), ()), ("0", "S#than/dieu_1#khoan_2", "40/2024/TT-NHNN#than/dieu_5#khoan_2", "sua_doi", (a, b), ())]


def test_an_article_without_clauses_is_one_command(edges):
    assert edges("whole") == [("0", "S#than/dieu_1", "1/2020/NĐ-CP#than/dieu_24#khoan_4", "bai_bo", (None, None), ())]


def test_recipients_give_no_target(edges):
    got = edges("recipients")
    assert [e[2].rsplit("#", 1)[1] for e in got] == ["than/dieu_16", "than/dieu_17"]


def test_warnings(edges):
    got = edges("warnings")
    assert [(e[0], e[1][-1], e[2].rsplit("_", 1)[-1], e[3], e[5]) for e in got] == [
        ("0", "1", "4", "bo_sung", ("unworded",)), ("0", "2", "", "bai_bo", ("no_target",)), ("0", "3", "5", "bo_sung", ("gap",)), ("0", "4", "6", "thay_phu_luc", ()),
        ("1", "1", "6", "thay_cum_tu", ()), ("1", "2", "7", "sua_doi", ()),
    ]


def test_a_quotation_that_crosses_a_border_is_told(edges):
    got = edges("cut")
    assert {(e[1][-1], w) for e in got for w in e[5] if w == "cut"} == {("1", "cut"), ("2", "cut")}
    assert ("1", "unworded") in {(e[1][-1], w) for e in got for w in e[5]}


def test_amending_documents_keep_all_their_articles(spark):
    rows = [("a", "Điều 1. Tên\nBãi bỏ Điều 2"), ("a", "Điều 2. Khác"), ("b", "Điều 1. Khác\nkhông"), ("b", None), (None, "Điều 1. Bãi bỏ")]
    got = I.amending(spark.createDataFrame(rows, "doc string, text string"), "doc").collect()
    assert sorted(r["text"] for r in got) == ["Điều 1. Tên\nBãi bỏ Điều 2", "Điều 2. Khác"]


def test_check_both_ways(spark):
    edges_ = spark.createDataFrame([(k,) for k in ("N#than/dieu_1", "N#than/dieu_2#khoan_1", "N#than/dieu_3#khoan_1#diem_a", "M#than/dieu_1", None)], "target_key string")
    listed = spark.createDataFrame([("N", "1", "khoan", "9"), ("N", "2", None, None), ("N", "3", "khoan", "1"), ("N", "4", None, None)], "base string, article string, level string, number string")
    got = {tuple(r) for r in I.checked(edges_, listed).collect()}
    assert got == {("edge", "N", "3", "diem", "a"), ("edge", "M", "1", None, None), ("list", "N", "3", "khoan", "1"), ("list", "N", "4", None, None)}


def test_edges_and_their_check_shuffle_no_text(spark):
    rows = [(f"k{i}", "Điều 8. Tên\n1. Bãi bỏ khoản 4 Điều 24, điểm a khoản 5 Điều 24 của Nghị định số 1/2020/NĐ-CP", "S#than/dieu_1", b, "2025-01-01") for i, b in enumerate(["1/2020/NĐ-CP", "2/2020/NĐ-CP", "", None])]
    found = I.impact_edges(spark.createDataFrame(rows, SCHEMA))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["key"], r["target_key"]) for r in found.collect())
    other = "1/2020/NĐ-CP#than/dieu_24#khoan_5#diem_a"
    assert got == [("k0", "1/2020/NĐ-CP#than/dieu_24#khoan_4"), ("k0", other), ("k1", other), ("k1", "2/2020/NĐ-CP#than/dieu_24#khoan_4"), ("k2", other), ("k3", other)]


def test_what_a_list_leaves_open_meets_nothing(spark):
    edges_ = spark.createDataFrame([("N#than/dieu_1#khoan_1",)], "target_key string")
    listed = spark.createDataFrame([("N", "1", "khoan", None), (None, "1", None, None), ("N", None, None, None)], "base string, article string, level string, number string")
    assert {tuple(r) for r in I.checked(edges_, listed).collect()} == {("edge", "N", "1", "khoan", "1"), ("list", "N", "1", "khoan", None), ("list", None, "1", None, None)}
