"""Functions on hand-written rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tempora.functions import keys as K
from tempora.functions import temporal as V
from tempora.functions import text as T
from tempora.functions.html import inline_html
from tempora.operators import normative as N


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_dates_are_read_in_one_shape_only(spark):
    day = datetime.date
    assert column(spark, ["2024-02-29", " 2024-01-01 ", "2024-02-30", "2024-7-1", "2024", "", None], V.parse_date) == [day(2024, 2, 29), day(2024, 1, 1), None, None, None, None, None]
    assert column(spark, ["31/12/2023", "99/99/2024", "1/2/2024"], V.day_first) == ["2023-12-31", "2024-99-99", None]
    assert column(spark, ["2024-03-01", "x"], V.day_before) == ["2024-02-29", None]


@pytest.mark.parametrize(("interval", "last"), [("closed", True), ("half_open", False)])
def test_validity_bounds(spark, interval, last):
    rows = [("2024-01-01", "2024-06-30", False), ("2024-06-30", None, False), (None, None, True), (None, None, None), ("bad", "", False), ("2024-07-01", None, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, vf string, vt string, sup boolean")
    got = [r[0] for r in df.orderBy("i").select(V.effective(V.parse_date(F.col("vf")), V.parse_date(F.col("vt")), F.col("sup"), "2024-06-30", interval)).collect()]
    assert got == [last, True, False, True, True, False]


def test_prefixes_stop_at_their_boundary(spark):
    assert column(spark, ["Điều 3", "Điều 3 Khoản 1", "Điều 30"], lambda x: K.prefix_at(x, F.lit("Điều 3"), " ")) == [True, True, False]
    assert column(spark, ["n#dieu_1#khoan_2", "n"], K.ancestors) == [["n", "n#dieu_1", "n#dieu_1#khoan_2"], ["n"]]
    df = spark.createDataFrame([("d", "Điều 3", "d", "Điều 3 Khoản 1"), ("d", "Điều 3", "d", "Điều 30"), ("d", "", "d", ""), ("d", "Điều 3", "e", "Điều 3")], "a string, x string, b string, y string")
    assert [r[0] for r in df.select(K.either_prefix(*map(F.col, "axby"))).collect()] == [True, False, False, False]


def test_ids_and_order(spark):
    assert column(spark, ["TT40-2024", "a\n", "a b", "a/b", "a'b", "", None], K.safe_id) == [True, False, False, False, False, False, False]
    assert column(spark, ["Điều 3 Khoản 12", "x"], K.numbers_in) == [[3, 12], []]
    assert column(spark, ["a", "d", "đ", "e", "ab"], K.letter_rank) == [1, 4, 5, 6, 0]
    assert column(spark, ["Điều 3a Khoản 1", "Phụ lục"], K.article_of) == ["Điều 3a", "Phụ lục"]


def test_official_numbers(spark):
    raw = ["40/2024/TT-NHNN", " 07 / 2021 / NĐ-CP", "59/2020/QH14", "41/2025/ТТ-NHNN", "1627/QĐ-NHNN", "40/2024/TT-", "40/2024", None]
    assert column(spark, raw, T.official_number) == ["40/2024/TT-NHNN", "7/2021/NĐ-CP", "59/2020/QH14", "41/2025/TT-NHNN", "1627/QĐ-NHNN", None, None, None]
    assert column(spark, raw, lambda x: T.doc_id_of(T.official_number(x)))[:5] == ["TT40-2024", "ND7-2021", "L59-2020", "TT41-2025", "QD1627-NHNN"]


def test_folding_and_markers(spark):
    assert column(spark, ["Điều ĐẤT Ủy"], T.fold_keep_d) == ["điêu đat uy".replace("ê", "e")]
    assert column(spark, ["Điều ĐẤT Ủy"], T.fold_all) == ["dieu dat uy"]
    assert column(spark, ["must not", "mustard", "A may, if B"], T.marker_groups) == [["prohibition"], [], ["condition", "permission"]]
    assert column(spark, ["1.000.000 and 2,5"], T.number_tokens) == [["1000000", "2.5"]]
    assert column(spark, ["Bãi bỏ Điều 1", "sửa đổi, bổ sung", "Điều bãi bỏ"], T.command_verb) == ["bai_bo", "sua_doi_bo_sung", None]
    assert column(spark, ["abc KHỐI kết"], lambda x: T.same_length_mask(x, "KHỐI")) == ["abc         "]
    assert column(spark, ["PHẦN I", "Phần I", "123"], T.shouted) == [True, False, False]


def test_html():
    assert inline_html('<p class="x"><b onclick="y">a<i>b</b> c &lt; d<script>x()</script><br/>') == "<b>a<i>b</i></b> c &lt; d<br>"
    assert inline_html("<a href='>'>t</a> <b title=\"a>b\">u</b>") == "t <b>u</b>"
    assert inline_html(None) is None
    assert inline_html("") == ""


def test_modality_and_partitions(spark):
    df = spark.createDataFrame([("A bank may lend 5", "A bank must lend 3")], "c string, s string")
    got = df.select(N.modality_delta(F.col("c"), F.col("s"))).first()[0]
    assert (got["added"], got["lost"], got["numbers"]) == (["permission"], ["obligation"], ["5"])
    rows = spark.createDataFrame([([1, 1], [1, 2]), ([1, 2], [1, 2]), ([1, 3], [1, 2]), ([1], None)], "v array<int>, d array<int>")
    assert [tuple(r[0]) if r[0] else None for r in rows.select(N.partition_proof(F.col("v"), F.col("d"))).collect()] == [(1, 0, True), (0, 0, False), (1, 1, False), None]
    claims = spark.createDataFrame([("d::Điều 3",), ("d::Điều 4 Khoản 9 Điểm a",), ("d::Điều 9",)], "claim string")
    chunks = spark.createDataFrame([("d::Điều 3",), ("d::Điều 4 Khoản 9",)], "id string")
    assert {tuple(r) for r in N.resolved_chunks(claims, chunks).collect()} == {("d::Điều 3", "d::Điều 3"), ("d::Điều 4 Khoản 9 Điểm a", "d::Điều 4 Khoản 9")}
