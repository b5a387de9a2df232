"""References, gates, the three tests, guards and partition proofs, on the cases that the product names."""

import pytest
from pyspark.sql import functions as F

from tempora.operators import gates as A
from tempora.operators import guards as U

ND = "52/2024/NĐ-CP"


def refs(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(A.references(F.col("t")).alias("r")).first()
    return [(r["points"], r["clauses"], r["articles"], r["this_clause"], r["this_article"], r["number"]) for r in row["r"]]


def test_references(spark):
    assert refs(spark, "theo Điều 11, Điều 12 và 13") == [([], [], ["11", "12", "13"], False, False, None)]
    assert refs(spark, "điểm a, điểm đ khoản 2 Điều này") == [(["a", "đ"], ["2"], [], False, True, None)]
    assert refs(spark, "khoản này và khoản 3 Điều 5a Nghị định số 101/2012/NĐ-CP") == [([], [], [], True, False, None), ([], ["3"], ["5a"], False, False, "101/2012/NĐ-CP")]
    assert refs(spark, "từ Điều 3 đến Điều 5") == [([], [], ["3", "4", "5"], False, False, None)]
    assert refs(spark, "điểm c, điểm đ khoản 1, điểm b khoản 2 Điều 25") == [(["c", "đ"], ["1"], [], False, False, None), (["b"], ["2"], ["25"], False, False, None)]
    assert refs(spark, "điều kiện khoảng điểmx 12/2020/TT-NHNN") == []


#: (text, title, article, clause, level) of all units that the tests below ask about: judged in one job.
UNITS = (
    ("Nghị định này có hiệu lực thi hành từ ngày 01 tháng 7 năm 2024.", "Hiệu lực thi hành", "37", "1", "clause"),
    ("Nghị định này có hiệu lực thi hành kể từ ngày 01 tháng 7 năm 2024.", "Hiệu lực thi hành", "37", "1", "clause"),
    ("Quy định tại Điều 11, Điều 12 Nghị định này có hiệu lực từ ngày 01 tháng 1 năm 2025, trừ trường hợp quy định tại khoản 2 Điều 12.", "", "37", "1", "clause"),
    ("điểm c khoản 1, điểm b khoản 2 Điều 25 có hiệu lực từ ngày 01 tháng 1 năm 2025", "", "37", "1", "clause"),
    ("khoản 2 Điều 17, Điều 18 có hiệu lực từ ngày 01 tháng 1 năm 2025", "", "37", "1", "clause"),
    ("Điều 2 Thông tư số 39/2014/TT-NHNN hết hiệu lực kể từ ngày Thông tư này có hiệu lực", "", "37", "1", "clause"),
    ("Bãi bỏ Thông tư số 39/2014/TT-NHNN.", "", "37", "1", "clause"),
    ("Quy định tại khoản 1 Điều này không áp dụng đối với tổ chức.", "", "26", "2", "clause"),
    ("Quy định tại Mục này chỉ áp dụng đối với tổ chức đã được cấp Giấy phép.", "Điều kiện cung ứng dịch vụ", "20", "1", "clause"),
    ("Khoản này áp dụng đối với ngân hàng.", "", "3", "4", "clause"),
    ("Tổ chức cung ứng dịch vụ trung gian thanh toán.", "Đối tượng áp dụng", "37", "1", "clause"),
    ("1. Tổ chức\n2. Cá nhân", "Đối tượng áp dụng", "37", "1", "article"),
    ("Ví điện tử là dịch vụ phải thu phí.", "Giải thích từ ngữ", "37", "1", "clause"),
    ("Bộ trưởng phải tổ chức thực hiện.", "Trách nhiệm thi hành", "37", "1", "clause"),
    ("Ngân hàng phải báo cáo.", "Điều khoản chuyển tiếp", "37", "1", "clause"),
    ("tổ chức không phải là ngân hàng", "Giải thích từ ngữ", "37", "1", "clause"),
    ("số tiền phải thu, phải trả", "Quản lý", "37", "1", "clause"),
    ("Khách hàng được cấp thẻ.", None, "37", "1", "clause"),
)


@pytest.fixture(scope="module")
def judge(spark):
    rows = [(n, text, title, f"{ND}#than/dieu_{article}#khoan_{clause}", level) for n, (text, title, article, clause, level) in enumerate(UNITS)]
    df = spark.createDataFrame(rows, "n int, t string, title string, k string, l string")
    found = {UNITS[r["n"]]: r for r in A.classified(df, "t", "title", "k", "l").collect()}
    return lambda text, title="", article="37", clause="1", level="clause": found[text, title, article, clause, level]


def test_effect_is_a_gate_of_the_document(judge):
    for said in ("từ ngày", "kể từ ngày"):
        v = judge(f"Nghị định này có hiệu lực thi hành {said} 01 tháng 7 năm 2024.", "Hiệu lực thi hành")
        assert (v["type"], v["gate"]["kind"], v["gate"]["scope"], v["gate"]["derivable"]) == ("meta_cu", "time", "document", True)


def test_effect_of_named_articles_with_exclusions(judge):
    v = judge("Quy định tại Điều 11, Điều 12 Nghị định này có hiệu lực từ ngày 01 tháng 1 năm 2025, trừ trường hợp quy định tại khoản 2 Điều 12.")
    assert v["gate"]["targets"] == [f"{ND}#than/dieu_11", f"{ND}#than/dieu_12"] and v["gate"]["scope"] == "article"
    assert v["gate"]["exclusions"] == [f"{ND}#than/dieu_12#khoan_2"] and v["gate"]["derivable"]


def test_vague_references_give_no_keys(judge):
    v = judge("điểm c khoản 1, điểm b khoản 2 Điều 25 có hiệu lực từ ngày 01 tháng 1 năm 2025")
    assert v["gate"]["targets"] == [f"{ND}#than/dieu_25#khoan_2#diem_b"] and not v["gate"]["derivable"] and v["warnings"] == ["scope_unresolved"]
    v = judge("khoản 2 Điều 17, Điều 18 có hiệu lực từ ngày 01 tháng 1 năm 2025")
    assert (v["gate"]["targets"], v["gate"]["scope"], v["gate"]["note"]) == ([], "document", "unresolved")


def test_other_documents_are_not_resolved(judge):
    v = judge("Điều 2 Thông tư số 39/2014/TT-NHNN hết hiệu lực kể từ ngày Thông tư này có hiệu lực")
    assert (v["gate"]["note"], v["gate"]["targets"], v["gate"]["derivable"]) == ("foreign", [], False)
    assert judge("Bãi bỏ Thông tư số 39/2014/TT-NHNN.")["gate"]["note"] == "replaces"


def test_polarity_and_scope_of_subject_gates(judge):
    v = judge("Quy định tại khoản 1 Điều này không áp dụng đối với tổ chức.", article="26", clause="2")
    assert (v["type"], v["gate"]["negative"], v["gate"]["targets"], v["gate"]["scope"]) == ("meta_cu", True, [f"{ND}#than/dieu_26#khoan_1"], "clause")
    v = judge("Quy định tại Mục này chỉ áp dụng đối với tổ chức đã được cấp Giấy phép.", "Điều kiện cung ứng dịch vụ", "20")
    assert (v["gate"]["kind"], v["gate"]["scope"], v["gate"]["derivable"], v["gate"]["negative"]) == ("subject", "section", False, False)
    assert judge("Khoản này áp dụng đối với ngân hàng.", article="3", clause="4")["gate"]["targets"] == [f"{ND}#than/dieu_3#khoan_4"]


@pytest.mark.parametrize(("text", "title", "level", "want"), [
    ("Tổ chức cung ứng dịch vụ trung gian thanh toán.", "Đối tượng áp dụng", "clause", ("premise", "vai_tro", ["A:title", "B:nothing", "C:role"], [])),
    ("1. Tổ chức\n2. Cá nhân", "Đối tượng áp dụng", "article", ("meta_cu", None, ["A:title", "B:nothing", "C:article"], [])),
    ("Ví điện tử là dịch vụ phải thu phí.", "Giải thích từ ngữ", "clause", ("premise", "dinh_nghia", ["A:title", "B:nothing", "C:premise"], ["title_against_markers"])),
    ("Bộ trưởng phải tổ chức thực hiện.", "Trách nhiệm thi hành", "clause", ("actor_cu", None, ["A:markers"], [])),
    ("Ngân hàng phải báo cáo.", "Điều khoản chuyển tiếp", "clause", ("actor_cu", None, ["A:title", "B:markers"], [])),
    ("tổ chức không phải là ngân hàng", "Giải thích từ ngữ", "clause", ("premise", "dinh_nghia", ["A:title", "B:nothing", "C:premise"], [])),
    ("số tiền phải thu, phải trả", "Quản lý", "clause", ("actor_cu", None, ["A:default"], [])),
    ("Khách hàng được cấp thẻ.", None, "clause", ("actor_cu", None, ["A:default"], [])),
])
def test_three_tests(judge, text, title, level, want):
    v = judge(text, title, level=level)
    assert (v["type"], v["premise_kind"], v["path"], v["warnings"]) == want


GUARDS = (
    ("(i) Đối với khách hàng là cá nhân: giấy tờ tùy thân", (("khách hàng", "cá nhân"), "")),
    ("a) giấy tờ (đối với khách hàng là tổ chức), con dấu", (("khách hàng", "tổ chức"), "")),
    ("1. Đối với tài khoản thanh toán của cá nhân: mở tại chi nhánh", (("tài khoản thanh toán", "cá nhân"), "")),
    ("4. Đối với thẻ trả trước, hạn mức là 5 triệu", (("thẻ", "thẻ trả trước"), "")),
    ("của chủ tài khoản (đối với khách hàng là cá nhân), người đại diện (đối với khách hàng là tổ chức)", (None, "several")),
    ("đối với khách hàng là cá nhân; đối với khách hàng là cá nhân", (("khách hàng", "cá nhân"), "")),
    ("2. Đối với các tài liệu quy định tại Điều 5, nộp bản sao", (None, "")),
    ("trường hợp phát hiện sai sót, báo ngay", (None, "")),
    ("nộp hồ sơ đối với ví điện tử, thẻ", (None, "odd")),
    ("không có gì", (None, "")),
    (None, (None, "")),
)


def test_guards(spark):
    rows = spark.createDataFrame([(n, text) for n, (text, _) in enumerate(GUARDS)], "n int, t string")
    found, warning = U.guards_in(F.col("t"))
    got = {r["n"]: (tuple(r["g"]) if r["g"] else None, r["w"]) for r in rows.select("n", found.alias("g"), warning.alias("w")).collect()}
    assert [got[n] for n in range(len(GUARDS))] == [want for _, want in GUARDS]


def test_guards_along_the_path(spark):
    pair = lambda a, v: {"attribute": a, "value": v}
    rows = [("N#than/dieu_1", None), ("N#than/dieu_1#khoan_1", pair("khách hàng", "cá nhân")), ("N#than/dieu_1#khoan_1#diem_a", None), ("N#than/dieu_1#khoan_1#diem_b", pair("mở tài khoản", "eKYC")), ("N#than/dieu_1#khoan_1#diem_c", pair("Khách  hàng", "tổ chức")), ("N#than/dieu_10", None)]
    units = spark.createDataFrame(rows, "key string, guard struct<attribute:string,value:string>")
    got = {r["key"].removeprefix("N#than/"): ([tuple(g) for g in r["guards"]], r["conflict"]) for r in U.effective_guards(units).collect()}
    own = [("khách hàng", "cá nhân")]
    assert got == {"dieu_1": ([], False), "dieu_1#khoan_1": (own, False), "dieu_1#khoan_1#diem_a": (own, False), "dieu_1#khoan_1#diem_b": ([*own, ("mở tài khoản", "eKYC")], False), "dieu_1#khoan_1#diem_c": ([*own, ("Khách  hàng", "tổ chức")], True), "dieu_10": ([], False)}


def test_partition_proofs(spark):
    g = lambda a, v: {"attribute": a, "value": v}
    rows = [("p1", g("khách hàng", "cá nhân")), ("p1", g("Khách hàng", "Tổ  chức")), ("p2", g("tài khoản thanh toán", "cá nhân")), ("p2", g("tài khoản thanh toán", "tổ chức")), ("p3", g("khách hàng", "cá nhân")), ("p3", None), ("p4", g("lạ", "x")), ("p4", g("lạ", "y")), ("p5", g("khách hàng", "cá nhân")), ("p5", g("khách hàng", "cá nhân")), ("p6", g("khách hàng", "hộ")), ("p6", g("khách hàng", "tổ chức")), ("p7", g("khách hàng", "cá nhân")), ("p7", g("thẻ", "tổ chức"))]
    units = spark.createDataFrame(rows, "parent string, guard struct<attribute:string,value:string>")
    bindings = spark.createDataFrame([("khách hàng", "chu_the", True), ("tài khoản thanh toán", "hinh_thuc", True)], "attribute string, domain string, closed boolean")
    domains = spark.createDataFrame([("chu_the", "cá nhân"), ("chu_the", "tổ chức"), ("hinh_thuc", "cá nhân"), ("hinh_thuc", "tổ chức"), ("hinh_thuc", "chung")], "domain string, value string")
    got = {r["parent"]: (r["missing"], r["foreign_values"], r["repeated"], r["proven"]) for r in U.sibling_proofs(units, bindings, domains).collect()}
    assert got == {"p1": ([], [], False, True), "p2": (["chung"], [], False, False), "p5": (["tổ chức"], [], True, False), "p6": (["cá nhân"], ["hộ"], False, False)}


def test_vocabulary(spark):
    terms = spark.createDataFrame([("thẻ",), ("thẻ trả trước",), ("ví điện tử",), ("Thẻ",)], "term string")
    phrases = spark.createDataFrame([(1, "Thẻ  trả trước"), (2, "thẻ và ví điện tử"), (3, "khác"), (4, None), (5, "")], "id int, phrase string")
    got = {r["id"]: (r["term"], r["rivals"]) for r in U.in_vocabulary(phrases, terms, "id", "phrase").collect()}
    assert got == {1: ("thẻ trả trước", 0), 2: ("ví điện tử", 1)}
