"""Routing, citations, reports and records on hand-written tables."""

from pyspark.sql import functions as F

from tempora.functions import labels as L
from tempora.functions import spans as S
from tempora.operators import normative as N
from tempora.operators import overlay as O
from tempora.operators import records as C
from tempora.operators import reports as A
from tempora.operators import segments as X
from tempora.sources import readers, writers

EDGE = "source_key string, target_key string, op string, valid_from string, ord int, span_start int, span_end int, new_text string"


def test_citations_widen_on_doubt(spark):
    keys = [("a", "N#than/dieu_4#khoan_2#diem_b"), ("a", "N#than/dieu_4#khoan_2#diem_đ"), ("a", "N#than/dieu_4#khoan_10"), ("b", "N#than/dieu_4#khoan_2"), ("b", "N#than/dieu_4#khoan_2#diem_b"), ("c", "M#than/dieu_3a"), ("c", "M#than/dieu_3a#khoan_1"), ("c", "odd"), *[("d", f"N#than/dieu_1#khoan_{i}") for i in range(1, 11)]]
    got = {r["g"]: r["citation"] for r in O.cited(spark.createDataFrame(keys, "g string, key string"), ["g"]).collect()}
    assert got == {"a": "N Điều 4 Khoản 2 Điểm b, đ, Khoản 10", "b": "N Điều 4 Khoản 2", "c": "M Điều 3a và odd", "d": "N Điều 1 Khoản 1, 2, 3, 4, 5, 6, 7, 8 và 2 đơn vị khác (đã rút gọn)"}


def test_routes(spark):
    edges = spark.createDataFrame([
        ("Q#than/dieu_1", "N#than/dieu_4", "sua_doi", "2024-01-01", 1, 100, 200, "new four"), ("Q#than/dieu_2", "N#than/dieu_5#khoan_1", "bai_bo", "2024-01-01", 2, None, None, None),
        ("R#than/dieu_1", "N#than/dieu_6", "sua_doi", "2024-01-01", 3, 10, 20, "dead"), ("Z#than/dieu_9", "R#than/dieu_1", "bai_bo", "2024-06-01", 4, None, None, None)], EDGE)
    chunks = spark.createDataFrame([("N::Điều 4", "N", None, None), ("N::Điều 4 Khoản 2", "N", None, None), ("N::Điều 5", "N", None, None), ("N::Điều 5 Khoản 1", "N", None, None), ("N::Điều 6", "N", None, None), ("Q::Điều 1", "Q", 150, 160), ("Q::Điều 3", "Q", 200, 210), ("R::Điều 1", "R", 0, 15), ("N::lạ", "N", None, None)], "chunk_id string, number string, span_start int, span_end int")
    rows = O.routed(chunks, edges, "2025-01-01")
    got = {r["chunk_id"]: (r["route"], r["citation"]) for r in rows.collect()}
    assert got["N::Điều 4"][0] == got["N::Điều 4 Khoản 2"][0] == "amended" and "đã sửa bởi" in got["N::Điều 4"][1]
    assert got["N::Điều 5"][0] == "amended" and "khoản 1" in got["N::Điều 5"][1] and "bãi bỏ" in got["N::Điều 5"][1]
    assert got["N::Điều 5 Khoản 1"][0] == "repealed" and got["N::Điều 6"][0] == "intact" and got["Q::Điều 3"][0] == "intact"
    assert got["Q::Điều 1"] == ("quoted", "N Điều 4 (sửa bởi Q Điều 1)")
    assert got["R::Điều 1"] == ("quoted", "N Điều 6 (từng được sửa bởi R Điều 1, hiện không áp dụng)")
    assert got["N::lạ"] == (None, None)
    texts = {r["chunk_id"]: r["current_text"] for r in O.current_text(rows, edges).collect()}
    assert texts["N::Điều 4"] == "new four" and texts["N::Điều 4 Khoản 2"] is None


def test_small_functions(spark):
    row = spark.range(1)
    one = lambda c: row.select(c).first()[0]
    lit = F.lit
    assert one(S.hull(F.array(F.struct(lit(3).alias("start"), lit(5).alias("end")), lit(None)))) is None
    assert one(L.alias_of(lit("Ngân hàng (sau đây gọi là NH )"))) == "NH" and one(L.split_label(lit("TT_x"))) is None
    assert one(L.masked(lit("phải trái và phải"), ["phải trái"])) == " " * 9 + " và phải"
    assert one(N.effect_date(lit("có hiệu lực từ ngày 1 tháng 7 năm 2024")).cast("string")) == "2024-07-01"
    assert one(N.invented(lit("must pay"), lit("may pay"))) == ["obligation"]
    assert one(L.lenient_json(lit("{bad"), "k:int")["_raw"]) == "{bad"
    assert one(A.counts_as_run(lit(16), lit(100), lit(5))) is False


def test_trees_and_merges(spark):
    nodes = spark.createDataFrame([("t", 1, 0), ("t", 2, 1), ("t", 3, 3), ("t", 4, 1), ("u", 1, 2)], "tree string, ord int, depth int")
    above = C.parents(nodes, "tree", "ord", "depth", 4)
    assert {(r["tree"], r["ord"]): r["parent"] for r in above.collect()} == {("t", 1): None, ("t", 2): 1, ("t", 3): 2, ("t", 4): 1, ("u", 1): None}
    assert {(r["tree"], r["ord"]): r["path"] for r in C.paths(above, "tree", "ord", 4).collect()}["t", 3] == [1, 2, 3]
    hits = lambda *ids: spark.createDataFrame([(1, i, n) for n, i in enumerate(ids)], "query int, id string, rank int")
    assert [r["id"] for r in C.base_then_extra(hits("b", "a"), hits("c", "a")).orderBy("place").collect()] == ["b", "a", "c"]
    assert [r["line"] for r in C.markdown(spark.createDataFrame([("x", 2)], "k string, n int"), ["k"]).orderBy("place").collect()] == ["| k | n |", "|-|-|", "| x | 2 |"]


def test_records_and_sinks(spark, tmp_path):
    body = "abc def"
    unit = lambda a, b, t: [(a, b, t)]
    raw = spark.createDataFrame([("s1", "1/2024", "t", body, unit(0, 3, "abc")), ("s2", None, "t", body, unit(0, 3, "abc")), ("s3", "2", "t", body, unit(1, 3, "abc")), ("s4", "3", "t", " ", None), ("s5", "4", "t", body, None)], "slug string, number string, title string, body string, units array<struct<char_start:int,char_end:int,text:string>>")
    assert {r["slug"]: r["reason"] for r in readers.judged_records(raw).collect()} == {"s1": None, "s2": "no number", "s3": "broken offsets", "s4": "no text", "s5": "no units"}
    path = str(tmp_path / "rows")
    assert readers.read_or_empty(spark, path, "a int").count() == 0
    writers.append_rows(spark.createDataFrame([(1,)], "a int"), path)
    writers.append_rows(spark.createDataFrame([(2, "x")], "a int, b string"), path)
    assert {tuple(r) for r in writers.read_appended(spark, path).select("a", "b").collect()} == {(1, None), (2, "x")}
    doc = lambda *ids: spark.createDataFrame([(i,) for i in ids], "doc string")
    there, missing = writers.forced(doc("a", "b"), doc("b", "c"))
    assert [r[0] for r in there.collect()] == ["b"] and [r[0] for r in missing.collect()] == ["a"]
    urls = spark.createDataFrame([("https://x/y/thong-tu-ngân-hang--12",), ("https://x/y/khac",)], "url string")
    assert readers.slug_search(urls, "Ngân hàng").count() == 1


def test_grounding(spark):
    units = spark.createDataFrame([(1, 0, 0, 10, "abc def gh"), (1, 1, 11, 20, "xyz uvw q")], "id int, uid int, start int, end int, text string")
    claims = spark.createDataFrame([(1, [0, 1], "uvw")], "id int, uids array<int>, quote string")
    assert tuple(X.grounded(claims, units).first()) == (1, 15, 18)
    assert tuple(X.grounded(claims.withColumn("uids", F.array(F.lit(0), F.lit(7))), units).first()) == (1, None, None)


def test_routes_are_the_same_whatever_is_said_and_ties_have_one_answer(spark):
    edges = spark.createDataFrame([
        ("Q#than/dieu_1", "N#than/dieu_4", "sua_doi", "2024-01-01", 1, 100, 200, "x"), ("Q#than/dieu_1", "N#than/dieu_5", "sua_doi", "2024-01-01", 1, 100, 200, "x"),
        ("T#than/dieu_1", "N#than/dieu_4", "bai_bo", "2024-01-01", 1, None, None, None), ("S#than/dieu_1", "N#than/dieu_4", "bai_bo", "2024-01-01", 1, None, None, None)], EDGE)
    chunks = spark.createDataFrame([("N::Điều 4", "N", None, None), ("N::Điều 9", "N", None, None), ("Q::Điều 1", "Q", 150, 160), ("N::lạ", "N", None, None)], "chunk_id string, number string, span_start int, span_end int")
    at = lambda say: {r["chunk_id"]: (r["key"], r["route"], r["target_key"], r["op"]) for r in O.routed(chunks, edges, "2025-01-01", say).collect()}
    assert at("none") == at("quoted") == at("all")
    assert {r["citation"] for r in O.routed(chunks, edges, "2025-01-01", "quoted").collect()} == {None, "N Điều 4 và N Điều 5"}
    assert {r["source_key"] for r in O.impacts(edges.orderBy("source_key"), "2025-01-01").where("key = 'N#than/dieu_4'").collect()} == {"T#than/dieu_1"} == {r["source_key"] for r in O.impacts(edges.orderBy(F.desc("source_key")), "2025-01-01").where("key = 'N#than/dieu_4'").collect()}
