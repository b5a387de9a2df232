"""Pages and conditions of records on hand-written rows, with expectations worked out by hand."""

import difflib
import random
import re

from pyspark.sql import functions as F

from tempora.functions import pages as W
from tempora.functions.text import marker_groups
from tempora.operators import conditions as K
from tempora.operators import pages as G


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in values))
    return row.select(column.alias("x")).first()["x"]


def lines(spark, text):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "id int, line_no int, line string")


def test_a_relation_tab_counts_its_titles(spark):
    text = "Căn cứ (2)\n A \n--\n\nB\nC\nThay thế (3)\nD\nHợp nhất (1)\nE\nVĂN BẢN ĐANG XEM: x\nno title\nCăn cứ (1)\nF\nG\nCăn cứ (1)\nH"
    got = {(r["direction"], r["category"]): r["titles"] for r in G.relation_tab(lines(spark, text)).collect()}
    assert got == {("outgoing", "Căn cứ"): ["A", "B"], ("outgoing", "Thay thế"): ["D"], ("outgoing", "Hợp nhất"): ["E"], ("incoming", "Căn cứ"): ["H"]}
    assert G.relation_tab(lines(spark, "no category\nat all")).collect() == []


def test_properties_and_bodies(spark):
    cells = spark.createDataFrame([(1, 0, "Loại\n Luật "), (1, 1, "Số\n--"), (1, 2, "Lạ\nx"), (1, 3, "Loại\nNghị định"), (2, 0, None), (2, 1, "Số")], "id int, ord int, cell string")
    got = {(r["id"], r["key"]): r["value"] for r in G.properties(cells, {"Loại": "type", "Số": "number"}).collect()}
    assert got == {(1, "type"): "Nghị định", (1, "number"): "", (2, "number"): ""}
    labels = ["a", "b", "c", "d"]
    body = lambda text: one(spark, W.page_body(F.col("text"), "Tải về", ["In"], labels, r"^Điều \d"), text=text)
    assert body("x\nTải về\ny\n Tải về\n In \n\n Điều 1. z ") == "Điều 1. z"
    assert body("a\nb\nc\nd\nvalue") == "" and body("a\nb\nc\nd\nĐiều 1") == "a\nb\nc\nd\nĐiều 1" and body("a\nb\nc\na") == "a\nb\nc\na"
    assert body(None) is None and body("") == ""


def test_paragraphs_have_the_address_of_their_numbering(spark):
    node = (7, "article", "Điều 5", "2", None, 'lead<br>"4. four :<BR/>a) x<br> <br />đ) y<br>1.000 đồng<br>w) no')
    rows = spark.createDataFrame([node], "id int, level string, article string, clause string, point string, html string")
    got = [(r["level"], r["clause"], r["point"]) for r in G.addressed_paragraphs(rows).orderBy("place").collect()]
    assert got == [("article", "2", None), ("clause", "4", None), ("point", "4", "a"), ("point", "4", "đ"), ("article", "2", None), ("article", "2", None)]


def test_articles_are_cut_at_their_lines(spark):
    text = "lead 7/2024/TT-NHNN\nĐiều 1. one\nin Điều 2 too\nĐiều 11. eleven\nĐiều 1a. more\nend"
    cut = lambda n: one(spark, W.article_text(F.col("text"), F.lit(n)), text=text)
    assert cut("1") == "Điều 1. one\nin Điều 2 too" and cut("11") == "Điều 11. eleven" and cut("1a") == "Điều 1a. more\nend" and cut("2") is None
    assert one(spark, W.head_text(F.col("text"), r"\d+/\d{4}/", r"^Điều \d"), text=text) == "lead 7/2024/TT-NHNN\n---\nlead 7/2024/TT-NHNN"


def test_units_have_the_text_of_what_is_under_them(spark):
    nodes = spark.createDataFrame([(1, 0, None), (1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "tree int, ord int, text string")
    paths = spark.createDataFrame([(1, 0, [0]), (1, 1, [0, 1]), (1, 2, [0, 1, 2]), (1, 3, [0, 3])], "tree int, ord int, path array<int>")
    got = {r["ord"]: r["full_text"] for r in G.unit_texts(nodes, paths, "tree", "ord", "text").collect()}
    assert got == {0: "a\nb\nc", 1: "a\nb", 2: "b", 3: "c"}


def test_impacts_are_numbered_in_document_order(spark):
    rows = spark.createDataFrame([("Điều 10", None, None), ("Điều 2", "3", "đ"), ("Điều 2", "3", "d"), ("Điều 2", None, None), ("Điều 2a", "1", None), ("Phụ lục", None, None)], "article string, clause string, point string")
    got = [(r["article"], r["point"]) for r in G.numbered_impacts(rows.withColumn("doc", F.lit(1)), "doc").orderBy("stt").collect()]
    assert got == [("Điều 2", None), ("Điều 2", "d"), ("Điều 2", "đ"), ("Điều 2a", None), ("Điều 10", None), ("Phụ lục", None)]


def test_the_narrowest_span_paints(spark):
    texts = spark.createDataFrame([(1, "abcdefghij"), (2, "xy"), (3, "")], "id int, text string")
    spans = spark.createDataFrame([(1, 0, 6, "wide"), (1, 2, 4, "narrow"), (1, 8, 99, "past the end"), (1, None, 3, "lost")], "id int, start int, end int, role string")
    got = {(r["id"], r["piece"]): (r["role"], r["shared"]) for r in G.painted(texts, spans).collect()}
    assert got == {(1, "ab"): ("wide", False), (1, "cd"): ("narrow", True), (1, "ef"): ("wide", False), (1, "ghij"): (None, False), (2, "xy"): (None, False)}


def test_points_come_from_units_not_from_claims(spark):
    units = spark.createDataFrame([("c", 1, "a"), ("c", 2, "b"), ("c", 3, None), ("d", 1, None)], "clause string, uid int, point string")
    claims = spark.createDataFrame([(1, "c", "b"), (2, "c", "a"), (3, "c", "a"), (4, "d", "a"), (5, "c", " ")], "id int, clause string, claimed string")
    picks = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (2, 2), (3, 3), (4, 1)], "id int, uid int")
    got = {r["id"]: (r["point"], r["warning"]) for r in K.derived_points(claims, picks, units).collect()}
    assert got == {1: ("a", None), 2: (None, "several"), 3: (None, "outside"), 4: (None, None), 5: (None, None)}


def test_gates(spark):
    gate = lambda text: one(spark, K.gate_clause(F.col("text")), text=text)
    said = gate("Luật có hiệu lực thi hành kể từ ngày 1 tháng 7 năm 2024.")
    assert (said["bound"], str(said["day"]), said["note"]) == ("start", "2024-07-01", "")
    assert gate("có hiệu lực đến hết ngày 31 tháng 2 năm 2024")[:] == ("end", None, "invalid")
    assert gate("hết hiệu lực khi luật mới có hiệu lực")[:] == ("end", None, "relative") and gate("không gì") is None and gate(None) is None


def test_records_of_gates_without_actors_need_no_subject(spark):
    rows = spark.createDataFrame([(1, "meta", ["thoi_gian", "lanh_tho"], 0), (2, "meta", ["thoi_gian", "chu_the"], 0), (3, "meta", [], 0), (4, "actor", ["thoi_gian"], 0), (5, "meta", ["thoi_gian"], 2), (6, None, None, None)], "id int, role string, kinds array<string>, n int")
    got = {r["id"]: (r["s"], r["c"]) for r in rows.select("id", K.no_subject(F.col("role"), F.col("kinds")).alias("s"), K.no_conditions(F.col("role"), F.col("kinds"), F.col("n")).alias("c")).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False), 5: (True, False), 6: (False, False)}


def test_swapped_markers_are_flips(spark):
    said = lambda s, c: [tuple(x) for x in one(spark, K.flips(K.word_changes(F.col("s"), F.col("c"))), s=s, c=c)]
    assert said("The bank may lend to others", "The bank must lend to others") == [("may", "must")]
    assert said("The bank may lend", "The bank may borrow") == [] and said(None, "must") == [] and said("", "") == []
    assert said("x may a b c d e f g y", "x must h i j k l m n y") == []


def test_flips_are_those_of_looking_at_every_change(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["may", "must", "bank", "if", "lend", "a"])
    pairs = [(" ".join(word() for _ in range(rng.randrange(9))), " ".join(word() for _ in range(rng.randrange(9)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "s string, c string").withColumn("x", K.word_changes("s", "c"))
    rows = df.select("s", "c", K.flips(F.col("x")).alias("f")).collect()
    groups = {r["w"]: r["g"] for r in spark.createDataFrame([(" ".join(p),) for s, c in pairs for p in runs(s, c)] or [("",)], "w string").distinct().select("w", marker_groups(F.col("w")).alias("g")).collect()}
    for r in rows:
        want = []
        for a, b in zip(*[iter(runs(r["s"], r["c"]))] * 2):
            s, c = " ".join(a), " ".join(b)
            if max(len(a), len(b)) <= K.FLIP_WORDS and groups[s] and groups[c] and groups[s] != groups[c]:
                want.append((len(a) + len(b), s, c))
        assert [tuple(x) for x in r["f"]] == [(s, c) for _, s, c in sorted(want)]


def runs(s, c):
    """The replaced runs of two texts, source and claim in turn."""
    a, b = (re.findall(r"\w+", x) for x in (s, c))
    return [run for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes() if kind == "replace" for run in (a[i:j], b[k:m])]
