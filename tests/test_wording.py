"""Claims against the texts they cite: named cases, and random pairs against counting one by one."""

import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tempora.operators import wording as W

PAIR = "id string, claim string, source string, evidence string, article int, clause int"
THIS = "Quy định tại khoản 1 Điều này không áp dụng đối với"
CASES = {
    "duty": ("tổ chức phải nộp báo cáo", "tổ chức nộp báo cáo", None, 0, 0),
    "spread": ("không được nhận tiền, không được cấp tín dụng, không được trả lãi", "không được nhận tiền; không được phép cấp tín dụng, trả lãi", "", 0, 0),
    "synonym": ("phải tạm dừng dịch vụ khi có dấu hiệu", "Ngân hàng phải tạm dừng dịch vụ trong trường hợp có dấu hiệu", "", 0, 0),
    "number": ("vốn tối thiểu 500 tỷ đồng", "vốn tối thiểu 50 tỷ đồng", "", 0, 0),
    "same": ("vốn 1.000 tỷ, 007", "vốn 1000 tỷ, 7", "", 0, 0),
    "soft": ("đáp ứng các điều kiện cấp phép", "khi đáp ứng các điều kiện cấp phép", "", 0, 0),
    "turned": ("phải đáp ứng đầy đủ và phải đảm bảo", "không phải là ngân hàng được cấp phép khi đáp ứng đầy đủ và phải đảm bảo", "phải đáp ứng", 0, 0),
    "copied": ("cảnh báo về hành vi không được thực hiện và xác nhận", "cảnh báo về các hành vi không được thực hiện khi mở tài khoản và xác nhận", "", 0, 0),
    "this": ("Quy định tại khoản 1 Điều 26", THIS, "", 26, 2),
    "other": ("Quy định tại khoản 1 Điều 27", THIS, "", 26, 2),
    "unsaid": ("Quy định tại khoản 1 Điều 26", "Quy định tại khoản 1 không áp dụng", "", 26, 2),
    "elsewhere": ("Quy định này áp dụng cho 26 tổ chức", THIS, "", 26, 2),
    "both": ("khoản 1 Điều 26 áp dụng cho 500 tỷ", THIS, "", 26, 2),
    "zero": ("quy định tại khoản 0 Điều này", "quy định tại khoản này", "", 26, 0),
    "wide": ("tổ chức phải nộp 30 tỷ và 40 tỷ", "tổ chức nộp", "tổ chức phải nộp 30 tỷ", 0, 0),
    "empty": (None, "tổ chức phải nộp 5", None, None, None),
    "nothing": (None, None, None, None, None),
}


def pairs(spark, cases):
    return spark.createDataFrame([(k, *v) for k, v in cases.items()], PAIR)


def test_named_cases(spark):
    got = {r["id"]: r for r in W.wording_deltas(pairs(spark, CASES), "id").collect()}
    assert set(got) == set(CASES)
    blamed = {k: (r["invented"], r["numbers"], r["turned_duty"]) for k, r in got.items() if r["invented"] or r["numbers"] or r["turned_duty"]}
    assert blamed == {
        "duty": (["obligation"], [], False), "number": ([], ["500"], False), "turned": ([], [], True), "other": ([], ["27"], False), "unsaid": ([], ["26"], False),
        "elsewhere": ([], ["26"], False), "both": ([], ["500"], False), "zero": ([], ["0"], False), "wide": ([], ["40"], False),
    }
    assert {k: r["notes"] for k, r in got.items() if r["notes"]} == {"this": ["number:26:unit"], "both": ["number:26:unit"], "wide": ["group:obligation:evidence", "number:30:evidence"]}
    assert got["soft"]["lost"] == got["copied"]["lost"] == ["condition:khi"] and got["turned"]["added"] == []
    assert got["spread"]["lost"] == ["prohibition:không được phép"] and got["spread"]["added"] == ["prohibition:không được"]
    assert got["empty"]["lost"] == ["obligation:phải"] and got["nothing"]["lost"] == []


def test_markers_are_whole_words_and_the_longest(spark):
    texts = ["Tổ chức KHÔNG ĐƯỢC kết nối", "không được phép; cấm", "cẩm nang, nghiêm cấm x_cấm cấm1", "buộc phải khi, nếu", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = [r["m"] for r in df.orderBy("n").select(W.markers(F.col("t")).alias("m")).collect()]
    assert got == [["không được"], ["không được phép", "cấm"], ["nghiêm cấm"], ["buộc phải", "khi", "nếu"], [], None]


def test_edits(spark):
    long = "Trường hợp thay đổi một trong các nội dung sau: tên tổ chức, địa điểm, đã được cấp phép, kết nối"
    cases = {
        "turn": ("tổ chức phải nộp", "tổ chức khi nộp", "họ phải nộp", 0, 0), "grow": ("tổ chức phải nộp ngay", "tổ chức nộp", "nộp, ngay", 0, 0),
        "part": ("bên được giao", "bên không được giao", "", 0, 0), "long": ("khi đổi", long, "", 0, 0), "equal": ("y hệt", "Y  hệt", None, 0, 0), "null": (None, "a", None, 0, 0),
    }
    got = [tuple(r) for r in W.judged_edits(pairs(spark, cases), "id").orderBy("id", "at").collect()]
    assert [g for g in got if g[0] in ("turn", "grow", "part", "null")] == [
        ("grow", 2, "insert", "", "phải", False, False), ("grow", 3, "insert", "", "ngay", False, True), ("null", 0, "delete", "a", "", False, True),
        ("part", 1, "delete", "không", "", False, True), ("turn", 2, "replace", "khi", "phải", True, True),
    ]
    assert not any(g[5] for g in got if g[0] == "long") and not [g for g in got if g[0] == "equal"]
    said = pairs(spark, cases).select("id", W.explained(W.aligned_edits("source", "claim"), 1).alias("x"))
    assert {r["id"]: r["x"] for r in said.collect() if r["id"] != "long"} == {"turn": "khi → phải", "grow": "+ phải; …", "part": "- không", "equal": "", "null": "- a"}


def counted(text):
    """Markers and numbers of a text, found by trying every place."""
    text, group = (text or "").lower(), {m: g for g, ms in W.LEXICON.items() for m in ms}
    letter, found, numbers, i = lambda c: c.isalnum() or c == "_", Counter(), Counter(), 0
    while i < len(text):
        fit = [m for m in group if text.startswith(m, i) and not (i and letter(text[i - 1])) and not letter(text[i + len(m) : i + len(m) + 1] or " ")]
        best = max(fit, key=len, default="")
        found.update([best] if best else [])
        i += len(best) or 1
    for n in re.findall(r"\d+(?:[.,]\d+)*", text):
        numbers[str(int(re.sub(r"\D", "", n)))] += 1
    return found, numbers, {group[m] for m in found}, group


def test_random_pairs(spark):
    deal = random.Random(3)
    words = ["phải", "không", "được", "phép", "khi", "nếu", "trong", "trường hợp", "cấm", "nghiêm", "nộp", "tối đa", "5", "05", "5.0", "7", "Điều này", "Điều 7", "khoản 5", "x,", "Khi"]
    text = lambda: " ".join(deal.choice(words) for _ in range(deal.randint(0, 9)))
    cases = {str(n): (text(), text(), text(), deal.choice([0, 5, 7]), deal.choice([0, 5])) for n in range(400)}
    for r in W.wording_deltas(pairs(spark, cases), "id").collect():
        claim, source, evidence, article, clause = cases[r["id"]]
        (c, cn, cg, group), (s, sn, sg, _), (_, en, eg, _) = counted(claim), counted(source), counted(evidence)
        label = lambda m: f"{group[m]}:{m}"
        assert r["added"] == sorted(map(label, c - s)) and r["lost"] == sorted(map(label, s - c))
        assert set(r["invented"]) == (cg - sg - eg) & set(W.HARD)
        own = {str(n) for n, w in ((article, "Điều"), (clause, "khoản")) if n and f"{w} này" in source and re.search(rf"{w} 0*{n}(?!\d)", claim)}
        assert r["numbers"] == sorted(n for n in cn - sn if n not in own and cn[n] > en[n])
        hard = [(m, (re.findall(r"\w+|[^\s\w]", claim.lower()[e:]) or [""])[0]) for m, e in places(claim) if group[m] in W.HARD]
        loose = any(f"{m} {after}".rstrip() not in source.lower() for m, after in hard)
        assert r["turned_duty"] == (loose and any(group[m] == "condition" for m in s - c) and "condition" not in cg), cases[r["id"]]


def places(text):
    """(marker, end) of each marker in order."""
    all_ = sorted((m for ms in W.LEXICON.values() for m in ms), key=len, reverse=True)
    return [(m.group(), m.end()) for m in re.finditer(rf"(?<!\w)(?:{'|'.join(all_)})(?!\w)", text.lower())]


def test_a_long_claim_is_counted_in_linear_time(spark):
    said = " ".join(str(n % 50_000) for n in range(100_000))
    rows = [("long", said + " phải 7", said, "", 0, 0), ("long", said + " phải 7", said, "phải", 0, 0)]
    began = time.perf_counter()
    got = W.wording_deltas(spark.createDataFrame(rows, PAIR), "id").orderBy("invented").collect()
    assert [(r["invented"], r["numbers"], r["lost"]) for r in got] == [([], ["7"], []), (["obligation"], ["7"], [])]
    assert time.perf_counter() - began < 30
