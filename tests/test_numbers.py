"""Official numbers: what is one, what is mended, what is only told, and what is refused."""

from tempora.operators import numbers as N

#: text: (number, type, agencies, term, normative, warnings), or None
CASES = {
    "52/2024/NĐ-CP": ("52/2024/NĐ-CP", "NĐ", ["CP"], None, True, []),
    "15a/2025/NĐ-CP": ("15a/2025/NĐ-CP", "NĐ", ["CP"], None, True, []),
    "025/2024/QĐ-SHB": ("025/2024/QĐ-SHB", "QĐ", ["SHB"], None, None, []),
    "123/CT-NHNN": ("123/CT-NHNN", "CT", ["NHNN"], None, False, []),
    "5/TT-NHNN": ("5/TT-NHNN", "TT", ["NHNN"], None, False, []),
    "123/QĐ-TTG": ("123/QĐ-TTg", "QĐ", ["TTg"], None, None, []),
    "45/2025/ttr-BTC": ("45/2025/TTr-BTC", "TTr", ["BTC"], None, False, []),
    "01/2020/TTLT-BTC-BNV": ("01/2020/TTLT-BTC-BNV", "TTLT", ["BTC", "BNV"], None, True, []),
    "01/2020/TT-BTC-BNV": ("01/2020/TT-BTC-BNV", "TT", ["BTC", "BNV"], None, True, ["several_agencies"]),
    "59/2020/QH14": ("59/2020/QH14", None, ["QH"], "14", True, []),
    "7/2020/ubtvqh15": ("7/2020/UBTVQH15", None, ["UBTVQH"], "15", True, []),
    "51/2025/TT-BTС": ("51/2025/TT-BTC", "TT", ["BTC"], None, True, ["lookalike"]),
    "9/2025/TT-ХYZ": ("9/2025/TT-XYZ", "TT", ["XYZ"], None, True, ["lookalike", "unknown_agency"]),
    "1/2020/ZZ-CP": ("1/2020/ZZ-CP", "ZZ", ["CP"], None, None, ["unknown_type"]),
    "Số 21/2017/TT- NHNN về": ("21/2017/TT-NHNN", "TT", ["NHNN"], None, True, ["glued"]),
    "Số 21/2017/TT-\n BTC-BNV": ("21/2017/TT-BTC-BNV", "TT", ["BTC", "BNV"], None, True, ["glued", "several_agencies"]),
    "21/2017/TT- Quy định": None,
    "21/2017/TT- Quy định 3/2018/NĐ-CP": ("3/2018/NĐ-CP", "NĐ", ["CP"], None, True, []),
    "TT 30/2025/TT-NHNN sửa đổi 15/2024/TT-NHNN": ("30/2025/TT-NHNN", "TT", ["NHNN"], None, True, []),
    "51/2025/TT": None, "52/2024": None, "52/2024/NDCP": None, "21/2017/TT-": None, "52/2024/-CP": None, "52/2024/NĐ--CP": None, "": None, "không phải": None,
}


def test_titles(spark):
    df = spark.createDataFrame([*((i, t) for i, t in enumerate(CASES)), (-1, None)], "id int, title string")
    got = {r["id"]: r for r in N.title_numbers(df, "id", "title", N.vocabulary(spark)).collect()}
    assert len(got) == len(CASES) + 1 and got[-1]["number"] is None
    for i, (text, want) in enumerate(CASES.items()):
        r = got[i]
        assert (want or (None,) * 6) == (r["number"], r["type"], r["agencies"], r["term"], r["normative"], r["warnings"]), text
