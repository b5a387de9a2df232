"""Page marks and repeated units: named cases, and random texts against looking at every earlier line."""

import random
import re

from tempora.operators import badges as B

TEXT = "\n".join(
    [
        "1. trước điều", "Điều khoản bị bãi bỏ", "Điều 1. Tên", "1. một", "Điều khoản được sửa đổi", "Điều khoản bị thay", "2. hai", "a) x", "a) x", "2. hai", "a) x", "2. khác", "1. một",
        "“mở", "1. một", "a) x”", "3.liền", "Điều 2. Tên", "1. một", "  b) y ", "Điều khoản bị cuối",
    ]
)


def test_named_cases(spark):
    df = spark.createDataFrame([("t", TEXT), ("null", None), ("empty", "")], "id string, text string")
    lines = B.marked_lines(df, "id", "text").collect()
    assert {r["id"] for r in lines} == {"t", "empty"}
    rows = sorted((r for r in lines if r["id"] == "t"), key=lambda r: r["line_no"])
    assert [r["line_no"] for r in rows if not r["kept"]] == [1, 4, 5, 8, 9, 10, 12, 20]
    assert [r["line_no"] for r in rows if r["differs"]] == [11] and [r["line_no"] for r in rows if r["glued"]] == [16]
    assert [r["level"] for r in rows if r["line_no"] in (0, 2, 14, 15)] == ["other", "article", "clause", "point"]
    marked = spark.createDataFrame(rows)
    got = sorted(tuple(r) for r in B.badge_labels(marked, "id").select("line_no", "badge", "article", "level", "number").collect())
    assert got == [(1, "Điều khoản bị bãi bỏ", "1", "article", "1"), (4, "Điều khoản được sửa đổi", "1", "clause", "2"), (5, "Điều khoản bị thay", "1", "clause", "2")]
    kept = [line for i, line in enumerate(TEXT.split("\n")) if i not in (1, 4, 5, 8, 9, 10, 12, 20)]
    assert B.cleaned_texts(marked, "id").first()["text"] == "\n".join(kept)


def judged(text):
    """Whether each line stays: every earlier line is looked at."""
    lines, out = text.split("\n"), []
    whole = [line.strip() for line in lines]
    for i, said in enumerate(whole):
        depth = straight = 0
        for c in "\n".join(lines[:i]):
            depth = max(depth + (c == "“") - (c == "”"), 0)
            straight ^= c == '"'
        top = max((j for j in range(i + 1) if re.match(r"Điều\s+\d+\s*\.", whole[j])), default=None)
        number, letter = re.match(r"(\d+[a-z]?)\.\s", said), re.match(r"([a-zđ])\)\s", said)
        clause, keeps = None, not re.match(r"Điều khoản (được|bị)\s", said)
        if keeps and top is not None and top < i and not depth and not straight:
            earlier = [r for r in out if r["i"] > top and r["own"]]
            clause = next((r["number"] for r in reversed(earlier) if r["number"] and r["keeps"]), None)
            if number:
                keeps = next((r["said"] for r in reversed(earlier) if r["number"] == number[1]), None) != said
            elif letter:
                keeps = not any(r["said"] == said and r["clause"] == clause for r in earlier if not r["number"])
            own = bool(number or letter)
        else:
            own, number = False, None
        out.append({"i": i, "said": said, "own": own, "number": number and number[1], "clause": clause, "keeps": keeps})
    return [r["keeps"] for r in out]


def test_random_texts(spark):
    deal = random.Random(7)
    parts = ["Điều 1. a", "Điều 2. b", "1. x", "1. y", "2. x", "2a. x", "a) p", "b) p", "a) q", "Điều khoản bị z", "“k", "k”", 'n"', "", " 1. x", "chữ", "3.z", "”"]
    texts = {str(n): "\n".join(deal.choice(parts) for _ in range(deal.randint(1, 40))) for n in range(150)}
    rows = B.marked_lines(spark.createDataFrame(list(texts.items()), "id string, text string"), "id", "text").collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["line_no"]):
        got.setdefault(r["id"], []).append(r["kept"])
    wrong = [texts[n] for n in texts if got[n] != judged(texts[n])]
    assert not wrong, wrong[0]
