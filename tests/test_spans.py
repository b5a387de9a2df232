"""Span joins, painted pieces, quotations and offsets against plain loops."""

import random
import time

from pyspark.sql import functions as F

from tempora.operators import pages as G
from tempora.operators import positional as P
from tempora.operators import quotes as Q
from tempora.operators import segments as X
from tempora.operators import span_joins as J


def test_spans_meet_once(spark):
    rng = random.Random(1)
    sides = []
    for _ in range(2):
        rows = []
        for _ in range(250):
            a = rng.choice([rng.randrange(300), rng.randrange(100_000)])
            rows.append((rng.randrange(3), a, a + rng.choice([0, 1, 5, 63, 64, 65, 500, 5000, 90_000, -1])))
        sides.append(rows + [(1, None, 5), (1, 0, 1 << 30)])
    left, right = (spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"{p}k int, doc int, {p}a int, {p}b int") for rows, p in zip(sides, "lr"))
    got = [tuple(r) for r in J.met(left, right, ["doc"], ("la", "lb"), ("ra", "rb")).select("lk", "rk").collect()]
    sound = lambda r: r[1] is not None and r[1] <= r[2]
    want = [(i, j) for i, x in enumerate(sides[0]) for j, y in enumerate(sides[1]) if x[0] == y[0] and sound(x) and sound(y) and x[1] <= y[2] and y[1] <= x[2]]
    assert sorted(got) == sorted(want)


def test_measured_spans_are_listed_where_the_other_side_has_some(spark):
    rows = [(k, k % 4, (k * 37) % 900, (k * 37) % 900 + w) for k, w in enumerate([0, 3, 63, 64, 150, 500, 511, 40] * 12)]
    left, right = (spark.createDataFrame([r for r in rows if r[3] - r[2] <= long], f"{p}k int, doc int, {p}a int, {p}b int") for p, long in (("l", 100), ("r", 600)))
    pairs = lambda **more: J.met(left, right, ["doc"], ("la", "lb"), ("ra", "rb"), **more)
    got = sorted((r["lk"], r["rk"]) for r in pairs(measured=True).collect())
    assert got == sorted((r["lk"], r["rk"]) for r in pairs().collect()) and got
    assert got == sorted((x[0], y[0]) for x in rows for y in rows if x[3] - x[2] <= 100 and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    none = left.limit(0)
    assert J.met(none, right, ["doc"], ("la", "lb"), ("ra", "rb"), True).isEmpty()


def brute_painted(text, spans):
    sound = [s for s in spans if 0 <= s[0] < s[1] <= len(text)]
    edges = sorted({0, len(text), *(x for s in sound for x in s[:2])})
    out = []
    for a, b in zip(edges, edges[1:]):
        over = sorted((e - s, s, e, r) for s, e, r in sound if s <= a and e >= b)
        out.append((a, b, over[0][3] if over else None, len(over) > 1, text[a:b]))
    return out


def test_painted_pieces(spark):
    rng = random.Random(2)
    texts, spans, want = [], [], []
    for k in range(40):
        text = "é" + "x" * rng.randrange(200)
        own = [(a := rng.randrange(-3, 205), a + rng.randrange(-2, 120), rng.choice("pqr")) for _ in range(rng.randrange(12))]
        texts.append((k, text))
        spans += [(k, *s) for s in own]
        want += [(k, *p) for p in brute_painted(text, own)]
    got = G.painted(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(spans, "id int, start int, end int, role string"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_a_hundred_thousand_nested_spans(spark):
    """Spans that all hold each other, of one document: pairs of spans and pieces would be ten thousand million."""
    n = 100_000
    texts = spark.range(1).select(F.col("id").cast("int").alias("id"), F.repeat(F.lit("x"), F.lit(2 * n)).alias("text"))
    spans = spark.range(n).select(F.lit(0).alias("id"), F.col("id").cast("int").alias("start"), (2 * n - F.col("id")).cast("int").alias("end"), F.col("id").cast("string").alias("role"))
    began = time.perf_counter()
    row = G.painted(texts, spans).agg(F.count(F.lit(1)).alias("n"), F.count_if("shared").alias("shared"), F.sum(F.col("role").cast("long")).alias("roles")).first()
    assert (row["n"], row["shared"]) == (2 * n - 1, 2 * n - 3)
    assert row["roles"] == 2 * sum(range(n - 1)) + (n - 1)
    assert time.perf_counter() - began < 90


FRAGMENTS = ["“", "”", '"', "a", "b c", "\n", "Điều 1. x", "Điều 2a: y", "Chương II", "Mục 3", "1. foo", "a) bar", "đ) baz", "2. qux", "Nơi nhận:", " ", "", "\n\n", "\n“Điều 5. q”\n"]
LINES = ["Điều 3. t", "Điều 4", "Chương I", "Mục 2", "1. c", "a) p", "text", "“q", "q”", '"x"', " 2a. z", "Nơi nhận: x", "PHỤ LỤC"]


def test_quotations_and_units_are_those_of_the_loops(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randrange(25))) for _ in range(300)] + ["", "“", "”", "a“b”c", "“\n”\n1. x"]
    texts += ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(14))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").cache()

    def rows(frame, *columns):
        return sorted(((r["id"], *(r[c] for c in columns)) for r in frame.collect()), key=str)

    def plain(function):
        return sorted(((i, *x) for i, t in enumerate(texts) for x in function(t)), key=str)

    def masks(t):
        mask = X.quote_mask(t)
        return [(n, a < len(t) and mask[a]) for n, (a, _) in enumerate(X.lines_of(t))]

    assert rows(Q.masked_lines(df, "id", "text"), "line_no", "masked") == plain(masks)
    assert rows(Q.quotations(df, "id", "text"), "char_start", "char_end") == plain(X.quote_spans)
    assert rows(Q.article_rows(df, "id", "text"), "article", "body", "chapter", "section", "char_start", "char_end") == plain(X.articles)
    loops = lambda t: [(k[2:], kind, p[2:] or None, a, b) for k, kind, p, a, b in X.units(t, "K")]
    assert rows(Q.unit_rows(df, "id", "text"), "unit", "kind", "parent", "char_start", "char_end") == plain(loops)


def test_a_document_of_many_lines(spark):
    lines = ["x" * (i % 7) for i in range(200_000)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, ""), (4, "é\n日本\n")], "id int, text string")
    began = time.perf_counter()
    got = P.lines_with_offsets(df, "text").select("id", "line_no", "line", "start").collect()
    assert time.perf_counter() - began < 20
    at, want = 0, []
    for n, line in enumerate(lines):
        want.append((n, line, at))
        at += len(line) + 1
    assert [(r["line_no"], r["line"], r["start"]) for r in got if r["id"] == 1] == want
    assert [(r["id"], r["line_no"], r["line"], r["start"]) for r in got if r["id"] > 1] == [(3, 0, "", 0), (4, 0, "é", 0), (4, 1, "日本", 2), (4, 2, "", 5)]


def test_gaps_of_any_width(spark):
    df = spark.createDataFrame([(1, [1, 1_000_000_000]), (2, [3, 1, 3, 7, None]), (3, []), (4, None), (5, [4])], "k int, xs array<long>")
    gaps = {r["k"]: r["g"] and [tuple(g) for g in r["g"]] for r in df.select("k", P.number_gaps(F.col("xs")).alias("g")).collect()}
    assert gaps == {1: [(2, 999_999_999)], 2: [(2, 2), (4, 6)], 3: None, 4: None, 5: []}
    missing = P.missing_numbers(df.where("k > 1"), F.col("xs"), ["k"], "n")
    assert sorted(map(tuple, missing.collect())) == [(2, 2), (2, 4), (2, 5), (2, 6)]
    wide = spark.createDataFrame([(1, [1, 50_002])], "k int, xs array<long>")
    assert P.missing_numbers(wide, F.col("xs"), ["k"], "n").agg(F.count("n"), F.min("n"), F.max("n")).first()[:] == (50_000, 2, 50_001)
