"""Sentences of documents as claims about the sentence before, and clauses of orders restated with other markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import wording as W
from tempora.plans.catalog import query
from tempora.session import table

#: What words of so many characters become in the sentences.
_SAID = {7: "phải", 8: "khi", 9: "không được", 10: "được", 11: "tối đa", 12: "Điều này", 13: "nghiêm cấm"}
_GROUP = {"phải": "obligation", "khi": "condition", "không được": "prohibition", "được": "permission", "tối đa": "quantity", "nghiêm cấm": "prohibition"}
_WORDS = " ".join(f"WHEN {n} THEN '{w}'" for n, w in _SAID.items())
_GROUPS = " ".join(f"WHEN '{w}' THEN '{g}'" for w, g in _GROUP.items())


@query(rf"""WITH d AS (SELECT doc_id, regexp_split_to_array(text, '[.\n]+') AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, trim(regexp_replace(unnest(l), '[\s\p{{Z}}]+', ' ', 'g')) AS s, generate_subscripts(l, 1) - 1 AS i FROM d),
y AS (SELECT doc_id, i, list_transform(string_split(s, ' '), lambda w: CASE length(w) {_WORDS} WHEN 6 THEN 'Điều ' || CAST(length(s) % 5 + 1 AS VARCHAR) WHEN 5 THEN CAST(length(s) % 7 AS VARCHAR) ELSE w END) AS ws FROM x),
e AS (SELECT doc_id, i, lag(ws, 0) OVER w AS c, lag(ws) OVER w AS s, lag(ws, 2) OVER w AS v FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, 'c' AS side, unnest(c) AS w FROM e UNION ALL SELECT doc_id, i, 's', unnest(s) FROM e UNION ALL SELECT doc_id, i, 'v', unnest(v) FROM e),
m AS (SELECT doc_id, i, w AS m, CASE w {_GROUPS} END AS g, count(*) FILTER (WHERE side = 'c') AS c, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 'v') AS v FROM t WHERE w IN ({", ".join(f"'{w}'" for w in _GROUP)}) GROUP BY doc_id, i, w),
k AS (SELECT doc_id, i, list_sort(list(g || ':' || m) FILTER (WHERE c > s)) AS added, list_sort(list(g || ':' || m) FILTER (WHERE c < s)) AS lost, list_sort(list(DISTINCT g) FILTER (WHERE c > 0)) AS cg, list(g) FILTER (WHERE s > 0) AS sg, list(g) FILTER (WHERE v > 0) AS vg FROM m GROUP BY doc_id, i),
b AS (SELECT doc_id, i, list_filter(cg, lambda g: g IN ('obligation', 'prohibition') AND NOT list_contains(coalesce(sg, []), g)) AS brought, coalesce(vg, []) AS vg, added, lost, cg FROM k),
r AS (SELECT doc_id, i, side, unnest(regexp_extract_all(w, '[0-9]+(?:[.,][0-9]+)*')) AS raw FROM t),
n AS (SELECT doc_id, i, regexp_replace(regexp_replace(raw, '[.,]', '', 'g'), '^0+([0-9])', '\1') AS n, count(*) FILTER (WHERE side = 'c') AS c, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 'v') AS v FROM r GROUP BY ALL),
u AS (SELECT doc_id, i, list_contains(s, 'Điều này') AND list_contains(c, 'Điều ' || CAST(i % 6 AS VARCHAR)) AND i % 6 > 0 AS own FROM e),
a AS (SELECT n.doc_id, n.i, list_sort(list(n) FILTER (WHERE NOT (own AND n = CAST(n.i % 6 AS VARCHAR)) AND c > v)) AS numbers, list_sort(list('number:' || n || ':evidence') FILTER (WHERE NOT (own AND n = CAST(n.i % 6 AS VARCHAR)) AND c <= v)) AS wide, list('number:' || n || ':unit') FILTER (WHERE own AND n = CAST(n.i % 6 AS VARCHAR)) AS unit FROM n JOIN u ON u.doc_id = n.doc_id AND u.i = n.i WHERE c > s GROUP BY n.doc_id, n.i),
f AS (SELECT doc_id, i, lower(array_to_string(s, ' ')) AS st, unnest(c) AS w, unnest(c[2:] || ['']) AS nx FROM e),
o AS (SELECT doc_id, i, bool_or(NOT contains(coalesce(st, ''), rtrim(w || ' ' || regexp_extract(lower(nx), '[\p{{L}}\p{{N}}_À-ỹ]+|[^\s\p{{L}}\p{{N}}_À-ỹ]')))) AS loose FROM f WHERE w IN ('phải', 'không được', 'nghiêm cấm') GROUP BY doc_id, i)
SELECT e.doc_id, e.i::INTEGER AS sentence, coalesce(array_to_string(added, ','), '') AS added, coalesce(array_to_string(lost, ','), '') AS lost, coalesce(array_to_string(list_filter(brought, lambda g: NOT list_contains(vg, g)), ','), '') AS invented, coalesce(array_to_string(numbers, ','), '') AS numbers,
  coalesce(loose, false) AND coalesce(list_contains(lost, 'condition:khi'), false) AND NOT coalesce(list_contains(cg, 'condition'), false) AS turned_duty,
  array_to_string(list_transform(list_filter(coalesce(brought, []), lambda g: list_contains(vg, g)), lambda g: 'group:' || g || ':evidence') || coalesce(wide, []) || coalesce(unit, []), ',') AS notes
FROM e LEFT JOIN b ON b.doc_id = e.doc_id AND b.i = e.i LEFT JOIN a ON a.doc_id = e.doc_id AND a.i = e.i LEFT JOIN o ON o.doc_id = e.doc_id AND o.i = e.i""")
def sentence_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of all documents as a claim about the one before it, the one before that being its wider evidence."""

    def word(w, s):
        out = w
        for n, said in _SAID.items():
            out = F.when(F.char_length(w) == n, said).otherwise(out)
        out = F.when(F.char_length(w) == 6, F.concat(F.lit("Điều "), (F.char_length(s) % 5 + 1).cast("string"))).otherwise(out)
        return F.when(F.char_length(w) == 5, (F.char_length(s) % 7).cast("string")).otherwise(out)

    # The sentences are an array of their own, so that what depends on a whole sentence isn't worked out anew for each word.
    sentences = F.transform(F.split("text", r"[.\n]+", -1), lambda piece: F.trim(F.regexp_replace(piece, r"[\s\p{Z}]+", " ")))
    told = F.transform(sentences, lambda s: F.array_join(F.transform(F.split(s, " ", -1), lambda w: word(w, s)), " "))
    said = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", told.alias("__said"))
    each = F.transform("__said", lambda s, i: F.struct(i.alias("sentence"), s.alias("claim"), F.get("__said", i - 1).alias("source"), F.get("__said", i - 2).alias("evidence")))
    pairs = said.select("doc_id", F.explode(each).alias("p")).select(F.struct("doc_id", "p.sentence").alias("id"), "p.claim", "p.source", "p.evidence", (F.col("p.sentence") % 6).alias("article"), F.lit(0).alias("clause"))
    lists = ("added", "lost", "invented", "numbers", "notes")
    return W.wording_deltas(pairs, "id").select("id.doc_id", "id.sentence", *(F.array_join(c, ",").alias(c) for c in lists), "turned_duty")


#: Markers by the remainder that picks them, with their groups.
_PICK = (("phải", "obligation"), ("khi", "condition"), ("nếu", "condition"), ("nghiêm cấm", "prohibition"), ("được", "permission"))
_PICKED = lambda c: f"CASE {c} % 5 " + " ".join(f"WHEN {n} THEN '{w}'" for n, (w, _) in enumerate(_PICK)) + " END"
_KIND = lambda c: f"CASE {c} % 5 " + " ".join(f"WHEN {n} THEN '{g}'" for n, (_, g) in enumerate(_PICK)) + " END"


@query(f"""WITH l AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line, {_PICKED("l_partkey")} AS a, {_PICKED("l_suppkey")} AS b, {_KIND("l_partkey")} AS g, {_KIND("l_suppkey")} AS h, l_quantity::INTEGER AS q, l_suppkey % 50 + 1 AS n, lower(l_returnflag) AS f FROM lineitem),
e AS (SELECT line, 2 AS place, a AS source, b AS claim, g <> h AS turned, b IN ('phải', 'được') AS borne FROM l WHERE a <> b UNION ALL SELECT line, CASE WHEN a = 'nghiêm cấm' THEN 5 ELSE 4 END, q::VARCHAR, n::VARCHAR, false, n > 25 FROM l WHERE q <> n)
SELECT line, place, source, claim, turned, borne FROM e""")
def restated_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a clause and as a claim with a marker and a number of its own: the edits, which turn it round, which evidence has."""
    pick = lambda c: F.element_at(F.array(*(F.lit(w) for w, _ in _PICK)), (F.col(c) % 5 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem")
    number, other = F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey") % 50 + 1
    line = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    clause = lambda marker, n: F.concat_ws(" ", F.lit("Bên"), "l_returnflag", marker, F.lit("giao"), n, F.lit("hàng, đủ"))
    borne = F.concat(F.lit("phải, được"), F.when(other > 25, F.concat(F.lit(" giao "), other.cast("string"))).otherwise(""))
    pairs = lines.select(line.alias("line"), clause(pick("l_partkey"), number).alias("source"), clause(pick("l_suppkey"), other.cast("string")).alias("claim"), borne.alias("evidence"))
    return W.judged_edits(pairs, "line").select("line", F.col("at").alias("place"), "source", "claim", "turned", "borne")
