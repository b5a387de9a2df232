"""Crawled pages and conditions of records on the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import pages as W
from tempora.operators import conditions as K
from tempora.operators import pages as G
from tempora.operators import positional as P
from tempora.operators import records as C
from tempora.plans.catalog import query
from tempora.session import table


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH c AS (SELECT conv_id AS id, turn, CASE role WHEN 'user' THEN 'asked' WHEN 'assistant' THEN 'answered' END AS key, {_STRIP.format('text')} AS value FROM conversations WHERE text IS NOT NULL)
SELECT id, key, md5(CASE value WHEN '--' THEN '' ELSE value END) AS value FROM (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY turn DESC, value DESC) AS n FROM c WHERE key IS NOT NULL) WHERE n = 1""")
def page_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a label and a value as properties: of each conversation, what was said last by each side."""
    cells = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("ord"), F.concat("role", F.lit("\n"), "text").alias("cell"))
    return G.properties(cells, {"user": "asked", "assistant": "answered"}).select("id", "key", F.md5("value").alias("value"))


@query(rf"""WITH t AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT id, i - 1 AS line_no, {_STRIP.format('ls[i]')} AS s, length(ls[i]) % 4 AS want FROM t, range(1, len(ls) + 1) r(i)),
x AS (SELECT id, line_no, CASE WHEN line_no % 4 = 1 THEN 'Loại ' || line_no % 3 ELSE NULL END AS name, want, CASE WHEN line_no = 6 THEN 'VĂN BẢN ĐANG XEM: ' || s ELSE s END AS line, CASE WHEN line_no >= 6 THEN 'incoming' ELSE 'outgoing' END AS direction FROM l),
y AS (SELECT *, count(name) OVER (PARTITION BY id, direction ORDER BY line_no) AS section FROM x), z AS (SELECT *, first_value(want) OVER w AS most, count(*) FILTER (name IS NULL AND line NOT IN ('', '--')) OVER w AS place FROM y WHERE section > 0 WINDOW w AS (PARTITION BY id, direction, section ORDER BY line_no)),
g AS (SELECT id, direction, section, max(name) AS category, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (name IS NULL AND line NOT IN ('', '--') AND place <= most), '') AS titles FROM z GROUP BY ALL)
SELECT id, direction, category, md5(arg_max(titles, section)) AS titles FROM g GROUP BY id, direction, category""")
def relation_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every text read as a relation tab: each fourth line counts how many titles follow, the seventh is the middle."""
    lines = P.lines_with_offsets(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "text")
    n = F.col("line_no")
    head = F.concat(F.lit("Loại "), _s(n % 3), F.lit(" ("), _s(F.char_length("line") % 4), F.lit(")"))
    line = F.when(n % 4 == 1, head).when(n == 6, F.concat(F.lit("VĂN BẢN ĐANG XEM: "), "line")).otherwise(F.col("line"))
    out = G.relation_tab(lines.select("id", "line_no", line.alias("line")))
    return out.select("id", "direction", "category", F.md5(F.array_join("titles", "\n")).alias("titles"))


@query(rf"""WITH t AS (SELECT doc_id, n_chars, list_transform(string_split(replace(text, ', ', chr(10) || 'Tải về' || chr(10)), chr(10)), lambda x: {_STRIP.format('x')}) AS ls FROM documents),
b AS (SELECT doc_id, n_chars, CASE WHEN list_contains(ls, 'Tải về') THEN ls[len(ls) - list_position(list_reverse(ls), 'Tải về') + 2:] ELSE ls END AS ls FROM t)
SELECT doc_id, md5(CASE WHEN n_chars % 5 = 0 THEN '' ELSE array_to_string(list_filter(ls, lambda x: x <> '' AND x <> 'The.'), chr(10)) END) AS body FROM b""")
def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a page: what follows its last tab, and nothing where that is a property table."""
    labels = ["Số ký hiệu", "Cơ quan ban hành", "Ngày ban hành", "Loại văn bản"]
    page = F.replace(F.col("text"), F.lit(", "), F.lit("\nTải về\n"))
    page = F.when(F.col("n_chars") % 5 == 0, F.concat(page, F.lit("\n" + "\n".join(labels)))).otherwise(page)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(W.page_body(page, "Tải về", ["The."], labels, r"^Điều \d")).alias("body"))


@query(rf"""WITH h AS (SELECT page_id AS id, list_filter(list_transform(string_split_regex(replace(replace(html, '$$$ ', '<br>4. '), '*** ', '<BR />a) '), '(?i)<br\s*/?>'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS ps FROM pages),
p AS (SELECT id, i - 1 AS place, ps[i] AS html, starts_with(ps[i], '4. ') AS c, starts_with(ps[i], 'a) ') AS q FROM h, range(1, len(ps) + 1) r(i))
SELECT id, place::INTEGER AS place, CASE WHEN c THEN 'clause' WHEN q THEN 'point' ELSE 'article' END AS level, CASE WHEN c THEN '4' WHEN q AND bool_or(c) OVER (PARTITION BY id ORDER BY place) THEN '4' WHEN q THEN '2' ELSE '2' END AS clause, CASE WHEN q THEN 'a' END AS point, md5(html) AS html FROM p""")
def addressed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages parted at line breaks, each paragraph with the address that its numbering gives it."""
    html = F.replace(F.replace(F.col("html"), F.lit("$$$ "), F.lit("<br>4. ")), F.lit("*** "), F.lit("<BR />a) "))
    nodes = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("article").alias("level"), F.lit("Điều 1").alias("article"), F.lit("2").alias("clause"), F.lit(None).cast("string").alias("point"), html.alias("html"))
    return G.addressed_paragraphs(nodes).select("id", "place", "level", "clause", "point", F.md5("html").alias("html"))


_TREE = "c AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2), t AS (SELECT *, turn % 4 + (conv_id + turn) % 2 AS depth FROM c), w AS (SELECT a.conv_id, a.turn, a.text, max(b.turn) AS parent FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.depth < a.depth GROUP BY ALL)"


@query(f"""WITH RECURSIVE {_TREE}, p AS (SELECT conv_id, turn, text, [turn] AS path FROM w WHERE parent IS NULL UNION ALL SELECT w.conv_id, w.turn, w.text, list_append(p.path, w.turn) FROM w JOIN p ON w.conv_id = p.conv_id AND w.parent = p.turn),
u AS (SELECT conv_id, turn, text, unnest(path) AS top FROM p WHERE coalesce(text, '') <> '') SELECT conv_id, top AS turn, md5(string_agg(text, chr(10) ORDER BY turn)) AS full_text FROM u GROUP BY conv_id, top""")
def unit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every node of a tree with all that stands under it."""
    nodes = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    tree = C.parents(nodes.withColumn("depth", F.col("turn") % 4 + (F.col("conv_id") + F.col("turn")) % 2), "conv_id", "turn", "depth", 5)
    out = G.unit_texts(nodes, C.paths(tree, "conv_id", "turn", 5), "conv_id", "turn", "text")
    return out.select("conv_id", "turn", F.md5("full_text").alias("full_text"))


@query(rf"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), a AS (SELECT doc_id, list_transform(ls, lambda x, i: CASE WHEN (i - 1) % 3 = 1 THEN 'Điều ' || (i - 1) || '. ' || x ELSE x END) AS ls FROM t),
b AS (SELECT doc_id, ls, list_transform(ls, lambda x: {_STRIP.format('x')}) AS st FROM a), c AS (SELECT *, list_filter(st, lambda x: contains(x, 'the'))[:5] AS named FROM b)
SELECT doc_id, md5({_STRIP.format("array_to_string(ls[5:7], chr(10))")}) AS article, md5(CASE WHEN len(named) > 0 THEN left(st[1], 5000) || chr(10) || '---' || chr(10) || array_to_string(named, chr(10)) ELSE left(st[1], 5000) END) AS head FROM c WHERE len(ls) > 4""")
def article_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article of every text that has it, and what stands before the first; each third line begins an article."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("Điều "), i.cast("string"), F.lit(". "), x)).otherwise(x))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    rows = docs.select("doc_id", W.article_text(F.col("text"), F.lit("4")).alias("article"), W.head_text(F.col("text"), "the", r"^Điều \d").alias("head"))
    return rows.where("article IS NOT NULL").select("doc_id", F.md5("article").alias("article"), F.md5("head").alias("head"))


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey % 12 + 1 AS n, CASE WHEN l_partkey % 3 = 0 THEN 'a' ELSE '' END AS s, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 11 END AS clause FROM lineitem)
SELECT doc, 'Điều ' || n || s AS article, clause::VARCHAR AS clause, (row_number() OVER (PARTITION BY doc ORDER BY n, s, clause NULLS FIRST))::INTEGER AS stt FROM i""")
def numbered_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The impacts on each document, numbered in the order of its units."""
    article = F.concat(F.lit("Điều "), _s(F.col("l_suppkey") % 12 + 1), F.when(F.col("l_partkey") % 3 == 0, "a").otherwise(""))
    clause = F.when(F.col("l_linenumber") % 2 == 1, _s(F.col("l_partkey") % 11))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), article.alias("article"), clause.alias("clause"), F.lit(None).cast("string").alias("point")).distinct()
    return G.numbered_impacts(rows, "doc").select("doc", "article", "clause", "stt")


@query("""WITH t AS (SELECT doc_id AS id, text, length(text) AS n FROM documents), s AS (SELECT id, 0 AS a, n // 2 AS b, 'half' AS role, n FROM t UNION ALL SELECT id, n // 3, n // 3 + 12, 'near', n FROM t UNION ALL SELECT id, n // 3 + 6, n // 3 + 40, 'far', n FROM t), o AS (SELECT * FROM s WHERE a < b AND b <= n),
e AS (SELECT id, 0 AS x FROM t UNION SELECT id, n FROM t UNION SELECT id, a FROM o UNION SELECT id, b FROM o), p AS (SELECT id, x AS a0, lead(x) OVER (PARTITION BY id ORDER BY x) AS b0 FROM e),
m AS (SELECT p.id, a0, b0, role, row_number() OVER (PARTITION BY p.id, a0 ORDER BY b - a, a, b, role) AS k, count(a) OVER (PARTITION BY p.id, a0) AS covers FROM p LEFT JOIN o ON o.id = p.id AND a <= a0 AND b >= b0 WHERE b0 IS NOT NULL)
SELECT m.id, a0::INTEGER AS start, b0::INTEGER AS "end", role, covers > 1 AS shared, md5(substr(text, (a0 + 1)::BIGINT, (b0 - a0)::BIGINT)) AS piece FROM m JOIN t USING (id) WHERE k = 1""")
def painted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut at the edges of three spans, each piece with the role of the narrowest over it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    span = lambda a, b, role: F.struct(a.alias("start"), b.alias("end"), F.lit(role).alias("role"))
    spans = docs.select("id", F.explode(F.array(span(F.lit(0), F.floor(n / 2).cast("int"), "half"), span(third, third + 12, "near"), span(third + 6, third + 40, "far"))).alias("s")).select("id", "s.*")
    return G.painted(docs, spans).withColumn("piece", F.md5("piece"))


@query("""WITH t AS (SELECT p_partkey, p_size % 4 AS k, p_size % 28 + 1 AS d, p_size % 12 + 1 AS m FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'end' WHEN 2 THEN 'end' ELSE 'start' END AS bound, CASE k WHEN 0 THEN make_date(2024, m, d) WHEN 1 THEN make_date(2024, m, d) END AS day, CASE k WHEN 2 THEN 'invalid' WHEN 3 THEN 'relative' ELSE '' END AS note FROM t""")
def gate_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a text says it takes effect or ends: by a day, by one that isn't in the calendar, or by none."""
    size = F.col("p_size")
    day = F.concat(F.lit("ngày "), _s(size % 28 + 1), F.lit(" tháng "), _s(size % 12 + 1), F.lit(" năm 2024"))
    said = F.when(size % 4 == 0, F.concat(F.lit("hết hiệu lực từ "), day)).when(size % 4 == 1, F.concat(F.lit("có hiệu lực thi hành kể từ "), day)).when(size % 4 == 2, F.lit("có hiệu lực đến hết ngày 30 tháng 2 năm 2024")).otherwise("có hiệu lực cùng lúc với luật")
    return table(spark, sf_dir, "part").select("p_partkey", K.gate_clause(F.concat("p_name", F.lit(" "), said)).alias("g")).select("p_partkey", "g.*")


@query("""WITH u AS (SELECT c_custkey AS clause, uid, CASE WHEN c_custkey % 4 = 0 OR uid = 7 THEN NULL WHEN uid < 4 THEN 'a' ELSE 'b' END AS point FROM customer, range(1, 8) r(uid)), k AS (SELECT o_orderkey AS id, o_custkey AS clause FROM orders),
s AS (SELECT k.id, list_sort(list(DISTINCT point) FILTER (point IS NOT NULL)) AS ps FROM k JOIN lineitem ON l_orderkey = k.id JOIN u ON u.clause = k.clause AND u.uid = l_linenumber GROUP BY 1), h AS (SELECT DISTINCT clause FROM u WHERE point IS NOT NULL)
SELECT k.id, CASE WHEN len(ps) = 1 THEN ps[1] END AS point, CASE WHEN len(ps) > 1 THEN 'several' WHEN coalesce(len(ps), 0) = 0 AND h.clause IS NOT NULL THEN 'outside' END AS warning FROM k LEFT JOIN s USING (id) LEFT JOIN h ON h.clause = k.clause""")
def derived_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point of each condition by the units that it picked."""
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("clause"), F.left("o_orderpriority", F.lit(1)).alias("claimed"))
    picks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("uid"))
    uid = F.explode(F.sequence(F.lit(1), F.lit(7))).alias("uid")
    units = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clause"), uid)
    point = F.when((F.col("clause") % 4 == 0) | (F.col("uid") == 7), F.lit(None).cast("string")).when(F.col("uid") < 4, "a").otherwise("b")
    return K.derived_points(claims, picks, units.withColumn("point", point))


@query("""WITH e AS (SELECT user_id, list(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'purchase') AS points FROM events WHERE value > 60 GROUP BY 1), r AS (SELECT *, user_id % 2 = 0 AND len(list_filter(kinds, lambda k: k NOT IN ('click', 'login'))) = 0 AS bare FROM e)
SELECT user_id, bare AS no_subject, bare AND points = 0 AS no_conditions FROM r""")
def absent_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which records need no subject, and which no conditions."""
    rows = table(spark, sf_dir, "events").where("value > 60").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.count_if(F.col("event_type") == "purchase").alias("points"))
    role, bare = F.when(F.col("user_id") % 2 == 0, "meta").otherwise("actor"), ("click", "login")
    return rows.select("user_id", K.no_subject(role, F.col("kinds"), bare).alias("no_subject"), K.no_conditions(role, F.col("kinds"), F.col("points"), bare).alias("no_conditions"))


@query("""WITH t AS (SELECT doc_id AS id, text, strpos(text, 'e') AS a, strpos(text, '. ') AS b FROM documents)
SELECT id, 'subject' AS field, left(text, 9) AS value, CASE WHEN a > 0 THEN a - 1 END::INTEGER AS start, CASE WHEN a > 0 THEN a + 8 END::INTEGER AS "end", a > 0 AS grounded FROM t UNION ALL SELECT id, 'action', lang, CASE WHEN b > 0 THEN b - 1 END::INTEGER, CASE WHEN b > 0 THEN b + 1 END::INTEGER, b > 0 FROM t JOIN (SELECT doc_id AS id, lang FROM documents) USING (id)""")
def grounding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each field of each record, with its span where it has one."""
    at, dot = F.instr("text", "e"), F.instr("text", ". ")
    field = lambda value, n, more: F.struct(value.alias("value"), F.when(n > 0, n - 1).alias("start"), F.when(n > 0, n + more).alias("end"))
    rows = table(spark, sf_dir, "documents").select("doc_id", field(F.left("text", F.lit(9)), at, 8).alias("subject"), field(F.col("lang"), dot, 1).alias("action"))
    return K.grounding_rows(rows, "doc_id", ["subject", "action"])


@query("""WITH u AS (SELECT l_orderkey AS id, list({'ord': l_linenumber, 'text': l_returnflag} ORDER BY l_linenumber, l_returnflag) AS units FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, md5(to_json({'id': o_orderkey, 'record': o_orderpriority, 'units': coalesce(units, []), 'verdict': CASE WHEN o_orderstatus = 'F' THEN 'pass' ELSE '' END})::VARCHAR) AS payload FROM orders LEFT JOIN u ON u.id = o_orderkey""")
def reviewer_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer is shown of each record, as one JSON text."""
    o = table(spark, sf_dir, "orders")
    units = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("text"))
    verdicts = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("pass").alias("verdict"))
    return K.payloads(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("record")), units, verdicts).withColumn("payload", F.md5("payload"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'spaced dash' WHEN 1 THEN 'cyrillic' WHEN 2 THEN 'spaced dash,cyrillic' ELSE '' END AS quirks FROM part""")
def title_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose number has blanks beside its dash or Cyrillic letters."""
    k = F.col("p_size") % 4
    number = F.when(k == 0, "7/2024/TT- NHNN").when(k == 1, "7/2024/ТT-NHNN").when(k == 2, "7/2024/ТT -NHNN").otherwise("7/2024/TT-NHNN")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(W.quirks(F.concat("p_name", F.lit(" "), number)), ",").alias("quirks"))
