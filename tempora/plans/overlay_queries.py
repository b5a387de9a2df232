"""Routing of chunks through amendments, citations and impacts on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import overlay as O
from tempora.plans.catalog import query
from tempora.session import settled, table

AS_OF = "1996-06-30"
_EDGES = f"""e AS (SELECT 's' || l_suppkey || '#than/dieu_' || (l_orderkey % 30) || '#khoan_' || l_linenumber AS source_key, 'c' || o_custkey || '#than/dieu_' || (l_partkey % 30) || CASE WHEN l_returnflag <> 'A' THEN '#khoan_' || l_linenumber ELSE '' END
      || CASE WHEN l_returnflag = 'N' AND l_quantity < 20 THEN '#diem_' || chr(97 + (l_suppkey % 3)::INTEGER) ELSE '' END AS target_key,
    CASE WHEN l_discount > 0.08 THEN 'bai_bo' ELSE 'sua_doi' END AS op, strftime(l_shipdate, '%Y-%m-%d') AS valid_from, l_orderkey * 10 + l_linenumber AS ord, (l_partkey * 37) % 20000 AS span_start, (l_partkey * 37) % 20000 + 150 AS span_end
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL
  SELECT 'z' || o_orderkey || '#than/dieu_1', 's' || (o_orderkey % 100 + 1) || '#than/dieu_' || (o_custkey % 30), 'bai_bo', strftime(o_orderdate, '%Y-%m-%d'), o_orderkey * 10, NULL, NULL FROM orders WHERE o_orderkey % 10 = 0),
a AS (SELECT * FROM e WHERE valid_from <= '{AS_OF}'),
anc AS (SELECT source_key, unnest(list_transform(range(1, len(string_split(source_key, '#')) + 1), lambda i: array_to_string(string_split(source_key, '#')[1:i], '#'))) AS up FROM (SELECT DISTINCT source_key FROM a)),
dead AS (SELECT DISTINCT source_key FROM anc WHERE up IN (SELECT target_key FROM a WHERE op = 'bai_bo')),
live AS (SELECT * FROM a WHERE source_key NOT IN (SELECT source_key FROM dead))"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amendments of customers' acts by suppliers', with the place of their wording, and repeals of articles of some suppliers' acts."""
    text = lambda *x: F.concat(*(c if not isinstance(c, str) else F.lit(c) for c in x))
    n = lambda c: c.cast("string") if not isinstance(c, str) else F.col(c).cast("string")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    clause = F.when(F.col("l_returnflag") != "A", text("#khoan_", n("l_linenumber"))).otherwise("")
    point = F.when((F.col("l_returnflag") == "N") & (F.col("l_quantity") < 20), text("#diem_", F.char(97 + F.col("l_suppkey") % 3))).otherwise("")
    start = (F.col("l_partkey") * 37) % 20000
    amend = lines.select(
        text("s", n("l_suppkey"), "#than/dieu_", n(F.col("l_orderkey") % 30), "#khoan_", n("l_linenumber")).alias("source_key"), text("c", n("o_custkey"), "#than/dieu_", n(F.col("l_partkey") % 30), clause, point).alias("target_key"),
        F.when(F.col("l_discount") > 0.08, "bai_bo").otherwise("sua_doi").alias("op"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("valid_from"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), start.alias("span_start"), (start + 150).alias("span_end"),
    )
    none = F.lit(None).cast("long")
    acts = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(
        text("z", n("o_orderkey"), "#than/dieu_1").alias("source_key"), text("s", n(F.col("o_orderkey") % 100 + 1), "#than/dieu_", n(F.col("o_custkey") % 30)).alias("target_key"),
        F.lit("bai_bo").alias("op"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"), (F.col("o_orderkey") * 10).alias("ord"), none.alias("span_start"), none.alias("span_end"),
    )
    return amend.unionByName(acts)


def _citations_sql(rows: str, by: str) -> str:
    """CTEs that end in cit (by, citation), for keys of articles, clauses and points."""
    return f"""k0 AS (SELECT DISTINCT {by}, key FROM {rows}),
k1 AS (SELECT *, split_part(key, '#', 1) AS doc, regexp_extract(key, 'dieu_([^#]+)', 1)::INTEGER AS art, nullif(regexp_extract(key, 'khoan_([^#]+)', 1), '')::INTEGER AS clause, nullif(regexp_extract(key, 'diem_([^#]+)', 1), '') AS point FROM k0),
k2 AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY doc, art, clause NULLS FIRST, point NULLS FIRST) AS place, count(*) OVER (PARTITION BY {by}) AS total FROM k1),
k3 AS (SELECT {by}, total, doc, art, clause, min(place) AS place, bool_or(point IS NULL) AS whole, string_agg(point, ', ' ORDER BY point) AS points FROM k2 WHERE place <= 8 GROUP BY ALL),
k4 AS (SELECT *, CASE WHEN whole THEN clause::VARCHAR ELSE clause || ' Điểm ' || points END AS said FROM k3),
k5 AS (SELECT {by}, total, doc, art, min(place) AS place, CASE WHEN bool_or(clause IS NULL) THEN doc || ' Điều ' || art WHEN bool_and(whole) THEN doc || ' Điều ' || art || ' Khoản ' || string_agg(said, ', ' ORDER BY place) ELSE doc || ' Điều ' || art || ' ' || string_agg('Khoản ' || said, ', ' ORDER BY place) END AS said FROM k4 GROUP BY {by}, total, doc, art),
cit AS (SELECT {by}, string_agg(said, ' và ' ORDER BY place) || CASE WHEN total > 8 THEN ' và ' || (total - 8) || ' đơn vị khác (đã rút gọn)' ELSE '' END AS citation FROM k5 GROUP BY {by}, total)"""


@query(f"WITH {_EDGES}, t AS (SELECT split_part(source_key, '#', 1) || '#' || split_part(source_key, '#', 2) AS act, target_key AS key FROM e), {_citations_sql('t', 'act')} SELECT act, citation FROM cit")
def cite_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that an article amends, as one citation: widened where a whole unit is among it, the first eight named."""
    act = F.array_join(F.slice(F.split("source_key", "#"), 1, 2), "#")
    return O.cited(_edges(spark, sf_dir).select(act.alias("act"), F.col("target_key").alias("key")), ["act"])


_ROUTES = f"""{_EDGES}, ch AS (SELECT 'C' || o_custkey || '::Điều ' || n || CASE WHEN n % 2 = 1 THEN ' Khoản ' || (n % 7 + 1) ELSE '' END AS chunk_id, 'c' || o_custkey AS number, 'c' || o_custkey || '#than/dieu_' || n || CASE WHEN n % 2 = 1 THEN '#khoan_' || (n % 7 + 1) ELSE '' END AS key, NULL AS a, NULL AS b
   FROM (SELECT DISTINCT o_custkey FROM orders), range(0, 30) r(n) UNION ALL SELECT 'S' || s_suppkey || '::Điều ' || n, 's' || s_suppkey, 's' || s_suppkey || '#than/dieu_' || n, n * 600, n * 600 + 200 FROM supplier, range(0, 30) r(n)),
m AS (SELECT ch.chunk_id, e.source_key, e.target_key, (e.source_key, e.target_key) IN (SELECT (source_key, target_key) FROM live) AS alive FROM ch JOIN e ON split_part(e.source_key, '#', 1) = ch.number AND e.span_start < ch.b AND ch.a < e.span_end),
told AS (SELECT * FROM m QUALIFY alive OR NOT bool_or(alive) OVER (PARTITION BY chunk_id)), q AS (SELECT chunk_id, min(target_key) AS target_key FROM told GROUP BY 1),
ka AS (SELECT key, unnest(list_transform(range(1, len(string_split(key, '#')) + 1), lambda i: array_to_string(string_split(key, '#')[1:i], '#'))) AS target_key FROM (SELECT DISTINCT key FROM ch)),
onn AS (SELECT key, arg_max(op, (valid_from, ord)) AS op, arg_max(target_key, (valid_from, ord)) AS target_key FROM ka JOIN live USING (target_key) GROUP BY key),
up AS (SELECT target_key, op, valid_from, ord, unnest(list_transform(range(1, len(string_split(target_key, '#'))), lambda i: array_to_string(string_split(target_key, '#')[1:i], '#'))) AS key FROM live),
below AS (SELECT key, arg_max(op, (valid_from, ord)) AS op, arg_max(target_key, (valid_from, ord)) AS target_key FROM up GROUP BY key),
r AS (SELECT chunk_id, ch.key, CASE WHEN q.chunk_id IS NOT NULL THEN 'quoted' WHEN onn.op = 'bai_bo' THEN 'repealed' WHEN onn.op IS NOT NULL OR below.op IS NOT NULL THEN 'amended' ELSE 'intact' END AS route,
  coalesce(q.target_key, onn.target_key, below.target_key) AS target_key FROM ch LEFT JOIN q USING (chunk_id) LEFT JOIN onn ON onn.key = ch.key LEFT JOIN below ON below.key = ch.key)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each of thirty articles, or a clause of it, of every customer's act, and of every supplier's with its span."""
    n = F.explode(F.sequence(F.lit(0), F.lit(29))).alias("n")
    s = lambda c: c.cast("string")
    orders, suppliers = table(spark, sf_dir, "orders").select("o_custkey").distinct().select("o_custkey", n), table(spark, sf_dir, "supplier").select("s_suppkey", n)
    clause = F.when(F.col("n") % 2 == 1, F.concat(F.lit(" Khoản "), s(F.col("n") % 7 + 1))).otherwise("")
    none = F.lit(None).cast("int")
    base = orders.select(F.concat(F.lit("C"), s(F.col("o_custkey")), F.lit("::Điều "), s(F.col("n")), clause).alias("chunk_id"), F.concat(F.lit("c"), s(F.col("o_custkey"))).alias("number"), none.alias("span_start"), none.alias("span_end"))
    acts = suppliers.select(F.concat(F.lit("S"), s(F.col("s_suppkey")), F.lit("::Điều "), s(F.col("n"))).alias("chunk_id"), F.concat(F.lit("s"), s(F.col("s_suppkey"))).alias("number"), (F.col("n") * 600).alias("span_start"), (F.col("n") * 600 + 200).alias("span_end"))
    return base.unionByName(acts)


@query(f"WITH {_ROUTES}, tq AS (SELECT chunk_id, target_key AS key FROM told), {_citations_sql('tq', 'chunk_id')} SELECT chunk_id, r.key, route, target_key, CASE WHEN route = 'quoted' THEN citation END AS quoted FROM r LEFT JOIN cit USING (chunk_id)")
def route_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk as intact, amended, repealed, or quoted inside an amending act, with what decides it."""
    out = O.routed(_chunks(spark, sf_dir), settled(_edges(spark, sf_dir), "edges"), AS_OF, "quoted")
    return out.select("chunk_id", "key", "route", "target_key", F.when(F.col("route") == "quoted", F.col("citation")).alias("quoted"))


@query(f"""WITH {_ROUTES}, x AS (SELECT DISTINCT target_key AS key FROM live), xa AS (SELECT key, unnest(list_transform(range(1, len(string_split(key, '#')) + 1), lambda i: array_to_string(string_split(key, '#')[1:i], '#'))) AS target_key FROM x),
l AS (SELECT xa.key, arg_max(op, (valid_from, ord)) AS op, arg_max(source_key, (valid_from, ord)) AS source_key FROM xa JOIN live USING (target_key) GROUP BY xa.key)
SELECT split_part(key, '#', 1) AS number, key, CASE WHEN op = 'bai_bo' THEN 'repealed' ELSE 'amended' END AS status, source_key, row_number() OVER (PARTITION BY split_part(key, '#', 1)
  ORDER BY regexp_extract(key, 'dieu_([^#]+)', 1)::INTEGER, nullif(regexp_extract(key, 'khoan_([^#]+)', 1), '')::INTEGER NULLS FIRST, regexp_extract(key, 'diem_([^#]+)', 1), key)::INTEGER AS badge FROM l""")
def doc_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units of every act that are amended or repealed, numbered in document order."""
    return O.impacts(_edges(spark, sf_dir), AS_OF)


@query(f"""WITH {_ROUTES}, h AS (SELECT number AS query, chunk_id, (row_number() OVER (PARTITION BY number ORDER BY chunk_id))::INTEGER AS rank FROM ch), t AS (SELECT query, chunk_id, rank, route, target_key FROM h JOIN r USING (chunk_id)),
kept AS (SELECT * FROM t QUALIFY route <> 'repealed' OR NOT bool_or(route <> 'repealed') OVER (PARTITION BY query)),
o AS (SELECT chunk_id AS origin, target_key, row_number() OVER (PARTITION BY target_key ORDER BY chunk_id) AS n FROM ch JOIN ka USING (key) WHERE chunk_id LIKE 'C%'),
p AS (SELECT query, origin AS chunk_id, min(rank) AS rank FROM kept JOIN o USING (target_key) WHERE route = 'quoted' AND n <= 2 GROUP BY ALL)
SELECT query, chunk_id, rank, route FROM kept UNION ALL SELECT query, chunk_id, rank, 'origin' FROM p WHERE (query, chunk_id) NOT IN (SELECT (query, chunk_id) FROM kept)""")
def annotate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits without repealed ones, and behind quotations the chunks of the units that they amend."""
    chunks = _chunks(spark, sf_dir)
    routes = settled(O.routed(chunks, settled(_edges(spark, sf_dir), "edges"), AS_OF, "none").select("chunk_id", "key", "route", "target_key"), "routes")
    from pyspark.sql import Window

    hits = chunks.select(F.col("number").alias("query"), "chunk_id", F.row_number().over(Window.partitionBy("number").orderBy("chunk_id")).alias("rank"))
    return O.with_origins(hits, routes, routes.select("chunk_id", "key"), F.col("chunk_id").startswith("C"))
