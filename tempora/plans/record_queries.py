"""Records, reports and labels on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import labels as L
from tempora.functions import spans as S
from tempora.functions import temporal as V
from tempora.operators import evaluation as E
from tempora.operators import normative as N
from tempora.operators import positional as P
from tempora.operators import records as C
from tempora.operators import reports as A
from tempora.operators import segments as X
from tempora.plans.catalog import query
from tempora.session import table


def _s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query("""WITH s AS (SELECT doc_id, strpos(text, 'e') - 1 AS a, strpos(text, 'e') + 19 AS b, strpos(text, 'n') - 1 AS c, strpos(text, 'n') + 4 AS d, split_part(text, ' ', 1) AS x, split_part(text, ' ', 2) AS y FROM documents)
SELECT doc_id, a < d AND c < b AS meets, CASE WHEN a <= c AND d <= b THEN 'inside' WHEN a < d AND c < b THEN 'partly' ELSE 'outside' END AS how, x <> '' AND y <> '' AND (contains(x, y) OR contains(y, x)) AS either, least(a, c)::INTEGER AS hull_start, greatest(b, d)::INTEGER AS hull_end FROM s""")
def span_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two spans of every text lie to each other, and whether its first two words hold one another."""
    at = lambda ch: F.instr("text", ch)
    a, b, c, d = at("e") - 1, at("e") + 19, at("n") - 1, at("n") + 4
    both = S.hull(F.array(F.struct(a.alias("start"), b.alias("end")), F.struct(c.alias("start"), d.alias("end"))))
    word = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    return table(spark, sf_dir, "documents").select("doc_id", S.overlap(a, b, c, d).alias("meets"), S.relation(a, b, c, d).alias("how"), S.either_contains(word(1), word(2)).alias("either"), both["start"].alias("hull_start"), both["end"].alias("hull_end"))


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'O' THEN false WHEN o_orderstatus = 'F' THEN true END, true) AS visible, nullif(trim(split_part(o_orderpriority, '-', 2)), 'HIGH') AS shown FROM orders
WHERE o_orderstatus IN ('O', 'F', 'P') AND o_totalprice > 1000 AND o_orderpriority ILIKE '%e%' AND o_orderdate::DATE <= DATE '1996-06-30' AND o_orderstatus <> 'F'""")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several facets at once, in the default scope of what has begun and isn't superseded; flags that are missing count as true."""
    o = table(spark, sf_dir, "orders")
    flag = F.when(F.col("o_orderstatus") == "O", False).when(F.col("o_orderstatus") == "F", True)
    begun = V.effective(F.to_date("o_orderdate"), F.lit(None).cast("date"), F.col("o_orderstatus") == "F", "1996-06-30")
    rows = o.where(F.col("o_orderstatus").isin("O", "F", "P")).where("o_totalprice > 1000").where(F.col("o_orderpriority").ilike("%e%")).where(begun)
    return rows.select("o_orderkey", F.coalesce(flag, F.lit(True)).alias("visible"), F.nullif(S.shown(F.split_part("o_orderpriority", F.lit("-"), F.lit(2))), F.lit("HIGH")).alias("shown"))


@query(r"""WITH t AS (SELECT page_id AS id, unnest(list_distinct(regexp_extract_all(html, '[0-9]+')[2:])) AS number FROM pages)
SELECT id, array_to_string(list_sort(list(DISTINCT number)), ',') AS owned FROM t WHERE number IN (SELECT s_suppkey::VARCHAR FROM supplier) GROUP BY id""")
def amends_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that name, after their first number, numbers that we own."""
    owned = table(spark, sf_dir, "supplier").select(_s("s_suppkey").alias("number"))
    out = C.amends_owned(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("title")), owned, "[0-9]+")
    return out.select("id", F.array_join("owned", ",").alias("owned"))


@query("""WITH v AS (SELECT lang, CASE WHEN quality IS NULL THEN 'not_assessed' WHEN toxic = 1 THEN 'violation' WHEN quality = 1 THEN 'pass' ELSE 'warning' END AS v FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))
SELECT lang, count(*) FILTER (v = 'pass') AS pass, count(*) FILTER (v = 'warning') AS warning, count(*) FILTER (v = 'violation') AS violation, count(*) FILTER (v = 'not_assessed') AS not_assessed FROM v GROUP BY lang""")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verdict counted, also those that don't occur."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    verdict = F.when(F.col("quality").isNull(), "not_assessed").when(F.col("toxic") == 1, "violation").when(F.col("quality") == 1, "pass").otherwise("warning")
    return A.verdict_counts(table(spark, sf_dir, "documents").join(labels, "doc_id", "left").withColumn("verdict", verdict), ["lang"])


@query("""SELECT code, count(event_type)::BIGINT AS n FROM (SELECT unnest(['click', 'error', 'login', 'purchase', 'refund', 'signup']) AS code) c LEFT JOIN events ON event_type = code GROUP BY code""")
def missing_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed set of codes with their counts, zero for those that are missing."""
    return A.missing_codes(table(spark, sf_dir, "events"), "event_type", ["click", "error", "login", "purchase", "refund", "signup"])


@query("""SELECT CASE WHEN lang <> 'en' THEN 'other language' WHEN n_chars < 300 THEN 'too short' WHEN text LIKE '%@%' THEN 'has an address' ELSE 'kept' END AS reason, count(*)::BIGINT AS n FROM documents GROUP BY 1""")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why documents are left out: the first reason counts, and the counts sum up to all documents."""
    rules = (("other language", F.col("lang") != "en"), ("too short", F.col("n_chars") < 300), ("has an address", F.col("text").contains("@")))
    return A.reasons(table(spark, sf_dir, "documents"), rules)


@query("""SELECT event_type, count(*) FILTER (value IS NOT NULL AND event_id % 13 <> 0)::BIGINT AS n, count(*) FILTER (NOT (value IS NOT NULL AND event_id % 13 <> 0))::BIGINT AS errors, count(*) FILTER (value IS NOT NULL AND event_id % 13 <> 0 AND value > 100)::BIGINT AS cited,
count(*) FILTER (value IS NOT NULL AND event_id % 13 <> 0 AND user_id % 2 = 0)::BIGINT AS fresh FROM events GROUP BY 1""")
def regression_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks passed by kind; what failed to run is counted apart."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value").isNull() | (F.col("event_id") % 13 == 0)).alias("failed"), (F.col("value") > 100).alias("cited"), (F.col("user_id") % 2 == 0).alias("fresh"))
    return A.regression(e, ["event_type"], ["cited", "fresh"], "failed")


@query("""WITH c AS (SELECT l_suppkey % 5 AS model, l_orderkey, l_orderkey % 3 = 0 AS positive, bool_or(l_discount > 0.05) AS a, bool_and(l_discount > 0.05) AS b FROM lineitem GROUP BY ALL)
SELECT model, count(*) FILTER (positive)::BIGINT AS n, count(*) FILTER (positive AND a)::BIGINT AS found, count(*) FILTER (positive AND b)::BIGINT AS stable, count(*) FILTER (NOT positive AND a)::BIGINT AS false_alarms FROM c GROUP BY model""")
def model_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several runs of each case: found in any, found in all, and false alarms."""
    runs = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("model"), "l_orderkey", (F.col("l_orderkey") % 3 == 0).alias("positive"), (F.col("l_discount") > 0.05).alias("hit"))
    return A.stability(runs, "l_orderkey", "hit", "positive", ["model"])


@query("""WITH u AS (SELECT role AS model, count(*) AS tokens_in, sum(length(text)) AS tokens_out FROM conversations GROUP BY 1)
SELECT model, tokens_in::BIGINT AS tokens_in, tokens_out::BIGINT AS tokens_out, CASE model WHEN 'user' THEN round((tokens_in * 2.0 + tokens_out * 8.0) / 1e6, 9) END::DOUBLE AS cost FROM u""")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and their price; null for what has no price."""
    usage = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("model")).agg(F.count(F.lit(1)).alias("tokens_in"), F.sum(F.char_length("text")).alias("tokens_out"))
    return A.priced(usage, spark.createDataFrame([("user", 2.0, 8.0)], "model string, price_in double, price_out double")).withColumn("cost", F.round("cost", 9))


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS s, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS x FROM events GROUP BY 1) SELECT user_id, x > 0 AND s <= 0.15 * n AS counts FROM c""")
def run_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which runs count: something was expected, and not too much was skipped."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(kind("error").alias("s"), F.count(F.lit(1)).alias("n"), kind("purchase").alias("x"))
    return rows.select("user_id", A.counts_as_run(F.col("s"), F.col("n"), F.col("x")).alias("counts"))


@query("""SELECT user_id, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS notes FROM events WHERE event_type <> 'click' GROUP BY user_id""")
def adverse_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct notes of each key, joined in order."""
    return table(spark, sf_dir, "events").where("event_type <> 'click'").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "; ").alias("notes"))


@query("""WITH r AS (SELECT lang AS level, source AS query, doc_id AS key, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents),
g AS (SELECT DISTINCT lang AS level, source AS query, doc_id AS key FROM documents JOIN labels USING (doc_id) WHERE quality = 1), s AS (SELECT level, query, count(*) AS ng, k FROM g, (SELECT unnest([1, 5, 20]) AS k) GROUP BY ALL),
h AS (SELECT s.level, s.query, s.k, ng, count(g.key) AS found, min(CASE WHEN g.key IS NOT NULL THEN rank END) AS first FROM s LEFT JOIN r ON r.level = s.level AND r.query = s.query AND rank < k LEFT JOIN g ON g.level = r.level AND g.query = r.query AND g.key = r.key GROUP BY ALL),
m AS (SELECT level, k, count(*) AS n, avg(found / ng) AS recall, avg(found / k) AS precision, avg(coalesce(1.0 / (first + 1), 0)::DOUBLE) AS rr FROM h GROUP BY level, k)
SELECT level, k::INTEGER AS k, n, round(recall, 6) AS recall, round(precision, 6) AS precision, round(rr, 6) AS rr, round(CASE WHEN 4 * precision + recall <= 0 THEN 0 ELSE 5 * precision * recall / (4 * precision + recall) END, 6)::DOUBLE AS f2 FROM m""")
def ir_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures at several levels and depths in one pass."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("level"), F.col("source").alias("query"), F.col("doc_id").alias("key"), "n_chars")
    results = docs.withColumn("rank", F.row_number().over(Window.partitionBy("level", "query").orderBy(F.desc("n_chars"), "key")) - 1).where("rank < 20")
    gold = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("key")), "key").select("level", "query", "key")
    out = A.grid(results.select("level", "query", "key", "rank"), gold, [1, 5, 20])
    return out.select("level", "k", "n", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "rr", "f2")))


_ENDS = "e AS (SELECT l_orderkey AS s, l_partkey AS t FROM lineitem), d AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0 UNION SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0)"


def _ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_doc"), F.col("l_partkey").alias("target_doc"))
    return edges, table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id")).union(table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select("p_partkey"))


@query(f"WITH {_ENDS}, x AS (SELECT s AS id FROM e UNION ALL SELECT t FROM e WHERE t <> s) SELECT id, count(*)::BIGINT AS n FROM x WHERE id NOT IN (SELECT id FROM d) GROUP BY id")
def endpoint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges that aren't documents, with the number of edges that are dropped for them."""
    return C.with_ends(*_ends(spark, sf_dir))[1]


@query(f"WITH {_ENDS}, x AS (SELECT s AS id FROM e UNION ALL SELECT t FROM e WHERE t <> s) SELECT 'written' AS part, count(*)::BIGINT AS n FROM e WHERE s IN (SELECT id FROM d) AND t IN (SELECT id FROM d) UNION ALL SELECT 'given', count(*) FROM e UNION ALL SELECT 'unmatched', count(DISTINCT id) FROM x WHERE id NOT IN (SELECT id FROM d)")
def overlay_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a push of edges writes, and what it can't match."""
    return C.pushed(*_ends(spark, sf_dir))


@query("""WITH old AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t, l_returnflag AS r FROM lineitem WHERE l_linenumber = 1), new AS (SELECT DISTINCT 7::BIGINT AS s, l_partkey AS t, 'R' AS r FROM lineitem WHERE l_linenumber = 2)
SELECT s AS source_doc, t AS target_doc, r AS rel_type FROM old WHERE s <> 7 AND (s, t, r) NOT IN (SELECT (s, t, r) FROM new) UNION ALL SELECT s, t, r FROM new""")
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph after one document's edges came anew."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    old = l.where("l_linenumber = 1").select(F.col("l_suppkey").alias("source_doc"), F.col("l_partkey").alias("target_doc"), F.col("l_returnflag").alias("rel_type")).distinct()
    new = l.where("l_linenumber = 2").select(F.lit(7).cast("long").alias("source_doc"), F.col("l_partkey").alias("target_doc"), F.lit("R").alias("rel_type"))
    return C.replaced_outgoing(old, new, F.lit(7), ["source_doc", "target_doc", "rel_type"])


@query("SELECT l_partkey AS target_doc, min(l_suppkey) AS successor FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def unique_successor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replaces a document, where exactly one does."""
    return C.only_successor(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_discount > 0.08").select(F.col("l_suppkey").alias("source_doc"), F.col("l_partkey").alias("target_doc")))


@query("SELECT o_custkey, count(*)::BIGINT AS n_missing FROM (SELECT o_custkey, o_orderkey % 50 AS conv_id, o_custkey % 8 AS turn FROM orders) WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM conversations) GROUP BY 1")
def label_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which questions name units that don't exist."""
    wanted = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 50).alias("conv_id"), (F.col("o_custkey") % 8).alias("turn"))
    return C.missing_labels(wanted, table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "o_custkey")


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t, l_returnflag AS r FROM lineitem WHERE l_linenumber = 1), l AS (SELECT * FROM (VALUES ('A', 'amends', 'amended by'), ('R', 'repeals', 'repealed by')) v(r, a, p))
SELECT s AS doc, t AS other, coalesce(a, r) AS label FROM e LEFT JOIN l USING (r) UNION ALL SELECT t, s, coalesce(p, r) FROM e LEFT JOIN l USING (r)""")
def relations_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each relation from both its ends, in the words of that end."""
    edges = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("source_doc"), F.col("l_partkey").alias("target_doc"), F.col("l_returnflag").alias("rel_type")).distinct()
    return C.both_ways(edges, spark.createDataFrame([("A", "amends", "amended by"), ("R", "repeals", "repealed by")], "rel_type string, active string, passive string"))


@query("""WITH e AS (SELECT l_orderkey AS t, l_suppkey AS s, l_linenumber AS n FROM lineitem WHERE l_returnflag IN ('A', 'R')) SELECT t AS doc, 'Điều ' || n AS article, array_to_string(list_sort(list(DISTINCT s)), ',') AS amenders FROM e WHERE n <> 4 GROUP BY t, n""")
def amendment_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who amends each article, from the anchors of edges."""
    article = F.when(F.col("l_linenumber") != 4, F.concat(F.lit("Điều "), _s("l_linenumber"))).otherwise("")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_doc"), F.col("l_orderkey").alias("target_doc"), F.col("l_returnflag").alias("rel_type"), F.array(F.struct(F.lit("").alias("source_article"), article.alias("target_article"))).alias("anchors"))
    return C.amenders(edges, ["A", "R"]).select("doc", "article", F.array_join(F.transform("amenders", lambda x: x.cast("string")), ",").alias("amenders"))


@query("""WITH a AS (SELECT p_partkey AS id, p_type || ' [' || p_name || '] or [Brand' || p_size || ']' AS text, [p_name, 'Brand' || p_size] AS ms FROM part), c AS (SELECT p_partkey AS id, 1 AS ord, split_part(p_name, ' ', 1) AS label, 'xx' AS title FROM part UNION ALL SELECT p_partkey, 2, 'Brand' || (p_size // 2 * 2), p_name FROM part),
m AS (SELECT id, i - 1 AS place, ms[i] AS marker FROM a, range(1, 3) r(i))
SELECT m.id, place::INTEGER AS place, marker, arg_min(label, ord) FILTER (contains(marker, label) OR contains(label, marker) OR contains(marker, left(title, 20))) AS citation FROM m JOIN c ON c.id = m.id GROUP BY m.id, place, marker""")
def citation_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citation that each marker of an answer means: the first that fits."""
    p = table(spark, sf_dir, "part")
    answers = p.select(F.col("p_partkey").alias("id"), F.concat("p_type", F.lit(" ["), "p_name", F.lit("] or [Brand"), _s("p_size"), F.lit("]")).alias("text"))
    one = p.select(F.col("p_partkey").alias("id"), F.lit(1).alias("ord"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("label"), F.lit("xx").alias("title"))
    two = p.select("p_partkey", F.lit(2), F.concat(F.lit("Brand"), _s(F.floor(F.col("p_size") / 2) * 2)), "p_name")
    return C.marked(answers, one.unionAll(two))


@query("""WITH b AS (SELECT c_nationkey AS query, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), x AS (SELECT c_nationkey AS query, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer),
u AS (SELECT query, id, 0 AS part, rank FROM b WHERE rank <= 5 UNION ALL SELECT query, id, 1, rank FROM x WHERE rank <= 5), f AS (SELECT query, id, min((part, rank)) AS w FROM u GROUP BY ALL)
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY w, id)::INTEGER AS place FROM f""")
def base_then_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one search, then those of another that aren't among them."""
    from tempora.operators.positional import top_per_group

    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("id"), "c_acctbal")
    return C.base_then_extra(top_per_group(c, ["query"], [F.desc("c_acctbal"), "id"], 5), top_per_group(c, ["query"], ["id"], 5))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') > 200 AS capped FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 200")
def capped_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection with a cap, which is the feature, and whether it was reached."""
    return C.capped(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), ["o_orderkey"], 200)


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey))[1:8], ', ') || CASE WHEN count(*) > 8 THEN ' +' || (count(*) - 8) ELSE '' END AS named FROM orders GROUP BY o_custkey")
def shortened_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight members of each list, and how many more there are."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("xs"))
    return lists.select("o_custkey", C.shortened(F.transform("xs", lambda x: x.cast("string")), 8).alias("named"))


_TREE = "t AS (SELECT conv_id, turn, turn % 4 + (conv_id + turn) % 2 AS depth FROM (SELECT DISTINCT conv_id, turn FROM conversations)), w AS (SELECT a.conv_id, a.turn, a.depth, max(b.turn) AS parent FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.depth < a.depth GROUP BY ALL)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct().withColumn("depth", F.col("turn") % 4 + (F.col("conv_id") + F.col("turn")) % 2)
    return C.parents(nodes, "conv_id", "turn", "depth", 5)


@query(f"WITH {_TREE} SELECT conv_id, turn, parent FROM w")
def tree_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent of each node of a flat list with depths: the nearest before it that is less deep."""
    return _tree(spark, sf_dir).select("conv_id", "turn", "parent")


@query(f"WITH RECURSIVE {_TREE}, p AS (SELECT conv_id, turn, turn::VARCHAR AS path FROM w WHERE parent IS NULL UNION ALL SELECT w.conv_id, w.turn, p.path || '/' || w.turn FROM w JOIN p ON w.conv_id = p.conv_id AND w.parent = p.turn) SELECT conv_id, turn, path FROM p")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path from the root to each node."""
    out = C.paths(_tree(spark, sf_dir), "conv_id", "turn", 5)
    return out.select("conv_id", "turn", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query("""WITH a AS (SELECT doc_id, count(*) FILTER (l <> '') AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1), b AS (SELECT doc_id, len(regexp_extract_all(text, '[.]\\n')) + 1 AS n FROM documents)
SELECT doc_id, b.n::BIGINT AS in_tree, a.n::BIGINT AS in_text FROM a JOIN b USING (doc_id) WHERE b.n < a.n""")
def tree_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose units, counted one way, are fewer than counted in the text."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).groupBy("doc_id").agg(F.count_if(F.col("l") != "").alias("n"))
    units = d.select("doc_id", (F.size(F.regexp_extract_all("text", F.lit(r"[.]\n"), F.lit(0))) + 1).cast("long").alias("n"))
    return C.covered(units, lines, "doc_id")


@query("""WITH i AS (SELECT o_custkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'out' ELSE 'in' END AS direction, o_orderstatus AS category, o_orderkey AS title FROM orders), l AS (SELECT doc, direction, category, list_sort(list(title)) AS ts FROM i GROUP BY ALL)
SELECT doc, direction, string_agg(category || '=' || array_to_string(ts, ','), ';' ORDER BY category) AS groups FROM l GROUP BY doc, direction""")
def grouped_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by direction and category, nested."""
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.when(F.col("o_orderkey") % 2 == 0, "out").otherwise("in").alias("direction"), F.col("o_orderstatus").alias("category"), F.col("o_orderkey").alias("title"))
    line = F.transform(F.map_entries("groups"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.transform(e["value"], lambda t: t.cast("string")), ",")))
    return C.grouped(items).select("doc", "direction", F.array_join(F.array_sort(line), ";").alias("groups"))


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_type <> 'click' AND event_id % 3 <> 0 GROUP BY ALL""")
def labelled_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One copy of each key, the first with a label; keys without a label are dropped."""
    e = table(spark, sf_dir, "events").where("event_type <> 'click'").withColumn("label", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).otherwise(" "))
    return C.labelled_first(e, ["user_id", "event_type"], "label", "event_id").select("user_id", "event_type", "event_id")


@query("""WITH x AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS ws, ['the', 'der', 'le', 'el'] AS k FROM documents), y AS (SELECT doc_id, k, list_intersect(ws, k) AS h, ws FROM x)
SELECT doc_id, CASE WHEN len(h) = len(k) THEN 'all' WHEN len(h) > 0 THEN 'some' ELSE 'none' END AS part FROM y""")
def three_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all, some or none of what is named is known."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("known"), F.array(*map(F.lit, ("the", "der", "le", "el"))).alias("named"))
    return C.three_ways(d, "named", "known").select("doc_id", "part")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS k, CASE WHEN event_id % 5 = 0 THEN left(props, length(props) - 1) END AS raw FROM events""")
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed properties, and the raw text of those that can't be read."""
    said = F.when(F.col("event_id") % 5 == 0, F.left("props", F.char_length("props") - 1)).otherwise(F.col("props"))
    read = L.lenient_json(said, "k:bigint")
    return table(spark, sf_dir, "events").select("event_id", read.alias("x")).select("event_id", F.when(F.col("x._raw").isNull(), F.col("x.k")).alias("k"), F.col("x._raw").alias("raw"))


@query("""SELECT p_partkey, coalesce(CASE lower(p_type) WHEN 'economy' THEN 'Economy' WHEN 'standard' THEN 'Standard' END, p_type) AS spelled, CASE WHEN p_type = 'ECONOMY' THEN 'cheap' ELSE 'khac:' || p_type END AS badge,
CASE WHEN starts_with(p_brand, 'Brand#1') THEN trim(substr(p_brand, 8)) ELSE p_brand END AS heading, regexp_extract(p_brand, '[0-9]+') AS first_number, upper(replace(p_name, ' ', '')) AS slug, 'Điều ' || p_size AS article, p_brand AS doc, p_size::VARCHAR AS no,
CASE WHEN p_size % 2 = 0 THEN p_type END AS alias, CASE WHEN p_size % 3 = 0 THEN 'any' WHEN p_size % 3 = 1 THEN 'all' ELSE 'unknown' END AS logic, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'a AND b' WHEN p_size % 2 = 0 THEN 'a' WHEN p_size % 3 = 0 THEN 'b' END AS guard FROM part""")
def label_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of parts: spelling, badges, headings, numbers, slugs, addresses, aliases, lead-ins and guards."""
    two, three = F.col("p_size") % 2 == 0, F.col("p_size") % 3
    split = L.split_label(F.concat("p_brand", F.lit("_"), _s("p_size")))
    alias = L.alias_of(F.when(two, F.concat(F.lit("Tên (sau đây gọi là "), "p_type", F.lit(" ) tiếp"))).otherwise(F.col("p_type")))
    lead = F.when(three == 0, "đáp ứng Một trong các điều kiện").when(three == 1, "đáp ứng đủ").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", L.spelled(F.concat(F.col("p_type"), F.lit(" ")), ["Economy", "Standard"]).alias("spelled0"), L.badge(F.col("p_type"), {"economy": "cheap"}).alias("badge"), L.heading(F.lit("Brand#1"), F.col("p_brand")).alias("heading"),
        L.first_number(F.col("p_brand"), "[0-9]+").alias("first_number"), L.slug_number(F.concat("p_name", F.lit("--77"))).alias("slug"), L.article_name(F.concat(F.lit("dieu "), _s("p_size"))).alias("article"),
        split["doc"].alias("doc"), split["article"].alias("no"), alias.alias("alias"), L.logic(lead).alias("logic"), L.conjunction(F.array(F.when(two, "a"), F.when(three == 0, "b"))).alias("guard"),
    ).withColumn("spelled", F.trim("spelled0")).drop("spelled0")


@query("""SELECT vec_id, list_max(list_transform(list_zip(embedding, list_transform(embedding, lambda x: x + CASE WHEN vec_id % 2 = 0 THEN 0.0 ELSE 0.001 END)), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) < 1e-6 AS same FROM embeddings""")
def vector_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two vectors are the same but for rounding."""
    v = F.col("embedding").cast("array<double>")
    moved = F.transform(v, lambda x: x + F.when(F.col("vec_id") % 2 == 0, 0.0).otherwise(0.001))
    return table(spark, sf_dir, "embeddings").select("vec_id", L.same_vector(v, moved).alias("same"))


@query("""WITH r AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT row_number() OVER (ORDER BY source) + 1 AS place, '| ' || source || ' | ' || n || ' |' AS line FROM r) SELECT 0::INTEGER AS place, '| source | n |' AS line UNION ALL SELECT 1, '|-|-|' UNION ALL SELECT place::INTEGER, line FROM b""")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count by source as the lines of a Markdown table."""
    return C.markdown(table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), ["source"])


@query("SELECT doc_id, md5('Doc ' || doc_id || ' — ' || source || ': ' || text) AS said FROM documents")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document would be embedded, as a digest."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(L.embedding_text(F.concat(F.lit("Doc "), _s("doc_id")), F.col("source"), F.col("text"))).alias("said"))


_LINES = "l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line, (length(array_to_string(ls[1:i - 1], chr(10))) + CASE WHEN i > 1 THEN 1 ELSE 0 END)::INTEGER AS start FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls) + 1) r(i))"


@query("""WITH r AS (SELECT l_orderkey, 'repeated' AS fault, l_suppkey % 9 AS number FROM lineitem GROUP BY l_orderkey, l_suppkey % 9 HAVING count(*) > 1), o AS (SELECT l_orderkey, 'out_of_order' AS fault, number FROM (SELECT l_orderkey, l_suppkey % 9 AS number, lag(l_suppkey % 9) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) WHERE number < b),
s AS (SELECT l_orderkey, list(DISTINCT l_suppkey % 9) AS xs FROM lineitem GROUP BY 1), m AS (SELECT l_orderkey, 'missing' AS fault, unnest(list_filter(range(list_min(xs), list_max(xs) + 1), lambda x: NOT list_contains(xs, x))) AS number FROM s)
SELECT * FROM r UNION ALL SELECT * FROM o UNION ALL SELECT * FROM m""")
def sequence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that repeat, run backwards or are missing in each list."""
    l = table(spark, sf_dir, "lineitem").withColumn("number", F.col("l_suppkey") % 9)  # noqa: E741
    return P.sequence_faults(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "number")


@query(f"WITH {_LINES} SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l WHERE line_no = 1 AND line LIKE '%e%')")
def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose units all give their text back; second lines with an e are broken first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    units = P.lines_with_offsets(docs, "text").withColumns({"char_start": F.col("start"), "char_end": F.col("start") + F.char_length("line")})
    broken = (F.col("line_no") == 1) & F.col("line").contains("e")
    return X.whole_documents(units.withColumn("line", F.when(broken, F.concat("line", F.lit("x"))).otherwise(F.col("line"))), "doc_id", "text", "line")


@query(f"WITH {_LINES}, e AS (SELECT doc_id AS doc, (n_chars // 3)::INTEGER AS span_start, (n_chars // 3 + 12)::INTEGER AS span_end, text FROM documents) SELECT doc, span_start, span_end, min(l.line_no)::INTEGER AS article, substr(text, span_start + 1, 12) AS span_text FROM e LEFT JOIN l ON l.doc_id = doc AND l.start <= span_start AND span_end <= l.start + length(l.line) GROUP BY ALL")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit that holds each span, and the span's text."""
    docs = table(spark, sf_dir, "documents")
    a = F.floor(F.col("n_chars") / 3).cast("int")
    edges = docs.select(F.col("doc_id").alias("doc"), a.alias("span_start"), (a + 12).alias("span_end"))
    lines = P.lines_with_offsets(docs.select(F.col("doc_id").alias("doc"), "text"), "text").select("doc", F.col("line_no").alias("article"), F.col("start").alias("char_start"), (F.col("start") + F.char_length("line")).alias("char_end"))
    return X.provenance(edges, lines, docs.select(F.col("doc_id").alias("doc"), "text")).select("doc", "span_start", "span_end", "article", "span_text")


@query(f"""WITH {_LINES}, c AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'the' ELSE '' END AS quote FROM documents), h AS (SELECT doc_id, count(*) AS n, min(start) AS a, max(start + length(line)) AS b, min(CASE WHEN quote <> '' AND contains(line, quote) THEN start + strpos(line, quote) - 1 END) AS q FROM l JOIN c USING (doc_id) WHERE line_no < 2 GROUP BY doc_id)
SELECT c.doc_id AS id, CASE WHEN n = 2 THEN coalesce(q, a) END::INTEGER AS start, CASE WHEN n = 2 THEN CASE WHEN q IS NOT NULL THEN q + 3 ELSE b END END::INTEGER AS "end" FROM c LEFT JOIN h USING (doc_id)""")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of the units that a claim names, narrowed to its quote; null where one doesn't exist."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    units = P.lines_with_offsets(docs, "text").select("id", F.col("line_no").alias("uid"), "start", (F.col("start") + F.char_length("line")).alias("end"), F.col("line").alias("text"))
    claims = docs.select("id", F.array(F.lit(0), F.lit(1), F.lit(1)).alias("uids"), F.when(F.col("id") % 2 == 0, "the").otherwise("").alias("quote"))
    return X.grounded(claims, units)


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Phạm vi điều chỉnh' WHEN p_size % 5 = 1 THEN 'Giải thích từ ngữ' ELSE p_name END AS title, CASE WHEN p_size % 3 = 0 THEN 'Ngân hàng phải ' WHEN p_size % 3 = 1 THEN 'nếu ' ELSE '' END || p_type || CASE WHEN p_size % 7 = 0 THEN ' có hiệu lực từ ngày ' || (p_size % 28 + 1) || ' tháng 2 năm 2024' ELSE '' END AS s, p_size FROM part)
SELECT p_partkey, CASE WHEN contains(title, 'Phạm vi') OR contains(s, 'hiệu lực') THEN 'gate' WHEN contains(title, 'Giải thích') THEN 'definition' WHEN contains(s, 'phải') THEN 'actor' WHEN contains(s, 'nếu') THEN 'condition' ELSE 'premise' END AS kind, CASE WHEN contains(s, 'hiệu lực') THEN make_date(2024, 2, p_size % 28 + 1) END AS effect FROM t""")
def unit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units as gates, definitions, norms, conditions or premises, and the day that they take effect."""
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    title = F.when(size % 5 == 0, "Phạm vi điều chỉnh").when(size % 5 == 1, "Giải thích từ ngữ").otherwise(F.col("p_name"))
    lead = F.when(size % 3 == 0, "Ngân hàng phải ").when(size % 3 == 1, "nếu ").otherwise("")
    day = F.when(size % 7 == 0, F.concat(F.lit(" có hiệu lực từ ngày "), _s(size % 28 + 1), F.lit(" tháng 2 năm 2024"))).otherwise("")
    said = F.concat(lead, F.col("p_type"), day)
    return p.select("p_partkey", N.unit_class(said, title)[0].alias("kind"), N.effect_date(said).alias("effect"))


@query("""WITH p AS (SELECT l_orderkey AS id, l_linenumber AS point, l_quantity AS v FROM lineitem WHERE l_suppkey % 4 <> 0), g AS (SELECT l_orderkey AS id, l_linenumber AS point, CASE WHEN l_partkey % 5 = 0 THEN l_quantity + 1 ELSE l_quantity END AS v FROM lineitem WHERE l_partkey % 3 <> 0),
k AS (SELECT id FROM p INTERSECT SELECT id FROM g), j AS (SELECT coalesce(p.id, g.id) AS id, coalesce(p.point, g.point) AS point, p.v AS a, g.v AS b FROM (SELECT * FROM p WHERE id IN (SELECT id FROM k)) p FULL JOIN (SELECT * FROM g WHERE id IN (SELECT id FROM k)) g ON p.id = g.id AND p.point = g.point)
SELECT CASE WHEN b IS NULL THEN 'extra' WHEN a IS NULL THEN 'lost' WHEN a = b THEN 'same' ELSE 'different' END AS state, count(*)::BIGINT AS n FROM j GROUP BY 1""")
def compared_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of records on both sides: same, different, extra and lost."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("point"), F.col("l_quantity").alias("value"), "l_suppkey", "l_partkey")  # noqa: E741
    gold = l.where("l_partkey % 3 <> 0").withColumn("value", F.when(F.col("l_partkey") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return N.compared_conditions(l.where("l_suppkey % 4 <> 0").select("id", "point", "value"), gold.select("id", "point", "value")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
