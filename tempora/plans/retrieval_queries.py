"""Ranking queries, and measures of them, on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import text as T
from tempora.operators import evaluation as E
from tempora.operators import positional as P
from tempora.operators import retrieval as R
from tempora.plans.catalog import query
from tempora.session import table

_TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
_VQ = "q AS (SELECT vec_id AS query, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0)"
_COS = f"""{_VQ}, dense AS (SELECT query, vec_id AS id, round(list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[]), 9) AS score FROM q, embeddings),
dr AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS rank FROM dense)"""
_BM = f"""bq AS (SELECT item_id AS query, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM benchmark),
toks AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
post AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM toks), tf AS (SELECT id, dl, term, count(*) AS tf FROM post WHERE term IN (SELECT term FROM bq) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN bq USING (term), st GROUP BY query, id)"""


def _vector_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return items.where("id % 100 = 0").select(F.col("id").alias("query"), "vector"), items


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text"), items


@query(f"WITH {_COS} SELECT query, id, round(score, 6) AS score, rank::INTEGER AS rank FROM dr WHERE rank < 15")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors by cosine."""
    return R.vector_pool(*_vector_queries(spark, sf_dir), 15).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_VQ}, s AS (SELECT query, vec_id AS id, -round(list_distance(qv::DOUBLE[], embedding::DOUBLE[]), 9) AS score FROM q, embeddings)
SELECT query, id, round(score, 6) + 0.0 AS score, (row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1)::INTEGER AS rank FROM s QUALIFY rank < 15""")
def l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors by Euclidean distance."""
    return R.vector_pool(*_vector_queries(spark, sf_dir), 15, "l2").select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_BM}, r AS (SELECT query, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM bm)
SELECT query, id, round(score, 5) AS score, rank::INTEGER AS rank FROM r WHERE rank < 15""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of every document for every benchmark text."""
    return R.bm25_pool(*_texts(spark, sf_dir), 15).select("query", "id", F.round("score", 5).alias("score"), "rank")


@query(rf"""WITH l AS (SELECT doc_id AS id, ' ' || array_to_string({_TOKENS.format('text')}, ' ') || ' ' AS line FROM documents),
p AS (SELECT item_id AS query, ' ' || array_to_string({_TOKENS.format('text')}, ' ') || ' ' AS phrase FROM benchmark)
SELECT query, id, 2.0::DOUBLE AS score FROM p, l WHERE phrase <> '  ' AND contains(line, phrase)""")
def phrase_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark text stands as a phrase."""
    return R.phrase_bonus(*_texts(spark, sf_dir), 2.0)


_BRANCHES = f"""dv AS (SELECT vec_id, embedding FROM embeddings), hq AS (SELECT item_id AS query, embedding AS qv FROM benchmark JOIN dv ON vec_id = item_id),
dense AS (SELECT query, vec_id AS id, round(list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[]), 9) AS score FROM hq, dv),
dr AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS rank FROM dense),
{_BM}, sr AS (SELECT query, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM bm)"""


def _branches(spark: SparkSession, sf_dir: str, pool: int = 15) -> tuple[DataFrame, DataFrame]:
    """A vector branch and a BM25 branch of every benchmark text, each over all its table."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked, docs = _texts(spark, sf_dir)
    queries = asked.select("query").join(vectors.select(F.col("id").alias("query"), "vector"), "query")
    return R.vector_pool(queries, vectors, pool), R.bm25_pool(asked, docs, pool)


@query(f"""WITH {_BRANCHES}, u AS (SELECT query, id, 1.0 / (60 + rank) AS part FROM dr WHERE rank < 15 UNION ALL SELECT query, id, 0.1 / (60 + rank) FROM sr WHERE rank < 15)
SELECT query, id, round(sum(part), 9)::DOUBLE AS score FROM u GROUP BY query, id""")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches fused by weighted reciprocal ranks."""
    dense, sparse = _branches(spark, sf_dir)
    return R.rrf({"dense": (dense, R.DENSE), "sparse": (sparse, R.SPARSE)}).select("query", "id", F.round("score", 9).alias("score"))


@query(f"""WITH {_BRANCHES}, a AS (SELECT query, id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM sr WHERE rank < 15 WINDOW w AS (PARTITION BY query)),
b AS (SELECT query, id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS d FROM dr WHERE rank < 15 WINDOW w AS (PARTITION BY query))
SELECT query, id, round(0.75 * coalesce(s, 0) + 0.25 * coalesce(d, 0), 6)::DOUBLE AS score FROM a FULL JOIN b USING (query, id)""")
def minmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches fused by scaled scores."""
    dense, sparse = _branches(spark, sf_dir)
    return R.fused(sparse, dense).select("query", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {_BRANCHES}, w AS (SELECT unnest([0.0, 0.1, 1.0]) AS weight),
u AS (SELECT weight, query, id, 1.0 / (60 + rank) AS part FROM dr, w WHERE rank < 15 UNION ALL SELECT weight, query, id, weight / (60 + rank) FROM sr, w WHERE rank < 15 AND weight > 0)
SELECT weight::DOUBLE AS weight, query, id, round(sum(part), 9)::DOUBLE AS score FROM u GROUP BY ALL""")
def weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fusion for several sparse weights, from branches that are ranked once."""
    return R.sweep(*_branches(spark, sf_dir), [0.0, 0.1, 1.0]).select("weight", "query", "id", F.round("score", 9).alias("score"))


_HYBRID = f"""dv AS (SELECT vec_id, embedding FROM embeddings), hq AS (SELECT item_id AS query, embedding AS qv FROM benchmark JOIN dv ON vec_id = item_id),
items AS (SELECT doc_id AS id, embedding AS vector, n_chars, lang FROM documents LEFT JOIN dv ON vec_id = doc_id {{scope}}),
toks AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS w FROM documents WHERE doc_id IN (SELECT id FROM items)), st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
bq AS (SELECT item_id AS query, unnest(list_distinct({_TOKENS.format('text')})) AS term FROM benchmark WHERE item_id IN (SELECT query FROM hq)),
tf AS (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM toks) WHERE term IN (SELECT term FROM bq) GROUP BY id, w, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM tf JOIN df USING (term) JOIN bq USING (term), st GROUP BY query, id),
sr AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS rank FROM bm),
cs AS (SELECT query, id, round(list_cosine_similarity(qv::DOUBLE[], vector::DOUBLE[]), 9) AS score FROM hq, items WHERE vector IS NOT NULL),
dr AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS rank FROM cs),
u AS (SELECT query, id, 1.0 / (60 + rank) AS part, rank AS seen FROM dr WHERE rank < {{pool}} UNION ALL SELECT query, id, 0.1 / (60 + rank), 1000000 + rank FROM sr WHERE rank < {{pool}}),
f AS (SELECT query, id, sum(part) AS score, min(seen) AS seen FROM u GROUP BY query, id),
p AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen) AS place FROM f JOIN items USING (id) WHERE n_chars <= 1500)
SELECT query, id, round(score, 9)::DOUBLE AS score, place::INTEGER AS place FROM p WHERE place <= {{k}}"""


def _hybrid_sql(scope: str, pool: int, k: int) -> str:
    return _HYBRID.replace("{scope}", scope).replace("{pool}", str(pool)).replace("{k}", str(k))


def _hybrid(spark: SparkSession, sf_dir: str, k: int, scope=None) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "n_chars", "lang").join(vectors, "id", "left")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text").join(vectors.select(F.col("id").alias("query"), "vector"), "query")
    return R.hybrid(queries, items, F.col("n_chars") <= 1500, k, scope=scope).select("query", "id", F.round("score", 9).alias("score"), "place")


@query("WITH " + _hybrid_sql("", 18, 6))
def hybrid_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and BM25 fused for every benchmark text; what isn't valid is dropped after the fusion."""
    return _hybrid(spark, sf_dir, 6)


@query("WITH " + _hybrid_sql("WHERE lang = 'en'", 8, 3))
def scoped_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within a scope of documents that is applied before ranking."""
    return _hybrid(spark, sf_dir, 3, F.col("lang") == "en")


@query("""
SELECT prefix, p_partkey, rank::INTEGER AS rank FROM (SELECT split_part(p_name, ' ', 1) AS prefix, p_partkey, row_number() OVER (PARTITION BY split_part(p_name, ' ', 1)
  ORDER BY list_transform(regexp_extract_all(p_name, '[0-9]+'), lambda x: x::BIGINT), p_partkey) AS rank FROM part) WHERE rank <= 2""")
def prefix_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two labels under each prefix, in natural order."""
    from tempora.functions.keys import numbers_in

    part = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("prefix"), "p_partkey", numbers_in(F.col("p_name")).alias("k"))
    return P.top_per_group(part, ["prefix"], ["k", "p_partkey"], 2).select("prefix", "p_partkey", "rank")


_IR = """r AS (SELECT lang AS query, doc_id AS key, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents),
g AS (SELECT DISTINCT lang AS query, doc_id AS key FROM documents JOIN labels USING (doc_id) WHERE quality = 1), s AS (SELECT query, count(*) AS n_gold FROM g GROUP BY query)"""


def _rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    results = P.top_per_group(docs, ["lang"], [F.desc("n_chars"), "doc_id"], 20).select(F.col("lang").alias("query"), F.col("doc_id").alias("key"), (F.col("rank") - 1).alias("rank"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return results, docs.join(good, "doc_id").select(F.col("lang").alias("query"), F.col("doc_id").alias("key"))


@query(f"""WITH {_IR}, ks AS (SELECT unnest([1, 2, 5, 10, 20]) AS k), h AS (SELECT k, s.query, n_gold, count(g.key) AS found, min(CASE WHEN g.key IS NOT NULL THEN rank END) AS first
  FROM s CROSS JOIN ks JOIN r ON r.query = s.query AND rank < k LEFT JOIN g ON g.query = r.query AND g.key = r.key GROUP BY ALL),
m AS (SELECT k, query, found / n_gold AS recall, found / k AS precision, coalesce(1.0 / (first + 1), 0.0) AS rr FROM h)
SELECT k::INTEGER AS k, query, round(recall, 6) AS recall, round(precision, 6) AS precision, round(rr, 6)::DOUBLE AS rr, round(CASE WHEN 4 * precision + recall <= 0 THEN 0 ELSE 5 * precision * recall / (4 * precision + recall) END, 6)::DOUBLE AS f2 FROM m""")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision, reciprocal rank and F2 at several depths."""
    results, gold = _rankings(spark, sf_dir)
    out = None
    for k in (1, 2, 5, 10, 20):
        part = E.ranking_measures(results, gold, k).select(F.lit(k).alias("k"), "query", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "rr", "f2")))
        out = part if out is None else out.unionAll(part)
    return out


@query(f"""WITH {_IR}, h AS (SELECT s.query, n_gold, count(g.key) AS found, min(CASE WHEN g.key IS NOT NULL THEN rank END) AS first
  FROM s JOIN r ON r.query = s.query AND rank < 10 LEFT JOIN g ON g.query = r.query AND g.key = r.key GROUP BY ALL),
m AS (SELECT found / n_gold AS r, found / 10 AS p, coalesce(1.0 / (first + 1), 0.0)::DOUBLE AS rr FROM h), a AS (SELECT count(*)::BIGINT AS n, avg(r) AS r, avg(p) AS p, avg(rr) AS rr, avg(CASE WHEN 4 * p + r <= 0 THEN 0 ELSE 5 * p * r / (4 * p + r) END) AS fm FROM m)
SELECT n, round(r, 6) AS recall, round(p, 6) AS precision, round(rr, 6) AS rr, round(fm, 6) AS f2_macro, round(CASE WHEN 4 * p + r <= 0 THEN 0 ELSE 5 * p * r / (4 * p + r) END, 6)::DOUBLE AS f2 FROM a""")
def ir_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The averages, with F2 of the averages beside the average of F2."""
    out = E.macro(E.ranking_measures(*_rankings(spark, sf_dir), 10))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "rr", "f2_macro", "f2")))


_PAIRS = """g AS (SELECT DISTINCT least(c_custkey, c_nationkey) AS a, greatest(c_custkey, c_nationkey) AS b FROM customer WHERE c_acctbal > 0),
p AS (SELECT DISTINCT least(c_custkey, c_nationkey) AS a, greatest(c_custkey, c_nationkey) AS b FROM customer WHERE c_mktsegment = 'BUILDING')"""


@query(f"""WITH {_PAIRS}, c AS (SELECT (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM g JOIN p USING (a, b)) AS n_hit)
SELECT n_gold::BIGINT AS n_gold, n_predicted::BIGINT AS n_predicted, n_hit::BIGINT AS n_hit, round(n_hit / n_gold, 3) AS recall, round(n_hit / n_predicted, 3) AS precision FROM c""")
def pair_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled recall and precision of unordered pairs."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").cast("long").alias("b"), "c_acctbal", "c_mktsegment")
    return E.pair_measures(c.where("c_acctbal > 0"), c.where("c_mktsegment = 'BUILDING'"))


@query("""
WITH v AS (SELECT lang, CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 0.0 WHEN quality = 1 THEN 1.0 ELSE 0.5 END AS w FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id))
SELECT lang, count(w)::BIGINT AS n, coalesce(round_even(100 * avg(w), 0), 0)::DOUBLE AS score FROM v GROUP BY lang""")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted score of verdicts; what wasn't assessed is out of the denominator."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    verdict = F.when(F.col("quality").isNull(), "not_assessed").when(F.col("toxic") == 1, "violation").when(F.col("quality") == 1, "pass").otherwise("warning")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left").withColumn("verdict", verdict)
    return docs.groupBy("lang").agg(F.count_if(F.col("verdict") != "not_assessed").alias("n"), E.weighted_score(F.col("verdict")).alias("score"))


@query("""
WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'pass' WHEN o_orderkey % 3 = 1 THEN 'warning' ELSE 'violation' END AS a, CASE WHEN o_custkey % 2 = 0 THEN 'pass' ELSE 'violation' END AS b,
  CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'warning' ELSE 'violation' END AS c FROM orders)
SELECT CASE WHEN a = b THEN a WHEN c = a OR c = b THEN c ELSE 'warning' END AS verdict, count(*)::BIGINT AS n FROM v GROUP BY 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two votes, a third where they differ, a warning where all differ."""
    pick = lambda c, *xs: F.when(c == 0, xs[0]).when(c == 1, xs[1]).otherwise(xs[2])
    status = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "warning").otherwise("violation")
    vote = E.majority(pick(F.col("o_orderkey") % 3, "pass", "warning", "violation"), F.when(F.col("o_custkey") % 2 == 0, "pass").otherwise("violation"), status)
    return table(spark, sf_dir, "orders").select(vote.alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_custkey, list_sort(list(o_totalprice))[(count(*) // 2)::BIGINT + 1] AS median FROM orders GROUP BY o_custkey""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median, not interpolated."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(E.upper_median(F.col("o_totalprice")).alias("median"))


@query(r"""
WITH s AS (SELECT doc_id, strpos(lower(text), 'th') - 1 AS a, strpos(lower(text), 'en') - 1 AS b FROM documents), p AS (SELECT doc_id, a, a + 20 AS ae, b, b + 30 AS be FROM s WHERE a >= 0 AND b >= 0)
SELECT doc_id, round(greatest(least(ae, be) - greatest(a, b), 0) / (greatest(ae, be) - least(a, b)), 6) AS iou FROM p""")
def span_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of two spans over their hull."""
    spans = table(spark, sf_dir, "documents").select("doc_id", (F.instr(F.lower("text"), "th") - 1).alias("a"), (F.instr(F.lower("text"), "en") - 1).alias("b")).where("a >= 0 AND b >= 0")
    a, b = F.col("a"), F.col("b")
    return spans.select("doc_id", F.round(E.hull_iou(a, a + 20, b, b + 30), 6).alias("iou"))


@query("""
WITH v AS (SELECT CASE WHEN toxic = 1 THEN 'violation' ELSE 'pass' END AS gold, CASE WHEN doc_id % 5 = 0 THEN 'not_assessed' WHEN quality = 0 THEN 'warning' WHEN doc_id % 7 = 0 THEN 'violation' ELSE 'pass' END AS verdict FROM labels),
g AS (SELECT CASE WHEN verdict = 'not_assessed' THEN 'unassessed' WHEN verdict = gold THEN 'correct' WHEN gold = 'violation' AND verdict = 'warning' THEN 'half' ELSE 'wrong' END AS g FROM v),
c AS (SELECT count(*) FILTER (g = 'correct') AS correct, count(*) FILTER (g = 'half') AS half, count(*) FILTER (g = 'wrong') AS wrong, count(*) FILTER (g = 'unassessed') AS unassessed FROM g)
SELECT correct::BIGINT AS correct, half::BIGINT AS half, wrong::BIGINT AS wrong, unassessed::BIGINT AS unassessed, round(correct / nullif(correct + half + wrong, 0), 3) AS share FROM c""")
def compliance_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts against gold: correct, half, wrong, unassessed."""
    verdict = F.when(F.col("doc_id") % 5 == 0, "not_assessed").when(F.col("quality") == 0, "warning").when(F.col("doc_id") % 7 == 0, "violation").otherwise("pass")
    return E.grades(table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "violation").otherwise("pass").alias("gold"), verdict.alias("verdict")))


@query("WITH " + _hybrid_sql("", 18, 6).replace("SELECT query, id, round(score, 9)::DOUBLE AS score, place::INTEGER AS place FROM p WHERE place <= 6", """
, b AS (SELECT query, id, place FROM p WHERE place <= 6), ed AS (SELECT doc_id AS s, (doc_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS t FROM documents),
nb AS (SELECT DISTINCT query, x AS id FROM (SELECT query, t AS x FROM b JOIN ed ON s = id UNION ALL SELECT query, s FROM b JOIN ed ON t = id) z WHERE NOT EXISTS (SELECT 1 FROM b q WHERE q.query = z.query AND q.id = z.x)),
d2 AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS rank FROM cs JOIN nb USING (query, id)), s2 AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) - 1 AS rank FROM bm JOIN nb USING (query, id)),
u2 AS (SELECT query, id, 1.0 / (60 + rank) AS part, rank AS seen FROM d2 WHERE rank < 8 UNION ALL SELECT query, id, 0.1 / (60 + rank), 1000000 + rank FROM s2 WHERE rank < 8), f2 AS (SELECT query, id, sum(part) AS score, min(seen) AS seen FROM u2 GROUP BY query, id),
x AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, seen) AS place FROM f2 JOIN items USING (id) WHERE n_chars <= 1500)
SELECT query, id, 'base' AS part, place::INTEGER AS place FROM b UNION ALL SELECT query, id, 'extra', place::INTEGER FROM x WHERE place <= 3"""))
def graph_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid's hits, then up to three from the documents one edge away from theirs."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    docs = table(spark, sf_dir, "documents")
    items = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), "n_chars").join(vectors, "id", "left")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text").join(vectors.select(F.col("id").alias("query"), "vector"), "query")
    edges = docs.select(F.col("doc_id").alias("source_doc"), ((F.col("doc_id") * 7 + 3) % vectors.count()).alias("target_doc"))
    return R.graph_augmented(queries, items, edges, F.col("n_chars") <= 1500)
