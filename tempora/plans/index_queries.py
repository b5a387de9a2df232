"""The persistent inverted index on the driver tables: loads, coverage, BM25 and phrases from postings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators import retrieval as R
from tempora.operators.text_index import TextIndex
from tempora.plans.catalog import query
from tempora.plans.retrieval_queries import _BM, _TOKENS
from tempora.session import shared_dir, table


def _before(docs: DataFrame) -> DataFrame:
    """The corpus as an earlier load found it: a seventh of the texts were others, a fifth weren't there, some are gone now."""
    old = F.when(F.col("doc") % 7 == 0, F.concat(F.lit("formerly "), "text")).otherwise(F.col("text"))
    gone = docs.where("doc % 11 = 0").select((F.col("doc") + 1_000_000_000).alias("doc"), "text")
    return docs.where("doc % 5 <> 0").select("doc", old.alias("text")).unionByName(gone)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


def _index(spark: SparkSession, sf_dir: str, now: bool) -> TextIndex:
    """An index of the earlier corpus, brought to the present one if asked."""
    index, docs = TextIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", 16), _docs(spark, sf_dir)
    index.load(_before(docs))
    if now:
        index.load(docs)
    return index


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")


@query("""SELECT state, count(*)::BIGINT AS docs FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'stale' ELSE 'indexed' END AS state FROM documents
UNION ALL SELECT 'extra' FROM documents WHERE doc_id % 11 = 0) GROUP BY state""")
def index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an index of an earlier corpus covers the present one."""
    return _index(spark, sf_dir, False).coverage(_docs(spark, sf_dir))


@query(f"""WITH {_BM}, r AS (SELECT query, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM bm)
SELECT query, id, round(score, 5) AS score, rank::INTEGER AS rank FROM r WHERE rank < 15""")
def indexed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 for every benchmark text from the postings alone, after a load that added, changed and removed documents."""
    scores = _index(spark, sf_dir, True).bm25(_asked(spark, sf_dir)).withColumn("score", F.round("score", 9))
    return R.ranked(scores, 15).select("query", "id", F.round("score", 5).alias("score"), "rank")


_PIECE = "list_slice(w, 1 + query % 5, 2 + query % 5)"


@query(f"""WITH q AS (SELECT query, {_PIECE} AS p FROM (SELECT item_id AS query, {_TOKENS.format('text')} AS w FROM benchmark)),
d AS (SELECT doc_id AS id, {_TOKENS.format('text')} AS w FROM documents), pairs AS (SELECT id, w[i] AS x, w[i + 1] AS y FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM d))
SELECT query, id, count(*)::BIGINT AS times FROM pairs JOIN q ON len(p) = 2 AND x = p[1] AND y = p[2] GROUP BY query, id""")
def indexed_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two adjacent words of every benchmark text stand side by side in every document, by their positions."""
    from tempora.functions.text import tokens

    start = (1 + F.col("query") % 5).cast("int")
    pieces = _asked(spark, sf_dir).select("query", tokens(F.coalesce("text", F.lit(""))).alias("w")).select("query", F.slice("w", start, F.lit(2)).alias("p")).where("size(p) = 2")
    return _index(spark, sf_dir, True).phrases(pieces.select("query", F.array_join("p", " ").alias("text")))
