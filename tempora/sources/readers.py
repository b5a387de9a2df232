"""Sources with declared schemas. Nothing is inferred; malformed records fail the read unless a source says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions.text import collapse, fold_all, strip_tags
from tempora.operators.graph import RELATIONS

ARTICLE = "struct<article:string,text:string,valid_from:string,valid_to:string,superseded:boolean,chapter:string,section:string,char_start:int,char_end:int>"
DOCUMENT = f"doc_id string, title string, doc_type string, source string, valid_from string, valid_to string, so_hieu string, articles array<{ARTICLE}>"
EDGE = "source_doc string, target_doc string, rel_type string, valid_from string, note string, anchors array<struct<source_article:string,target_article:string,detail:string>>"
CORPUS = f"documents array<struct<{DOCUMENT.replace(' string', ':string').replace(', ', ',').replace(' array', ':array')}>>, relationships array<struct<{EDGE.replace(' string', ':string').replace(', ', ',').replace(' array', ':array')}>>"
QUESTION = "query string, as_of string, expected_doc string, must_not_doc string, expect_conflict boolean, relevant_docs array<string>, relevant_articles array<string>"


class UnknownRelation(ValueError):
    """An edge has a code outside the closed set."""


class BadQuestions(ValueError):
    """A question set has rows without a question or a date."""


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, edges) of a corpus file; a relation code outside the closed set is an error that names the codes."""
    whole = spark.read.schema(CORPUS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    documents, edges = whole.selectExpr("inline(documents)"), whole.selectExpr("inline(relationships)")
    if bad := edges.where(~F.col("rel_type").isin(*RELATIONS)).select("rel_type").distinct().limit(5).collect():
        raise UnknownRelation(f"{[r[0] for r in bad]} are none of {', '.join(RELATIONS)}")
    return documents, edges


def articles(documents: DataFrame) -> DataFrame:
    """A row for each article of each document, with its ordinal; exploded where the document is."""
    rows = documents.select("doc_id", "title", "doc_type", "source", F.col("valid_from").alias("doc_from"), F.col("valid_to").alias("doc_to"), F.posexplode("articles").alias("ordinal", "a"))
    bound = lambda own, parent: F.coalesce(F.nullif(F.col(own), F.lit("")), F.nullif(F.col(parent), F.lit("")))
    return rows.select("doc_id", "title", "doc_type", "source", "ordinal", "a.article", "a.text", "a.chapter", "a.section", bound("a.valid_from", "doc_from").alias("valid_from"), bound("a.valid_to", "doc_to").alias("valid_to"), F.coalesce("a.superseded", F.lit(False)).alias("superseded"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set, strictly: a malformed line fails the read, an empty question or date raises; documents default to the expected one."""
    rows = spark.read.schema(QUESTION).option("mode", "FAILFAST").json(path)
    if not rows.where((F.coalesce(F.trim("query"), F.lit("")) == "") | F.col("as_of").isNull()).isEmpty():
        raise BadQuestions(path)
    one = F.when(F.col("expected_doc").isNotNull(), F.array("expected_doc")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("relevant_docs", F.when(F.coalesce(F.size("relevant_docs"), F.lit(0)) > 0, F.col("relevant_docs")).otherwise(one))


def read_keyed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines by key; of rows that share one, the last in the file."""
    rows = spark.read.schema(schema).json(path).withColumns({"__file": F.col("_metadata.file_path"), "__at": F.monotonically_increasing_id()})
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__file"), F.desc("__at")))
    return rows.withColumn("__n", last).where("__n = 1").drop("__n", "__file", "__at")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of plain text and HTML files; HTML is reduced to its visible text."""
    rows = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("name"), "value")
    return rows.select("name", F.when(F.lower("name").rlike(r"\.html?$"), strip_tags(F.col("value"))).otherwise(F.col("value")).alias("text"))


def register_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    """Parquet files as SQL views, for queries in SQL."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def read_crawl(spark: SparkSession, path: str, schema: str, number: str, richness: str) -> DataFrame:
    """Crawled records, one for each number: the one with the longest body; raises where no record is recognised."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path).where(F.col(number).isNotNull())
    best = F.row_number().over(Window.partitionBy(number).orderBy(F.desc_nulls_last(F.char_length(richness)), F.col("_metadata.file_path")))
    out = rows.withColumn("__n", best).where("__n = 1").drop("__n")
    if out.isEmpty():
        raise ValueError(f"no record of {path} has {number}")
    return out


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, url) of a list of URLs: comments, blank lines and repeats dropped, in the file's order."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.trim(F.replace("value", F.lit("﻿"), F.lit(""))).alias("url"))
    return rows.where((F.col("url") != "") & ~F.col("url").startswith("#") & F.col("url").rlike("^https?://")).groupBy("url").agg(F.min("ordinal").alias("ordinal")).select("ordinal", "url")


def sitemap_urls(spark: SparkSession, path: str, keyword: str | None = None) -> DataFrame:
    """The URLs of sitemap files that landed in a folder, by a keyword in them if one is given."""
    urls = spark.read.option("wholetext", True).text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("url")).distinct()
    return urls.where(F.contains(collapse(F.col("url")), F.lit(keyword.lower().replace(" ", "-")))) if keyword else urls


def visible_to(rows: DataFrame, user: str, role: str, owner: str = "user_id") -> DataFrame:
    """Row-level security: owners see their rows, administrators all."""
    return rows if role == "admin" else rows.where(F.col(owner) == user)


def table_exists(spark: SparkSession, name: str) -> bool:
    """Whether the catalog knows a table."""
    return spark.catalog.tableExists(name)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An artefact that may not be there yet: no rows then. Other failures are raised when it is read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    place = hadoop(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def read_first(spark: SparkSession, paths: Sequence[str], schema: str, strict: bool = False) -> DataFrame:
    """The first of several places that has the table; none gives no rows, or an error where it is to be read and written again."""
    for path in paths:
        rows = read_or_empty(spark, path, schema)
        if not rows.isEmpty():
            return rows
    if strict:
        raise FileNotFoundError(f"none of {list(paths)} has rows")
    return spark.createDataFrame([], schema)


def read_fixtures(spark: SparkSession, folder: str, index: str) -> DataFrame:
    """(key, name, text) of text files by an index of (name, key) as JSON lines; files that it lacks are left out."""
    keys = spark.read.schema("name string, key string").json(index)
    return read_texts(spark, folder).join(F.broadcast(keys), "name").select("key", "name", "text")


def slug_search(urls: DataFrame, words: str, most: int = 20) -> DataFrame:
    """URLs whose last part has the words in order, whatever their accents; at most `most`, which is the feature."""
    slug = fold_all(F.regexp_extract("url", r"([^/?#]*)/?(?:[?#].*)?$", 1))
    return urls.where(F.contains(slug, F.replace(fold_all(F.trim(F.lit(words))), F.lit(" "), F.lit("-")))).orderBy("url").limit(most)


def judged_records(raw: DataFrame) -> DataFrame:
    """raw (slug, number, title, body, units array<struct<char_start,char_end,text>>) with reason: why a record is refused, or null."""
    span = lambda u: F.substring(F.col("body"), u["char_start"] + 1, u["char_end"] - u["char_start"]) == u["text"]
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.when(blank("number"), "no number").when(blank("body"), "no text").when(F.coalesce(F.size("units"), F.lit(0)) < 1, "no units").when(~F.coalesce(F.forall("units", span), F.lit(False)), "broken offsets")
    return raw.withColumn("reason", reason)
