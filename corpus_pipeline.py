"""A training corpus from raw documents: STAGES, each over what the one before it kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import written
from tempora.llm.near_dedup import near_duplicate_classes
from tempora.llm.packing import pack_documents
from tempora.llm.pii import sanitise
from tempora.llm.substring_dedup import remove_repeated_passages
from tempora.llm.toxicity import score_toxicity

#: Documents that score this much or more are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; the labels are read beside the documents."""
    scores = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where(F.col("score") >= TOXIC)
    return docs.join(scores.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest id."""
    # Rows that repeat an id are one document, the first of them by text; rows without an id are in no class and all stay.
    row = F.struct(F.col("text"), *(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    one = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(row).alias("row")).select("row.*").select(*docs.columns)
    one = written(one, "one")
    copies = near_duplicate_classes(one).where(F.col("doc_id") > F.col("class_id")).select("doc_id")
    return one.join(copies, "doc_id", "left_anti").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that a smaller document has; those left without words are dropped.

    A text that loses nothing stays as it is; of others, the words kept are joined by spaces.
    """
    out = remove_repeated_passages(docs, keep=("lang", "source", "n_chars", "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kept = out.where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers masked and the terms that reveal them generalised or removed."""
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with the bin it is packed into."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: The first two stages can't be expressed in SQL; tests hold the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
