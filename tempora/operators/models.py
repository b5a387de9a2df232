"""Model calls as a batch operator with a pluggable client, and what is relational around them.

The default client is a stub whose answers are a function of the prompt, so that jobs can be run and tested offline.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.operators.evaluation import majority

VERDICTS = ("pass", "warning", "violation")
Client = Callable[[list[str]], list[str]]


def stub(prompts: list[str]) -> list[str]:
    """A verdict for each prompt, by its digest."""
    return [VERDICTS[hashlib.md5(p.encode()).digest()[0] % 3] for p in prompts]


def ask(prompts: DataFrame, client: Client = stub, batch: int = 32, attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """prompts (id string, prompt string) with the client's answers: (id, answer). A batch that fails is tried again, then fails the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                for attempt in range(attempts):
                    try:
                        answers = client(part["prompt"].tolist())
                        break
                    except Exception:
                        if attempt + 1 == attempts:
                            raise
                        time.sleep(pause * 2**attempt)
                yield pd.DataFrame({"id": part["id"], "answer": answers})

    return prompts.select(F.col("id").cast("string").alias("id"), "prompt").mapInPandas(run, "id string, answer string")


def conflict_pairs(chunks: DataFrame) -> DataFrame:
    """(query, a, b): pairs of a query's chunks, one internal and one external, where at least two documents are among its chunks."""
    docs = chunks.groupBy("query").agg(F.countDistinct("doc_id").alias("n")).where("n >= 2").select("query")
    wide = chunks.join(docs, "query", "left_semi")
    side = lambda source, name: wide.where(F.col("source") == source).select("query", F.col("id").alias(name))
    return side("internal", "a").join(side("external", "b"), "query")


def judged(articles: DataFrame, client: Client = stub) -> DataFrame:
    """(id, verdict) of articles (id, prompt): the majority of two votes, a third where they differ; without evidence, not assessed."""
    asked = articles.where(F.col("prompt").isNotNull())
    vote = lambda n: ask(asked.select("id", F.concat("prompt", F.lit(f"\n#{n}")).alias("prompt")), client).select("id", F.when(F.col("answer").isin(*VERDICTS), F.col("answer")).otherwise("warning").alias(f"v{n}"))
    two = vote(1).join(vote(2), "id")
    third = two.where("v1 <> v2").select("id").join(asked.select(F.col("id").cast("string").alias("id"), "prompt"), "id")
    last = ask(third.select("id", F.concat("prompt", F.lit("\n#3")).alias("prompt")), client).select("id", F.col("answer").alias("v3"))
    votes = two.join(last, "id", "left").select("id", majority(F.col("v1"), F.col("v2"), F.coalesce("v3", F.lit("warning"))).alias("verdict"))
    return articles.select(F.col("id").cast("string").alias("id")).join(votes, "id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("not_assessed")))
