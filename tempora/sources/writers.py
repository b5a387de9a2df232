"""Sinks: first loads that never overwrite, guarded artefacts, insert-ignore, status transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.operators.graph import insert_ignore
from tempora.operators.incremental import bucketed, refuse_shrinking


class DuplicateKeys(ValueError):
    """A key that must be unique isn't."""


def require_unique(rows: DataFrame, keys: Sequence[str]) -> None:
    """Raise where two rows share a key."""
    if twice := rows.groupBy(*keys).count().where("count > 1").limit(5).collect():
        raise DuplicateKeys(str([tuple(r)[:-1] for r in twice]))


def create_table(rows: DataFrame, path: str, doc: str, buckets: int) -> None:
    """A first load, partitioned by a hash of the document; fails where something is there already."""
    bucketed(rows, doc, buckets).write.mode("errorifexists").partitionBy("bucket").parquet(path)


def write_guarded(rows: DataFrame, path: str, previous: int | None, least: float = 0.9) -> int:
    """An artefact as JSON lines, refused if it is empty or much smaller than before; returns its rows."""
    n = rows.count()
    refuse_shrinking(n, previous, least)
    rows.write.mode("overwrite").json(path)
    return n


def append_ignore(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose key the table doesn't have."""
    insert_ignore(rows, spark.read.schema(rows.schema).parquet(path), keys).write.mode("append").parquet(path)


def reviewed(rows: DataFrame, doc_id: str, verdict: str) -> DataFrame:
    """Maker-checker: a pending document becomes approved or rejected; others keep their status."""
    if verdict not in ("approved", "rejected"):
        raise ValueError(verdict)
    pending = (F.col("doc_id") == doc_id) & (F.col("status") == "pending")
    return rows.withColumn("status", F.when(pending, verdict).otherwise(F.col("status")))


def append_rows(rows: DataFrame, path: str) -> None:
    """Sessions, messages and audit rows: appended; columns that come later are read by merging schemas."""
    rows.write.mode("append").parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """What `append_rows` wrote, with all columns that ever came."""
    return spark.read.option("mergeSchema", True).parquet(path)


def write_selection(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    """A selection, written through as a whole and in order."""
    rows.dropDuplicates().orderBy(*order).write.mode("overwrite").json(path)


def replace_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A full reload of the graph: both tables replaced; keys are checked first."""
    require_unique(vertices, ["id"])
    require_unique(edges, ["source_doc", "target_doc", "rel_type"])
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def forced(wanted: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents asked for that exist, those that don't) of two tables (doc)."""
    return wanted.select("doc").intersect(existing.select("doc")), wanted.select("doc").exceptAll(existing.select("doc"))
