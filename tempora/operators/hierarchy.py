"""Amendments of units addressed by hierarchical keys, at a date.

Joins on prefixes are joins on equality with exploded ancestors, so that they shuffle by key instead of comparing all
pairs. An applied repeal kills the edges whose source lies under its target; the check is one level deep: repeals are
not themselves checked for being dead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.keys import ancestors

#: The operation that repeals.
REPEAL = "bai_bo"


def applied(edges: DataFrame, as_of: str) -> DataFrame:
    """Edges in force on a day: dated, and not later; dates are ISO text."""
    return edges.where(F.col("valid_from").isNotNull() & (F.col("valid_from") <= as_of))


def alive(edges: DataFrame, repeal: str = REPEAL) -> DataFrame:
    """Edges (source_key, target_key, op, ...) without those whose source lies under the target of a repeal among them."""
    repealed = edges.where(F.col("op") == repeal).select(F.col("target_key").alias("__dead")).distinct()
    under = edges.select("source_key").distinct().select("source_key", F.explode(ancestors(F.col("source_key"))).alias("__dead"))
    dead = under.join(repealed, "__dead", "left_semi").select("source_key").distinct()
    return edges.join(dead, "source_key", "left_anti").select(*edges.columns)


def current_version(keys: DataFrame, edges: DataFrame, as_of: str, repeal: str = REPEAL) -> DataFrame:
    """(key, status, n_applied, last_source) of each key: intact, amended or repealed by the edges on it or an ancestor.

    The latest edge decides; of edges of one day, the later in the input (column ord).
    """
    live = alive(applied(edges, as_of), repeal)
    reach = keys.select("key").distinct().select("key", F.explode(ancestors(F.col("key"))).alias("target_key"))
    met = reach.join(live, "target_key")
    last = met.groupBy("key").agg(F.count(F.lit(1)).alias("n_applied"), F.max_by(F.struct("op", "source_key"), F.struct("valid_from", "ord")).alias("last"))
    status = F.when(F.col("last").isNull(), "intact").when(F.col("last.op") == repeal, "repealed").otherwise("amended")
    return keys.select("key").distinct().join(last, "key", "left").select("key", status.alias("status"), F.coalesce("n_applied", F.lit(0)).alias("n_applied"), F.col("last.source_key").alias("last_source"))


def newest_deeper(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """For each key, the newest edge whose target lies strictly below it: (key, target_key, valid_from)."""
    above = edges.select("*", F.explode(ancestors(F.col("target_key"))).alias("key")).where(F.col("key") != F.col("target_key"))
    met = above.join(keys.select("key").distinct(), "key", "left_semi")
    return met.groupBy("key").agg(F.max(F.struct("valid_from", "target_key")).alias("x")).select("key", F.col("x.target_key").alias("target_key"), F.col("x.valid_from").alias("valid_from"))


def overlay_nodes(edges: DataFrame) -> DataFrame:
    """(key, role) of each end of the edges; a key that is ever a target is one."""
    ends = edges.select(F.col("source_key").alias("key"), F.lit("source").alias("role")).unionAll(edges.select(F.col("target_key"), F.lit("target")))
    return ends.groupBy("key").agg(F.max("role").alias("role"))


def reconciled(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """(key, side): keys of edges that no mark covers, and of marks that no edge covers, where covering is equality or ancestry either way."""

    def uncovered(a: DataFrame, b: DataFrame, side: str) -> DataFrame:
        up = a.select("key", F.explode(ancestors(F.col("key"))).alias("x")).join(b.select(F.col("key").alias("x")), "x", "left_semi").select("key")
        down = b.select(F.explode(ancestors(F.col("key"))).alias("key"))
        return a.select("key").distinct().join(up.unionAll(down).distinct(), "key", "left_anti").withColumn("side", F.lit(side))

    return uncovered(edges, marks, "edge").unionAll(uncovered(marks, edges, "mark"))


def annotated(hits: DataFrame, versions: DataFrame) -> DataFrame:
    """Hits (query, key, ...) with their status; repealed ones are dropped, unless all hits of their query are."""
    joined = hits.join(versions.select("key", "status"), "key", "left").withColumn("status", F.coalesce("status", F.lit("intact")))
    keep = F.col("status") != "repealed"
    some = F.max(keep.cast("int")).over(Window.partitionBy("query"))
    return joined.withColumn("__some", some).where(keep | (F.col("__some") == 0)).drop("__some")
