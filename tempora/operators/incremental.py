"""Keeping a derived table current: fingerprints, difference plans, scoped replacement, guards."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class UnexpectedDocuments(ValueError):
    """The table holds documents that the corpus doesn't."""


class Shrunk(ValueError):
    """An artefact would lose too many rows."""


def fingerprints(rows: DataFrame, doc: str, columns: Sequence[str]) -> DataFrame:
    """(doc, fingerprint): of the set of a document's rows; order and repeats don't count, null and empty differ.

    Each row is hashed before anything is shuffled; what is gathered for a document are hashes.
    """
    row = F.md5(F.array_join(F.array(*(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns)), "\x1f"))
    return rows.select(F.col(doc).alias("doc"), row.alias("h")).groupBy("doc").agg(F.md5(F.array_join(F.array_sort(F.collect_set("h")), "")).alias("fingerprint"))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc, change) of two fingerprint tables: 'changed', 'new' or 'extra'; unchanged documents have no row."""
    o, n = old.withColumnRenamed("fingerprint", "o"), new.withColumnRenamed("fingerprint", "n")
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "extra").when(F.col("o") != F.col("n"), "changed")
    return o.join(n, "doc", "full").select("doc", change.alias("change")).where("change IS NOT NULL")


def refuse_extra(plan: DataFrame, allow: bool = False, show: int = 5) -> None:
    """Raise before any work where the table has documents that the corpus lacks."""
    if not allow and (extra := [r["doc"] for r in plan.where("change = 'extra'").orderBy("doc").limit(show).collect()]):
        raise UnexpectedDocuments(f"the table has documents that the corpus lacks, such as {extra}")


def orphans(existing: DataFrame, new: DataFrame, scope: DataFrame, doc: str, key: str) -> DataFrame:
    """Keys of a scope's existing rows that its new rows don't have."""
    return existing.join(scope, doc, "left_semi").select(key).join(new.select(key), key, "left_anti")


def upserted(existing: DataFrame, new: DataFrame, scope: DataFrame, doc: str, key: str) -> DataFrame:
    """The table after a scoped replacement: orphans of the scope gone, then new rows put in by key."""
    gone = orphans(existing, new, scope, doc, key)
    kept = existing.join(gone, key, "left_anti").join(new.select(key), key, "left_anti")
    return kept.unionByName(new)


def merged_fields(base: DataFrame, patch: DataFrame, key: str, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """base with the patch's non-empty values in some columns; in columns of `keep` an existing value wins."""
    p = patch.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in (*columns, *keep)))
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    new = {c: F.when(filled(f"__{c}").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    old = {c: F.when(filled(c).isNotNull(), F.col(c)).otherwise(F.col(f"__{c}")) for c in keep}
    return base.join(p, key, "left").withColumns(new | old).select(*base.columns)


def refuse_shrinking(new: int, old: int | None, least: float = 0.9) -> None:
    """Raise where an artefact would become empty, or smaller than `least` of what it was."""
    if not new or old is not None and new < least * old:
        raise Shrunk(f"{new} rows would replace {old}")


def bucketed(rows: DataFrame, doc: str, buckets: int) -> DataFrame:
    """rows with the bucket that their document belongs to."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int"))


def replace_documents(spark, path: str, new: DataFrame, scope: DataFrame, doc: str, key: str, buckets: int) -> None:
    """Incremental load: the touched buckets are read, changed and staged beside the table, then swapped in by partition.

    A bucket that is left without rows is removed, as an overwrite would not touch it; the staged copy goes last. Run
    again after a failure, the same load gives the same table.
    """
    schema = bucketed(new, doc, buckets).schema
    touched = bucketed(scope, doc, buckets).select("bucket").distinct()
    existing = spark.read.schema(schema).parquet(path).join(touched, "bucket", "left_semi").drop("bucket")
    after = bucketed(upserted(existing, new, scope, doc, key), doc, buckets)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    after.select(*schema.names).write.partitionBy("bucket").parquet(staged)
    done = spark.read.schema(schema).parquet(staged)
    filled = {r["bucket"] for r in done.select("bucket").distinct().collect()}
    emptied = [r["bucket"] for r in touched.collect() if r["bucket"] not in filled]
    if filled:
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for place in (*(f"{path}/bucket={b}" for b in emptied), staged):
        files.delete(hadoop(place), True)
