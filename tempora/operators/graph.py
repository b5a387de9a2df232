"""The document graph: closed relation codes, number bridges, one hop, voids, stubs, change events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The closed set of relation codes.
RELATIONS = (
    "HUONG_DAN_AP_DUNG", "QUY_DINH_CHI_TIET_HUONG_DAN", "HOP_NHAT", "SUA_DOI_BO_SUNG", "DINH_CHINH", "BAI_BO", "DAN_CHIEU",
    "CAN_CU", "GIAI_THICH", "DINH_CHI_THI_HANH", "TAM_NGUNG_HIEU_LUC", "CONG_BO", "THAY_THE",
)
ADVERSE = ("BAI_BO", "DINH_CHI_THI_HANH", "TAM_NGUNG_HIEU_LUC")


def unknown_relations(edges: DataFrame, known: Sequence[str] = RELATIONS) -> DataFrame:
    """(rel_type, n) of codes outside the closed set."""
    return edges.where(~F.col("rel_type").isin(*known) | F.col("rel_type").isNull()).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


def bridge(docs: DataFrame, number: str, doc_id: str) -> DataFrame:
    """(number, n_claims, doc_id): the document of each official number; a number that several claim maps to nothing."""
    claims = docs.where(F.col(number).isNotNull()).groupBy(F.col(number).alias("number")).agg(F.countDistinct(doc_id).alias("n_claims"), F.min(doc_id).alias("one"))
    return claims.select("number", "n_claims", F.when(F.col("n_claims") == 1, F.col("one")).alias("doc_id"))


def bridged(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Edges with ends given as numbers replaced by document ids where the bridge has one; other ends stay and are flagged."""
    to = numbers.where(F.col("doc_id").isNotNull())
    s = to.select(F.col("number").alias("source_doc"), F.col("doc_id").alias("__s"))
    t = to.select(F.col("number").alias("target_doc"), F.col("doc_id").alias("__t"))
    out = edges.join(s, "source_doc", "left").join(t, "target_doc", "left")
    return out.withColumns({"unresolved": F.col("__s").isNull() | F.col("__t").isNull(), "source_doc": F.coalesce("__s", "source_doc"), "target_doc": F.coalesce("__t", "target_doc")}).drop("__s", "__t")


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query, id): what is one edge away from a query's seeds (query, id), either way; a seed that neighbours another is returned."""
    ends = edges.select(F.col("source_doc").alias("id"), F.col("target_doc").alias("to")).unionAll(edges.select(F.col("target_doc"), F.col("source_doc")))
    return seeds.join(ends, "id").select("query", F.col("to").alias("id")).distinct()


def expansion(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The neighbours of a query's seeds without the seeds."""
    return neighbours(edges, seeds).join(seeds.select("query", "id"), ["query", "id"], "left_anti")


def void(edges: DataFrame) -> DataFrame:
    """Repealed documents that nothing replaces: (target_doc, repealed_by)."""
    repeals = edges.where(F.col("rel_type") == "BAI_BO")
    replaced = edges.where(F.col("rel_type") == "THAY_THE").select("target_doc")
    return repeals.join(replaced, "target_doc", "left_anti").groupBy("target_doc").agg(F.array_sort(F.collect_set("source_doc")).alias("repealed_by"))


def stubs(edges: DataFrame, docs: DataFrame, priority: str = "priority") -> DataFrame:
    """(id, n_edges, n_kinds, priority) of ends of edges that aren't documents, most urgent first by (priority, -n_edges, id)."""
    ends = edges.select(F.col("source_doc").alias("id"), "rel_type", F.lit("source").alias("side"), priority).unionAll(edges.select(F.col("target_doc"), "rel_type", F.lit("target"), priority))
    missing = ends.join(docs.select("id"), "id", "left_anti")
    return missing.groupBy("id").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("rel_type", "side").alias("n_kinds"), F.min(priority).alias("priority"))


def collapsed(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with stub ends moved to the documents that arrived for them (stub, doc_id), without duplicates and loops."""
    m = lambda end: mapping.select(F.col("stub").alias(end), F.col("doc_id").alias(f"__{end}"))
    out = edges.join(m("source_doc"), "source_doc", "left").join(m("target_doc"), "target_doc", "left")
    moved = out.withColumns({e: F.coalesce(f"__{e}", e) for e in ("source_doc", "target_doc")}).select(*edges.columns)
    return moved.where(F.col("source_doc") != F.col("target_doc")).distinct()


def change_events(edges: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, source_doc_id, rel_type, summary) for each edge: titles of both ends, or their ids, joined by a dash."""
    s = titles.select(F.col("id").alias("source_doc"), F.col("title").alias("__s"))
    t = titles.select(F.col("id").alias("target_doc"), F.col("title").alias("__t"))
    out = edges.join(s, "source_doc", "left").join(t, "target_doc", "left")
    return out.select(F.col("target_doc").alias("doc_id"), F.col("source_doc").alias("source_doc_id"), "rel_type", F.concat_ws(" — ", F.coalesce("__s", F.col("source_doc").cast("string")), F.coalesce("__t", F.col("target_doc").cast("string"))).alias("summary"))


def insert_ignore(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key isn't there yet, one for each key."""
    return new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
