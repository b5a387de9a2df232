"""Relations around records: scopes, owned documents, ends of edges, successors, trees of units, merged hits, run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def amends_owned(titles: DataFrame, owned: DataFrame, number: str) -> DataFrame:
    """(id, owned) of titles (id, title) that name a document we own after their own number, which comes first; owned: (number)."""
    later = F.explode(F.array_distinct(F.slice(F.regexp_extract_all("title", F.lit(number), F.lit(0)), 2, 1 << 20))).alias("number")
    return titles.select("id", later).join(owned, "number", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("number")).alias("owned"))


def with_ends(edges: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose two ends are documents (id), report (id, n) of ends that aren't, by the number of edges they cost)."""
    s, t = (docs.select(F.col("id").alias(c)) for c in ("source_doc", "target_doc"))
    kept = edges.join(s, "source_doc", "left_semi").join(t, "target_doc", "left_semi").select(*edges.columns)
    ends = edges.select(F.explode(F.array_distinct(F.array("source_doc", "target_doc"))).alias("id"))
    return kept, ends.join(docs.select("id"), "id", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def only_successor(edges: DataFrame) -> DataFrame:
    """(target_doc, successor) of replaced documents that exactly one document replaces."""
    out = edges.groupBy("target_doc").agg(F.countDistinct("source_doc").alias("n"), F.min("source_doc").alias("successor"))
    return out.where("n = 1").select("target_doc", "successor")


def missing_labels(wanted: DataFrame, units: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """(group, n_missing) for groups that name units which don't exist."""
    return wanted.join(units.select(*keys).distinct(), list(keys), "left_anti").groupBy(group).agg(F.count(F.lit(1)).alias("n_missing"))


def both_ways(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, other, label) of each edge from both its ends; labels: (rel_type, active, passive); codes without one speak for themselves."""
    told = edges.join(F.broadcast(labels), "rel_type", "left")
    out = told.select(F.col("source_doc").alias("doc"), F.col("target_doc").alias("other"), F.coalesce("active", "rel_type").alias("label"))
    return out.unionAll(told.select("target_doc", "source_doc", F.coalesce("passive", "rel_type")))


def amenders(edges: DataFrame, codes: Sequence[str]) -> DataFrame:
    """(doc, article, amenders) from edges with anchors array<struct<source_article, target_article>> of some codes."""
    rows = edges.where(F.col("rel_type").isin(*codes)).select(F.col("target_doc").alias("doc"), "source_doc", F.explode("anchors").alias("a")).where(F.coalesce(F.col("a.target_article"), F.lit("")) != "")
    return rows.groupBy("doc", F.col("a.target_article").alias("article")).agg(F.array_sort(F.collect_set("source_doc")).alias("amenders"))


def marked(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, place, marker, citation): each [marker] of an answer (id, text) with the first of its citations (id, ord, label, title)
    whose label lies in it or it in the label, or whose title begins with the same 20 characters; null where none fits."""
    found = answers.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\[([^\[\]]+)\]"), F.lit(1))).alias("place", "marker"))
    fits = F.contains("marker", "label") | F.contains("label", "marker") | F.contains("marker", F.left("title", F.lit(20)))
    met = found.join(citations, "id").where(fits).groupBy("id", "place").agg(F.min_by("label", "ord").alias("citation"))
    return found.join(met, ["id", "place"], "left").select("id", "place", "marker", "citation")


def base_then_extra(base: DataFrame, extra: DataFrame) -> DataFrame:
    """(query, id, place) of hits (query, id, rank): the base's first, then the extra ones that aren't among them."""
    both = base.select("query", "id", F.lit(0).alias("part"), "rank").unionAll(extra.select("query", "id", F.lit(1), "rank"))
    first = both.groupBy("query", "id").agg(F.min(F.struct("part", "rank")).alias("at"))
    return first.select("query", "id", F.row_number().over(Window.partitionBy("query").orderBy("at", "id")).alias("place"))


def capped(rows: DataFrame, order: Sequence[str], most: int) -> DataFrame:
    """The first rows in order, with `capped`: whether there were more. The cap is the feature."""
    n = rows.limit(most + 1).count()
    return rows.orderBy(*order).limit(most).withColumn("capped", F.lit(n > most))


def shortened(values: Column, most: int) -> Column:
    """The first members joined by commas, and how many more there are."""
    more = F.size(values) - most
    return F.concat(F.array_join(F.slice(values, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))


def parents(nodes: DataFrame, tree: str, ord_: str, depth: str, levels: int) -> DataFrame:
    """nodes with parent: the ord of the nearest node before that is less deep, by a carried-forward value for each level."""
    before = Window.partitionBy(tree).orderBy(ord_).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(depth) == d, F.col(ord_)), ignorenulls=True).over(before) for d in range(levels)]
    above = F.greatest(*(F.when(F.col(depth) > d, x) for d, x in enumerate(last)), F.lit(None).cast(nodes.schema[ord_].dataType))
    return nodes.withColumn("parent", above)


def paths(nodes: DataFrame, tree: str, ord_: str, levels: int) -> DataFrame:
    """(tree, ord, path) of nodes with parent: the ords from the root down; `levels` equi joins, as trees have bounded depth."""
    up = nodes.select(tree, F.col(ord_).alias("__at"), F.col("parent").alias("__up"))
    out = nodes.select(tree, ord_, F.array(ord_).alias("path"), F.col("parent").alias("__next"))
    for _ in range(levels):
        out = out.join(up, (out[tree] == up[tree]) & (out["__next"] == up["__at"]), "left").select(out[tree], ord_, F.when(F.col("__next").isNull(), F.col("path")).otherwise(F.concat(F.array("__next"), F.col("path"))).alias("path"), F.col("__up").alias("__next"))
    return out.select(tree, ord_, "path")


def covered(units: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, in_tree, in_text) of documents whose tree has fewer units than their text; both sides (key, n)."""
    both = texts.select(key, F.col("n").alias("in_text")).join(units.select(key, F.col("n").alias("in_tree")), key, "left").withColumn("in_tree", F.coalesce("in_tree", F.lit(0).cast("long")))
    return both.where(F.col("in_tree") < F.col("in_text")).select(key, "in_tree", "in_text")


def grouped(items: DataFrame) -> DataFrame:
    """(doc, direction, groups): a map from category to its sorted titles; items: (doc, direction, category, title)."""
    lists = items.groupBy("doc", "direction", "category").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    return lists.groupBy("doc", "direction").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "titles")))).alias("groups"))


def labelled_first(rows: DataFrame, keys: Sequence[str], label: str, ord_: str) -> DataFrame:
    """One row for each key: the first that has a label; keys without any are dropped."""
    has = rows.where(F.coalesce(F.trim(label), F.lit("")) != "")
    return has.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(ord_))).where("__n = 1").drop("__n")


def three_ways(rows: DataFrame, named: str, known: str) -> DataFrame:
    """rows with part: 'all', 'some' or 'none' of the members of one array are in the other; 'empty' without members."""
    hit = F.size(F.array_intersect(named, known))
    return rows.withColumn("part", F.when(F.size(named) <= 0, "empty").when(hit == F.size(F.array_distinct(named)), "all").when(hit > 0, "some").otherwise("none"))


def pushed(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, n): how many edges and ends an overlay push writes and how many it can't match."""
    kept, missing = with_ends(edges, nodes)
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(kept, "written").unionAll(count(edges, "given")).unionAll(count(missing, "unmatched"))


def replaced_outgoing(edges: DataFrame, new: DataFrame, doc: Column, keys: Sequence[str]) -> DataFrame:
    """The edge table after one document's edges came anew: its outgoing edges replaced, incoming ones merged by key."""
    stay = edges.where(F.col("source_doc") != doc)
    return stay.join(new.select(*keys), list(keys), "left_anti").select(*edges.columns).unionByName(new.select(*edges.columns).dropDuplicates(list(keys)))


def markdown(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """(line) of a report as a Markdown table, in order: for tables that people read."""
    cells = lambda values: F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))
    place = F.row_number().over(Window.orderBy(*order)) + 1
    body = rows.select(place.alias("place"), cells([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("line"))
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + "-|" * len(rows.columns))], "place int, line string")
    return head.unionByName(body)
