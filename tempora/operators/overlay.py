"""Routing of chunks through amendments: intact, amended in the base text, or quoted inside an amending document.

Everything is a join on keys: ancestors are exploded, spans meet by cells of their document, and citations are built
by grouping, from points over clauses and articles to documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.keys import ancestors, citation, letter_rank, node_key
from tempora.functions.spans import overlap
from tempora.operators import span_joins
from tempora.operators.hierarchy import REPEAL, alive, applied
from tempora.session import settled

#: Units that a citation names at most; the rest is counted.
NAMED = 8
#: Operations whose new wording stands for the whole unit.
WHOLE = ("thay_the", "sua_doi", "sua_doi_bo_sung")


def _part(name: str) -> Column:
    return F.nullif(F.regexp_extract("key", rf"(?:#|/){name}_([^#]+)", 1), F.lit(""))


def _natural(value: Column) -> Column:
    """Numbers before their suffixes: 3, 3a, 10; what is missing comes first."""
    return F.struct(F.regexp_extract(value, r"^(\d+)", 1).try_cast("int").alias("n"), F.regexp_extract(value, r"^\d*(.*)$", 1).alias("s"))


def cited(rows: DataFrame, by: Sequence[str], most: int = NAMED) -> DataFrame:
    """(by, citation) of all keys of a group: widened on doubt, in natural order, the first `most` named.

    A key of a whole article covers its clauses, one of a whole clause its points. Keys of another form are named as they are.
    """
    by = list(by)
    k = rows.select(*by, "key").distinct().withColumns({"doc": F.regexp_extract("key", r"^([^#]+)", 1), "article": _part("dieu"), "clause": _part("khoan"), "point": _part("diem")})
    k = k.withColumns({"doc": F.when(F.col("article").isNull(), F.col("key")).otherwise(F.col("doc")), "o1": _natural(F.col("article")), "o2": _natural(F.col("clause")), "o3": F.struct(letter_rank(F.coalesce("point", F.lit(""))).alias("n"), F.col("point").alias("s"))})
    order = Window.partitionBy(*by).orderBy("doc", "o1", "o2", "o3", "key")
    k = k.withColumns({"place": F.row_number().over(order), "total": F.count(F.lit(1)).over(Window.partitionBy(*by))}).where(F.col("place") <= most)
    points = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o3", "point"))), lambda x: x["point"]), ", ")
    clauses = k.groupBy(*by, "total", "doc", "o1", "article", "o2", "clause").agg(F.min("place").alias("place"), F.when(F.max(F.col("point").isNull()), F.col("clause")).otherwise(F.concat(F.col("clause"), F.lit(" Điểm "), points)).alias("said"), F.max(F.col("point").isNotNull() & F.col("clause").isNotNull()).alias("fine"))
    clauses = clauses.withColumn("fine", F.col("fine") & F.col("said").contains(" Điểm "))
    head = F.concat("doc", F.lit(" Điều "), "article")
    list_of = lambda prefix: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: F.concat(F.lit(prefix), x["said"])), ", ")
    units = clauses.groupBy(*by, "total", "doc", "o1", "article").agg(
        F.min("place").alias("place"), F.when(F.col("article").isNull(), F.col("doc")).when(F.max(F.col("clause").isNull()), head)
        .when(~F.max("fine"), F.concat(head, F.lit(" Khoản "), list_of(""))).otherwise(F.concat(head, F.lit(" "), list_of("Khoản "))).alias("said"),
    )
    out = units.groupBy(*by, "total").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]), " và ").alias("said"))
    more = F.when(F.col("total") > most, F.concat(F.lit(" và "), (F.col("total") - most).cast("string"), F.lit(" đơn vị khác (đã rút gọn)"))).otherwise("")
    return out.select(*by, F.concat("said", more).alias("citation"))


def _on_or_above(keys: DataFrame, live: DataFrame) -> DataFrame:
    """(key, edge): the latest live edge on each key or an ancestor of it."""
    reach = keys.select("key").distinct().select("key", F.explode(ancestors(F.col("key"))).alias("target_key"))
    edge = F.struct("source_key", "target_key", "op", "valid_from")
    return _latest(reach.join(live, "target_key").select("key", "valid_from", "ord", edge.alias("edge")))


def _latest(rows: DataFrame) -> DataFrame:
    """(key, edge): the last edge of each key by (valid_from, ord); of several of one place the greatest, so that runs agree."""
    return rows.groupBy("key").agg(F.max(F.struct("valid_from", "ord", "edge"))["edge"].alias("edge"))


def _below(keys: DataFrame, live: DataFrame) -> DataFrame:
    """(key, edge): the latest live edge strictly below each key."""
    edge = F.struct("source_key", "target_key", "op", "valid_from")
    up = live.select(edge.alias("edge"), "valid_from", "ord", F.explode(ancestors(F.col("target_key"))).alias("key")).where(F.col("key") != F.col("edge.target_key"))
    return _latest(up.join(keys.select("key").distinct(), "key", "left_semi"))


def routed(chunks: DataFrame, edges: DataFrame, as_of: str, say: str = "all") -> DataFrame:
    """(chunk_id, key, route, target_key, op, citation) of chunks (chunk_id, number, span_start, span_end) at a date.

    edges: (source_key, target_key, op, valid_from, ord, span_start, span_end), the last two where the new wording stands in
    the amending text. A chunk of an amending document whose span meets new wording is 'quoted': its citation names all
    targets that still count, or all it once had. Else the latest edge on or above its key, else the newest below it,
    makes it 'amended' or 'repealed'; what no edge touches is 'intact'. Chunks without a key have no route. say 'quoted':
    citation is only what a quoted chunk's wording amends; 'none': there is no citation, which costs most of the work.

    Keys, live edges and what spans meet are read by several parts: each is written once, which also keeps plans small.
    """
    known = settled(chunks.withColumn("key", node_key(F.col("chunk_id"), F.col("number"))), "chunks")
    live = settled(alive(applied(edges.select("source_key", "target_key", "op", "valid_from", "ord"), as_of)), "live")
    worded = edges.where("span_start IS NOT NULL").select("source_key", "target_key", F.regexp_extract("source_key", "^([^#]+)", 1).alias("number"), F.col("span_start").alias("a"), F.col("span_end").alias("b"))
    counts = live.select("source_key", "target_key").distinct().withColumn("alive", F.lit(True))
    met = span_joins.met(known.where("key IS NOT NULL").drop("key"), worded, ["number"], ("span_start", "span_end"), ("a", "b"), True).where(overlap(F.col("span_start"), F.col("span_end"), F.col("a"), F.col("b")))
    met = met.select("chunk_id", "source_key", "target_key").distinct().join(counts, ["source_key", "target_key"], "left")
    met = met.select("chunk_id", "source_key", "target_key", F.coalesce("alive", F.lit(False)).alias("alive")).withColumn("some", F.max("alive").over(Window.partitionBy("chunk_id")))
    told = settled(met.where(F.col("alive") | ~F.col("some")).drop("alive"), "told")
    side = lambda column, name: cited(told.select("chunk_id", F.col(column).alias("key")), ["chunk_id"]).withColumnRenamed("citation", name)
    quoted = told.groupBy("chunk_id", "some").agg(F.min("target_key").alias("target_key"))
    on, below = _on_or_above(known, live).withColumnRenamed("edge", "on"), _below(known, live).withColumnRenamed("edge", "below")
    edge = F.coalesce("on", "below")
    gone = edge["op"] == REPEAL
    found = F.col("q_target").isNotNull()
    route = F.when(F.col("key").isNull(), None).when(found, "quoted").when(edge.isNull(), "intact").when(F.col("on").isNotNull() & gone, "repealed").otherwise("amended")
    shown = ["chunk_id", "key", route.alias("route"), F.coalesce("q_target", edge["target_key"]).alias("target_key"), F.when(~found, edge["op"]).alias("op")]
    by_key = lambda quoted: known.join(quoted, "chunk_id", "left").join(on, "key", "left").join(below, "key", "left")
    if say != "all":
        what = side("target_key", "citation") if say == "quoted" else None
        quoted = quoted if what is None else quoted.join(what, "chunk_id")
        return by_key(quoted.drop("some").withColumnRenamed("target_key", "q_target")).select(*shown, *(["citation"] if say == "quoted" else []))
    quoted = quoted.join(side("target_key", "what"), "chunk_id").join(side("source_key", "by"), "chunk_id")
    said = F.when(F.col("some"), F.concat("what", F.lit(" (sửa bởi "), "by", F.lit(")"))).otherwise(F.concat("what", F.lit(" (từng được sửa bởi "), "by", F.lit(", hiện không áp dụng)")))
    quoted = quoted.select("chunk_id", F.col("target_key").alias("q_target"), said.alias("q_said"))
    named = F.when(F.col("on").isNotNull(), citation(F.col("key"))).otherwise(citation(F.col("below.target_key")))
    change = F.concat(named, F.when(gone, " (đã bị bãi bỏ bởi ").otherwise(F.when(F.col("on").isNotNull(), " (đã sửa bởi ").otherwise(" (sửa bởi ")), citation(edge["source_key"]), F.lit(")"))
    return by_key(quoted).select(*shown, F.when(F.col("key").isNotNull(), F.coalesce("q_said", F.when(edge.isNull(), citation(F.col("key"))).otherwise(change))).alias("citation"))


def current_text(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """routes with current_text: the newest wording of an edge that replaces the very unit as a whole; otherwise null."""
    worded = edges.where(F.col("op").isin(*WHOLE) & F.col("new_text").isNotNull())
    newest = worded.groupBy(F.col("target_key").alias("key")).agg(F.max_by("new_text", F.struct("valid_from", "ord")).alias("current_text"))
    return routes.join(newest, "key", "left").withColumn("current_text", F.when((F.col("route") == "amended") & (F.col("target_key") == F.col("key")), F.col("current_text")))


def with_origins(hits: DataFrame, routes: DataFrame, chunks: DataFrame, valid: Column, per: int = 2) -> DataFrame:
    """(query, chunk_id, rank, route) of hits (query, chunk_id, rank): repealed ones dropped unless a query has no others, and
    behind a quotation the first `per` chunks of the unit that it amends, where these are valid and not there already."""
    told = hits.join(routes.select("chunk_id", "route", "target_key"), "chunk_id")
    keep = F.coalesce(F.col("route") != "repealed", F.lit(True))
    some = F.max(keep.cast("int")).over(Window.partitionBy("query"))
    kept = settled(told.withColumn("some", some).where(keep | (F.col("some") == 0)).select("query", "chunk_id", "rank", "route", "target_key"), "kept")
    under = chunks.where(valid).select(F.col("chunk_id").alias("origin"), F.explode(ancestors(F.col("key"))).alias("target_key"))
    first = under.withColumn("n", F.row_number().over(Window.partitionBy("target_key").orderBy("origin"))).where(F.col("n") <= per)
    pulled = kept.where("route = 'quoted'").join(first, "target_key").groupBy("query", F.col("origin").alias("chunk_id")).agg(F.min("rank").alias("rank")).withColumn("route", F.lit("origin"))
    return kept.select("query", "chunk_id", "rank", "route").unionByName(pulled.join(kept.select("query", "chunk_id"), ["query", "chunk_id"], "left_anti"))


def impacts(edges: DataFrame, as_of: str) -> DataFrame:
    """(number, key, status, source_key, badge): every unit that isn't intact, numbered in the order of its document."""
    live = alive(applied(edges, as_of))
    targets = live.select(F.col("target_key").alias("key")).distinct()
    touched = _on_or_above(targets, live).select(F.regexp_extract("key", "^([^#]+)", 1).alias("number"), "key", F.when(F.col("edge.op") == REPEAL, "repealed").otherwise("amended").alias("status"), F.col("edge.source_key").alias("source_key"))
    order = [_natural(_part("dieu")), _natural(_part("khoan")), letter_rank(F.coalesce(_part("diem"), F.lit(""))), F.col("key")]
    return touched.withColumn("badge", F.row_number().over(Window.partitionBy("number").orderBy(*order)))
