"""Crawled pages as relations: property cells, relation tabs, paragraphs with addresses, texts of units, numbered impacts, painted spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions.pages import paragraphs, prefix_level, stripped
from tempora.operators.span_joins import numbered, over_places

#: A category of a relation tab with its count, and the line that parts outgoing from incoming ones.
CATEGORY, MIDDLE = r"^(.+?)\s*\((\d+)\)$", "VĂN BẢN ĐANG XEM"


def properties(cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """(id, key, value) of cells (id, ord, cell), each a label and under it a value: '--' is empty, labels without a name
    are left out, and of several cells of one name the last counts (of the same place, the greater value)."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    at = F.instr("cell", "\n")
    label = stripped(F.when(at > 0, F.left("cell", at - 1)).otherwise(F.col("cell")))
    value = F.when(at > 0, stripped(F.substr("cell", at + 1))).otherwise("")
    rows = cells.select("id", table[label].alias("key"), F.struct("ord", F.when(value == "--", "").otherwise(value).alias("value")).alias("last")).where("key IS NOT NULL")
    return rows.groupBy("id", "key").agg(F.max("last").alias("last")).select("id", "key", "last.value")


def relation_tab(lines: DataFrame, category: str = CATEGORY, middle: str = MIDDLE) -> DataFrame:
    """(id, direction, category, titles) of lines (id, line_no, line).

    A category line names how many titles follow; blank lines and '--' are none of them, and a category that ends early
    is cut by the next. What stands before the middle line is outgoing. A category that comes twice counts as it came last.
    """
    so_far = Window.partitionBy("id").orderBy("line_no")
    side = F.when(F.max(F.startswith("line", F.lit(middle)).cast("int")).over(so_far) == 1, "incoming").otherwise("outgoing")
    name = F.regexp_extract("line", category, 1)
    rows = lines.select("id", "line_no", stripped(F.col("line")).alias("line")).withColumn("direction", side)
    rows = rows.withColumn("name", F.when(name != "", F.trim(name))).withColumn("want", F.when(name != "", F.regexp_extract("line", category, 2).cast("long")))
    rows = rows.withColumn("section", F.count("name").over(Window.partitionBy("id", "direction").orderBy("line_no"))).where("section > 0")
    inside = Window.partitionBy("id", "direction", "section").orderBy("line_no")
    title = F.col("name").isNull() & ~F.col("line").isin("", "--")
    rows = rows.withColumns({"place": F.count_if(title).over(inside), "most": F.first("want").over(inside)})
    kept = F.when(title & (F.col("place") <= F.col("most")), F.struct("line_no", "line"))
    sections = rows.groupBy("id", "direction", "section").agg(F.max("name").alias("category"), F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["line"]).alias("titles"))
    return sections.groupBy("id", "direction", "category").agg(F.max_by("titles", "section").alias("titles"))


def addressed_paragraphs(nodes: DataFrame) -> DataFrame:
    """(id, place, level, article, clause, point, html) of nodes (id, level, article, clause, point, html), parted at line breaks.

    The level is what the paragraph's own numbering says, else the node's; a point stands under the last clause numbered
    before it in the node, else under the node's clause. A paragraph without numbering has the node's address.
    """
    rows = nodes.select(*(F.col(c) for c in ("id", "level", "article", "clause", "point")), F.posexplode(paragraphs(F.col("html"))).alias("place", "part"))
    rows = rows.withColumn("own", prefix_level(F.col("part")))
    is_clause, is_point = F.col("own.level") == "clause", F.col("own.level") == "point"
    carried = F.last(F.when(is_clause, F.col("own.no")), ignorenulls=True).over(Window.partitionBy("id").orderBy("place"))
    clause = F.when(is_clause, F.col("own.no")).when(is_point, F.coalesce(carried, "clause")).otherwise(F.col("clause"))
    point = F.when(is_point, F.col("own.no")).when(~F.coalesce(is_clause, F.lit(False)), F.col("point"))
    return rows.select("id", "place", F.coalesce("own.level", "level").alias("level"), "article", clause.alias("clause"), point.alias("point"), F.col("part").alias("html"))


def unit_texts(nodes: DataFrame, paths: DataFrame, tree: str, ord_: str, text: str) -> DataFrame:
    """(tree, ord, full_text): each unit's own text and that of all units under it, in order; paths: (tree, ord, path) of ords from the root."""
    said = nodes.join(paths, [tree, ord_]).where(F.coalesce(text, F.lit("")) != "")
    up = said.select(tree, F.explode("path").alias("__at"), F.struct(ord_, text).alias("__part"))
    parts = F.transform(F.array_sort(F.collect_list("__part")), lambda x: x[text])
    return up.groupBy(tree, F.col("__at").alias(ord_)).agg(F.array_join(parts, "\n").alias("full_text"))


def number_key(value: Column) -> Column:
    """A sort key of '12a': the number, then its letter; what has no number comes last."""
    digits = F.regexp_extract(value, r"(\d+)", 1)
    return F.struct(F.when(digits != "", digits.cast("long")).otherwise(F.lit(1 << 40)).alias("n"), F.regexp_extract(F.lower(value), r"\d+([a-zđ]?)", 1).alias("s"))


def numbered_impacts(impacts: DataFrame, doc: str) -> DataFrame:
    """impacts (doc, article, clause, point) with stt: their number in the document's order, from 1; whole articles and clauses come before what is in them."""
    part = lambda c: F.when(F.col(c).isNotNull(), number_key(F.col(c)))
    order = (number_key(F.col("article")), part("clause").asc_nulls_first(), F.col("point").asc_nulls_first())
    return impacts.withColumn("stt", F.row_number().over(Window.partitionBy(doc).orderBy(*order)))


def painted(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, start, end, role, shared, piece): texts (id, text) cut at every edge of their spans (id, start, end, role); a piece has the
    role of the narrowest span over it (the first by start, end and role of equally narrow ones), null outside all; shared: whether
    several cover it. Spans are cut into dyadic ranges of pieces, so that nested spans don't multiply."""
    length = texts.select("id", "text", F.char_length("text").alias("length"))
    sound = spans.join(length.select("id", "length"), "id").where("0 <= start AND start < end AND end <= length").drop("length")
    edges = length.select("id", F.explode(F.array(F.lit(0), "length")).alias("start")).unionAll(sound.select("id", F.explode(F.array("start", "end")))).distinct()
    places = numbered(edges, ["id"], "start", "place").withColumn("end", F.lead("start").over(Window.partitionBy("id").orderBy("start")))
    at = places.select("id", F.col("start").alias("__at"), "place")
    s = sound.join(at.withColumnsRenamed({"__at": "start", "place": "i"}), ["id", "start"]).join(at.withColumnsRenamed({"__at": "end", "place": "j"}), ["id", "end"])
    narrow = F.struct((F.col("end") - F.col("start")).alias("width"), F.col("start").alias("a"), F.col("end").alias("b"), "role")
    best = over_places(places.where("end IS NOT NULL"), s, ["id"], "place", "i", "j", narrow, "best", "covers")
    return best.join(length, "id").select("id", "start", "end", "best.role", (F.col("covers") > 1).alias("shared"), F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("piece"))
