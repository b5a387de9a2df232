"""Page marks and repeated units among the lines of a text: what a page put in is dropped, what differs stays and is told.

Every line is a row; which article and clause it is in, what its number said before and which unit a mark stands before are
windows over the rows of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.positional import lines_with_offsets
from tempora.operators.quotes import quote_runs

#: How page marks, articles, clauses and points begin, and a clause whose number lacks its space.
BADGE, ARTICLE = r"(?U)^Điều khoản (?:được|bị)\s", r"(?U)^Điều\s+(\d+)\s*\."
CLAUSE, POINT, GLUED = r"(?U)^(\d+[a-z]?)\.\s", r"(?U)^([a-zđ])\)\s", r"(?U)^\d+\.\S"


def _found(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("said", pattern, 1), F.lit(""))


def quoted_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, quoted): whether a quotation is open before a line's first character; an unopened close is none."""
    lines = lines_with_offsets(df.select(key, text), text).select(key, "line_no", "line", "start")
    state = (F.col("clamped") > 0) | F.col("straight")
    marks = quote_runs(df, key, text).select(key, "start", F.lit(1).alias("kind"), F.col("run").alias("line_no"), F.lit(None).cast("string").alias("line"), state.alias("open"))
    both = lines.select(key, "start", F.lit(0).alias("kind"), "line_no", "line", F.lit(None).cast("boolean").alias("open")).unionByName(marks)
    # A mark at a line's own start isn't before it; of runs at one place the last one counts.
    before = F.last("open", ignorenulls=True).over(Window.partitionBy(key).orderBy("start", "kind", "line_no"))
    return both.withColumn("quoted", F.coalesce(before, F.lit(False))).where("kind = 0").select(key, "line_no", "line", "quoted")


def marked_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, level, article, number, kept, differs, glued): each line of a text, and whether it stays.

    level: badge, article, clause, point or other; clauses and points are such in articles only. Not kept are badges, a clause
    that says what the last one of its number in its article said, and a point that was seen under the same clause. differs:
    a clause's number was there before with other words; both stay. Quoted clauses and points belong to another text: they
    stay and aren't compared. glued: a clause number without its space. Null texts have no lines; repeated keys mix.
    """
    rows = quoted_lines(df, key, text).withColumn("said", F.regexp_replace("line", r"(?U)^\s+|\s+\z", ""))
    rows = rows.withColumns({"badge": F.col("said").rlike(BADGE), "art": _found(ARTICLE), "cl": _found(CLAUSE), "pt": _found(POINT)})
    upto = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumns({"nth": F.count("art").over(upto), "article": F.last("art", ignorenulls=True).over(upto)})
    inside = (F.col("nth") > 0) & F.col("art").isNull() & ~F.col("badge")
    clause, point = inside & F.col("cl").isNotNull(), inside & F.col("cl").isNull() & F.col("pt").isNotNull()
    level = F.when(F.col("badge"), "badge").when(F.col("art").isNotNull(), "article").when(clause, "clause").when(point, "point").otherwise("other")
    rows = rows.withColumn("level", level).withColumn("own", F.when(~F.col("quoted") & F.col("level").isin("clause", "point"), F.col("level")))
    told = F.lag("said").over(Window.partitionBy(key, "nth", "own", F.when(F.col("own") == "clause", F.col("cl"))).orderBy("line_no"))
    rows = rows.withColumn("before", F.when(F.col("own") == "clause", told))
    repeat = F.coalesce(F.col("before") == F.col("said"), F.lit(False))
    under = F.last(F.when((F.col("own") == "clause") & ~repeat, F.col("cl")), ignorenulls=True).over(Window.partitionBy(key, "nth").orderBy("line_no"))
    rows = rows.withColumns({"repeat": repeat, "under": under})
    seen = F.row_number().over(Window.partitionBy(key, "nth", "own", F.when(F.col("own") == "point", F.struct("under", "said"))).orderBy("line_no")) > 1
    rows = rows.withColumn("seen", seen & F.coalesce(F.col("own") == "point", F.lit(False)))
    number = F.when(F.col("level") == "article", F.col("art")).when(F.col("level") == "clause", F.col("cl")).when(F.col("level") == "point", F.col("pt"))
    kept = ~F.col("badge") & ~F.col("repeat") & ~F.col("seen")
    return rows.select(key, "line_no", "line", "level", "article", number.alias("number"), kept.alias("kept"), (F.col("before").isNotNull() & ~F.col("repeat")).alias("differs"), ((F.col("level") == "other") & F.col("said").rlike(GLUED)).alias("glued"))


def badge_labels(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, badge, article, level, number): each badge of marked lines with the unit that the next other line begins.

    A badge after which nothing comes has no unit and no row.
    """
    # Read backwards, so that the frame grows with the scan.
    back = Window.partitionBy(key).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    unit = F.last(F.when(F.col("level") != "badge", F.struct("article", "level", "number")), ignorenulls=True).over(back)
    rows = lines.withColumn("unit", unit).where("level = 'badge' AND unit IS NOT NULL")
    return rows.select(key, "line_no", F.regexp_replace("line", r"(?U)^\s+|\s+\z", "").alias("badge"), "unit.article", "unit.level", "unit.number")


def cleaned_texts(lines: DataFrame, key: str) -> DataFrame:
    """(key, text, n_lines, n_kept, n_differs, n_glued): the kept lines of each text, joined again, and counts of its lines.

    The text is empty where no line is kept.
    """
    kept = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("line_no", "line"))))
    counts = (F.count_if(c).alias(f"n_{c}") for c in ("kept", "differs", "glued"))
    return lines.groupBy(key).agg(F.array_join(F.transform(kept, lambda r: r["line"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_lines"), *counts)
