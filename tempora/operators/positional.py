"""Order-dependent operators: latest row, first occurrence, carry-forward, islands, offsets, packing, sequence checks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Fixed value: repeat marks at a label's end.
_MARKS = r"(?: \(\d+\))+\z"


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in this order. Spark cuts each group to its first row before it shuffles, so that a hot key costs no more than others."""
    columns = df.columns
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").select(*columns)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered from 1; Spark limits groups before it shuffles them."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def first_occurrence(df: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """The first row of each key in rank order."""
    return df.groupBy(*keys).agg(F.min(rank).alias(rank))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """The last value that isn't null up to each row of its group."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(window))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column], begins: Column, name: str) -> DataFrame:
    """Numbers the runs of rows in each group that a marker row begins; rows before the first marker are run 0."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(begins.cast("long")).over(window))


def uniquified(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], label: str, name: str) -> DataFrame:
    """Labels made unique in a group, in order (columns, ascending): a repeat gets the first ' (n)', from 2, that no label before it has.

    Only labels that are equal but for such marks at their end can meet. Where none of those bears a mark, a repeat's number is
    its place among them; the others are named one after the other, in time that grows with their number.
    """
    own = F.col(label).cast("string")
    columns, family = df.columns, [*(F.col(k) for k in keys), F.regexp_replace(own, _MARKS, "")]
    by = Window.partitionBy(*family)
    # Marks first: rows that lie together by family need no other shuffle to be numbered.
    rows = df.withColumn("__own", own).withColumn("__marked", F.max(F.coalesce(own.rlike(_MARKS), F.lit(False))).over(by))
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*family, "__own").orderBy(*order, *columns)))
    plain = rows.where("NOT __marked").select(*columns, F.when(F.col("__place") == 1, F.col("__own")).otherwise(F.concat("__own", F.lit(" ("), F.col("__place").cast("string"), F.lit(")"))).alias(name))
    marked = rows.where("__marked").withColumns({"__family": F.regexp_replace("__own", _MARKS, ""), "__place": F.row_number().over(by.orderBy(*order, *columns))}).drop("__marked")
    kinds = StructType([*df.schema.fields, StructField(name, StringType())])

    def named(group: pa.Table) -> pa.Table:
        group = group.sort_by("__place")
        used, upto, out = set(), {}, []
        for said in group["__own"].to_pylist():
            one = said
            if said in used:
                n = upto.get(said, 2)
                while (one := f"{said} ({n})") in used:
                    n += 1
                upto[said] = n + 1
            used.add(one)
            out.append(one)
        return group.select(columns).append_column(name, pa.array(out, pa.string()))

    return plain.unionByName(marked.groupBy(*keys, "__family").applyInArrow(named, kinds))


@F.pandas_udf(ArrayType(IntegerType()))
def _starts(lengths: pd.Series) -> pd.Series:
    """The offset of each part, from the lengths of all, each followed by a gap of one."""
    return lengths.map(lambda x: None if x is None else np.cumsum(np.concatenate([[0], np.asarray(x, np.int64)[:-1] + 1])) if len(x) else [])


def lines_with_offsets(df: DataFrame, text: str) -> DataFrame:
    """A row for each line: line_no (from 0), line, and start, its offset in code points. Offsets are summed up inside the row: nothing is shuffled."""
    lines = F.split(F.col(text), "\n", -1)
    rows = df.withColumn("__lines", lines).withColumn("__starts", _starts(F.transform("__lines", F.char_length)))
    rows = rows.select(*df.columns, F.arrays_zip(F.col("__lines").alias("line"), F.col("__starts").alias("start")).alias("__both"))
    return rows.select(*df.columns, F.posexplode("__both").alias("line_no", "__line")).select(*df.columns, "line_no", F.col("__line.line").alias("line"), F.col("__line.start").alias("start"))


def packed_sizes(sizes: Column, most: int, gap: int = 1) -> Column:
    """Greedy packing of adjacent units: the bin (from 0) of each size; a unit joins the bin before it while both fit with a gap."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def bins(rows: pd.Series) -> pd.Series:
        def packed(row):
            out, used, at = [], None, 0
            for n in row:
                if used is not None and used + gap + n <= most:
                    used += gap + n
                else:
                    at, used = at + (used is not None), n
                out.append(at)
            return out

        return rows.map(lambda row: None if row is None else packed(row))

    return bins(sizes)


def number_gaps(numbers: Column) -> Column:
    """(first, last) of each run of integers between the least and the greatest that are absent, ascending; null without numbers."""
    known = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull())))
    pairs = F.zip_with(F.slice(known, 1, F.greatest(F.size(known) - 1, F.lit(0))), F.slice(known, 2, F.size(known)), lambda a, b: F.struct((a + 1).alias("first"), (b - 1).alias("last")))
    return F.when(F.size(known) > 0, F.filter(pairs, lambda p: p["first"] <= p["last"]))


#: Numbers of a gap that are unfolded at once.
UNFOLD = 10_000


def missing_numbers(df: DataFrame, numbers: Column, keep: Sequence[str | Column], name: str) -> DataFrame:
    """A row (keep, name) for each absent integer: gaps are unfolded in pieces, so that no row holds a range of any width."""
    gaps = df.select(*keep, F.explode(number_gaps(numbers)).alias("__gap"))
    pieces = gaps.withColumn("__from", F.explode(F.sequence(F.col("__gap.first"), F.col("__gap.last"), F.lit(UNFOLD).cast(gaps.schema["__gap"].dataType["first"].dataType))))
    rows = pieces.withColumn(name, F.explode(F.sequence("__from", F.least(F.col("__from") + UNFOLD - 1, F.col("__gap.last")))))
    return rows.drop("__gap", "__from")


def out_of_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column], number: str) -> DataFrame:
    """Rows whose number is below that of the row before them in the group."""
    before = F.lag(number).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("before", before).where(F.col(number) < F.col("before"))


def sequence_faults(units: DataFrame, keys: Sequence[str], order: Sequence[Column], number: str) -> DataFrame:
    """(keys, fault, number) of numbered units: 'repeated', 'out_of_order' (below the one before) and 'missing' between least and greatest."""
    keys = list(keys)
    repeated = units.groupBy(*keys, number).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit("repeated").alias("fault"), number)
    behind = out_of_order(units, keys, order, number).select(*keys, F.lit("out_of_order"), number)
    sets = units.groupBy(*keys).agg(F.collect_set(number).alias("xs"))
    absent = missing_numbers(sets, F.col("xs"), [*keys, F.lit("missing").alias("fault")], number)
    return repeated.unionAll(behind).unionAll(absent)
