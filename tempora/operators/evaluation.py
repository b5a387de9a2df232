"""Measures of rankings and judgements. Each convention for empty denominators is kept where it belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of verdicts; what wasn't assessed has none.
WEIGHTS = {"pass": 1.0, "warning": 0.5, "violation": 0.0}


def f2(precision: Column, recall: Column) -> Column:
    """5PR / (4P + R), 0 where that has no denominator."""
    low = 4 * precision + recall
    return F.when(low <= 0, 0.0).otherwise(5 * precision * recall / low)


def ranking_measures(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query, recall, precision, rr, f2) at k of results (query, key, rank from 0) against gold (query, key).

    Results are first reduced to the first place of each key. Recall counts gold found, precision divides by k also
    where fewer came back; queries without gold are left out.
    """
    first = results.groupBy("query", "key").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", "key")) - 1
    top = first.withColumn("place", place).where(F.col("place") < k)
    wanted = gold.distinct().withColumn("rel", F.lit(1))
    sizes = gold.distinct().groupBy("query").agg(F.count(F.lit(1)).alias("n_gold"))
    hit = top.join(wanted, ["query", "key"]).groupBy("query").agg(F.count(F.lit(1)).alias("found"), F.min("place").alias("first"))
    out = sizes.join(hit, "query", "left").select("query", (F.coalesce("found", F.lit(0)) / F.col("n_gold")).alias("recall"), (F.coalesce("found", F.lit(0)) / F.lit(float(k))).alias("precision"), F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0)).alias("rr"))
    return out.withColumn("f2", f2(F.col("precision"), F.col("recall")))


def macro(measures: DataFrame) -> DataFrame:
    """Averages over queries, F2 of the averages and the average of F2, and the number of queries."""
    avg = measures.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ("recall", "precision", "rr")), F.avg("f2").alias("f2_macro"))
    return avg.withColumn("f2", f2(F.col("precision"), F.col("recall")))


def ratio(part: Column, whole: Column, digits: int = 3) -> Column:
    """part / whole, or null where the whole is 0."""
    return F.when(whole != 0, F.round(part / whole, digits))


def weighted_score(verdict: Column) -> Column:
    """100 times the mean weight of the assessed verdicts, half to even; 0 where none was assessed. An aggregate."""
    weight = F.lit(None).cast("double")
    for name, w in WEIGHTS.items():
        weight = F.when(verdict == name, w).otherwise(weight)
    return F.coalesce(F.bround(100 * F.avg(weight), 0), F.lit(0.0))


def majority(first: Column, second: Column, third: Column) -> Column:
    """Two votes that agree decide; else the third breaks the tie, and three different votes are a warning."""
    return F.when(first == second, first).when((third == first) | (third == second), third).otherwise("warning")


def upper_median(values: Column) -> Column:
    """The element at n // 2 of the sorted values, not interpolated. An aggregate."""
    xs = F.array_sort(F.collect_list(values))
    return F.get(xs, F.floor(F.size(xs) / 2).cast("int"))


def hull_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap of two spans over the hull of both, which is more than their union where they are apart."""
    over = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull > 0, over / hull).otherwise(0.0)


def pair_measures(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(n_gold, n_predicted, n_hit, recall, precision) of unordered pairs (a, b), pooled; null ratios without a denominator."""
    both = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = both(gold).withColumn("g", F.lit(1)).join(both(predicted).withColumn("p", F.lit(1)), ["a", "b"], "full")
    counts = met.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("n_gold"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_predicted"), F.coalesce(F.sum(F.col("g") * F.col("p")), F.lit(0)).alias("n_hit"))
    return counts.select("*", ratio(F.col("n_hit"), F.col("n_gold")).alias("recall"), ratio(F.col("n_hit"), F.col("n_predicted")).alias("precision"))


def grades(pairs: DataFrame) -> DataFrame:
    """Counts of (gold, verdict) as correct, half (a warning for a violation), wrong and unassessed, and the share of correct among assessed."""
    grade = F.when(F.col("verdict") == "not_assessed", "unassessed").when(F.col("verdict") == F.col("gold"), "correct").when((F.col("gold") == "violation") & (F.col("verdict") == "warning"), "half").otherwise("wrong")
    out = pairs.select(grade.alias("g")).agg(*(F.count_if(F.col("g") == n).alias(n) for n in ("correct", "half", "wrong", "unassessed")))
    return out.withColumn("share", ratio(F.col("correct"), F.col("correct") + F.col("half") + F.col("wrong")))


def span_f1(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(id, precision, recall, f1) of sets; F1 is null where either is null or 0."""
    met = gold.distinct().withColumn("g", F.lit(1)).join(predicted.distinct().withColumn("p", F.lit(1)), keys, "full")
    hit = F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull())
    counts = met.groupBy("id").agg(hit.alias("hit"), F.count("g").alias("ng"), F.count("p").alias("np"))
    p, r = ratio(F.col("hit"), F.col("np"), 9), ratio(F.col("hit"), F.col("ng"), 9)
    out = counts.select("id", p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
