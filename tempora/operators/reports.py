"""Counts that reports are made of: verdicts, reasons, regressions, stability, prices, grids of measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.evaluation import f2

#: The verdicts that a report always shows.
VERDICTS = ("pass", "warning", "violation", "not_assessed")
#: Share of skipped cases from which a run doesn't count.
SKIPPED = 0.15


def verdict_counts(rows: DataFrame, by: Sequence[str], verdict: str = "verdict", known: Sequence[str] = VERDICTS) -> DataFrame:
    """A count of each verdict, zero where there is none."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(verdict) == v).alias(v) for v in known))


def missing_codes(rows: DataFrame, code: str, known: Sequence[str]) -> DataFrame:
    """(code, n) of a closed set, zero where it doesn't occur."""
    codes = rows.sparkSession.createDataFrame([(c,) for c in known], "code string")
    seen = rows.groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return codes.join(seen, "code", "left").select("code", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def reasons(rows: DataFrame, rules: Sequence[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """(reason, n): each row counts once, under the first rule that holds, so that the counts sum up to the input."""
    reason = F.lit(kept)
    for name, rule in reversed(list(rules)):
        reason = F.when(rule, name).otherwise(reason)
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def regression(rows: DataFrame, by: Sequence[str], checks: Sequence[str], failed: str) -> DataFrame:
    """For each check (a boolean column): how many rows pass it; rows that failed to run aren't in n."""
    ran = ~F.col(failed)
    return rows.groupBy(*by).agg(F.count_if(ran).alias("n"), F.count_if(F.col(failed)).alias("errors"), *(F.count_if(ran & F.col(c)).alias(c) for c in checks))


def stability(runs: DataFrame, case: str, hit: str, positive: str, by: Sequence[str]) -> DataFrame:
    """Of several runs of each case: cases found in any run, found in all, and negative cases alerted."""
    cases = runs.groupBy(*by, case, positive).agg(F.bool_or(hit).alias("any"), F.bool_and(hit).alias("all"))
    return cases.groupBy(*by).agg(F.count_if(F.col(positive)).alias("n"), F.count_if(F.col(positive) & F.col("any")).alias("found"), F.count_if(F.col(positive) & F.col("all")).alias("stable"), F.count_if(~F.col(positive) & F.col("any")).alias("false_alarms"))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, tokens_in, tokens_out) with cost; prices: (model, price_in, price_out) a million tokens; null for other models."""
    return usage.join(F.broadcast(prices), "model", "left").withColumn("cost", (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6).select(*usage.columns, "cost")


def counts_as_run(n_skipped: Column, n_cases: Column, n_expected: Column) -> Column:
    """Whether a run counts: something was expected, and at most a share of SKIPPED was skipped."""
    return F.coalesce((n_expected > 0) & (n_skipped <= SKIPPED * n_cases), F.lit(False))


def grid(results: DataFrame, gold: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(level, k, n, recall, precision, rr, f2): macro averages of results (level, query, key, rank from 0) against gold (level, query, key), at all
    depths in one pass; queries without gold at a level aren't counted there."""
    depth = results.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    sizes = gold.distinct().groupBy("level", "query").agg(F.count(F.lit(1)).alias("n_gold")).join(F.broadcast(depth), F.lit(True))
    first = results.groupBy("level", "query", "key").agg(F.min("rank").alias("rank")).join(gold.distinct(), ["level", "query", "key"])
    hits = first.join(F.broadcast(depth), F.col("rank") < F.col("k")).groupBy("level", "query", "k").agg(F.count(F.lit(1)).alias("found"), F.min("rank").alias("first"))
    each = sizes.join(hits, ["level", "query", "k"], "left").select("level", "k", (F.coalesce("found", F.lit(0)) / F.col("n_gold")).alias("r"), (F.coalesce("found", F.lit(0)) / F.col("k")).alias("p"), F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("rr"))
    out = each.groupBy("level", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("recall"), F.avg("p").alias("precision"), F.avg("rr").alias("rr"))
    return out.withColumn("f2", f2(F.col("precision"), F.col("recall")))
