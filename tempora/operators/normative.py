"""Deterministic parts of normative classification: ordered rules, multisets, closed domains, modality changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions.text import marker_groups, number_tokens

#: Roles of articles by their titles, tried in order.
ROLES = (("scope", r"(?iu)phạm vi|scope"), ("subject", r"(?iu)đối tượng|subject"), ("definition", r"(?iu)giải thích từ ngữ|definition"), ("transition", r"(?iu)chuyển tiếp|transition"), ("effect", r"(?iu)hiệu lực|effect"))


def tier(rules: Sequence[tuple[int, Column]], default: int) -> Column:
    """The number of the first rule that holds."""
    out = F.lit(default)
    for n, rule in reversed(list(rules)):
        out = F.when(rule, n).otherwise(out)
    return out


def role(title: Column, default: str = "norm") -> Column:
    """An article's role by its title."""
    out = F.lit(default)
    for name, pattern in reversed(ROLES):
        out = F.when(title.rlike(pattern), name).otherwise(out)
    return out


def multiset_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Keys that a has more often than b, and how much more often."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    more = F.col("__a") - F.coalesce("__b", F.lit(0))
    return count(a, "__a").join(count(b, "__b"), list(keys), "left").where(more > 0).select(*keys, more.alias(name))


def partition_proof(values: Column, domain: Column) -> Column:
    """(missing, foreign, repeated): values of the domain not seen, values seen outside it, whether any is seen twice. A null domain proves nothing."""
    seen = F.array_distinct(values)
    return F.when(domain.isNotNull(), F.struct(F.size(F.array_except(domain, seen)).alias("missing"), F.size(F.array_except(seen, domain)).alias("foreign"), (F.size(values) > F.size(seen)).alias("repeated")))


def modality_delta(claim: Column, source: Column) -> Column:
    """(added, lost, numbers): deontic groups and numbers that a claim has and its source lacks, or the other way about."""
    c, s = marker_groups(claim), marker_groups(source)
    return F.struct(F.array_except(c, s).alias("added"), F.array_except(s, c).alias("lost"), F.array_except(number_tokens(claim), number_tokens(source)).alias("numbers"))


def resolved_chunks(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(claim, id): an id named by a model made a chunk's: itself if it exists, else the one chunk that it specifies."""
    exact = claims.join(chunks.select(F.col("id").alias("claim"), "id"), "claim")
    rest = claims.join(exact.select("claim"), "claim", "left_anti")
    words = F.split("claim", " ")
    cut = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    longer = rest.select("claim", F.explode(cut).alias("id")).join(chunks.select("id"), "id")
    one = longer.groupBy("claim").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").select("claim", "id")
    return exact.select("claim", "id").unionAll(one)


#: Groups of markers that a claim may not add of its own.
HARD = ("obligation", "prohibition")


def invented(claim: Column, source: Column) -> Column:
    """Hard groups that a claim has and its source hasn't."""
    return F.array_intersect(F.array_except(marker_groups(claim), marker_groups(source)), F.array(*map(F.lit, HARD)))


def effect_date(text: Column) -> Column:
    """The day on which a text says it takes effect, or null."""
    pattern = r"(?iu)có hiệu lực(?: thi hành)?(?: kể)? từ ngày (\d{1,2}) tháng (\d{1,2}) năm (\d{4})"
    part = lambda n: F.regexp_extract(text, pattern, n)
    return F.when(part(3) != "", F.try_to_date(F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd"))


def unit_class(text: Column, title: Column) -> tuple[Column, Column]:
    """(class, path) of a unit: gates by role or effect date, then norms by their markers, then definitions, else a premise.

    path names the tests that were tried, in order, the last being the one that decided.
    """
    groups, own = marker_groups(text), role(title)
    tests = (
        ("gate", own.isin("scope", "subject", "effect", "transition") | effect_date(text).isNotNull()),
        ("definition", own == "definition"),
        ("actor", F.arrays_overlap(groups, F.array(*map(F.lit, ("obligation", "prohibition", "permission"))))),
        ("condition", F.array_contains(groups, "condition")),
    )
    kind, path = F.lit("premise"), F.array(*(F.lit(n) for n, _ in tests), F.lit("premise"))
    for i in reversed(range(len(tests))):
        name, holds = tests[i]
        kind = F.when(holds, name).otherwise(kind)
        path = F.when(holds, F.array(*(F.lit(n) for n, _ in tests[: i + 1]))).otherwise(path)
    return kind, path


def compared_conditions(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, point, state) of conditions on either side: 'same', 'different', 'extra' or 'lost', for records that both sides have."""
    ids = predicted.select("id").intersect(gold.select("id"))
    p, g = predicted.join(ids, "id", "left_semi").withColumnRenamed("value", "p"), gold.join(ids, "id", "left_semi").withColumnRenamed("value", "g")
    state = F.when(F.col("g").isNull(), "extra").when(F.col("p").isNull(), "lost").when(F.col("p") == F.col("g"), "same").otherwise("different")
    return p.join(g, ["id", "point"], "full").select("id", "point", state.alias("state"))
