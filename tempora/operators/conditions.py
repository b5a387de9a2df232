"""Conditions of normative records: gates by date, points by their units, what doesn't apply, changed wording, reviewers' payloads."""

from __future__ import annotations

import difflib
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tempora.functions.text import marker_groups

#: Kinds of gates that have no actor, and the most words of a replaced run that can be a swapped marker.
NO_ACTOR, FLIP_WORDS = ("thoi_gian", "lanh_tho"), 6
_CHANGES = ArrayType(StructType([StructField(c, StringType()) for c in ("kind", "source", "claim")]))


def gate_clause(text: Column) -> Column:
    """(bound, day, note) of the clause that says when a text takes effect ('start') or ends ('end'); null without one.

    day is null where the clause names none (note 'relative') or one that isn't in the calendar (note 'invalid').
    """
    pattern = r"(?iu)(có|hết)\s+hiệu\s+lực(?:\s+thi\s+hành)?(?:\s+kể)?(?:\s+(từ|đến(?:\s+hết)?))?(?:\s+ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4}))?"
    part = lambda n: F.regexp_extract(text, pattern, n)
    day = F.when(part(5) != "", F.try_to_date(F.concat_ws("-", part(5), F.lpad(part(4), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd"))
    bound = F.when((F.lower(part(1)) == "hết") | F.startswith(F.lower(part(2)), F.lit("đến")), "end").otherwise("start")
    note = F.when(part(5) == "", "relative").when(day.isNull(), "invalid").otherwise("")
    return F.when(part(1) != "", F.struct(bound.alias("bound"), day.alias("day"), note.alias("note")))


def no_subject(role: Column, kinds: Column, without_actor: Sequence[str] = NO_ACTOR) -> Column:
    """Whether a record needs no subject: a meta record whose gates, at least one, all have no actor."""
    return F.coalesce((role == "meta") & (F.size(kinds) > 0) & F.forall(kinds, lambda k: k.isin(*without_actor)), F.lit(False))


def no_conditions(role: Column, kinds: Column, n_points: Column, without_actor: Sequence[str] = NO_ACTOR) -> Column:
    """Whether a record needs no conditions: it needs no subject, and its clause has no points."""
    return no_subject(role, kinds, without_actor) & (F.coalesce(n_points, F.lit(0)) == 0)


def derived_points(claims: DataFrame, picks: DataFrame, units: DataFrame) -> DataFrame:
    """(id, point, warning): a condition's point by the units it picked; what the claim says is only held against it.

    claims: (id, clause, claimed), picks: (id, uid), units: (clause, uid, point). Units of one point give that point;
    of several give none and 'several'; a claimed point outside all points of a clause that has some gives 'outside'.
    """
    has = units.groupBy("clause").agg((F.count("point") > 0).alias("has_points"))
    seen = claims.select("id", "clause").join(picks, "id").join(units, ["clause", "uid"]).groupBy("id").agg(F.collect_set("point").alias("points"))
    n = F.coalesce(F.size("points"), F.lit(0))
    outside = (n <= 0) & (F.trim(F.coalesce("claimed", F.lit(""))) != "") & F.coalesce("has_points", F.lit(False))
    rows = claims.join(seen, "id", "left").join(has, "clause", "left")
    return rows.select("id", F.when(n == 1, F.get("points", F.lit(0))).alias("point"), F.when(n > 1, "several").when(outside, "outside").alias("warning"))


def grounding_rows(records: DataFrame, id_: str, fields: Sequence[str]) -> DataFrame:
    """(id, field, value, start, end, grounded): a row for each field of a record, each a struct of value, start and end."""
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("at")) for f in fields))).alias("r")
    out = records.select(F.col(id_).alias("id"), rows).select("id", "r.field", "r.at.value", "r.at.start", "r.at.end")
    return out.withColumn("grounded", F.col("start").isNotNull() & F.col("end").isNotNull())


@F.pandas_udf(_CHANGES)
def word_changes(source: pd.Series, claim: pd.Series) -> pd.Series:
    """The runs of words that were replaced, deleted or inserted between two texts, in order; null texts have no words."""
    out = []
    for s, c in zip(source, claim, strict=True):
        a, b = (re.findall(r"\w+", (x or "").lower()) for x in (s, c))
        codes = difflib.SequenceMatcher(None, a, b).get_opcodes()
        out.append([{"kind": kind, "source": " ".join(a[i:j]), "claim": " ".join(b[k:m])} for kind, i, j, k, m in codes if kind != "equal"])
    return pd.Series(out)


def flips(changes: Column, most: int = FLIP_WORDS) -> Column:
    """Of the changes of words, replaced runs of at most `most` words whose marker groups differ, both having some; shortest first."""
    words = lambda s: F.size(F.split(s, " "))
    groups = lambda s: marker_groups(s)
    kept = F.filter(changes, lambda c: (c["kind"] == "replace") & (F.greatest(words(c["source"]), words(c["claim"])) <= most) & (F.size(groups(c["source"])) > 0) & (F.size(groups(c["claim"])) > 0) & (groups(c["source"]) != groups(c["claim"])))
    keyed = F.transform(kept, lambda c: F.struct((words(c["source"]) + words(c["claim"])).alias("n"), c["source"].alias("source"), c["claim"].alias("claim")))
    return F.transform(F.array_sort(keyed), lambda c: F.struct(c["source"], c["claim"]))


def payloads(records: DataFrame, units: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, payload): what a reviewer is shown, as JSON: the record (id, record), its units (id, ord, text) in order, the verdict (id, verdict) if there is one."""
    lists = units.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("units"))
    rows = records.join(lists, "id", "left").join(verdicts, "id", "left")
    empty = F.coalesce("units", F.array().cast(lists.schema["units"].dataType))
    return rows.select("id", F.to_json(F.struct("id", "record", empty.alias("units"), F.coalesce("verdict", F.lit("")).alias("verdict"))).alias("payload"))
