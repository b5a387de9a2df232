"""Wording: what a claim adds to the text it cites, loses from it or turns round in it, and which of that other texts bear out.

Markers and numbers are counted within the row, as runs of sorted tokens; nothing is shuffled. Only the alignment of two
word sequences is Python, in Arrow batches. A null text is an empty one; repeated rows are judged alike.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Deontic markers by group.
LEXICON = {
    "obligation": ("phải", "có trách nhiệm", "có nghĩa vụ", "buộc phải", "bắt buộc"),
    "prohibition": ("không được phép", "không được", "nghiêm cấm", "cấm"),
    "permission": ("được phép", "có quyền", "được"),
    "condition": ("trong trường hợp", "với điều kiện", "trừ trường hợp", "khi", "nếu"),
    "quantity": ("tối thiểu", "tối đa", "ít nhất", "nhiều nhất", "không quá", "chậm nhất", "trong thời hạn", "trở lên", "trở xuống"),
}
#: Groups that a claim may not bring in, and the most words of a replaced run that can be a marker turned round.
HARD, TURN_WORDS = ("obligation", "prohibition"), 6
#: Words by which a text points at its own unit.
SELF = {"article": "Điều", "clause": "khoản"}
_LETTER = r"\p{L}\p{N}_À-ỹ"


def _whole(words: Iterable[str]) -> str:
    """A pattern of words that stand whole, the longest first; the letters they begin with are looked at before all else."""
    return rf"(?=[{''.join(sorted({w[0] for w in words}))}])(?<![{_LETTER}])({'|'.join(sorted(words, key=len, reverse=True))})(?![{_LETTER}])"


_AT = _whole([m for group in LEXICON.values() for m in group])
# No other marker holds a hard one within, so these can be looked for on their own.
_HARD_AT = _whole([m for group in HARD for m in LEXICON[group]])
_EDITS = ArrayType(StructType([StructField("at", IntegerType()), *(StructField(c, StringType()) for c in ("kind", "source", "claim"))]))


def markers(text: Column) -> Column:
    """The markers of a text in order, as whole words; where several fit, the longest."""
    return F.regexp_extract_all(F.lower(text), F.lit(_AT), 1)


def group_of(marker: Column) -> Column:
    """The group of a marker; null for other words."""
    out = F.lit(None).cast("string")
    for group, words in LEXICON.items():
        out = F.when(marker.isin(*words), group).otherwise(out)
    return out


def groups(text: Column) -> Column:
    """The groups of a text's markers, sorted."""
    return F.array_sort(F.array_distinct(F.transform(markers(text), group_of)))


def plain_number(digits: Column) -> Column:
    """Digits without points, commas and leading zeros."""
    kept = F.ltrim(F.translate(digits, ".,", ""), F.lit("0"))
    return F.when(kept == "", "0").otherwise(kept)


def plain_numbers(text: Column) -> Column:
    """All numbers of a text in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)*"), 0), plain_number)


def loose_duties(claim: Column, source: Column) -> Column:
    """Hard markers of a claim, each with the word or sign after it, that the source doesn't hold in that company; both in lower case."""
    ahead = rf"{_HARD_AT}(?=\s*([{_LETTER}]+|[^\s{_LETTER}])?)"
    part = lambda n: F.regexp_extract_all(claim, F.lit(ahead), n)
    said = F.zip_with(part(1), part(2), lambda marker, after: F.rtrim(F.concat(marker, F.lit(" "), after)))
    return F.filter(said, lambda p: ~F.contains(source, p))


def spelled_out(claim: Column, source: Column, unit: dict[str, Column]) -> Column:
    """Numbers of the unit itself that a claim spells out right after the word for which its source says 'this one'."""
    out = []
    for level, number in unit.items():
        word = SELF[level]
        cited = F.transform(F.regexp_extract_all(claim, F.lit(rf"(?iu){word}\s+(\d+)"), 1), plain_number)
        own = (number > 0) & source.rlike(rf"(?iu){word}\s+này") & F.array_contains(cited, number.cast("string"))
        out.append(F.when(own, number.cast("string")))
    return F.array_compact(F.array(*out))


def token_runs(pairs: DataFrame, id_: str) -> DataFrame:
    """(id, runs): for each pair the markers and numbers of its texts, sorted, with how often each text holds them.

    runs: array of (kind, token, claim, source, evidence, unit). unit counts numbers that only spell out the unit; kind
    'loose' are the claim's hard markers in new company. All within the row: tokens are sorted, and runs of equal ones are
    measured by where the next begins, so that nothing is shuffled and long texts cost what they hold.
    """
    sides = ("claim", "source", "evidence")
    rows = lambda side, kind, found: F.transform(found, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token"), F.lit(side).alias("side")))
    unit = {level: F.coalesce(F.col(level), F.lit(0)) for level in SELF}
    whole = pairs.select(id_, *unit.keys(), *(F.coalesce(F.col(s), F.lit("")).alias(s) for s in sides))
    # Lower case and the claim's markers are columns of their own, as several expressions read them.
    low = whole.select("*", *(F.lower(s).alias(f"__{s}") for s in sides)).withColumn("__markers", F.regexp_extract_all("__claim", F.lit(_AT), 1))
    marked = {"claim": F.col("__markers")} | {s: F.regexp_extract_all(f"__{s}", F.lit(_AT), 1) for s in sides[1:]}
    hard = F.exists("__markers", lambda m: group_of(m).isin(*HARD))
    parts = [rows(s, "marker", marked[s]) for s in sides] + [rows(s, "number", plain_numbers(F.col(s))) for s in sides]
    parts.append(rows("claim", "loose", F.when(hard, loose_duties(F.col("__claim"), F.col("__source"))).otherwise(F.array().cast("array<string>"))))
    parts.append(rows("unit", "number", spelled_out(F.col("claim"), F.col("source"), unit)))
    tokens = low.select(id_, F.array_sort(F.concat(*parts)).alias("__tokens"))
    at = lambda i: F.get("__tokens", i)
    new = lambda i: (i == 0) | (at(i)["token"] != at(i - 1)["token"]) | (at(i)["kind"] != at(i - 1)["kind"])
    # A sequence can't be empty: the one that ends where it begins stands for no tokens and is filtered out.
    starts = tokens.withColumn("__starts", F.filter(F.sequence(F.lit(0), F.size("__tokens")), lambda i: (i < F.size("__tokens")) & new(i)))
    ends = F.concat(F.slice("__starts", F.lit(2), F.size("__starts")), F.array(F.size("__tokens")))

    def run(start: Column, end: Column) -> Column:
        count = lambda side: F.size(F.filter(F.slice("__tokens", start + 1, end - start), lambda t: t["side"] == side))
        return F.when(start.isNotNull(), F.struct(at(start)["kind"].alias("kind"), at(start)["token"].alias("token"), *(count(s).alias(s) for s in (*sides, "unit"))))

    return starts.select(id_, F.array_compact(F.zip_with("__starts", ends, run)).alias("runs"))


def wording_deltas(pairs: DataFrame, id_: str) -> DataFrame:
    """One row for each pair (id, claim, source, evidence, article, clause) of a claim and the span it cites.

    added, lost: 'group:marker' that the claim has more often, or less often, than its source. invented: hard groups, and
    numbers: those, that neither source nor evidence bears out. A number that spells out 'this article' is no invention.
    turned_duty: a condition was lost and a duty stands in new company; wider evidence doesn't excuse that. notes: what was
    excused, as 'group:<g>:evidence', 'number:<n>:evidence' or 'number:<n>:unit'; where both would do, the unit is named.
    """
    marker = lambda r: r["kind"] == "marker"
    number = lambda r: (r["kind"] == "number") & (r["claim"] > r["source"])
    named = lambda r: F.concat_ws(":", group_of(r["token"]), r["token"])
    take = lambda holds, value: F.array_sort(F.transform(F.filter("runs", holds), value))
    held = lambda side: F.array_distinct(take(lambda r: marker(r) & (r[side] > 0), lambda r: group_of(r["token"])))
    excuse = lambda by: lambda r: F.concat(F.lit("number:"), r["token"], F.lit(f":{by}"))
    by_unit, by_evidence = (lambda r: r["unit"] > 0), (lambda r: r["claim"] <= r["evidence"])
    sets = token_runs(pairs, id_).select(
        id_, take(lambda r: marker(r) & (r["claim"] > r["source"]), named).alias("added"), take(lambda r: marker(r) & (r["claim"] < r["source"]), named).alias("lost"),
        *(held(side).alias(f"__{side}") for side in ("claim", "source", "evidence")),
        take(lambda r: number(r) & ~by_unit(r) & ~by_evidence(r), lambda r: r["token"]).alias("numbers"),
        take(lambda r: number(r) & by_unit(r), excuse("unit")).alias("__unit"), take(lambda r: number(r) & ~by_unit(r) & by_evidence(r), excuse("evidence")).alias("__wide"),
        F.exists("runs", lambda r: r["kind"] == "loose").alias("__loose"),
    )
    brought = F.array_intersect(F.array_except("__claim", "__source"), F.array(*map(F.lit, HARD)))
    excused = F.transform(F.array_intersect(brought, F.col("__evidence")), lambda g: F.concat(F.lit("group:"), g, F.lit(":evidence")))
    lost_condition = F.exists("lost", lambda m: F.startswith(m, F.lit("condition:")))
    return sets.select(
        id_, "added", "lost", F.array_except(brought, F.col("__evidence")).alias("invented"), "numbers",
        (F.col("__loose") & lost_condition & ~F.array_contains("__claim", "condition")).alias("turned_duty"),
        F.concat(excused, "__wide", "__unit").alias("notes"),
    )


_WORD = re.compile(r"[\wÀ-ỹ]+|[^\s\wÀ-ỹ]")


@F.pandas_udf(_EDITS)
def aligned_edits(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The edits that make a source a claim, over lower-cased words and signs: place in the source's words, kind, both runs."""
    for sources, claims in batches:
        out = []
        for source, claim in zip(sources, claims, strict=True):
            old, new = (_WORD.findall((text or "").lower()) for text in (source, claim))
            steps = difflib.SequenceMatcher(None, old, new).get_opcodes()
            out.append([{"at": i, "kind": kind, "source": " ".join(old[i:j]), "claim": " ".join(new[k:m])} for kind, i, j, k, m in steps if kind != "equal"])
        yield pd.Series(out)


def judged_edits(pairs: DataFrame, id_: str) -> DataFrame:
    """(id, at, kind, source, claim, turned, borne): a row for each edit between a pair's source and claim.

    turned: a replaced run of at most TURN_WORDS words whose marker groups, some on both sides, differ. borne: whether the
    claim's run stands word for word in the pair's evidence; a deletion claims nothing and is borne out.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("evidence", F.lit(""))), F.lit(rf"[{_LETTER}]+|[^\s{_LETTER}]"), 0)
    there = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    rows = pairs.select(id_, there.alias("__there"), aligned_edits("source", "claim").alias("__edits"))
    borne = lambda e: F.contains(F.col("__there"), F.concat(F.lit(" "), e["claim"], F.lit(" ")))
    told = F.transform("__edits", lambda e: F.struct(e["at"].alias("at"), e["kind"].alias("kind"), e["source"].alias("source"), e["claim"].alias("claim"), ((e["kind"] == "delete") | borne(e)).alias("borne")))
    edits = rows.select(id_, F.explode(told).alias("e")).select(id_, "e.*")
    length = lambda c: F.size(F.split(c, " "))
    short = (F.col("kind") == "replace") & (F.greatest(length(F.col("source")), length(F.col("claim"))) <= TURN_WORDS)
    old, new = groups(F.col("source")), groups(F.col("claim"))
    return edits.select(id_, "at", "kind", "source", "claim", (short & (F.size(old) > 0) & (F.size(new) > 0) & (old != new)).alias("turned"), "borne")


def explained(edits: Column, most: int = 4) -> Column:
    """The first edits in words: 'a → b', '- a' for what is gone, '+ b' for what is new; '…' stands for further ones."""
    said = F.transform(F.slice(edits, 1, most), lambda e: F.when(e["kind"] == "replace", F.concat_ws(" → ", e["source"], e["claim"])).when(e["kind"] == "delete", F.concat(F.lit("- "), e["source"])).otherwise(F.concat(F.lit("+ "), e["claim"])))
    return F.array_join(F.concat(said, F.when(F.size(edits) > most, F.array(F.lit("…"))).otherwise(F.array().cast("array<string>"))), "; ")
