"""Predicates over half-open spans and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether [a, b) and [c, d) share a position."""
    return (a < d) & (c < b)


def contains(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether [a, b) holds all of [c, d)."""
    return (a <= c) & (d <= b)


def relation(a: Column, b: Column, c: Column, d: Column) -> Column:
    """How [c, d) lies to [a, b): 'inside', 'partly' or 'outside'."""
    return F.when(contains(a, b, c, d), "inside").when(overlap(a, b, c, d), "partly").otherwise("outside")


def either_contains(a: Column, b: Column) -> Column:
    """Whether either text holds the other; null and empty texts hold nothing and lie in nothing."""
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def hull(spans: Column) -> Column:
    """(start, end) around all spans of an array, or null where one of them is null or there is none."""
    sound = (F.size(spans) > 0) & F.forall(spans, lambda s: s.isNotNull())
    return F.when(sound, F.struct(F.array_min(F.transform(spans, lambda s: s["start"])).alias("start"), F.array_max(F.transform(spans, lambda s: s["end"])).alias("end")))


def shown(text: Column) -> Column:
    """Text trimmed, or null where nothing is left: what a page shows."""
    return F.nullif(F.trim(text), F.lit(""))
