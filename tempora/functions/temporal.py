"""Dates that are kept as ISO text, and validity intervals over them. Empty or unreadable bounds are open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """A date from yyyy-MM-dd, or null; no other shape is read, so 2024-7-1 and 2024 are null."""
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(trimmed, "yyyy-MM-dd"))


def day_first(text: Column) -> Column:
    """dd/mm/yyyy as yyyy-mm-dd text; only the shape is checked, other text is null."""
    part = lambda n: F.regexp_extract(text, r"\A\s*(\d{2})/(\d{2})/(\d{4})\s*\z", n)
    return F.when(part(3) != "", F.concat_ws("-", part(3), part(2), part(1)))


def day_before(text: Column) -> Column:
    """The day before an ISO date, as ISO text."""
    return F.date_format(F.date_sub(parse_date(text), 1), "yyyy-MM-dd")


def effective(valid_from: Column, valid_to: Column, superseded: Column, as_of: Column | str, interval: str = "closed") -> Column:
    """Whether a validity holds on a day: not superseded, begun and not over.

    interval 'closed' counts the last day, 'half_open' doesn't. Bounds are dates, or text read by `parse_date`.
    """
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    begun = F.coalesce(valid_from <= day, F.lit(True))
    over = valid_to < day if interval == "closed" else valid_to <= day
    return ~F.coalesce(superseded, F.lit(False)) & begun & ~F.coalesce(over, F.lit(False))


def inherited(own: Column, parent: Column) -> Column:
    """The own bound, or the parent's where it is null or empty."""
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(parent, F.lit("")))


def status(valid_from: Column, valid_to: Column, superseded: Column, as_of: Column | str) -> Column:
    """Two states: what isn't effective, also what hasn't begun, is expired."""
    return F.when(effective(valid_from, valid_to, superseded, as_of), "effective").otherwise("expired")
