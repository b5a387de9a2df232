"""Text of crawled pages as column expressions: bodies among page furniture, property tables, quirks, paragraphs, articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How many labels of a property table a body without articles has to show to be one.
TABLE_LABELS = 4
#: Letters that number points.
POINT_LETTERS = "abcdeghiklmnopqrstuvxyđ"


def stripped(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def stripped_lines(text: Column) -> Column:
    """The lines of a text, each without white space at its ends."""
    return F.transform(F.split(text, "\n", -1), stripped)


def property_table(lines: Column, labels: Sequence[str], article: str) -> Column:
    """Whether lines are a property table: enough of its labels, and no line that begins an article."""
    known = F.array_intersect(lines, F.array(*map(F.lit, labels)))
    return (F.size(known) >= TABLE_LABELS) & ~F.exists(lines, lambda x: x.rlike(article))


def page_body(text: Column, tab: str, noise: Sequence[str], labels: Sequence[str], article: str) -> Column:
    """The lines after the last `tab` line, without blank ones and page furniture; '' where they are but a property table."""
    lines = stripped_lines(text)
    after = F.size(lines) - F.array_position(F.reverse(lines), tab).cast("int") + 1
    body = F.when(F.array_contains(lines, tab), F.slice(lines, after + 1, F.size(lines))).otherwise(lines)
    body = F.filter(body, lambda x: (x != "") & ~x.isin(*noise))
    return F.when(property_table(body, labels, article), "").otherwise(F.array_join(body, "\n"))


def quirks(title: Column) -> Column:
    """What is odd in a title's number: blanks beside its dash, Cyrillic letters."""
    return F.array_compact(F.array(F.when(title.rlike(r"/\p{L}+(?:\s+-|-\s+)\p{L}"), "spaced dash"), F.when(title.rlike(r"\p{IsCyrillic}"), "cyrillic")))


def paragraphs(html: Column) -> Column:
    """The parts of inline HTML between line breaks, trimmed; empty ones are dropped."""
    return F.filter(F.transform(F.split(html, r"(?i)<br\s*/?>", -1), stripped), lambda x: x != "")


def prefix_level(paragraph: Column) -> Column:
    """(level, no) of a paragraph by the numbering it begins with, behind opening quotes: '4. ' is a clause, 'a) ' a point; else nulls."""
    plain = F.regexp_replace(paragraph, "^[“”\"'\\s]+", "")
    clause, point = F.regexp_extract(plain, rf"^(\d+[{POINT_LETTERS}]?)\.\s", 1), F.regexp_extract(plain, rf"^([{POINT_LETTERS}])\)\s", 1)
    level = F.when(clause != "", "clause").when(point != "", "point")
    return F.struct(level.alias("level"), F.when(clause != "", clause).when(point != "", point).alias("no"))


def article_text(text: Column, number: Column, word: str = "Điều") -> Column:
    """One article of a clean text, from its line to the next article's; null where there is none."""
    pattern = F.concat(F.lit(f"(?ms)^{word} "), number, F.lit(rf"(?![0-9a-zđ]).*?(?=^{word} [0-9]|\z)"))
    return stripped(F.regexp_substr(text, pattern))


def head_text(text: Column, number: str, article: str, most: int = 5000, lines_most: int = 5) -> Column:
    """What names a document: its lines before the first article, and its first lines that hold an official number. The limits are the feature."""
    lines = stripped_lines(text)
    first = F.array_position(F.transform(lines, lambda x: x.rlike(article)), True).cast("int")
    head = F.left(F.array_join(F.when(first > 0, F.slice(lines, 1, first - 1)).otherwise(lines), "\n"), F.lit(most))
    named = F.slice(F.filter(lines, lambda x: x.rlike(number)), 1, lines_most)
    return F.when(F.size(named) > 0, F.concat(head, F.lit("\n---\n"), F.array_join(named, "\n"))).otherwise(head)
