"""Names and labels as column expressions: headings, badges, numbers in slugs, document types, impacts, aliases, traps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def picked(value: Column, names: dict[str, str], other: Column) -> Column:
    """The name of a value, whatever its case and blanks; other where there is none."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in (pair[0].lower(), pair[1])))
    return F.coalesce(table[F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))], other)


def spelled(value: Column, vocabulary: Sequence[str]) -> Column:
    """A code as the vocabulary spells it, or as it is."""
    return picked(value, {v: v for v in vocabulary}, value)


def badge(value: Column, kinds: dict[str, str]) -> Column:
    """The kind of a badge; one that isn't known is 'khac:' and its text."""
    return picked(value, kinds, F.concat(F.lit("khac:"), value))


def heading(label: Column, line: Column) -> Column:
    """What follows a label, a dot or colon and blanks in a line, else the line."""
    plain = F.trim(line)
    rest = F.substr(plain, F.char_length(label) + 1)
    return F.when(F.startswith(plain, label), F.trim(F.regexp_replace(rest, r"^\s*[.:]\s*", ""))).otherwise(plain)


def first_number(text: Column, pattern: str) -> Column:
    """The first part of a text that has the form of a number."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0))


def slug_number(slug: Column) -> Column:
    """A number from a slug: what follows the last '--' goes first, then capitals, no blanks, Đ as D."""
    return F.translate(F.upper(F.regexp_replace(F.regexp_replace(slug, r"--[^-]*$", ""), r"\s+", "")), "Đ", "D")


def article_name(text: Column) -> Column:
    """'Dieu 11' and 'điều 11' as 'Điều 11'; other text stays."""
    n = F.regexp_extract(text, r"(?iu)^\s*(?:điều|dieu)\s+(\d+[a-zđ]?)\s*$", 1)
    return F.when(n != "", F.concat(F.lit("Điều "), n)).otherwise(text)


def split_label(text: Column) -> Column:
    """(doc, article) of 'doc_article', cut at the last underscore; null unless the article is a number."""
    ok = text.rlike(r"^.+_\d+[a-z]?$")
    return F.when(ok, F.struct(F.regexp_extract(text, r"^(.+)_\d+[a-z]?$", 1).alias("doc"), F.regexp_extract(text, r"_(\d+[a-z]?)$", 1).alias("article")))


def alias_of(text: Column) -> Column:
    """What a text says it will be called from there on, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?iu)\((?:sau đây gọi(?: tắt)?(?: là)?|hereinafter(?: referred to as)?)\s*:?\s*([^()]+)\)", 1)), F.lit(""))


def masked(text: Column, traps: Sequence[str]) -> Column:
    """The text with fixed phrases blanked at the same length, so that offsets stay and they are no markers."""
    out = text
    for trap in traps:
        out = F.regexp_replace(out, f"(?iu){trap}", " " * len(trap))
    return out


def logic(lead: Column) -> Column:
    """Whether a lead-in asks for all of its points, any of them, or doesn't say."""
    return F.when(lead.rlike(r"(?iu)một trong|any of|either"), "any").when(lead.rlike(r"(?iu)đồng thời|tất cả|đáp ứng đủ|all of|each of"), "all").otherwise("unknown")


def conjunction(guards: Column) -> Column:
    """The guards on a path joined, without those that are null; null where none is left."""
    some = F.array_compact(guards)
    return F.when(F.size(some) > 0, F.array_join(some, " AND "))


def impact(status: Column, op: Column) -> Column:
    """How an impact is shown."""
    return F.when(status == "repealed", "Bãi bỏ").when(op == "bo_sung", "Bổ sung").when(op == "thay_the", "Thay thế").when(status == "amended", "Sửa đổi").otherwise("Nguyên văn")


def same_vector(a: Column, b: Column, most: float = 1e-6) -> Column:
    """Whether no component differs by that much; vectors of other lengths differ."""
    gap = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return F.coalesce((F.size(a) == F.size(b)) & (gap < most), F.lit(False))


def lenient_json(text: Column, schema: str, raw: str = "_raw") -> Column:
    """Parsed JSON, beside the raw text where it can't be read; the schema gets a field for it."""
    kind = f"struct<{schema},{raw}:string>"
    return F.from_json(text, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": raw})


def embedding_text(title: Column, article: Column, text: Column) -> Column:
    """What of a unit is embedded: title — article: text."""
    return F.concat(title, F.lit(" — "), article, F.lit(": "), text)
