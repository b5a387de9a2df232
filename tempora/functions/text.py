"""Text functions as column expressions: folding, tokens, official numbers, markers, HTML. No Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Vietnamese letters by base letter. đ has no base: it is a letter of its own.
_VOWELS = {"a": "àáảãạăằắẳẵặâầấẩẫậ", "e": "èéẻẽẹêềếểễệ", "i": "ìíỉĩị", "o": "òóỏõọôồốổỗộơờớởỡợ", "u": "ùúủũụưừứửữự", "y": "ỳýỷỹỵ"}
_MARKED = "".join(_VOWELS.values())
_PLAIN = "".join(base * len(marked) for base, marked in _VOWELS.items())
#: Cyrillic and Greek capitals that look like Latin ones, and these.
LOOKALIKES, LATIN = "АВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEKMHOPCTXIJSABEZHIKMNOPTYX"
#: Groups of deontic markers.
MARKERS = {
    "obligation": ("phải", "có trách nhiệm", "có nghĩa vụ", "must", "shall"),
    "permission": ("được", "được phép", "có quyền", "may"),
    "prohibition": ("không được", "nghiêm cấm", "cấm", "must not", "shall not"),
    "condition": ("nếu", "trường hợp", "trừ trường hợp", "if", "unless"),
}
#: Verbs that begin an amending command, in the order in which they are tried.
COMMANDS = (("bai_bo", r"(?iu)^\s*bãi bỏ"), ("thay_the", r"(?iu)^\s*thay thế"), ("sua_doi_bo_sung", r"(?iu)^\s*sửa đổi, bổ sung"), ("bo_sung", r"(?iu)^\s*bổ sung"), ("sua_doi", r"(?iu)^\s*sửa đổi"))


def fold_keep_d(s: Column) -> Column:
    """Lower case without accents; đ stays."""
    return F.translate(F.lower(s), _MARKED, _PLAIN)


def fold_all(s: Column) -> Column:
    """Lower case without accents; đ becomes d, as the text index folds it."""
    return F.translate(fold_keep_d(s), "đ", "d")


def ascii_key(s: Column) -> Column:
    """Capitals and digits only, for building ids."""
    return F.regexp_replace(F.upper(fold_all(s)), r"[^A-Z0-9]", "")


def latin_capitals(s: Column) -> Column:
    """Capitals that look Latin, made Latin."""
    return F.translate(s, LOOKALIKES, LATIN)


def collapse(s: Column) -> Column:
    """Lower case with white space collapsed and trimmed: equal results count as the same text."""
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def tokens(s: Column) -> Column:
    """The runs of letters and digits, lower-cased: no stemming, no stop words."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), 0)


def official_number(s: Column) -> Column:
    """The canonical official number in a text, or null: n/yyyy/TYPE-AGENCY or n/yyyy/QHn; spaces dropped, capitals repaired."""
    clean = latin_capitals(F.regexp_replace(s, r"\s+", ""))
    found = F.regexp_extract(clean, r"(?iu)^(\d+[A-Za-z]?/(?:(?:19|20)\d{2}/)?(?:QH\d+|[\p{L}]+(?:-[\p{L}]+)+))$", 1)
    return F.when(found != "", F.regexp_replace(F.upper(found), r"^0+(\d)", "$1"))


def number_parts(number: Column) -> Column:
    """(no, year, kind, agency) of a canonical number; the year may be empty."""
    get = lambda n: F.regexp_extract(number, r"^([^/]+)/(?:(\d{4})/)?(?:(QH)\d+|([^-/]+)-(.+))$", n)
    return F.struct(get(1).alias("no"), get(2).alias("year"), F.when(get(3) != "", get(3)).otherwise(get(4)).alias("kind"), get(5).alias("agency"))


def doc_id_of(number: Column) -> Column:
    """A document id from a canonical number: TYPE + no - year (or agency without a year); acts of the assembly are L + no - year."""
    p = number_parts(number)
    tail = F.when(p["year"] != "", p["year"]).otherwise(p["agency"])
    kind = F.when(p["kind"] == "QH", "L").otherwise(ascii_key(p["kind"]))
    return F.when(number.isNotNull(), F.concat(kind, p["no"], F.lit("-"), tail))


def marker_groups(s: Column) -> Column:
    """The groups whose markers stand in a text as whole words, sorted; longer markers shadow the shorter in them."""
    rest, out = F.lower(s), []
    for group in ("prohibition", "obligation", "permission", "condition"):
        words = "|".join(sorted(MARKERS[group], key=len, reverse=True))
        pattern = rf"(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])"
        out.append(F.when(rest.rlike(pattern), group))
        rest = F.regexp_replace(rest, pattern, " ")
    return F.array_sort(F.array_compact(F.array(*out)))


def number_tokens(s: Column) -> Column:
    """Numbers as written, thousands points dropped and decimal commas made points."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"(\d+(?:[.,]\d+)*)"), 1), lambda x: F.replace(F.regexp_replace(x, r"\.(?=\d{3}(?:\D|$))", ""), F.lit(","), F.lit(".")))


def command_verb(s: Column) -> Column:
    """The operation that a command begins with, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(COMMANDS):
        out = F.when(s.rlike(pattern), name).otherwise(out)
    return out


def strip_tags(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags gone, the common entities decoded, white space collapsed."""
    s = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def links(html: Column) -> Column:
    """The targets of links, in order."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)


def slug_title(url: Column, most: int = 80) -> Column:
    """A readable title from the last part of a URL: id suffix dropped, hyphens as spaces, cut."""
    last = F.regexp_extract(url, r"([^/?#]*)/?(?:[?#].*)?$", 1)
    return F.left(F.trim(F.replace(F.regexp_replace(last, r"(--\d+|\.html?)$", ""), F.lit("-"), F.lit(" "))), F.lit(most))


def shouted(line: Column) -> Column:
    """Whether a line has letters and all are capitals."""
    return (line == F.upper(line)) & line.rlike(r"\p{L}")


def same_length_mask(s: Column, pattern: str) -> Column:
    """s with what follows the first match blanked out, at the same length, so that offsets stay."""
    at = F.regexp_instr(s, F.lit(pattern))
    return F.when(at > 0, F.rpad(F.left(s, at - 1), F.char_length(s), " ")).otherwise(s)
