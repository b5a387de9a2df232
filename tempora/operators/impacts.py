"""What amending articles do to other documents: one edge for each unit that a command names, and what can't be told.

An article's clauses are its commands; an article without clauses is one command. Where commands begin and end, which
quotations lie in them, which are cut by their borders and what they cite is read where the text is, in Arrow batches; nothing
is shuffled. Of texts and commands that are equal, a batch reads one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from tempora.functions.citations import citations, node_keys
from tempora.operators.amendments import base_number
from tempora.operators.quotes import CLAUSE
from tempora.operators.segments import lines_of, quote_mask, quote_spans

#: How commands begin, in the order in which they are tried, and the operation of each.
OPERATIONS = (
    ("thay_cum_tu", r"thay\s*thế\s+cụm\s+từ"),
    ("thay_phu_luc", r"thay\s*thế\s+(một\s+số\s+)?phụ\s+lục"),
    ("bai_bo", r"bãi\s+bỏ"),
    ("sua_doi", r"sửa\s+đổi"),
    ("bo_sung", r"bổ\s+sung"),
)
#: Operations that need a new wording; lines from which on a document only lists recipients and signatures.
WORDED = ("sua_doi", "bo_sung")
CLOSING = r"(?m)^[ \t]*(?:Nơi nhận\s*:|TM\.\s|KT\.\s)"
_NUMBER, _LABEL = r"(?U)^\s*\d{1,3}\S?\s*\.\s*", r"(?U)^\s*Điều\s+\d+[a-zđ]?\s*[.:]?\s*"


#: White space as Java's patterns know it, with Unicode and without, and how lines begin that start a clause (operators.quotes.CLAUSE).
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_S, _ASCII = f"[{_WHITE}]", "[ \t\n\x0b\f\r]"


def _python(pattern: str) -> re.Pattern:
    """A pattern that is written for Java with (?U), for Python."""
    flags = re.IGNORECASE if pattern.startswith("(?iuU)") else 0
    body = re.sub(r"^\(\?\w+\)", "", pattern).replace(r"\s", _S).replace(r"\S", f"[^{_WHITE}]")
    return re.compile(body, flags)


_CLAUSE, _NUMBERED, _LABELLED = (_python(p) for p in (CLAUSE, _NUMBER, _LABEL))
_VERBS = [(name, _python(rf"(?iuU)^\s*{pattern}")) for name, pattern in OPERATIONS]
_CLOSED = re.compile(rf"(?:\A|(?<=[\n\r\x85\u2028\u2029]))[ \t]*(?:Nơi nhận{_ASCII}*:|TM\.{_ASCII}|KT\.{_ASCII})")
#: Stands for the document's own number until each row puts its own; texts that a worker remembers.
_OWN, HELD = "\u0001", 1 << 14
_SPANS = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())]))
_COMMANDS = ArrayType(StructType([*(StructField(n, StringType()) for n in ("unit", "op", "command", "shown", "title")), StructField("start", IntegerType()), StructField("spans", _SPANS), StructField("cut", _SPANS), StructField("named", ArrayType(StringType()))]))


def _verb(command: str) -> str | None:
    return next((name for name, pattern in _VERBS if pattern.match(command)), None)


@lru_cache(HELD)
def _read(text: str) -> list[dict]:
    """The commands of a text: its clauses outside quotations, or all of it, with the quotations in them and those that their borders cut."""
    mask, quotes = (quote_mask(text), quote_spans(text)) if any(c in text for c in "“”\"") else ([], [])
    marks = [(at, f"khoan_{m[1]}") for at, line in lines_of(text) if (m := _CLAUSE.match(line)) and not (at < len(mask) and mask[at])] or [(0, None)]
    title = _LABELLED.sub("", text.split("\n", 1)[0], count=1)
    pairs = lambda of: [{"a": a, "b": b} for a, b in of]
    out = []
    for (start, unit), end in zip(marks, [*(at for at, _ in marks[1:]), len(text)]):
        skipped = (_NUMBERED if unit else _LABELLED).match(text[start:end])
        begin = start + (skipped.end() if skipped else 0)
        command = text[begin:end]
        if not (op := _verb(command)):
            continue
        near = quotes[bisect_left(quotes, start + 1, key=lambda q: q[1]) : bisect_left(quotes, end, key=lambda q: q[0])]
        spans = [q for q in near if q[0] >= start and q[1] <= end]
        named = _named(command, [(max(a - begin, 0), max(b - begin, 0)) for a, b in spans], title, _OWN)
        out.append({"unit": unit, "op": op, "command": command, "shown": _CLOSED.split(command, maxsplit=1)[0].strip(_WHITE), "title": title, "start": begin, "spans": pairs(spans), "cut": pairs(q for q in near if q not in spans), "named": named})
    return out


@lru_cache(HELD)
def _commands_something(text: str) -> bool:
    lines = text.split("\n", 2)
    return any(_verb(_NUMBERED.sub("", line, count=1)) for line in (_LABELLED.sub("", lines[0], count=1), *lines[1:2]))


@F.arrow_udf(_COMMANDS)
def _commands(text: pa.Array) -> pa.Array:
    codes = text.dictionary_encode()
    return pa.array([_read(t) for t in codes.dictionary.to_pylist()], to_arrow_type(_COMMANDS)).take(codes.indices)


@F.arrow_udf(BooleanType())
def _amends(text: pa.Array) -> pa.Array:
    codes = text.dictionary_encode()
    return pa.array([_commands_something(t) for t in codes.dictionary.to_pylist()], pa.bool_()).take(codes.indices)


def _named(command: str, quoted: list[tuple[int, int]], title: str, base: str | None) -> list[str]:
    """The keys that a command names outside its quotations and before the closing block, seen from its article's title."""
    parts, at = [], 0
    for a, b in quoted:
        parts.append(command[at : max(a, at)])
        at = max(at, b)
    said = re.split(CLOSING, "\u0000".join([*parts, command[at:]]), maxsplit=1)[0]
    article = next((c.articles[0] for c in citations(title) if c.articles and not c.number), None)
    keys = (key for c in citations(said) for key in node_keys(c, base_number(title, base), article, None))
    return list(dict.fromkeys(keys))


def commands(articles: DataFrame) -> DataFrame:
    """(key, source_key, op, command, shown, command_start, title, base, valid_from, spans, cut, targets) of the commands of articles.

    articles: key, text, source_key, base, valid_from. A text starts with its label and title, `Điều N. Title`. spans are the
    quotations [a, b) that lie in the command, in order; cut, those that its borders cut; shown, the command up to the closing
    block; targets, the keys that it names. Positions are code points of the article's text. What doesn't begin with a verb
    isn't a command. Null texts have none.
    """
    own = ["key", "source_key", "base", "valid_from"]
    rows = articles.where("text IS NOT NULL").select(*own, F.explode(_commands("text")).alias("u"))
    source = F.when(F.col("u.unit").isNull(), F.col("source_key")).otherwise(F.concat("source_key", F.lit("#"), "u.unit"))
    # What a command cites doesn't hang on its document's number, which is put in here; without one, nothing is meant by it.
    mine = F.when(F.col("base") != "", F.transform("u.named", lambda k: F.when(k.startswith(_OWN), F.concat("base", F.substring(k, 2, (1 << 31) - 1))).otherwise(k)))
    targets = F.array_distinct(F.coalesce(mine, F.filter("u.named", lambda k: ~k.startswith(_OWN))))
    return rows.select("key", source.alias("source_key"), "u.op", "u.command", "u.shown", F.col("u.start").alias("command_start"), "u.title", "base", "valid_from", "u.spans", "u.cut", targets.alias("targets"))


def impact_edges(articles: DataFrame) -> DataFrame:
    """(key, source_key, target_key, op, span_start, span_end, valid_from, command, warnings): an edge for each target of a command.

    A target is named once for each command. The new wording is [span_start, span_end), from the first quotation in the command
    to the last. Warnings: `cut`, a quotation crosses the command's border and isn't counted; `gap`, there are several that
    don't touch; `unworded`, a change or addition without any; `no_target`, nothing that the command cites could be told:
    then there is one row without a target. Articles as for `commands`.
    """
    rows, spans = commands(articles), F.col("spans")
    apart = F.exists(F.sequence(F.lit(1), F.size(spans) - 1), lambda i: F.get(spans, i - 1)["b"] != F.get(spans, i)["a"])
    told = F.array(
        F.when(F.size("cut") > 0, "cut"),
        F.when(F.size(spans) > 1, F.when(apart, "gap")),
        F.when((F.size(spans) == 0) & F.col("op").isin(*WORDED), "unworded"),
        F.when(F.size("targets") == 0, "no_target"),
    )
    return rows.select("key", "source_key", F.explode_outer("targets").alias("target_key"), "op", F.get(spans, F.lit(0))["a"].alias("span_start"), F.element_at(F.when(F.size(spans) > 0, spans), -1)["b"].alias("span_end"), "valid_from", F.col("shown").alias("command"), F.array_compact(told).alias("warnings"))


def amending_documents(articles: DataFrame, document: str) -> DataFrame:
    """The documents one of whose articles commands something in the first line of its body, title or text, each once."""
    return articles.where("text IS NOT NULL").where(_amends("text")).select(document).distinct()


def amending(articles: DataFrame, document: str) -> DataFrame:
    """All articles of amending documents. Where texts are made of other columns, those of amending_documents are cheaper to shuffle."""
    return articles.join(amending_documents(articles, document), document, "left_semi")


def _place(key: Column) -> list[Column]:
    """The document, article, level and number of the innermost unit that a key names below the article."""
    part = lambda p: F.nullif(F.regexp_extract(key, p, 1), F.lit(""))
    clause, point = part(r"#khoan_([^#]+)"), part(r"#diem_([^#]+)$")
    level = F.when(point.isNotNull(), "diem").when(clause.isNotNull(), "khoan")
    return [F.substring_index(key, "#", 1).alias("base"), part(r"#than/dieu_([^#]+)").alias("article"), level.alias("level"), F.coalesce(point, clause).alias("number")]


def checked(edges: DataFrame, listed: DataFrame) -> DataFrame:
    """(side, base, article, level, number) where edges and a list of affected units (base, article, level, number) disagree.

    side `edge`: a target that the list doesn't have; `list`: a listed unit that no edge changes. A listed article covers all
    within it, and so does an edge to a whole article; below that, level and number must be equal. Level null: the article.
    """
    ours = edges.where("target_key IS NOT NULL").select(*_place(F.col("target_key"))).where("article IS NOT NULL")
    theirs = listed.where("article IS NOT NULL").select("base", "article", "level", "number")
    side = lambda rows, edge: rows.select("base", "article", F.struct("level", "number").alias("u"), F.lit(edge).alias("edge"))
    # The units of an article meet in one row: what a task has of them is put together before it is shuffled.
    both = side(ours, True).unionByName(side(theirs, False)).groupBy("base", "article").agg(F.collect_set(F.when(F.col("edge"), F.col("u"))).alias("edge"), F.collect_set(F.when(~F.col("edge"), F.col("u"))).alias("list"))
    whole, fine = (lambda u: u["level"].isNull()), (lambda u: u["level"].isNotNull())
    known = F.col("base").isNotNull()

    def missing(own: str, other: str) -> Column:
        rest = F.array_except(F.filter(own, fine), F.filter(other, lambda u: fine(u) & u["number"].isNotNull()))
        left = F.when(known, F.concat(F.when(F.size(other) == 0, F.filter(own, whole)).otherwise(F.filter(own, lambda u: F.lit(False))), F.when(F.exists(other, whole), F.filter(own, lambda u: F.lit(False))).otherwise(rest))).otherwise(F.col(own))
        return F.transform(left, lambda u: F.struct(F.lit(own).alias("side"), u["level"].alias("level"), u["number"].alias("number")))

    rows = both.select("base", "article", F.explode(F.concat(missing("edge", "list"), missing("list", "edge"))).alias("m"))
    return rows.select("m.side", "base", "article", "m.level", "m.number")
