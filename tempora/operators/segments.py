"""Splitting long texts into addressable units with exact offsets: table functions over single documents.

Scans that carry a state from line to line (quotes, chapters, the current article) are table functions; each document
is one row, so they run inside the scan, without a shuffle. Every unit satisfies text[start:end] == unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tempora.operators import span_joins

ARTICLE = re.compile(r"^\s*Điều\s+(\d+[a-zđ]?)\s*[.:]?")
CHAPTER = re.compile(r"^\s*(Chương|CHƯƠNG)\s+([IVXLC\d]+)")
SECTION = re.compile(r"^\s*(Mục|MỤC)\s+(\d+)")
ENDING = re.compile(r"^\s*(Nơi nhận\s*:|PHỤ LỤC|Phụ lục\s+[IVXLC\d]+\s*$)")
CLAUSE = re.compile(r"^\s*(\d+[a-zđ]?)\.\s")
POINT = re.compile(r"^\s*([a-zđ])\)\s")
ROMAN, DASH = re.compile(r"^\s*(\([ivx]+\))\s"), re.compile(r"^\s*([-–+])\s")
#: Characters that a chunk may have.
CHUNK = 2000


def lines_of(text: str) -> Iterator[tuple[int, str]]:
    """(offset, line) of each line."""
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def quote_mask(text: str) -> list[bool]:
    """For each character, whether it is inside a quotation; all false where curly quotes don't balance or straight ones are odd."""
    mask, depth, straight = [False] * len(text), 0, False
    for i, ch in enumerate(text):
        if ch == "“":
            depth += 1
        mask[i] = depth > 0 or straight or ch == '"'
        if ch == "”":
            depth -= 1
            if depth < 0:
                return [False] * len(text)
        elif ch == '"':
            straight = not straight
    return mask if not depth and not straight else [False] * len(text)


def quote_spans(text: str) -> list[tuple[int, int]]:
    """[start, end) of quotations; one that isn't closed runs to the end."""
    out, depth, straight, begin = [], 0, False, -1
    for i, ch in enumerate(text):
        if ch == "“" or ch == '"' and not straight:
            if not depth and not straight:
                begin = i
            depth, straight = depth + (ch == "“"), straight or ch == '"'
        elif ch == "”" or ch == '"':
            depth, straight = max(0, depth - (ch == "”")), straight and ch != '"'
            if begin >= 0 and not depth and not straight:
                out.append((begin, i + 1))
                begin = -1
    return [*out, (begin, len(text))] if begin >= 0 else out


def articles(text: str) -> Iterator[tuple]:
    """(article, text, chapter, section, start, end): outside quotations, up to the recipients or annexes."""
    mask, chapter, section, open_at, label, where = quote_mask(text), None, None, -1, "", (None, None)

    def unit(end: int) -> tuple:
        body = text[open_at:end].rstrip()
        return label, body, *where, open_at, open_at + len(body)

    for at, line in lines_of(text):
        if at < len(mask) and mask[at]:
            continue
        found = ARTICLE.match(line)
        if (found or CHAPTER.match(line) or SECTION.match(line) or ENDING.match(line)) and open_at >= 0:
            yield unit(at)
            open_at = -1
        if ENDING.match(line):
            return
        if m := CHAPTER.match(line):
            chapter, section = f"Chương {m[2]}", None
        elif m := SECTION.match(line):
            section = f"Mục {m[2]}"
        elif found:
            open_at, label, where = at + len(line) - len(line.lstrip()), f"Điều {found[1]}", (chapter, section)
    if open_at >= 0:
        yield unit(len(text))


def units(text: str, key: str) -> Iterator[tuple]:
    """(key, kind, parent_key, start, end) of an article's clauses and points, outside quotations; without clauses, one virtual clause."""
    mask = quote_mask(text)
    marks = []
    for at, line in lines_of(text):
        if at < len(mask) and mask[at]:
            continue
        if m := CLAUSE.match(line):
            marks.append((at, "clause", m[1]))
        elif m := POINT.match(line):
            marks.append((at, "point", m[1]))
    if not any(kind == "clause" for _, kind, _ in marks):
        yield f"{key}#khoan_0", "virtual_clause", key, 0, len(text)
    clause = f"{key}#khoan_0"
    for i, (at, kind, name) in enumerate(marks):
        later = marks[i + 1 :]
        end = next((a for a, k, _ in later if kind == "point" or k == "clause"), len(text))
        if kind == "clause":
            clause = f"{key}#khoan_{name}"
            yield clause, kind, key, at, end
        else:
            yield f"{clause}#diem_{name}", kind, clause, at, end


def _pieces(text: str, most: int) -> Iterator[str]:
    """Text cut to size at the coarsest boundary that does: lines, sentences, spaces; a longer word stays whole."""
    for boundary in ("\n", r"(?<=[.;:])\s", r"\s"):
        parts = re.split(boundary, text)
        if len(parts) > 1 and (boundary == r"\s" or all(len(p) <= most for p in parts)):
            held = ""
            for part in parts:
                if held and len(held) + 1 + len(part) > most:
                    yield held
                    held = part
                else:
                    held = f"{held} {part}" if held and boundary != "\n" else f"{held}\n{part}" if held else part
            if held:
                yield held
            return
    yield text


def _runs(text: str, marker: re.Pattern) -> list[tuple[str | None, str]]:
    """(number, text) of the runs of lines that a marker begins; what stands before the first goes with it."""
    out: list[tuple[str | None, str]] = []
    for line in text.split("\n"):
        found = marker.match(line)
        if found and out and out[-1][0] is not None or not out:
            out.append((found[1] if found else None, line))
        else:
            out[-1] = (found[1] if found else out[-1][0], f"{out[-1][1]}\n{line}")
    return out


def _gathered(runs: list[tuple[str | None, str]], most: int) -> Iterator[list[tuple[str | None, str]]]:
    """Neighbouring runs together as long as they fit."""
    held: list[tuple[str | None, str]] = []
    for run in runs:
        if held and sum(len(body) + 1 for _, body in held) + len(run[1]) > most:
            yield held
            held = []
        held.append(run)
    yield held


def chunks(label: str, text: str, most: int = CHUNK) -> Iterator[tuple[str, str]]:
    """(label, text) of an article's chunks, no label twice.

    An article that fits stays whole; of several clauses, neighbours go together as long as they fit, and one clause that
    doesn't is whole. Other articles are cut before points, else before (i), else before dashes, else at lines, sentences
    and spaces, and their chunks are numbered as parts.
    """
    if len(text) <= most:
        yield label, text
        return
    clauses = _runs(text, CLAUSE)
    if sum(name is not None for name, _ in clauses) > 1:
        used: set[str] = set()
        for held in _gathered(clauses, most):
            name = own = _clause_label(label, held[0][0] or "", held[-1][0] or "")
            while name in used:
                name = f"{own} ({sum(u == own or u.startswith(own + ' (') for u in used) + 1})"
            used.add(name)
            yield name, "\n".join(body for _, body in held)
        return
    finer = next((runs for marker in (POINT, ROMAN, DASH) if len(runs := _runs(text, marker)) > 1), None)
    parts = ["\n".join(body for _, body in held) for held in _gathered(finer, most)] if finer else list(_pieces(text, most))
    for n, part in enumerate(parts, 1):
        yield f"{label} (phần {n})", part


def _clause_label(label: str, first: str, last: str) -> str:
    """'Điều 3 Khoản 1-4'; a range never runs backwards."""
    number = lambda x: int(re.match(r"\d+", x)[0])
    return f"{label} Khoản {first}" + (f"-{last}" if last != first and number(last) >= number(first) else "")


def split_unit(text: str, least: int = 15, long: int = 200) -> list[str]:
    """Atomic units: lines whose wrap is undone, cut after ';', and after sentence ends and ':' where long; short ones join the one before."""
    joined: list[str] = []
    for _, line in lines_of(text):
        if joined and joined[-1] and joined[-1][-1] not in ".;:" and not (CLAUSE.match(line) or POINT.match(line)):
            joined[-1] += " " + line.strip()
        elif line.strip():
            joined.append(line.strip())
    out: list[str] = []
    for line in joined:
        for part in re.split(r"(?<=;)\s+", line):
            for piece in re.split(r"(?<=[.:])\s+(?=\w)", part) if len(part) >= long else [part]:
                if out and len(piece) < least:
                    out[-1] += " " + piece
                else:
                    out.append(piece)
    return out


@udtf(returnType="article string, body string, chapter string, section string, char_start int, char_end int")
class SplitArticles:
    def eval(self, text: str):
        yield from articles(text or "")


@udtf(returnType="key string, kind string, parent_key string, char_start int, char_end int")
class SplitUnits:
    def eval(self, text: str, key: str):
        yield from units(text or "", key)


@udtf(returnType="label string, body string")
class SplitChunks:
    def eval(self, label: str, text: str):
        yield from chunks(label, text or "")


@udtf(returnType="char_start int, char_end int")
class QuoteSpans:
    def eval(self, text: str):
        yield from quote_spans(text or "")


@udtf(returnType="unit_no int, unit string")
class SplitAtoms:
    def eval(self, text: str):
        yield from enumerate(split_unit(text or ""))


def register(spark) -> None:
    """Makes the table functions known to SQL, for LATERAL joins."""
    for name, function in (("split_articles", SplitArticles), ("split_units", SplitUnits), ("split_chunks", SplitChunks), ("quote_spans", QuoteSpans), ("split_atoms", SplitAtoms)):
        spark.udtf.register(name, function)


def broken_spans(units_of: DataFrame, text: str, unit: str) -> DataFrame:
    """Units whose offsets don't give their text back: has no rows where all is well."""
    return units_of.where(F.substring(F.col(text), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col(unit))


def whole_documents(units_of: DataFrame, doc: str, text: str, unit: str) -> DataFrame:
    """(doc) of documents all of whose units give their text back at their offsets: one that doesn't rejects its document."""
    same = F.coalesce(F.substring(F.col(text), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col(unit), F.lit(False))
    return units_of.groupBy(doc).agg(F.bool_and(same).alias("ok")).where("ok").select(doc)


def provenance(edges: DataFrame, articles_of: DataFrame, texts: DataFrame) -> DataFrame:
    """edges (doc, span_start, span_end, ...) with the article that holds their span, the first by offset, and the text of the span.

    articles_of: (doc, article, char_start, char_end); texts: (doc, text). Spans meet articles of their document by cells.
    """
    a = articles_of.select(F.col("doc"), F.col("article"), F.col("char_start").alias("a0"), F.col("char_end").alias("a1"))
    met = span_joins.met(edges.select("doc", "span_start", "span_end").distinct(), a, ["doc"], ("span_start", "span_end"), ("a0", "a1"))
    met = met.where((F.col("a0") <= F.col("span_start")) & (F.col("span_end") <= F.col("a1")))
    holds = met.groupBy("doc", "span_start", "span_end").agg(F.min_by("article", "a0").alias("article"))
    said = F.substring("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    return edges.join(holds, ["doc", "span_start", "span_end"], "left").join(texts.select("doc", "text"), "doc", "left").withColumn("span_text", said).drop("text")


def grounded(claims: DataFrame, units_of: DataFrame) -> DataFrame:
    """(id, start, end) of claims (id, uids array, quote) over units (id, uid, start, end, text): the hull of the units, narrowed
    to the quote where it stands in one of them; null where a unit doesn't exist or none is named."""
    named = claims.select("id", "quote", F.size(F.array_distinct("uids")).alias("n"), F.explode(F.array_distinct("uids")).alias("uid"))
    met = named.join(units_of, ["id", "uid"])
    at = F.when(F.coalesce(F.col("quote"), F.lit("")) != "", F.nullif(F.instr(F.col("text"), F.col("quote")), F.lit(0)))
    spans = met.withColumn("at", F.col("start") + at - 1).groupBy("id").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("found"), F.min("start").alias("a"), F.max("end").alias("b"), F.min("at").alias("q"), F.first(F.char_length("quote")).alias("long"))
    ok = spans.where("n = found").select("id", F.coalesce("q", "a").alias("start"), F.when(F.col("q").isNotNull(), F.col("q") + F.col("long")).otherwise(F.col("b")).alias("end"))
    return claims.select("id").join(ok, "id", "left")
