"""The grammar of citations: lists of points, clauses and articles, references to 'this' unit, and foreign numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.functions import udtf

_AND = r"\s*(?:,|;|và|hoặc)\s*"
_POINT = r"[a-zđ](?![\w)])"
_NUM = r"\d+[a-zđ]?(?!\w)"


def _list_of(word: str, item: str) -> str:
    return rf"{word}\s+(?:{item}(?:(?:{_AND}|\s+đến\s+)(?:{word}\s+)?{item})*|này)"


_POINTS, _CLAUSES, _ARTICLES = _list_of("điểm", _POINT), _list_of("khoản", _NUM), _list_of("điều", _NUM)
#: A citation names its units from the innermost outwards; the document's number may follow its kind.
CITATION = re.compile(
    rf"(?P<points>{_POINTS})?\s*(?P<clauses>{_CLAUSES})?\s*(?P<articles>{_ARTICLES})?"
    r"(?:\s+(?:của\s+)?(?:thông tư|nghị định|luật|bộ luật|quyết định|nghị quyết|văn bản hợp nhất)\s+(?:số\s+)?(?P<number>\d+[\w]*/[\w/-]*\w))?",
    re.IGNORECASE,
)


@dataclass
class Citation:
    """One reference: what it names, whether it says 'this', the foreign number if it has one, and where it stands."""

    points: list[str] = field(default_factory=list)
    clauses: list[str] = field(default_factory=list)
    articles: list[str] = field(default_factory=list)
    this_clause: bool = False
    this_article: bool = False
    number: str | None = None
    start: int = 0
    end: int = 0


def _items(said: str | None, item: str, word: str) -> list[str]:
    """The members of a list; a range of numbers is written out."""
    if not said:
        return []
    body = re.sub(rf"(?i)\b{word}\s+", "", said)
    out: list[str] = []
    for part in re.split(_AND, body):
        ends = re.split(r"\s+đến\s+", part.strip())
        if len(ends) == 2 and all(e.isdigit() for e in ends) and int(ends[0]) <= int(ends[1]):
            out += map(str, range(int(ends[0]), int(ends[1]) + 1))
        else:
            out += [e for e in ends if re.fullmatch(item, e)]
    return list(dict.fromkeys(out))


def citations(text: str) -> Iterator[Citation]:
    """The citations in a text, in order; a number alone is none."""
    at = 0
    while at < len(text):
        m = CITATION.match(text, at)
        said = m and (m["points"] or m["clauses"] or m["articles"])
        if not said or (at and text[at - 1].isalnum()):
            at += 1
            continue
        this = lambda part: bool(m[part]) and m[part].lower().endswith("này")
        yield Citation(
            _items(m["points"], r"[a-zđ]", "điểm"), _items(m["clauses"], r"\d+[a-zđ]?", "khoản"), _items(m["articles"], r"\d+[a-zđ]?", "điều"),
            this("clauses"), this("articles"), m["number"], at, at + len(m[0].rstrip()),
        )
        at = max(m.end(), at + 1)


def node_keys(ref: Citation, number: str | None, article: str | None, clause: str | None) -> list[str]:
    """The keys that a citation names, seen from a place; none where the place doesn't give what it needs."""
    base = ref.number or number
    articles = ref.articles or ([article] if article and not ref.number and (ref.this_article or not ref.articles) else [])
    if not base or not articles:
        return []
    if ref.this_clause and not clause:
        return []
    clauses = ref.clauses or ([clause] if ref.this_clause or ref.points and clause and not ref.articles else [])
    if ref.points and not clauses:
        return []
    out = []
    for a in articles:
        for c in clauses or [None]:
            for p in ref.points or [None]:
                out.append(f"{base}#than/dieu_{a}" + (f"#khoan_{c}" if c else "") + (f"#diem_{p}" if p else ""))
    return list(dict.fromkeys(out))


@udtf(returnType="points array<string>, clauses array<string>, articles array<string>, this_clause boolean, this_article boolean, number string, char_start int, char_end int")
class Citations:
    def eval(self, text: str):
        for c in citations(text or ""):
            yield c.points, c.clauses, c.articles, c.this_clause, c.this_article, c.number, c.start, c.end
