"""From amending text to edges: commands, their targets, and the new wording that they quote."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tempora.functions.citations import citations, node_keys
from tempora.functions.text import COMMANDS
from tempora.operators.segments import lines_of, quote_mask, quote_spans

_ORDINAL = re.compile(r"^\s*(?:\d+[a-zđ]?[.)]|[a-zđ]\))\s*")
_BASE = re.compile(r"(?iu)(?:của|sửa đổi[^.]*?)\s+(?:thông tư|nghị định|luật|quyết định)\s+(?:số\s+)?(\d+\w*/[\w/-]*\w)")
_VERBS = [(name, re.compile(pattern)) for name, pattern in COMMANDS]


def verb(line: str) -> str | None:
    """The operation that a line commands, past its numbering."""
    rest = _ORDINAL.sub("", line)
    return next((name for name, pattern in _VERBS if pattern.match(rest)), None)


def base_number(title: str, default: str | None) -> str | None:
    """The number of the document that an article amends, by its title."""
    m = _BASE.search(title)
    return m[1] if m else default


def edges_of(text: str, source_key: str, default_base: str | None, valid_from: str | None) -> Iterator[tuple]:
    """(source_key, target_key, op, span_start, span_end, valid_from, command, warning) of an article of an amending document.

    A command is a line outside quotations that begins with a verb; its targets are what it cites before its colon; the
    quotation between it and the next command is the new wording. A command without a target is given out once, with a
    warning and no target.
    """
    mask, quotes = quote_mask(text), quote_spans(text)
    base = base_number(text.split("\n", 1)[0], default_base)
    found = [(at, line, op) for at, line in lines_of(text) if not (at < len(mask) and mask[at]) and (op := verb(line))]
    for i, (at, line, op) in enumerate(found):
        until = found[i + 1][0] if i + 1 < len(found) else len(text)
        span = next(((a, b) for a, b in quotes if at <= a and b <= until), (None, None))
        said = line.split(":", 1)[0]
        said = said[: said.index("“")] if "“" in said else said
        keys = [k for c in citations(said) for k in node_keys(c, base, None, None)]
        for key in dict.fromkeys(keys):
            yield source_key, key, op, *span, valid_from, line.strip(), None
        if not keys:
            yield source_key, None, op, *span, valid_from, line.strip(), "no target"


@udtf(returnType="source_key string, target_key string, op string, span_start int, span_end int, valid_from string, command string, warning string")
class AmendmentEdges:
    def eval(self, text: str, source_key: str, default_base: str, valid_from: str):
        yield from edges_of(text or "", source_key, default_base, valid_from)


def amendments(articles: DataFrame) -> DataFrame:
    """Edges of articles (text, source_key, base, valid_from), with the new wording beside its offsets."""
    wanted = articles.where(F.col("text").rlike("(?iu)(bãi bỏ|thay thế|sửa đổi|bổ sung)"))
    edges = wanted.lateralJoin(AmendmentEdges(F.col("text").outer(), F.col("source_key").outer(), F.col("base").outer(), F.col("valid_from").outer()).alias("e"))
    return edges.select("e.*", F.substring("text", F.col("e.span_start") + 1, F.col("e.span_end") - F.col("e.span_start")).alias("new_text"))
