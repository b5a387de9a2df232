"""An inline HTML whitelist. Balancing needs a scan with a state, so this runs in Arrow batches."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The inline tags that stay.
INLINE = frozenset({"b", "strong", "i", "em", "u", "sup", "sub", "br"})
#: A tag's attributes: what is quoted may hold the sign that ends a tag.
_REST = r"""(?:\s(?:"[^"]*"|'[^']*'|[^'">])*?)?"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<(?P<shut>/?)(?P<name>[A-Za-z][A-Za-z0-9]*){_REST}(?P<empty>/?)>|<[/!?][^>]*>|<(?:script|style)\b", re.DOTALL)


def inline_html(text: str | None) -> str | None:
    """The text with whitelisted inline tags only, without attributes, balanced, white space collapsed; empty where no text is left."""
    if text is None:
        return None
    source, out, levels, at = text, [], [], 0
    while at < len(source):
        found = _TOKEN.search(source, at)
        said = source[at : found.start() if found else len(source)]
        out.append(html.escape(html.unescape(said), quote=False))
        if not found:
            break
        at, name = found.end(), (found["name"] or "").lower()
        if name in ("script", "style") and not found["shut"]:
            over = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(source, at)
            at = over.end() if over else len(source)
        elif name == "br":
            out.append("<br>")
        elif name not in INLINE or found["empty"]:
            continue
        elif not found["shut"]:
            levels.append(name)
            out.append(f"<{name}>")
        elif name in levels:
            depth = len(levels) - levels[::-1].index(name) - 1
            out += [f"</{n}>" for n in reversed(levels[depth:])]
            del levels[depth:]
    out += [f"</{n}>" for n in reversed(levels)]
    tidy = " ".join("".join(out).split())
    return tidy if re.sub("<[^>]*>", "", tidy).strip() else ""


@F.pandas_udf(StringType())
def sanitize(texts: pd.Series) -> pd.Series:
    return texts.map(inline_html)
