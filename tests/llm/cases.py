"""Small documents with the awkward cases, and plain versions of what the operators compute."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, words string, score double"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Random texts, copies exact and near, a shared passage, short, empty, null and long ones; the last columns only clash by name."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    texts: list[str | None] = [" ".join(words(rng, rng.randint(20, 120))) for _ in range(n)]
    base = words(rng, 200)
    for k in range(12):
        copy = list(base)
        for _ in range(k % 4):
            copy[rng.randrange(len(copy))] = "edited"
        texts.append(" ".join(copy))
    for _ in range(6):
        texts.append(" ".join(words(rng, 30) + passage + words(rng, 30)))
    texts += ["", None, "   \n\t", "one two", "one two", "one", "é ü 日本 ñ", " ".join(words(rng, 9000)), texts[0], texts[0], "a b c d e f g h i j k l m", "a b c d e f g h i j k l m"]
    rows = [(i * 3, t, "en", f"src{i % 5}" if i % 9 else None, len(t) if t else None, "x", None, 1.0) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "no id here at all", "en", "s", 1, None, None, None), (None, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def shingles(text: str | None) -> list[bytes]:
    w = (text or "").encode().split()
    return [b" ".join(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [b" ".join(w)] if w else []


def lcs(x: list, y: list) -> int:
    row = [0] * (len(y) + 1)
    for a in x:
        before = 0
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], before + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]
