"""Suffix arrays, repeated windows and the removal of repeated bytes against brute force."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from tempora.llm.suffix_dedup import remove_repeated_bytes, segments
from tempora.llm.suffix_groups import lyndon_groups, repeated_starts, suffix_array

from . import cases


def test_suffix_array_is_that_of_sorting():
    rng = random.Random(1)
    for _ in range(3000):
        codes = [rng.randrange(rng.choice([1, 2, 3, 10])) for _ in range(rng.randrange(1, 40))]
        assert suffix_array(codes) == sorted(range(len(codes)), key=lambda i: codes[i:])
    assert suffix_array([]) == []


def test_groups_share_lyndon_prefixes():
    rng = random.Random(2)

    def lyndon(s):  # the longest prefix that is smaller than all its proper suffixes
        return max(s[:k] for k in range(1, len(s) + 1) if all(s[:k] < s[j:k] for j in range(1, k)))

    for _ in range(300):
        codes = [rng.randrange(3) for _ in range(rng.randrange(2, 16))]
        group, _, _ = lyndon_groups(codes)
        words = [tuple(lyndon(codes[i:])) for i in range(len(codes))]
        assert all((group[i] == group[j]) <= (words[i] == words[j]) for i in range(len(codes)) for j in range(len(codes)))


def test_repeated_starts_are_those_of_counting():
    rng = random.Random(3)
    for _ in range(200):
        length, letters = rng.choice([1, 3, 8, 20, 60]), rng.choice([1, 2, 4, 200])
        base = bytes(rng.randrange(letters) + 33 for _ in range(rng.randrange(1, 300)))
        parts = []
        for _ in range(rng.randrange(1, 8)):
            a = rng.randrange(len(base))
            part = bytearray(base[a : rng.randrange(a, len(base) + 1)])
            if part and rng.random() < 0.5:
                part[rng.randrange(len(part))] = 33
            parts.append(bytes(part))
        count = Counter(s[i : i + length] for s in parts for i in range(len(s) - length + 1))
        assert [x.tolist() for x in repeated_starts(parts, length)] == [[count[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in parts]


def test_segments_hold_each_start_once():
    rng = random.Random(4)
    texts = [" ".join(cases.words(rng, n)) for n in (0, 3, 200, 50)] + ["x" * 3000, None, "ab" * 700]
    seen = Counter()
    for of, _, _, _, lo, many in segments(pa.array(texts), 100):
        seen.update((i, p) for i, a, n in zip(of.tolist(), lo.tolist(), many.tolist()) for p in range(a, a + n))
    assert seen == Counter((i, p) for i, t in enumerate(texts) for p in range(len((t or "").encode()) - 99))


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, kept))
    return out


@pytest.mark.parametrize("dense", [2048, 2])
def test_removal_is_that_of_brute_force(spark, dense):
    rng = random.Random(5)
    rows = cases.documents(5)
    passage = " ".join(cases.words(rng, 40))
    extra = [f"{' '.join(cases.words(rng, 20))} {passage} {' '.join(cases.words(rng, 20))}" for _ in range(8)] + ["z" * 900, "é" * 300, "ab" * 500]
    rows += [(900 + i, t, "en", "s", 1, "k", "w", 0.0) for i, t in enumerate(extra)]
    for length in (400, 90):
        got = remove_repeated_bytes(spark.createDataFrame(rows, cases.SCHEMA), length=length, keep=("keys", "words"), dense=dense, table_bytes=20_000).collect()
        found = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got)
        assert found == Counter((row[0], *want) for row, want in zip(rows, brute([r[1] for r in rows], length)))
        assert all(sum(s["b"] - s["a"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_nothing_and_nulls(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], cases.SCHEMA)).count() == 0
    rows = [(None, None), (1, None), (1, ""), (2, "short"), (2, "short")]
    got = remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got) == [(0, 0, b"")] * 3 + [(5, 0, b"short")] * 2
