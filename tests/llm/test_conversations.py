"""Repair of conversations against a plain search over edits."""

import hashlib
import random
import re
from zlib import crc32

import pytest

from tempora.llm import conversations as C

RULE = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by a table from the last row to the first of the least (cost, audit, lines) from each role before."""
    fault = faults(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {q: ((0, "", []) if q in ("", "a") else None) for q in follow}

    def add_turns(b):
        for _ in range(4):
            for q in b:
                for x in "ua":
                    if x in follow[q] and b[x]:
                        c, a, r = b[x]
                        new = (c + 3, "I" + a, [{"u": "user:", "a": "assistant:"}[x], *r])
                        b[q] = min(b[q], new) if b[q] else new
        return b

    add_turns(best)
    for (role, text), f in reversed(list(zip(rows, fault))):
        now = {}
        for q in follow:
            ways = [(4 + best[q][0], "D" + best[q][1], best[q][2])]
            if f not in ("blank", "duplicate"):
                more = 3 if f == "truncated" else 0
                if role[:1] and role[:1] in follow[q]:
                    c, a, r = best[role[:1]]
                    ways.append((c + more, "K" + a, [f"{role}:{text}", *r]))
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in follow[q]:
                        c, a, r = best[x]
                        ways.append((c + 3 + more, "R" + a, [f"{name}:{text}", *r]))
            now[q] = min(ways)
        best = add_turns(now)
    return best[""]


def test_the_search_is_least_among_all_short_edits():
    """The search above, against trying every string of edits on a few rows."""
    from itertools import product

    for roles in (["u", "u"], ["a"], ["s", "a"], ["x", "u", "a"], ["s"]):
        rows = [(r, f"t{i}.") for i, r in enumerate(roles)]
        found = []
        for n in range(7):
            for edits in product("DIKR", repeat=n):
                if sum(e != "I" for e in edits) == len(rows):
                    todo = [("", 0)]
                    k = 0
                    for e in edits:
                        step = {"I": lambda s: [s + "u", s + "a"], "D": lambda s: [s], "K": lambda s: [s + roles[k]], "R": lambda s: [s + "u", s + "a"]}[e]
                        todo = [(t, c + {"I": 3, "D": 4, "K": 0, "R": 3}[e]) for s, c in todo for t in step(s)]
                        k += e != "I"
                    found += [(c, "".join(edits)) for s, c in todo if RULE.fullmatch(s)]
        assert min(found) == cheapest(rows)[:2]


def test_automaton_gives_the_cheapest_edits():
    rng = random.Random(1)
    for _ in range(2000):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["", "a.", "b", "c!", f"x{rng.random()}.", f"y{rng.random()}"])) for _ in range(rng.randrange(12))]
        word = "".join(C.symbol(r[:1] or "-", f) for (r, _), f in zip(rows, faults(rows)))
        assert C.repair(word) == cheapest(rows)[:2]
    assert len(C._AUTOMATON.vectors) < 500


def expected(rows):
    """The report of each conversation, from rows (conv, turn, role, text) as they are."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, hashlib.md5((" " if text is None else text).encode()).hexdigest(), " " if text is None else text))
    out = {}
    for conv, group in groups.items():
        group.sort()
        turns = [g[1] for g in group if g[0]]
        pairs = [(g[2], g[4]) for g in group]
        f = faults(pairs)
        c, a, r = cheapest(pairs)
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(pairs, pairs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), illegal, c, a, hashlib.sha256("\n".join(r).encode()).hexdigest())
    return out


def make(rng, convs, most):
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None])
            text = rng.choice(["", " \t\x0b\n", None, "yes.", "no", f"t{turn}!", f"é {turn}? \n", "日本。", "a" * 3000 + "."])
            row = (conv, rng.choice([None, turn, turn // 2, turn * 3]), role, text)
            rows += [row] * rng.choice([1, 1, 1, 3])
    return rows


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("size", [200_000, 9])
def test_repairs_are_those_of_the_search(spark, size):
    rng = random.Random(2)
    rows = make(rng, 30, 10) + [(77, t, rng.choice(["user", "assistant"]), f"turn {t // 3}.") for t in range(80)]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").selectExpr("*", "1 AS times", "'x' AS cost", "0 AS part")
    got = {r["conv"]: tuple(r[f] for f in FIELDS) for r in C.repair_conversations(df, size).collect()}
    assert got == expected(rows)


def test_damage(spark):
    rows = make(random.Random(3), 40, 12)
    want = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        want += [(conv, turn, "user" if code == 4 else role, text, 2 if code == 3 else 1)] * (code != 0)
    got = C.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv long, turn long, role string, text string, times int")
    assert C.repair_conversations(empty).count() == 0
