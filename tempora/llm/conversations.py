"""Structure repair of conversations by a lazily determinised weighted automaton.

A conversation is a word of symbols: for each row, which role it has and what is wrong with it. The edits that bring it into
the form `(s?(ua)+)?` are the paths of a weighted automaton over four states (nothing yet, after s, after u, after a). The
automaton is determinised as it is needed, from the end of a conversation to its start: a determinised state is the vector
of the costs to go from each of the four states, less their least; each transition on a symbol is computed once and kept in
a table with the cost that was taken out. Scanning a conversation is then a table look-up for each row. The audit follows
tight arcs from the start: those whose cost and cost to go are together the cost to go, the ASCII-least letter first.

A conversation may hold a third of all rows: rows are dealt by ranges of (conversation, turn, role, text), a conversation in
several ranges is scanned range by range. Each range's effect is a 4 x 4 matrix of costs (min, +); the vectors at the ranges'
ends follow from these matrices, each range is traced from all four states, and the traces are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. Which state a kept initial leads to, and what an added turn is.
ROLES = "sua"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ADDED = {0: "u", 1: "u", 2: "a", 3: "u"}
INF = 1 << 60
NOTHING = hashlib.sha256(b"").hexdigest()
#: Rows of a range.
RANGE_ROWS = 200_000


def _closed(v: list[int]) -> list[int]:
    """Costs to go when turns may be added first."""
    u, a = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    s = min(v[1], INSERT + u)
    return [min(v[0], INSERT + u), s, u, a]


END = _closed([0, INF, INF, 0])


def symbol(initial: str, fault: str) -> str:
    """One letter for a row: d where it must go; else s, u, a or o (another role), a capital where it is truncated."""
    if fault in ("blank", "duplicate"):
        return "d"
    letter = initial if initial in ROLES else "o"
    return letter.upper() if fault == "truncated" else letter


def _arcs(state: int, letter: str) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row in a state, but for added turns."""
    out = [("D", DELETE, state)]
    if letter != "d":
        role, extra = letter.lower(), TRUNCATED if letter.isupper() else 0
        if role in NEXT[state]:
            out.append(("K", KEEP + extra, NEXT[state][role]))
        out.append(("R", REROLE + extra, NEXT[state][ADDED[state]]))
    return out


class Determinised:
    """The determinised automaton, built as far as it has been asked: vectors, and a table of (next, cost taken out)."""

    def __init__(self) -> None:
        self.names: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.table: list[dict[str, tuple[int, int]]] = []
        self.best: dict[tuple[int, str, int], tuple[str, int]] = {}

    def state(self, costs: list[int]) -> tuple[int, int]:
        """(the state of these costs, their least)."""
        low = min(costs)
        vector = tuple(c - low if c < INF else INF for c in costs)
        if vector not in self.names:
            self.names[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append({})
        return self.names[vector], low

    def step(self, at: int, letter: str) -> tuple[int, int]:
        """The state before a row, from that after it."""
        known = self.table[at].get(letter)
        if known is None:
            after = self.vectors[at]
            known = self.table[at][letter] = self.state(_closed([min(cost + after[to] for _, cost, to in _arcs(q, letter)) for q in range(4)]))
        return known

    def scan(self, word: str, end: list[int]) -> tuple[list[int], int]:
        """(the state before each row and at the end, all that was taken out)."""
        at, total = self.state(end)
        path = [at]
        table = self.table
        for letter in reversed(word):
            found = table[at].get(letter) or self.step(at, letter)
            at = found[0]
            total += found[1]
            path.append(at)
        return path[::-1], total

    def _tight(self, before: int, then: int, letter: str, state: int) -> tuple[str, int]:
        """(edit, next state): the ASCII-least tight arc from a state at a row."""
        here, after, out = self.vectors[before], self.vectors[then], self.table[then][letter][1]
        tight = [(edit, to) for edit, cost, to in _arcs(state, letter) if cost + after[to] == here[state] + out]
        added = NEXT[state][ADDED[state]]
        if INSERT + here[added] == here[state]:
            tight.append(("I", added))
        return min(tight)

    def trace(self, word: str, path: list[int], state: int, last: bool) -> tuple[str, int]:
        """(edits, state at the end) of the cheapest path from a state, the ASCII-least of them; last: nothing follows.

        Turns that could be added between two ranges are left to the second.
        """
        edits = []
        for i, letter in enumerate(word):
            edit = "I"
            while edit == "I":
                key = (path[i + 1], letter, state)
                if key not in self.best:
                    self.best[key] = self._tight(path[i], *key)
                edit, state = self.best[key]
                edits.append(edit)
        while last and state not in (0, 3):
            edits.append("I")
            state = NEXT[state][ADDED[state]]
        return "".join(edits), state


_AUTOMATON = Determinised()


def repair(word: str) -> tuple[int, str]:
    """(cost, audit) of a conversation's symbols."""
    path, total = _AUTOMATON.scan(word, END)
    return total + _AUTOMATON.vectors[path[0]][0], _AUTOMATON.trace(word, path, 0, True)[0]


def _matrix(word: str) -> list[int]:
    """Cost from each state before a range to each state after it, by scans that may end in one state only."""
    out = []
    for q in range(4):
        path, total = _AUTOMATON.scan(word, [0 if x == q else INF for x in range(4)])
        out.append([min(INF, c + total) for c in _AUTOMATON.vectors[path[0]]])
    return [out[to][at] for at in range(4) for to in range(4)]


def _fates(word: str, times: list[int], edits: str, state: int) -> list[str]:
    """For each folded row, and for what follows the last, a letter for each line that comes of it.

    u and a: a turn added before it; K, U and A: the row itself as it is, as user, as assistant; nothing where it goes.
    """
    out, mine, k, left = [], "", 0, iter(times)
    copies = next(left, 0)
    for edit in edits:
        if edit == "I":
            mine += ADDED[state]
            state = NEXT[state][ADDED[state]]
            continue
        if edit == "K":
            mine += "K"
            state = NEXT[state][word[k].lower()]
        elif edit == "R":
            mine += ADDED[state].upper()
            state = NEXT[state][ADDED[state]]
        k, copies = k + 1, copies - 1
        if not copies:
            out.append(mine)
            mine, copies = "", next(left, 0)
    return [*out, mine]


def _repaired_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost, audit and fates of conversations that lie in one range."""
    for batch in batches:
        cost, audit, fates = [], [], []
        for word, times in zip(batch["word"].to_pylist(), batch["times"].to_pylist(), strict=True):
            c, edits = repair(word)
            cost.append(c)
            audit.append(edits)
            fates.append(_fates(word, times, edits, 0))
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["part"], pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(fates, pa.list_(pa.string()))], ["conv", "part", "cost", "audit", "fates"])


_RANGE = "conv {0}, part int, cost long, audit string, fates array<string>"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["part"], pa.array([_matrix(w) for w in batch["word"].to_pylist()], pa.list_(pa.int64()))], ["conv", "part", "m"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation of several ranges: the costs to go after each, from their matrices in order."""
    for batch in batches:
        out = []
        for ranges in batch["ranges"].to_pylist():
            after, rows = END, []
            for r in reversed(ranges):
                rows.append({"part": r["part"], "after": after, "last": r is ranges[-1]})
                after = [min(INF, *(r["m"][4 * at + to] + after[to] for to in range(4))) for at in range(4)]
            out.append(rows)
        kind = pa.list_(pa.struct([("part", pa.int32()), ("after", pa.list_(pa.int64())), ("last", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch["conv"], pa.array(out, kind)], ["conv", "ends"])


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's trace from each of the four states; cost: from each state to the conversation's end."""
    for batch in batches:
        out = []
        for word, times, after, last in zip(*(batch[c].to_pylist() for c in ("word", "times", "after", "last")), strict=True):
            path, total = _AUTOMATON.scan(word, after)
            rows = []
            for q in range(4):
                edits, to = _AUTOMATON.trace(word, path, q, last)
                rows.append({"cost": total + _AUTOMATON.vectors[path[0]][q], "audit": edits, "to": to, "fates": _fates(word, times, edits, q)})
            out.append(rows)
        kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("to", pa.int32()), ("fates", pa.list_(pa.string()))]))
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["part"], pa.array(out, kind)], ["conv", "part", "traces"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each range of a conversation is entered."""
    for batch in batches:
        out = []
        for ranges in batch["ranges"].to_pylist():
            state, rows = 0, []
            for r in ranges:
                rows.append({"part": r["part"], "state": state})
                state = r["to"][state]
            out.append(rows)
        yield pa.RecordBatch.from_arrays([batch["conv"], pa.array(out, pa.list_(pa.struct([("part", pa.int32()), ("state", pa.int32())])))], ["conv", "entries"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 over the lines of each conversation, rows in order; a conversation's rows may go on in the next batch."""
    name, digest, begun = None, None, False
    for batch in batches:
        done: list[tuple] = []
        for conv, lines in zip(batch["conv"].to_pylist(), batch["lines"], strict=True):
            if digest is None or conv != name:
                if digest is not None:
                    done.append((name, digest.hexdigest()))
                name, digest, begun = conv, hashlib.sha256(), False
            digest.update(b"\n" if begun else b"")
            digest.update(lines.as_py().encode())
            begun = True
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field("conv").type), pa.array([d[1] for d in done], pa.string())], ["conv", "repaired_sha256"])
        kind = batch.schema.field("conv").type
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([digest.hexdigest()], pa.string())], ["conv", "repaired_sha256"])


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conversations as the repair query wants them damaged: columns conv, turn, role, text and times (1, or 2 if repeated).

    crc32 of `conv:turn` modulo 20: 0 drops the row, 1 empties its text, 2 removes its `.`, `!` and `?`, 3 repeats it, 4 sets
    its role to user. A null role or text is read as one space, and so is a null conversation or turn in the checksum.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = F.when(code == 1, F.lit("")).when(code == 2, F.translate(blank(text_col), ".!?", "")).otherwise(blank(text_col))
    role = F.when(code == 4, F.lit("user")).otherwise(blank(role_col))
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.when(code == 3, 2).otherwise(1).alias("times"), code.alias("code"))
    return out.where("code <> 0").drop("code")


def _same(names: list[str]) -> Column:
    """Whether the columns equal those of the same name with a mark before it, nulls included."""
    out = F.lit(True)
    for name in names:
        out = out & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return out


def repair_conversations(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Faults, the cheapest edits and the repaired text of each conversation. rows: conv, turn (long), role, text, times.

    Rows are taken by turn (nulls first); rows of one turn by role, then by the MD5 of their text; times says how often a row
    stands there. Blank is a text without a character other than space and tab to carriage return; duplicate, one whose role
    and text stood earlier in the conversation; truncated, one whose last such character isn't `.`, `!` or `?`; a row has
    its first fault only. Null roles and texts are read as one space. Other columns are dropped.
    Returns conv, gaps, blank, duplicate, truncated, illegal, cost (long), audit and repaired_sha256; conversations without
    rows don't appear. A null conv is a conversation. Equal rows and any number of them in a conversation are sound; only
    what belongs in one row of the result, the audit, is put together in one place, and the digest is read as a stream.
    """
    rows = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "times")
    kind = rows.schema["conv"].dataType.simpleString()
    ident = ["conv", "turn", "role", "digest"]
    folded = rows.withColumn("digest", F.md5("text")).groupBy(*ident).agg(F.sum("times").alias("times"), F.first("text").alias("text"))
    folded = written(folded, "turns")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    light = folded.select(*ident, "times", last.alias("last"))
    # The first row of each role and text: a key with the turn in it, so that none is hot.
    early = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = light.groupBy("conv", "role", "digest").agg(F.min(early).alias("first")).select(F.col("conv").alias("_conv"), F.col("first.turn").alias("_turn"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), F.lit(True).alias("_first"))
    light = light.join(first, _same(ident), "left").select(*ident, "times", "last", F.coalesce("_first", F.lit(False)).alias("is_first"))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    fault = F.when(F.col("last") == "", "blank").when(~F.col("is_first"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    light = light.withColumn("fault", fault).withColumn("initial", initial)
    head = F.when(F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)), "d").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    light = light.withColumn("word", F.concat(head, F.expr("repeat('d', CAST(times AS INT) - 1)")))

    n = folded.count()
    in_order = [F.asc_nulls_first(c) for c in ident]
    ranged = light.repartitionByRange(max(1, -(-n // range_rows)), *in_order).withColumn("part", F.spark_partition_id())
    many = F.col("times")
    facts = ranged.groupBy("conv", "part").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "digest", "word", "initial", "times"))).alias("rows"),
        F.sum(F.when(F.col("fault") == "blank", many).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", many).when(F.col("fault") == "blank", 0).otherwise(many - 1)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0)).alias("truncated"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"),
    )
    fine = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
    pairs = F.arrays_zip(F.slice("rows", 1, F.greatest(F.size("rows") - 1, F.lit(0))).alias("a"), F.slice("rows", 2, F.size("rows")).alias("b"))
    steps = F.aggregate(pairs, F.lit(0).cast("long"), lambda x, p: x + F.when(fine(p["a"]["initial"], p["b"]["initial"]), 0).otherwise(1))
    # Equal rows in a row never alternate.
    illegal = steps + F.aggregate("rows", F.lit(0).cast("long"), lambda x, r: x + r["times"] - 1)
    facts = facts.select("conv", "part", "blank", "duplicate", "truncated", "low", "high", "turns", illegal.alias("illegal"), F.array_join(F.transform("rows", lambda r: r["word"]), "").alias("word"), F.transform("rows", lambda r: F.struct(r["turn"].alias("turn"), r["role"].alias("role"), r["digest"].alias("digest"), r["times"].alias("times"))).alias("rows"), F.col("rows")[0]["initial"].alias("head"), F.element_at("rows", -1)["initial"].alias("tail"))
    facts = written(facts, "facts")

    # Conversations of one range are repaired where they lie; those of several, by the matrices of their ranges.
    spread = written(facts.groupBy(F.col("conv").alias("_conv")).agg(F.count(F.lit(1)).alias("parts")).where("parts > 1"), "spread")
    alone, wide = (facts.join(spread, _same(["conv"]), how) for how in ("left_anti", "left_semi"))
    results = alone.select("conv", "part", "word", F.col("rows.times").alias("times")).mapInArrow(_repaired_ranges, _RANGE.format(kind))
    if not spread.isEmpty():
        matrices = wide.select("conv", "part", "word").mapInArrow(_matrices, f"conv {kind}, part int, m array<long>")
        ends = matrices.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("ranges")).mapInArrow(_ends, f"conv {kind}, ends array<struct<part:int,after:array<long>,last:boolean>>")
        ends = ends.select(F.col("conv").alias("_conv"), F.explode("ends").alias("e")).select("_conv", F.col("e.part").alias("_part"), "e.after", "e.last")
        traced = wide.join(ends, _same(["conv", "part"])).select("conv", "part", "word", F.col("rows.times").alias("times"), "after", "last")
        traced = written(traced.mapInArrow(_traces, f"conv {kind}, part int, traces array<struct<cost:long,audit:string,to:int,fates:array<string>>>"), "traces")
        steps_of = traced.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", F.col("traces.to").alias("to")))).alias("ranges"))
        entries = steps_of.mapInArrow(_entries, f"conv {kind}, entries array<struct<part:int,state:int>>").select(F.col("conv").alias("_conv"), F.explode("entries").alias("e")).select("_conv", F.col("e.part").alias("_part"), "e.state")
        taken = traced.join(entries, _same(["conv", "part"])).select("conv", "part", F.element_at("traces", F.col("state") + 1).alias("t"))
        results = results.unionByName(taken.select("conv", "part", "t.cost", "t.audit", "t.fates"))
    results = written(results, "results")

    ranges = facts.join(results.withColumnsRenamed({"conv": "_conv", "part": "_part"}), _same(["conv", "part"])).drop("_conv", "_part")
    whole = ranges.groupBy("conv").agg(
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"), F.sum("illegal").alias("illegal"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"),
        F.min_by("cost", "part").alias("cost"),
        F.array_sort(F.collect_list(F.struct("part", "head", "tail", "audit", F.struct("low", "high").alias("span")))).alias("parts"),
    )
    seams = F.arrays_zip(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))).alias("a"), F.slice("parts", 2, F.size("parts")).alias("b"))
    across = F.aggregate(seams, F.lit(0).cast("long"), lambda x, p: x + F.when(fine(p["a"]["tail"], p["b"]["head"]), 0).otherwise(1))
    # A turn that two ranges share is one turn.
    shared = F.aggregate(seams, F.lit(0).cast("long"), lambda x, p: x + F.when(p["a"]["span"]["high"] == p["b"]["span"]["low"], 1).otherwise(0))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - shared), F.lit(0).cast("long"))
    audit = F.array_join(F.transform("parts", lambda p: p["audit"]), "")
    report = whole.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + across).alias("illegal"), "cost", audit.alias("audit"))

    # What becomes of each row, beside its text; the lines of a conversation are read in order, as a stream.
    placed = ranges.select("conv", "part", F.posexplode(F.arrays_zip(F.col("rows").alias("row"), F.slice("fates", 1, F.size("rows")).alias("fate"))).alias("at", "z"))
    fates = placed.select("conv", "part", "at", "z.row.turn", "z.row.role", "z.row.digest", "z.fate").where("fate <> ''")
    texts = folded.select(*(F.col(c).alias(f"_{c}") for c in ident), "text")
    after = ranges.select("conv", "part", F.size("rows").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.element_at("fates", -1).alias("fate")).where("fate <> ''")
    stream = fates.join(texts, _same(ident)).select("conv", "part", "at", "role", "text", "fate").unionByName(after)
    said = {"u": F.lit("user:"), "a": F.lit("assistant:"), "K": F.concat("role", F.lit(":"), "text"), "U": F.concat(F.lit("user:"), "text")}
    line = lambda c: F.when(c == "u", said["u"]).when(c == "a", said["a"]).when(c == "K", said["K"]).when(c == "U", said["U"]).otherwise(F.concat(F.lit("assistant:"), "text"))
    lines = F.array_join(F.transform(F.filter(F.split("fate", ""), lambda c: c != ""), line), "\n")
    ordered = stream.select("conv", "part", "at", lines.alias("lines")).repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), "part", "at")
    digests = ordered.select("conv", "lines").mapInArrow(_digests, f"conv {kind}, repaired_sha256 string").withColumnRenamed("conv", "_conv")
    return report.join(digests, _same(["conv"]), "left").drop("_conv").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(NOTHING)))
