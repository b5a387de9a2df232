"""Removal of bytes that lie in a long string which starts more than once in the corpus.

Equal texts are folded first. Every string of `length` bytes is assigned to its anchor: the least hash of GRAM bytes inside
it, the leftmost among equals. Equal strings have equal anchors at equal offsets, so strings are compared only inside their
anchor's group. The strings of one occurrence of an anchor start in a row: they are one segment of text. Segments are folded
by content; a segment met twice is repeated as a whole. Only where an anchor has several different segments are their texts
fetched, dealt by anchor into tables of a few megabytes, and read off a suffix array (suffix_groups).

An anchor with more than DENSE different segments isn't gathered: its strings are hashed to 128 bits each and counted by a
grouped aggregate, which combines before it shuffles. What travels besides the texts are a row for each anchor, some 170
bytes apart, and the segments that differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import U64, join_hot, mix, slices, written
from tempora.llm.suffix_groups import Rolling, repeated_starts

#: Bytes of an anchor; different segments that one task may gather for an anchor; bytes of segments for a suffix array.
GRAM, DENSE, TABLE_BYTES = 64, 2048, 4 << 20
#: Bytes of text that are hashed at once.
SLICE = 1 << 20
_TOP = U64((1 << 64) - (1 << 21))


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of size values, by the minima to both sides of every size-th place."""
    n = len(values)
    padded = np.full(-(-n // size) * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, size)
    onward = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - size + 1], onward[size - 1 : n])


def segments(texts: pa.Array, length: int, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(text's index, anchor, two content hashes, first start, number of starts) of the segments of each slice of texts.

    Positions are bytes from the start of a text. Texts shorter than length have no segments. A text over a megabyte is read
    in pieces that overlap by length - 1 bytes: its segments may be cut there, and strings keep their anchors.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    raw = texts.cast(pa.large_binary())
    for a, b in slices(raw, SLICE):
        pieces: list[tuple[int, int, bytes]] = []
        for i in range(a, b):
            body = raw[i].as_py() or b""
            pieces += [(i, at, body[at : at + SLICE + length - 1]) for at in range(0, len(body) - length + 1, SLICE)]
        batch: list[tuple[int, int, bytes]] = []
        for k, piece in enumerate(pieces):
            batch.append(piece)
            if k + 1 == len(pieces) or sum(len(x[2]) for x in batch) + len(pieces[k + 1][2]) > SLICE:
                yield _segments(batch, length, gram)
                batch = []


def _segments(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    gram = min(gram, length)
    data = np.frombuffer(b"".join(x[2] for x in pieces), np.uint8)
    sizes = np.array([len(x[2]) for x in pieces], np.int64)
    ends = np.cumsum(sizes)
    rolling = Rolling(data)
    at = np.arange(len(data) - gram + 1)
    # The hash above, the place below: the least is the leftmost of the least.
    best = _least((rolling.of(at, at + gram) & _TOP) | at.astype(np.uint64), length - gram + 1)
    place = (best & ~_TOP).astype(np.int64)
    start = np.arange(len(place))
    piece = np.searchsorted(ends, start, "right")
    valid = start + length <= ends[piece]
    head = valid.copy()
    head[1:] &= (place[1:] != place[:-1]) | (piece[1:] != piece[:-1]) | ~valid[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(start))
    many = np.minimum(last, ends[piece[first]] - length + 1) - first
    stop = first + many + length - 1
    content = rolling.of(first, stop)
    anchor = mix(rolling.of(place[first], place[first] + gram))
    # Where the anchor lies belongs to the content: equal bytes are one segment only if their starts have one anchor.
    second = mix(content * U64(0xA24BAED4963EE407) + rolling.of((first + stop) // 2, stop)) + (place[first] - first).astype(np.uint64)
    of = np.array([x[0] for x in pieces], np.int64)[piece[first]]
    offset = np.array([x[1] for x in pieces], np.int64) - (ends - sizes)
    return of, anchor, content, second, first + offset[piece[first]], many


def repeated_spans(texts: DataFrame, length: int, dense: int = DENSE, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(tid, spans) of the texts in which strings repeat. texts: tid (long, unique), body (binary), each body once.

    spans: array of (start, end) in bytes, ascending, disjoint and not touching: what strings of `length` bytes that start
    anywhere else cover.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid = np.asarray(batch["tid"])
            for of, anchor, c1, c2, lo, many in segments(batch["body"], length):
                yield pa.RecordBatch.from_arrays([pa.array(tid[of]), *(pa.array(x.view(np.int64)) for x in (anchor, c1, c2)), pa.array(lo), pa.array(many)], ["tid", "h", "c1", "c2", "lo", "many"])

    all_segments = written(texts.where(F.octet_length("body") >= length).mapInArrow(cut, "tid long, h long, c1 long, c2 long, lo long, many long"), "segments")
    content = ["h", "c1", "c2"]
    folded = written(all_segments.groupBy(*content).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("tid", "lo", "many")).alias("one")), "folded")
    anchors = folded.groupBy("h").agg(F.count(F.lit(1)).alias("different"), F.sum("times").alias("met")).where("met > 1").drop("met")
    known = written(join_hot(folded, anchors, ["h"], "different", folded.count()), "known")
    whole = known.where("times > 1").select(*content, "times", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("one.many").alias("b"))).alias("runs"))

    # One text of each segment that differs from others of its anchor, cut from a text that has it.
    wanted = known.where("different > 1").select("one.tid", F.struct(*content, "times", "different", F.col("one.lo").alias("lo"), F.col("one.many").alias("many")).alias("want"))
    asked = wanted.groupBy("tid").agg(F.collect_list("want").alias("wants"))
    parts = texts.join(asked, "tid").select("body", F.explode("wants").alias("w")).select("w.*", F.expr("substring(body, CAST(w.lo AS INT) + 1, CAST(w.many AS INT) + %d)" % (length - 1)).alias("bytes"))
    parts = written(parts, "parts")
    row = parts.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).alias("size")).first()
    tables = max(1, -(-row["size"] // table_bytes))

    def read(table: pa.Table) -> pa.Table:
        found = repeated_starts([x.as_py() for x in table["bytes"]], length)
        edges = [np.flatnonzero(np.diff(np.concatenate([[0], x.view(np.int8), [0]]))) for x in found]
        runs = [[{"a": int(a), "b": int(b)} for a, b in zip(e[::2], e[1::2], strict=True)] for e in edges]
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return pa.table({c: table[c] for c in (*content, "times")} | {"runs": pa.array(runs, kind)})

    answer = "h long, c1 long, c2 long, times long, runs array<struct<a:long,b:long>>"
    few = parts.where(F.col("different") <= dense).groupBy(F.pmod("h", F.lit(tables))).applyInArrow(read, answer)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in enumerate(batch["bytes"]):
                data = np.frombuffer(body.as_py(), np.uint8)
                rolling, at = Rolling(data), np.arange(len(data) - length + 1)
                x = rolling.of(at, at + length)
                y = mix(x * U64(0xA24BAED4963EE407) + rolling.of(at + length // 2, at + length))
                same = [pa.array(np.full(len(at), batch[c][i].as_py())) for c in (*content, "times")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], [*content, "times", "a", "x", "y"])

    strings = parts.where(F.col("different") > dense).mapInArrow(windows, "h long, c1 long, c2 long, times long, a long, x long, y long")
    counted = strings.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not parts.where(F.col("different") > dense).isEmpty():
        strings = written(strings, "strings")
        counted = strings.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        again = join_hot(strings, counted, ["x", "y"], "n", strings.count())
        runs = F.transform(F.collect_list("a"), lambda a: F.struct(a.alias("a"), (a + 1).alias("b")))
        few = few.unionByName(again.groupBy(*content).agg(F.first("times").alias("times"), runs.alias("runs")))
    answers = whole.unionByName(few.where("times = 1 AND size(runs) > 0"))

    hits = join_hot(all_segments, answers, content, "times", all_segments.count())
    spans = hits.select("tid", F.transform("runs", lambda r: F.struct((F.col("lo") + r["a"]).alias("a"), (F.col("lo") + r["b"] + length - 1).alias("b"))).alias("spans"))
    return spans.groupBy("tid").agg(F.flatten(F.collect_list("spans")).alias("spans")).mapInArrow(_merged, f"tid long, {_SPANS}")


_SPANS = "spans array<struct<a:long,b:long>>"
_SPANS_TYPE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans in ascending order, those that touch or overlap as one."""
    for batch in batches:
        rows = []
        for spans in batch["spans"].to_pylist():
            a, b = (np.array([s[k] for s in spans], np.int64) for k in "ab")
            by = np.argsort(a, kind="stable")
            a, b = a[by], np.maximum.accumulate(b[by])
            new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
            rows.append([{"a": int(x), "b": int(y)} for x, y in zip(a[new], b[np.append(new[1:] - 1, len(b) - 1)], strict=True)])
        yield pa.RecordBatch.from_arrays([batch["tid"], pa.array(rows, _SPANS_TYPE)], ["tid", "spans"])


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep: tuple[str, ...] = (), dense: int = DENSE, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts anywhere else, in the same text or another.

    Returns a row for each document: the id, the columns of `keep`, n_bytes, n_removed and n_spans (long), spans (array of
    the removed (a, b) in bytes, end exclusive) and kept (binary, as a cut can fall inside a character). Texts are read as
    UTF-8; strings never cross documents, overlaps count, and all are judged on the input. A null text has no bytes. Ids
    play no part: they may be null or repeated, and rows that are equal throughout are copies of each other, as any equal
    texts are. Columns other than these are dropped. No documents give no rows.
    """
    body = F.coalesce(F.encode(text_col, "utf-8"), F.lit(b""))
    rows = docs.select(*dict.fromkeys((id_col, *keep)), body.alias("__body")).withColumn("__key", F.when(F.octet_length("__body") >= length, F.unhex(F.sha2("__body", 256))))
    folded = rows.where("__key IS NOT NULL").groupBy("__key").agg(F.count(F.lit(1)).alias("__many"), F.first("__body").alias("body"))
    texts = written(folded.withColumn("tid", F.monotonically_increasing_id()), "texts")
    found = repeated_spans(texts.select("tid", "body"), length, dense, table_bytes)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.octet_length("body").cast("long").alias("b")))
    copied = texts.where("__many > 1").select("__key", "__many", all_of_it.alias("spans"))
    single = texts.where("__many = 1").select("tid", "__key", "__many").join(found, "tid").select("__key", "__many", "spans")
    removed = written(copied.unionByName(single), "removed")
    out = join_hot(rows, removed, ["__key"], "__many", texts.agg(F.sum("__many")).first()[0] or 0, "left").drop("__many")
    kept = [(f.name, f.dataType.simpleString()) for f in rows.drop("__body", "__key").schema]
    ddl = ", ".join(f"`{n}` {t}" for n, t in kept) + f", n_bytes long, n_removed long, n_spans long, {_SPANS}, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, count, left, cuts = [], [], [], [], []
            for text, spans in zip(batch["__body"], batch["spans"].to_pylist(), strict=True):
                data, spans = text.as_py(), spans or []
                at = [0, *(x for s in spans for x in (s["a"], s["b"])), len(data)]
                left.append(b"".join(data[a:b] for a, b in zip(at[::2], at[1::2], strict=True)))
                n.append(len(data))
                gone.append(len(data) - len(left[-1]))
                count.append(len(spans))
                cuts.append(spans)
            own = [batch[name] for name, _ in kept]
            new = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(cuts, _SPANS_TYPE), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(own + new, [x for x, _ in kept] + ["n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return out.select(*(x for x, _ in kept), "__body", "spans").mapInArrow(cut, ddl)
