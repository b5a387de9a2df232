"""Resampling of documents by the importance of their n-grams for a target, over a dictionary of distinct features.

A text's features are its runs of one to three words. Texts are read in blocks of some megabytes; a block folds its n-grams
and sends each distinct one once, as a string, with the documents that have it and how often. Three-word strings are dealt by
a hash of their first two words and carry the two-word string as their prefix; single words are dealt by the word. A shard
puts the strings of all blocks into one dictionary, counts them over the corpus, hashes each distinct string once, and adds
its counts up by bucket. From the buckets of the corpus and of the target come the gains. The gains are joined back to the
shards: the gain of a block's string, hashed on from its first two words to all three, times its count in a document goes to
that document's weight, summed inside a block's part of a shard before it travels.

A string, however frequent, is one entry of a block, so that a shard holds what some tens of megabytes of text give. Both
numbers, of blocks and of shards, grow with the input; a block has a row for a shard only if it has strings there, so there
are never more rows than distinct strings in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import U64, mix, slices, text_size, written
from tempora.llm.suffix_groups import Rolling

BUCKETS = 10_000
#: Bytes of text of a block, and of text dealt to a shard on average.
BLOCK_BYTES, SHARD_BYTES = 6 << 20, 8 << 20
#: Rows of a range of scores.
RANGE_ROWS = 100_000
SHARD = "__tempora_shard"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: The bytes of words: digits, letters without case, and all of other scripts.
_INSIDE = np.zeros(256, bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> 1 ^ np.uint32(0xEDB88320), x >> 1).astype(np.uint32)
    return x


_CRC = _crc_table()


def _crc_states(body: np.ndarray, start: np.ndarray, end: np.ndarray, states: np.ndarray | None = None) -> np.ndarray:
    """The CRC-32 of the strings [start, end), from these states on: all strings a byte further at a time, the longest first."""
    sizes = end - start
    most = int(sizes.max(initial=0))
    by = np.argsort(-sizes.astype(np.int16 if most < 1 << 15 else np.int64), kind="stable")
    at, crc = start[by], np.full(len(by), 0xFFFFFFFF, np.uint32) if states is None else states[by]
    falling = -sizes[by]
    for k in range(most):
        n = int(np.searchsorted(falling, -k, "left"))
        crc[:n] = _CRC[(crc[:n] ^ body[at[:n] + k]) & 0xFF] ^ crc[:n] >> np.uint32(8)
    out = np.empty(len(by), np.uint32)
    out[by] = crc
    return out


def crc32s(strings: pa.Array) -> np.ndarray:
    """The CRC-32 of each binary string."""
    strings = strings.cast(pa.large_binary())
    _, offsets, data = strings.buffers()
    off = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return _crc_states(body, off[:-1], off[1:]) ^ np.uint32(0xFFFFFFFF)


class _Words:
    """The words of some texts, A-Z lower-cased: code of each word (in order of their bytes), first word of each text, and the distinct words."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        base = int(off[0])
        body = _LOWER[np.frombuffer(data, np.uint8)[base : int(off[-1])]] if data is not None and off[-1] > base else np.zeros(0, np.uint8)
        off = off - base
        inside = _INSIDE[body]
        n = len(inside)
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        starts[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        bounds = np.zeros(len(first) + 1, np.int64)
        np.cumsum(last - first, out=bounds[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(body[inside])]).dictionary_encode()
        by = np.asarray(pc.sort_indices(words.dictionary))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.distinct = words.dictionary.take(pa.array(by))
        self.code = rank[np.asarray(words.indices)]
        self.first = np.searchsorted(first, off)


def _spelled(distinct: pa.Array, parts: list[np.ndarray], end: int) -> pa.Array:
    """Strings of the words with these codes, joined by one space, each with a byte at its end; a code of -1 is no word."""
    _, offsets, data = distinct.buffers()
    off = np.frombuffer(offsets, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    body = np.frombuffer(data, np.uint8)
    sizes = np.diff(off)
    n = len(parts[0])
    lengths = [np.where(p >= 0, sizes[p] + (k > 0), 0) for k, p in enumerate(parts)]
    bounds = np.zeros(n + 1, np.int64)
    np.cumsum(sum(lengths) + 1, out=bounds[1:])
    out = np.full(int(bounds[-1]), 0x20, np.uint8)
    out[bounds[1:] - 1] = end
    to = bounds[:-1].copy()
    for k, (p, length) in enumerate(zip(parts, lengths, strict=True)):
        # Places of single bytes are made for some strings at a time.
        for lo in range(0, n, 1 << 16):
            have = np.flatnonzero(length[lo : lo + (1 << 16)]) + lo
            size = sizes[p[have]]
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(to[have] + (k > 0), size) + step] = body[np.repeat(off[p[have]], size) + step]
        to += length
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(out)])


_PACKED = pa.Codec("zstd", compression_level=6)


def _zip(x: np.ndarray) -> bytes:
    """Integers as compressed bytes; the type is the narrowest that holds them."""
    x = np.asarray(x)
    top = int(x.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    raw = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unzip(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    width, size = data[0], int.from_bytes(data[1:9], "little")
    raw = np.frombuffer(pa.decompress(data[9:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").reshape(-1).astype(np.int64)


#: kind 0: a block's documents (ids, n_features, n_words). kind 1: single words; kind 3: three words, or a text's last two.
#: text: the row's strings, sorted, a line each.
_ROW = pa.schema([(SHARD, pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("m", pa.list_(pa.int64())), ("text", pa.binary()), ("copies", pa.binary()), ("doc", pa.binary()), ("times", pa.binary())])
_ROW_DDL = f"{SHARD} int, block long, kind int, ids array<long>, n array<long>, m array<long>, text binary, copies binary, doc binary, times binary"


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where a new value starts in columns that are sorted together."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _sent(shard: np.ndarray, distinct: pa.Array, parts: list[np.ndarray], doc: np.ndarray, block: int, kind: int) -> Iterator[tuple]:
    """Rows for the shards of a block: each distinct n-gram once, with its documents and counts. One entry for each place."""
    # Places come in the order of their texts, which stable sorts keep.
    key, wide = np.zeros(len(shard), np.int64), len(distinct) + 1
    if wide ** len(parts) < 1 << 63:
        for p in parts:
            key = key * wide + (p + 1)
        by = np.argsort(key, kind="stable")
    else:
        by = np.lexsort(parts[::-1])
    by = by[np.argsort(shard[by].astype(np.uint16 if shard.max(initial=0) < 1 << 16 else np.int32), kind="stable")]
    shard, doc, parts = shard[by], doc[by], [p[by] for p in parts]
    pairs = _runs([shard, *parts, doc])
    times = np.diff(np.append(pairs, len(shard)))
    heads = _runs([shard[pairs], *(p[pairs] for p in parts)])
    copies = np.diff(np.append(heads, len(pairs)))
    at = pairs[heads]
    strings = _spelled(distinct, [p[at] for p in parts], 0x0A)
    bounds = np.frombuffer(strings.buffers()[1], np.int64)[: len(at) + 1]
    body = memoryview(strings.buffers()[2]) if len(at) else b""
    edges = _runs([shard[at]]) if len(at) else np.zeros(0, np.int64)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=True):
        c, d = int(heads[a]), int(heads[b]) if b < len(heads) else len(pairs)
        raw = bytes(body[int(bounds[a]) : int(bounds[b])])
        packed = len(raw).to_bytes(8, "little") + _PACKED.compress(raw, asbytes=True)
        yield (int(shard[at[a]]), block, kind, None, None, None, packed, _zip(copies[a:b]), _zip(doc[pairs[c:d]]), _zip(times[c:d]))


def _block(ids: list, texts: pa.Array, block: int, shards: int) -> Iterator[tuple]:
    words = _Words(texts)
    code, first = words.code, words.first
    count = np.diff(first)
    n = count + np.maximum(count - 1, 0) + np.maximum(count - 2, 0)
    yield (block % shards, block, 0, ids, n.tolist(), count.tolist(), b"", b"", b"", b"")
    if not len(code):
        return
    doc = np.repeat(np.arange(len(count)), count)
    off = np.frombuffer(words.distinct.buffers()[1], np.int64)[words.distinct.offset : words.distinct.offset + len(words.distinct) + 1]
    hashed = _hashes(np.frombuffer(words.distinct.buffers()[2], np.uint8), off)
    of = lambda h: ((h >> U64(33)) * U64(shards) >> U64(31)).astype(np.int32)
    yield from _sent(of(hashed[code]), words.distinct, [code], doc, block, 1)
    left = np.repeat(first[1:], count) - np.arange(len(code))
    at = np.flatnonzero(left >= 2)
    second = code[at + 1]
    third = np.where(left[at] >= 3, code[np.minimum(at + 2, len(code) - 1)], -1)
    yield from _sent(of(mix(hashed[code[at]] * U64(0x9E3779B97F4A7C15) + hashed[second])), words.distinct, [code[at], second, third], doc[at], block, 3)


def _hashes(body: np.ndarray, off: np.ndarray) -> np.ndarray:
    rolling = Rolling(body[: int(off[-1])])
    return rolling.of(off[:-1], off[1:])


def _features(shards: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch["id"].to_pylist(), batch["text"]
            for a, b in slices(texts, block_bytes):
                pa.default_memory_pool().release_unused()
                rows = _block(ids[a:b], texts.slice(a, b - a), (task << 32) + k, shards)
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)

    return run


def _cut(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings [start, end) of a buffer: ascending, not empty, not touching."""
    edge = np.zeros(len(body) + 1, np.int8)
    edge[start], edge[end] = 1, -1
    kept = body[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(0, np.cumsum(end - start))), pa.py_buffer(kept)])


class _Row:
    """A block's strings in a shard, read from row i of a table when they are asked for."""

    def __init__(self, table: pa.Table, i: int):
        self.table, self.i = table, i
        self.block, self.kind = table["block"][i].as_py(), table["kind"][i].as_py()

    def _numbers(self, column: str) -> np.ndarray:
        return _unzip(self.table[column][self.i].as_py())

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The row's bytes, and of each string where it starts, where its first two words end and where it ends."""
        packed = self.table["text"][self.i].as_py()
        body = np.frombuffer(_PACKED.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True), np.uint8)
        end = np.flatnonzero(body == 0x0A)
        start = np.append(0, end[:-1] + 1)
        if self.kind == 1:
            return body, start, end, end
        # A string's second space, if it has one, ends its first two words.
        space = np.flatnonzero(body == 0x20)
        return body, start, np.minimum(np.append(space, len(body))[np.minimum(np.searchsorted(space, start) + 1, len(space))], end), end

    def gains(self, gain: np.ndarray) -> np.ndarray:
        """Of each string the gains of its features: of a word, or of the first two words and of all three, if there are three."""
        body, start, pair, end = self.lines()
        state = _crc_states(body, start, pair)
        out = gain[_bucket(state ^ np.uint32(0xFFFFFFFF))]
        full = np.flatnonzero(pair < end)
        out[full] += gain[_bucket(_crc_states(body, pair[full], end[full], state[full]) ^ np.uint32(0xFFFFFFFF))]
        return out

    def strings(self, feature: int) -> tuple[pa.Array, np.ndarray]:
        """(distinct strings of so many words, the place among them of each string of the row, -1 if it isn't one)."""
        body, start, pair, end = self.lines()
        if feature == 3:
            full = pair < end
            return _cut(body, start[full], end[full]), np.where(full, np.cumsum(full) - 1, -1)
        if feature == 2:
            coded = _cut(body, start, pair).dictionary_encode()
            return coded.dictionary, np.asarray(coded.indices)
        return _cut(body, start, end), np.arange(len(start))

    def met(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string of the row, document, how often), for each string and document that has it."""
        copies = self._numbers("copies")
        return np.repeat(np.arange(len(copies)), copies), self._numbers("doc"), self._numbers("times")


#: Words of a feature, and the kind of row that has it.
_FEATURES = {1: 1, 2: 3, 3: 3}


def _dictionary(rows: list[_Row], words: int) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """(distinct strings of so many words in these rows, for each row the places among them of its own distinct strings, and
    which of these each string of the row has, -1 for none); rows of another kind have none."""
    parts, places = [], []
    for r in rows:
        strings, place = r.strings(words) if r.kind == _FEATURES[words] else (pa.array([], pa.large_binary()), np.zeros(0, np.int64))
        parts.append(strings)
        places.append(place.astype(np.int32))
    coded = pa.chunked_array(parts, pa.large_binary()).combine_chunks().dictionary_encode()
    ends = np.cumsum([len(x) for x in parts])[:-1] if parts else []
    return coded.dictionary, np.split(np.asarray(coded.indices), ends), places


def _bucket(crc: np.ndarray) -> np.ndarray:
    return (crc % np.uint32(BUCKETS)).astype(np.int32)


def _buckets(strings: pa.Array) -> np.ndarray:
    return _bucket(crc32s(strings))


def _bucket_counts(table: pa.Table) -> pa.Table:
    """The counts of a shard's strings by bucket: strings are counted, each is hashed once, counts are added up."""
    rows = [_Row(table, i) for i in range(table.num_rows)]
    total = np.zeros(BUCKETS)
    for words, kind in _FEATURES.items():
        known, codes, places = _dictionary(rows, words)
        count = np.zeros(len(known))
        for r, own, place in zip(rows, codes, places, strict=True):
            if r.kind == kind:
                of, _, times = r.met()
                here = place[of]
                have = here >= 0
                # Strings are distinct in a row.
                count[own] += np.bincount(here[have], times[have], len(own))
        total += np.bincount(_buckets(known), count, BUCKETS)
        del known, codes, places
        pa.default_memory_pool().release_unused()
    at = np.flatnonzero(total)
    return pa.table({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at].astype(np.int64))})


_PART = "block long, ids array<long>, n array<long>, m array<long>, doc binary, weight array<long>"
_PART_TYPES = {"block": pa.int64(), "ids": pa.list_(pa.int64()), "n": pa.list_(pa.int64()), "m": pa.list_(pa.int64()), "doc": pa.binary(), "weight": pa.list_(pa.int64())}


def _weighed(table: pa.Table, gains: pa.Table) -> pa.Table:
    """For each row of a shard, the gains of its strings summed by document; rows of documents pass through."""
    out: list[tuple] = []
    if table.num_rows:
        gain = np.asarray(gains["gains"][0].values, np.int64)
        for r in (_Row(table, i) for i in range(table.num_rows)):
            if not r.kind:
                out.append((r.block, *(table[c][r.i].as_py() for c in ("ids", "n", "m")), b"", None))
                continue
            of, doc, times = r.met()
            weight = np.bincount(doc, r.gains(gain)[of] * times).astype(np.int64)
            met = np.flatnonzero(np.bincount(doc))
            out.append((r.block, None, None, None, _zip(met), weight[met].tolist()))
            pa.default_memory_pool().release_unused()
    return pa.table({name: pa.array([row[k] for row in out], kind) for k, (name, kind) in enumerate(_PART_TYPES.items())})


def _summed(table: pa.Table) -> pa.Table:
    """The weights of a block's documents: what its parts of all shards give."""
    head = next(row for row in table.select(["ids", "n", "m"]).to_pylist() if row["ids"] is not None)
    weight = np.zeros(len(head["ids"]), np.int64)
    for doc, part in zip(table["doc"], table["weight"], strict=True):
        if part.is_valid:
            weight[_unzip(doc.as_py())] += np.asarray(part.values, np.int64)
    return pa.table({"id": pa.array(head["ids"], pa.int64()), "n_features": pa.array(head["n"], pa.int64()), "n_words": pa.array(head["m"], pa.int64()), "weight": pa.array(weight)})


def gain(t: Column, s: Column, total_t: Column, total_s: Column) -> Column:
    """floor(1000 ln ((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))), in doubles."""
    d = lambda c: c.cast("double")
    return F.floor(F.lit(1000.0) * F.ln((d(t) + 1.0) * (d(total_s) + float(BUCKETS)) / ((d(s) + 1.0) * (d(total_t) + float(BUCKETS))))).cast("long")


def _spread(docs: DataFrame, id_col: str | None, text_col: str, block_bytes: int, shard_bytes: int) -> tuple[DataFrame, int]:
    _, size = text_size(docs, text_col)
    shards = max(1, -(-size // shard_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id") if id_col else F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_features(shards, block_bytes), _ROW_DDL), shards


def importance_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, n_features, n_words, weight) of each document: the gains of its features, summed.

    A-Z are lower-cased; words are runs of digits, letters and all characters from U+0080 on; features are runs of 1 to 3
    words, joined by one space, repeats counted. A feature's bucket is the CRC-32 of its bytes modulo BUCKETS. Texts that
    are null or have no words have no features and weigh 0. Ids may be null or repeat; each row is a document of its own.
    Other columns are dropped. Either table may be empty.
    """
    rows, shards = _spread(docs, id_col, text_col, block_bytes, shard_bytes)
    wanted, _ = _spread(target, None, target_text_col, block_bytes, shard_bytes)
    count = lambda r, name: r.groupBy(SHARD).applyInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))
    buckets = count(rows, "s").join(count(wanted, "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    # One row: all buckets, those of no feature too. Its size is fixed; each shard gets a copy.
    found = buckets.agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("s", "t").alias("v")))).alias("b"), F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T"))
    none = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    of = lambda i: F.coalesce(F.col("b")[i], none)
    vector = found.select(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: gain(of(i)["t"], of(i)["s"], F.col("T"), F.col("S"))).alias("gains"))
    copies = vector.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias(SHARD), "gains")
    parts = rows.groupBy(SHARD).cogroup(copies.groupBy(SHARD)).applyInArrow(_weighed, _PART)
    return parts.groupBy("block").applyInArrow(_summed, "id long, n_features long, n_words long, weight long").withColumnRenamed("id", id_col)


def resample(weights: DataFrame, id_col: str = "doc_id", percent: int = 5, seed: int = 42, least_words: int = 20) -> DataFrame:
    """weights with score and rank: the floor(percent N / 100) largest scores of the N documents of least_words or more.

    score is the weight plus a Gumbel variable from a hash of `seed:id` in thousandths: the largest scores are a sample
    without replacement, by importance. Ranks go down the scores, ties to the smaller id, a null id last (it is hashed as an
    empty string); equal rows are numbered in any order. The rank of what isn't drawn is null.

    Ranks come from ranges of (score, id): counts of the ranges before, of which there are as many as partitions, and a
    number inside each range that can be drawn from.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(weights.withColumn("score", F.col("weight") + noise), "scored")
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("weight"), F.asc("n_features")]
    enough = scored.where(F.col("n_words") >= least_words)
    n = enough.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    dealt = written(enough.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = dealt.join(F.broadcast(before.select("__range", F.coalesce("before", F.lit(0)).alias("before"))), "__range")
    drawn = n * percent // 100
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("before")
    columns = scored.columns
    top = ranked.where(F.col("before") < drawn).withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*columns, "rank")
    rest = ranked.where(F.col("before") >= drawn).select(*columns, F.lit(None).cast("long").alias("rank"))
    short = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return top.unionByName(rest).unionByName(short)
