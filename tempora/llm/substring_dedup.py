"""Substring deduplication with a count-min prefilter.

Documents are dealt into blocks. Every block counts its windows of `window` words in a count-min sketch; the sketches, cut
into shards of the hash range, are added up by a shuffle, and each block gets back which of its cells count more than it put
there itself. A window all of whose cells do is estimated repeated elsewhere: the estimate can be too high, never too low,
so that none is lost. A second pass groups just those windows exactly, by 96 bits of hash, and tells each block which of its windows
start in a smaller document elsewhere. Repeats inside a block are settled there.

Only packed integers travel besides the text, which is dealt out once, by a hash of the whole row, so that an id that many
rows have is no hot key. Both counts, blocks and shards, grow with the input; a passage that a third of all documents share
is one entry a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import U64, Words, mix, pack, pack_sorted, slices, text_size, unpack, unpack_sorted, windows

BLOCK = "__tempora_block"
NO_ID = np.iinfo(np.int64).max
#: Cells of one row of a shard's sketch, as a power of two, and the windows dealt to a shard on average.
CELL_BITS, SHARD_WINDOWS = 24, 3_000_000
_ROWS = (U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F))


class _Block:
    """One block's windows, the same each time they are computed."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int, shards: int):
        ids = pc.fill_null(table[id_col].cast(pa.int64()), NO_ID).combine_chunks()
        self.order = np.lexsort((np.arange(len(ids)), np.asarray(ids)))
        table = table.take(pa.array(self.order))
        self.table, self.ids = table, np.asarray(ids)[self.order]
        texts = table[text_col].combine_chunks()
        h1, h2, at, doc, firsts, words = [], [], [], [], [np.zeros(1, np.int64)], 0
        for a, b in slices(texts):
            w = Words(texts.slice(a, b - a))
            hashes = w.hashes()
            x, where = windows(hashes, w.first, window, 0xC2B2AE3D27D4EB4F)
            y, _ = windows(mix(hashes ^ U64(0x27D4EB2F165667C5)), w.first, window, 0x9FB21C651E98DF25)
            h1.append(x)
            h2.append((y >> U64(32)).astype(np.uint32))
            at.append(where + words)
            doc.append(np.searchsorted(w.first, where, "right") - 1 + a)
            firsts.append(w.first[1:] + words)
            words += len(hashes)
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        h1, h2, self.at, doc = cat(h1, np.uint64), cat(h2, np.uint32), cat(at, np.int64), cat(doc, np.int64)
        self.first = np.concatenate(firsts)
        self.window_id = self.ids[doc] if len(doc) else np.zeros(0, np.int64)
        by = np.argsort(h1, kind="stable")
        same = h1[by][1:] == h1[by][:-1]
        if (h2[by][1:][same] != h2[by][:-1][same]).any():
            by = np.lexsort((h2, h1))
        x, y = h1[by], h2[by]
        new = np.ones(len(by), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        heads = np.flatnonzero(new)
        #: For each distinct window: both hashes and the smallest id here; group: the distinct window of each window.
        self.h1, self.h2 = x[heads], y[heads]
        self.least = np.minimum.reduceat(self.window_id[by], heads) if len(heads) else np.zeros(0, np.int64)
        self.group = np.empty(len(by), np.int64)
        self.group[by] = np.cumsum(new) - 1
        self.times = np.diff(np.append(heads, len(by))).astype(np.uint64)
        shard = (self.h1 >> U64(32)) * U64(shards) >> U64(32)
        self.bounds = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))

    def shards(self) -> Iterator[tuple[int, int, int]]:
        for s in range(len(self.bounds) - 1):
            if self.bounds[s] < self.bounds[s + 1]:
                yield s, int(self.bounds[s]), int(self.bounds[s + 1])

    def cells(self, a: int, b: int, row: int) -> np.ndarray:
        return mix(self.h1[a:b] ^ _ROWS[row]) >> U64(64 - CELL_BITS)

    def counts(self, a: int, b: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        """(cells, windows counted in each) of one row of the sketch."""
        cells, inverse = np.unique(self.cells(a, b, row), return_inverse=True)
        return cells, np.bincount(inverse, self.times[a:b].astype(np.float64), len(cells)).astype(np.uint64)

    def repeated(self, answers: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
        """Of each distinct window, whether the merged sketch estimates that another block has it."""
        out = np.ones(len(self.h1), bool)
        for s, a, b in self.shards():
            for row in (0, 1):
                _, inverse = np.unique(self.cells(a, b, row), return_inverse=True)
                out[a:b] &= np.unpackbits(np.frombuffer(answers[s][row], np.uint8))[inverse].astype(bool)
        return out


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


_SKETCH = pa.schema([(BLOCK, pa.int64()), ("shard", pa.int32()), ("kind", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])
_DDL = f"{BLOCK} long, shard int, kind int, x binary, y binary, z binary"


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, keep: tuple[str, ...] = (), block_bytes: int = 4 << 20) -> DataFrame:
    """Remove each word covered by a window of `window` words that also starts in a document with a smaller id.

    Returns a row for each document: the id, the columns of `keep`, n_words and n_removed (long), and kept_text, the
    words kept, joined by one space. Words are runs of bytes other than ASCII white space. Windows are judged on the
    input. A null text has no words; a text shorter than the window loses none. Rows with a null id count as larger
    than all others; rows with equal ids never remove words from each other. Columns other than these are dropped.
    """
    rows, size = text_size(docs, text_col)
    blocks = max(1, min(rows, -(-size // block_bytes)))
    shards = max(1, -(-size // (6 * SHARD_WINDOWS)))
    dealt = docs.select(*dict.fromkeys((id_col, text_col, *keep)), F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).alias(BLOCK))
    grouped = dealt.groupBy(BLOCK)

    def sketch(table: pa.Table) -> pa.Table:
        block, out = _Block(table, id_col, text_col, window, shards), []
        key = table[BLOCK][0].as_py()
        for s, a, b in block.shards():
            (x, n), (y, m) = (block.counts(a, b, row) for row in (0, 1))
            out.append((key, s, 0, pack_sorted(x), pack_sorted(y), pack(np.concatenate([n, m]))))
        return _rows(_SKETCH, out)

    def merge(table: pa.Table) -> pa.Table:
        answers: list[list] = [[k, s, 1, b"", b"", b""] for k, s in zip(table[BLOCK].to_pylist(), table["shard"].to_pylist(), strict=True)]
        for row, column in enumerate(("x", "y")):
            total = np.zeros(1 << CELL_BITS, np.uint32)

            def own(cells: pa.Scalar, counts: pa.Scalar, row: int = row) -> tuple[np.ndarray, np.ndarray]:
                cells, counts = unpack_sorted(cells.as_py()), unpack(counts.as_py())
                return cells, counts[len(counts) - len(cells) :] if row else counts[: len(cells)]

            for value, counts in zip(table[column], table["z"], strict=True):
                cells, n = own(value, counts)
                total[cells] += n.astype(np.uint32)
            for answer, value, counts in zip(answers, table[column], table["z"], strict=True):
                cells, n = own(value, counts)
                answer[3 + row] = np.packbits(total[cells] > n).tobytes()
        return _rows(_SKETCH, answers)

    def answered(table: pa.Table) -> dict[int, tuple[bytes, bytes]]:
        return {s: (x, y) for s, k, x, y in zip(*(table[c].to_pylist() for c in ("shard", "kind", "x", "y")), strict=True) if k == 1}

    def candidates(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if table.num_rows:
            block, key = _Block(table, id_col, text_col, window, shards), table[BLOCK][0].as_py()
            many = block.repeated(answered(answers))
            for s, a, b in block.shards():
                if (part := np.flatnonzero(many[a:b]) + a).size:
                    out.append((key, s, 2, pack_sorted(block.h1[part]), pack(block.h2[part]), pack(block.least[part].view(np.uint64))))
        return _rows(_SKETCH, out)

    def exact(table: pa.Table) -> pa.Table:
        h1 = [unpack_sorted(x.as_py()) for x in table["x"]]
        ends = np.cumsum([len(x) for x in h1])
        h1 = np.concatenate(h1)
        h2 = np.concatenate([unpack(x.as_py()).astype(np.uint32) for x in table["y"]])
        least = np.concatenate([unpack(x.as_py()).view(np.int64) for x in table["z"]])
        by = np.lexsort((h2, h1))
        x, y = h1[by], h2[by]
        new = np.ones(len(by), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        low = np.minimum.reduceat(least[by], np.flatnonzero(new))
        smaller = np.empty(len(by), bool)
        smaller[by] = low[np.cumsum(new) - 1] < least[by]
        keys, shard = table[BLOCK].to_pylist(), table["shard"].to_pylist()
        return _rows(_SKETCH, [(k, s, 3, np.packbits(part).tobytes(), b"", b"") for k, s, part in zip(keys, shard, np.split(smaller, ends[:-1]), strict=True)])

    kept_types = [(f.name, f.dataType.simpleString()) for f in docs.select(id_col, *keep).schema]
    ddl = ", ".join(f"`{n}` {t}" for n, t in kept_types) + ", n_words long, n_removed long, kept_text string"

    def clean(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], table[n].type) for n, _ in kept_types} | {"n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        block = _Block(table, id_col, text_col, window, shards)
        many = block.repeated(answered(answers))
        smaller = np.zeros(len(many), bool)
        flags = {s: x for s, k, x in zip(*(answers[c].to_pylist() for c in ("shard", "kind", "x")), strict=True) if k == 3}
        for s, a, b in block.shards():
            if (part := np.flatnonzero(many[a:b]) + a).size:
                smaller[part] = np.unpackbits(np.frombuffer(flags[s], np.uint8))[: len(part)].astype(bool)
        hit = block.at[(block.least[block.group] < block.window_id) | smaller[block.group]]
        cover = np.zeros(int(block.first[-1]) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        texts, removed = [], []
        for i, text in enumerate(block.table[text_col]):
            words = (text.as_py() or "").encode().split()
            drop = gone[block.first[i] : block.first[i + 1]]
            if (n := int(drop.sum())) :
                words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
            removed.append(n)
            texts.append(b" ".join(words).decode())
        columns = {n: block.table[n] for n, _ in kept_types}
        return pa.table(columns | {"n_words": pa.array(np.diff(block.first)), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.string())})

    estimates = grouped.applyInArrow(sketch, _DDL).groupBy("shard").applyInArrow(merge, _DDL)
    found = grouped.cogroup(estimates.groupBy(BLOCK)).applyInArrow(candidates, _DDL)
    flags = found.groupBy("shard").applyInArrow(exact, _DDL)
    return grouped.cogroup(estimates.unionByName(flags).groupBy(BLOCK)).applyInArrow(clean, ddl)


def kept_digest(kept: str) -> str:
    """The digest that the query reports, for tests."""
    return hashlib.sha256(kept.encode()).hexdigest()
