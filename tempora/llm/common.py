"""What the training-data operators share: cutting lineage, word spans, hashes and packed integer arrays."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.session import shared_dir

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
#: The bytes that end a word: space and the five control characters from tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: what is read from now on survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def slices(texts: pa.Array, most_bytes: int = 1 << 21):
    """(from, to) runs of rows with about most_bytes of text each, so that temporary arrays stay small."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most_bytes:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


class Words:
    """The words of some texts: runs of bytes other than white space, over one byte buffer.

    start, end: byte offsets of each word; first: index of each text's first word, and the number of words.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        base = int(off[0])
        self.bytes = np.frombuffer(data, np.uint8)[base : int(off[-1])] if data is not None and off[-1] > base else np.zeros(0, np.uint8)
        off = off - base
        inside = ~_SPACE[self.bytes]
        n = len(inside)
        edge = off[off < n]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[edge] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self._inside = inside

    def of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lengths = self.end - self.start
        at = np.zeros(len(lengths), np.int64)
        np.cumsum(lengths[:-1], out=at[1:])
        powers = np.multiply.accumulate(np.full(int(lengths.max()), 0xD6E8FEB86659FD93, np.uint64))
        values = _BYTE[self.bytes[self._inside]]
        values *= powers[np.arange(len(values)) - np.repeat(at, lengths)]
        return mix(np.add.reduceat(values, at) + lengths.astype(np.uint64) * _ODD)


def windows(words: np.ndarray, first: np.ndarray, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of size words, index of its first word), for runs inside one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
    at = np.flatnonzero(left[:n] >= size)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= U64(base)
        out += words[j : j + n]
    return mix(out[at]), at


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes: high planes of small numbers cost almost nothing."""
    x = np.ascontiguousarray(x, "<u8")
    wide = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([wide]) + zlib.compress(x.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    wide = data[0]
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(wide, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :wide] = planes.T
    return out.view("<u8").reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned integers, by their differences."""
    return pack(np.diff(x, prepend=x.dtype.type(0)) if len(x) else x)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def text_size(docs: DataFrame, text: str) -> tuple[int, int]:
    """(rows, bytes of text): what block counts are derived from."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


#: Keys that hold more than a share of 1 in HOT of all rows are hot; there are at most HOT of them.
HOT = 1000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], many: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for each key, the number of left's rows with it (many), and what is wanted.

    total: the rows of left. Hot keys, of which there can't be more than HOT, are joined by broadcast, where their rows are;
    all others are joined by shuffle, where no key holds more than one row in HOT. how: 'inner' or 'left'.
    """
    hot, cold = right.where(F.col(many) * HOT > total), right.where(F.col(many) * HOT <= total)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return left.join(F.broadcast(hot), on).unionByName(rest)
