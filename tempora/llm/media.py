"""Media columns: baseline JPEG.

A payload is stored without loss as the DC coefficients of a grayscale baseline JPEG: with a DC quantiser of 8, a block
of 8 x 8 equal samples is one coefficient, so that the image's DC-only thumbnail is the payload again. Each row of blocks
is a restart interval. The decoder reads baseline JPEG in general (grayscale or several components, any sampling, with
or without restarts): it parses the markers, Huffman-decodes the scans of many images in step, one symbol of each
restart interval at a time, passes over AC coefficients, and returns luminance thumbnails of one sample a block.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tempora.llm.common import slices

#: Blocks in a row of an image, and rows in an image at most: JPEG counts samples in 16 bits.
ROW, MOST_ROWS = 192, 8191
#: Huffman codes of our files: numbers of codes by length, and their symbols. One AC symbol: end of block.
_DC_COUNTS, _DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (5, 6, 4, 7, 3, 2, 1, 0, 8, 9, 10, 11)
_AC_COUNTS, _AC_SYMBOLS = (1,) + (0,) * 15, (0,)


def _codes(counts: tuple, symbols: tuple) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in canonical order."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """For differences of -255 to 255: the bits of a block (DC code, extra bits, end of block) and their number."""
    dc = {s: (c, n) for s, c, n in _codes(_DC_COUNTS, _DC_SYMBOLS)}
    bits, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255], length[d + 255] = (code << size | extra) << 1, n + size + 1
    return bits, length


_BITS, _LENGTHS = _difference_codes()


def _header(rows: int) -> bytes:
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    table = lambda kind, counts, symbols: bytes([kind, *counts, *symbols])
    return (
        b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, bytes([0, 8, *[1] * 63]))
        + segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + b"\1\x11\0")
        + segment(0xC4, table(0x00, _DC_COUNTS, _DC_SYMBOLS) + table(0x10, _AC_COUNTS, _AC_SYMBOLS))
        + segment(0xDD, struct.pack(">H", ROW)) + segment(0xDA, b"\1\1\0\0\x3f\0")
    )


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of a positive multiple of ROW bytes, as one JPEG file, or several one after the other if it is long."""
    rows = [len(p) // ROW for p in payloads]
    values = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).astype(np.int16)
    step = np.diff(values, axis=1, prepend=np.int16(128)) + 255
    length = _LENGTHS[step]
    ends = np.cumsum(length, axis=1)
    wide = (ends[:, -1] + 7) // 8
    base = np.cumsum(wide) - wide
    at = ((base * 8)[:, None] + ends - length).ravel()
    shifted = _BITS[step].ravel() << (24 - (at & 7) - length.ravel()).astype(np.uint32)
    data = np.zeros(int(wide.sum()) + 2, np.float64)
    for k in range(3):
        data += np.bincount((at >> 3) + k, (shifted >> np.uint32(16 - 8 * k)) & np.uint32(255), len(data))
    data = data[:-2].astype(np.uint8)
    data[base + wide - 1] |= ((1 << (wide * 8 - ends[:, -1])) - 1).astype(np.uint8)
    full = data == 0xFF
    stuffed = np.cumsum(full) - full
    place = np.arange(len(data)) + stuffed + 2 * np.repeat(np.arange(len(wide)), wide)
    out = np.zeros(len(data) + int(full.sum()) + 2 * len(wide), np.uint8)
    out[place] = data
    tail = place[base + wide - 1] + 1 + full[base + wide - 1]
    which = np.concatenate([np.arange(n) for n in rows])
    last = np.zeros(len(wide), bool)
    last[np.cumsum(rows) - 1] = True
    last |= which % MOST_ROWS == MOST_ROWS - 1
    out[tail] = 0xFF
    out[tail + 1] = np.where(last, 0xD9, 0xD0 + which % MOST_ROWS % 8)
    flat, ends = out.tobytes(), tail + 2
    files, row = [], 0
    for n in rows:
        parts = []
        for a in range(0, n, MOST_ROWS):
            many = min(MOST_ROWS, n - a)
            begin = int(ends[row + a - 1]) if row + a else 0
            parts += [_header(many), flat[begin : int(ends[row + a + many - 1])]]
        files.append(b"".join(parts))
        row += n
    return files


class _Image:
    """The parsed markers of one JPEG image, and where its scan's intervals lie in the file."""

    def __init__(self, data: bytes, at: int):
        quant, huff, self.restart = {}, {}, 0
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no JPEG image")
        at += 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    quant[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    huff[body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xC0:
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                frame = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                parts = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
                break
        if len(parts) == 1:
            self.h = self.v = 1
            sampling = [(1, 1)]
        else:
            sampling = [frame[c][:2] for c, _ in parts]
            self.h, self.v = sampling[0]
        most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
        self.across, self.down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        self.scale = quant[frame[parts[0][0]][2]]
        #: What images decoded together share: blocks of each component in a unit, and its code tables.
        self.layout = tuple((h * v, huff[t >> 4], huff[0x10 | t & 15]) for (h, v), (_, t) in zip(sampling, parts, strict=True))
        self.intervals: list[tuple[int, int]] = []
        while True:
            end = data.find(b"\xff", at)
            begin = at
            while end >= 0 and data[end + 1] == 0:
                end = data.find(b"\xff", end + 2)
            if end < 0:
                raise ValueError("the scan has no end")
            self.intervals.append((begin, end))
            at = end + 2
            if not 0xD0 <= data[end + 1] <= 0xD7:
                break
        self.end = at


    def missing(self) -> bool:
        """Whether there are fewer restart intervals than the image needs."""
        units = self.across * self.down
        return len(self.intervals) < (-(-units // self.restart) if self.restart else 1)


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: length of the code and its symbol, as length << 8 | symbol."""
    if table not in _LOOKUPS:
        out = np.zeros(1 << 16, np.int64)
        for symbol, code, n in _codes(tuple(table[:16]), tuple(table[16:])):
            out[code << 16 - n : code + 1 << 16 - n] = n << 8 | symbol
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


def _scan(data: np.ndarray, begin: np.ndarray, units: np.ndarray, layout: tuple) -> np.ndarray:
    """DC values of the first component, (interval, unit, block), of intervals that begin at these bits; data is unstuffed."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    word = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    at = begin.copy()
    most = len(word) * 8 - 17
    out = np.zeros((len(begin), int(units.max()), layout[0][0]), np.int64)
    before = np.zeros((len(begin), len(layout)), np.int64)

    def peek(rows: np.ndarray | slice) -> np.ndarray:
        p = np.minimum(at[rows], most)
        return (word[p >> 3] >> (16 - (p & 7)).astype(np.uint32)) & 0xFFFF

    for unit in range(out.shape[1]):
        live = slice(None) if unit < units.min() else np.flatnonzero(units > unit)
        for c, (blocks, dc, ac) in enumerate(layout):
            for block in range(blocks):
                found = _lookup(dc)[peek(live)]
                at[live] += found >> 8
                size = found & 255
                extra = (peek(live) >> (16 - size)).astype(np.int64)
                at[live] += size
                before[live, c] += np.where(extra < 1 << np.maximum(size - 1, 0), extra - (1 << size) + 1, extra) * (size > 0)
                if c == 0:
                    out[live, unit, block] = before[live, 0]
                rows, k = (live, None)
                while True:
                    found = _lookup(ac)[peek(rows)]
                    run, size = (found & 255) >> 4, found & 15
                    at[rows] += (found >> 8) + size
                    done = found & 255 == 0
                    if done.all():
                        break
                    index = np.arange(len(at))[rows]
                    k = (np.ones(len(index), np.int64) if k is None else k) + run + 1
                    stay = ~done & (k < 64)
                    rows, k = index[stay], k[stay]
                    if not len(rows):
                        break
    return out


def thumbnails(files: list[bytes]) -> list[list[np.ndarray]]:
    """The DC-only luminance thumbnails of each file's images."""
    images: list[list[_Image]] = []
    for data in files:
        own, at = [], 0
        while at < len(data):
            own.append(_Image(data, at))
            if not all((own[-1].width, own[-1].height)) or own[-1].missing():
                raise ValueError("the image has no size, or its scan is cut short")
            at = own[-1].end
        images.append(own)
    out: list[list] = [[None] * len(own) for own in images]
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, own in enumerate(images):
        for j, image in enumerate(own):
            groups.setdefault(image.layout, []).append((i, j))
    for layout, members in groups.items():
        parts, begin, units, at = [], [], [], 0
        for i, j in members:
            image = images[i][j]
            left = image.across * image.down
            for a, b in image.intervals:
                part = files[i][a:b].replace(b"\xff\x00", b"\xff")
                parts.append(part)
                begin.append(at * 8)
                at += len(part)
                units.append(min(left, image.restart or left))
                left -= units[-1]
        values = _scan(np.frombuffer(b"".join(parts), np.uint8), np.array(begin), np.array(units), layout)
        row = 0
        for i, j in members:
            image, n = images[i][j], len(images[i][j].intervals)
            own = np.concatenate([values[row + k, : units[row + k]] for k in range(n)]) if n > 1 and units[row] != units[row + n - 1] else values[row : row + n, : units[row]].reshape(-1, layout[0][0])
            row += n
            grid = own.reshape(image.down, image.across, image.v, image.h).transpose(0, 2, 1, 3).reshape(image.down * image.v, image.across * image.h)
            grid = np.clip(np.rint(grid * (image.scale / 8)) + 128, 0, 255).astype(np.uint8)
            out[i][j] = grid[: -(-image.height // 8), : -(-image.width // 8)]
    return out


def readable_thumbnails(files: list[bytes]) -> list[list[np.ndarray] | str]:
    """The thumbnails of each file, or what is wrong with it: files are read together, and one by one where that fails."""
    try:
        return thumbnails(files)
    except (ValueError, KeyError, IndexError, AttributeError, struct.error) as fault:
        if len(files) == 1:
            return [f"{type(fault).__name__}: {fault}"]
        half = len(files) // 2
        return readable_thumbnails(files[:half]) + readable_thumbnails(files[half:])


def thumbnail_hash(grid: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are brighter than its mean."""
    y, x = (np.arange(8) * n // 8 for n in grid.shape)
    cells = np.add.reduceat(np.add.reduceat(grid.astype(np.int64), y, 0), x, 1)
    tall, wide = (np.maximum(np.diff(np.append(e, n)), 1) for e, n in zip((y, x), grid.shape, strict=True))
    bits = cells * grid.size > int(grid.sum(dtype=np.int64)) * tall[:, None] * wide[None, :]
    return np.packbits(bits).tobytes().hex()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id_col, n_bytes (long) and media (binary): the text's UTF-8 as JPEG.

    Spaces fill the text up to a positive multiple of ROW bytes. A null text is stored as an empty one. Texts of more
    than ROW * MOST_ROWS bytes become several images in one value. Other columns are dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(1)):
                part = batch.slice(at, to - at)
                texts = [(t.as_py() or "").encode() for t in part.column(1)]
                files = encode([t + b" " * (max(1, -(-len(t) // ROW)) * ROW - len(t)) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media's columns, with payload (binary), payload_bytes, tail_crc32 (long), width and height (int) and thumb_hash (string).

    width and height are of the first image, thumb_hash of all its thumbnails. Null or empty media have an empty
    payload and null dimensions and hash; so have values that are cut short or aren't baseline JPEG, with the reason in
    error (string), which is null for all others. Repeated rows are read each; an empty table gives an empty one.
    """
    added = pa.schema([("payload", pa.binary()), ("payload_bytes", pa.int64()), ("tail_crc32", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("thumb_hash", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch.column(media_col)):
                part = batch.slice(at, to - at)
                files = [m or b"" for m in part.column(media_col).to_pylist()]
                rows = []
                for data, grids in zip(files, readable_thumbnails(files), strict=True):
                    if isinstance(grids, str):
                        rows.append((b"", 0, zlib.crc32(b""), None, None, None, grids))
                        continue
                    payload = b"".join(g.tobytes() for g in grids)
                    shape = (grids[0].shape[1] * 8, grids[0].shape[0] * 8) if grids else (None, None)
                    rows.append((payload, len(payload), zlib.crc32(payload[-16:]), *shape, "".join(map(thumbnail_hash, grids)) if grids else None, None))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, f.type) for c, f in zip(zip(*rows), added, strict=True))], names=[*part.schema.names, *added.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema)
    return media.mapInArrow(run, f"{kinds}, payload binary, payload_bytes long, tail_crc32 long, width int, height int, thumb_hash string, error string")


def digest(data: bytes) -> str:
    """The digest that the query reports, for tests."""
    return hashlib.sha256(data).hexdigest()
