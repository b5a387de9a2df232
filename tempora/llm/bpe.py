"""BPE encoding and decoding by a tokenization automaton.

Compiling (`compile_vocabulary`, once, on the driver) builds a deterministic automaton over tokens, whose paths are exactly
the correct tokenizations. It starts with one state that every character leads back to. Each merge (x, y), in order, is a
gadget: where an x-arc is followed by a y-arc, an arc for the new token xy is put beside the x-arc, leading where the y-arc
leads, and the state behind the x-arc loses its y-arc. A state is shared by all tokens after which the same tokens may
follow, and a column of the transition table by all tokens that the same states allow; a gadget splits a state or a column
only when it is about to differ, so that the table of a vocabulary of 49,000 tokens has some 11,600 states and 14,000
columns, one bit each.

Words are read one byte at a time by a second automaton, made of the first and of the tree of token spellings: its states
are what is still open (places in the tree, each with the token state before it) and the one token that ends here. Every
prefix of a word has exactly one correct tokenization, so that this automaton is deterministic; its transition table is
filled as bytes are met (at most STATES states are kept, after which it starts anew) and the tokens of a word are read off
backwards from its last state. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The byte alphabet of byte-level BPE, a published convention: printable bytes stand for themselves, others for
#: characters from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_BYTES = {c: b for b, c in BYTE_CHARS.items()}
#: White space as the vocabulary's pre-tokenizer knows it; unlike str.split(), without U+001C to U+001F.
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACES = re.compile("[\x1c-\x1f]")
#: Letters and numbers of later Unicode versions than the tokenizers library knows as such.
_LATER = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191
191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
#: Small letters that the library knows and Python's tables may not, by their capitals.
_LOWER = {0x03A3: 0x03C3, 0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5}
_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Words kept by a worker with their tokens, and states of its byte automaton; both are emptied when full.
_CACHE, STATES = 250_000, 300_000


def _word_pattern(pattern: str) -> regex.Pattern:
    """The pre-tokenizer's pattern, with letters and numbers as the library knows them."""
    later = "".join("-".join(f"\\U{int(x, 16):08x}" for x in run.split("-")) for run in _LATER.split())
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--[{later}]]")
    return regex.compile(pattern, regex.V1)


class _Table:
    """Bits of (state, column), both shared until they differ."""

    def __init__(self, capacity: int):
        self.bits = np.zeros((capacity, capacity // 8), np.uint8)
        self.state_uses, self.column_uses = [0], [0]
        self.state_of: list[int] = []
        self.column_of: list[int] = []

    def allowed(self, u: int, v: int) -> bool:
        c = self.column_of[v]
        return bool(self.bits[self.state_of[u], c >> 3] >> (c & 7) & 1)

    def _room(self) -> None:
        if max(len(self.state_uses), len(self.column_uses)) + 1 >= len(self.bits):
            more = np.zeros((2 * len(self.bits), 2 * self.bits.shape[1]), np.uint8)
            more[: len(self.bits), : self.bits.shape[1]] = self.bits
            self.bits = more

    def add(self, state: int, column: int) -> None:
        """A token that leads to a state and shares a column."""
        self.state_of.append(state)
        self.column_of.append(column)
        self.state_uses[state] += 1
        self.column_uses[column] += 1

    def forbid(self, u: int, v: int) -> None:
        """Takes the v-arc from the state of u, alone."""
        self._room()
        s, c = self.state_of[u], self.column_of[v]
        if self.state_uses[s] > 1:
            self.state_uses[s] -= 1
            self.bits[len(self.state_uses)] = self.bits[s]
            s = self.state_of[u] = len(self.state_uses)
            self.state_uses.append(1)
        if self.column_uses[c] > 1:
            self.column_uses[c] -= 1
            new, n = len(self.column_uses), len(self.state_uses)
            self.bits[:n, new >> 3] |= (self.bits[:n, c >> 3] >> (c & 7) & 1) << (new & 7)
            c = self.column_of[v] = new
            self.column_uses.append(1)
        self.bits[s, c >> 3] &= ~np.uint8(1 << (c & 7))


def compile_vocabulary(spec: dict) -> dict:
    """The automaton over tokens, from the parsed JSON file of a word-end BPE tokenizer, with all that encoding needs.

    Where several merges make one token, each is a gadget of its own; tokens that no path reaches have no arcs.
    """
    model = spec["model"]
    suffix, vocab, merges = model["end_of_word_suffix"], model["vocab"], model["merges"]
    made = {x + y for x, y in merges}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ends = lambda t: len(t) > len(suffix) and t.endswith(suffix)
    table = _Table(1024)
    table.state_uses, table.column_uses = [0, 0, 0], [0]  # states: the end of a word, every character, the beginning
    table.bits[1:3, 0] = 1
    symbols: list[str] = []
    number: dict[str, int] = {}
    for token in vocab:
        if token not in made and token not in special:
            number[token] = len(symbols)
            symbols.append(token)
            table.add(0 if ends(token) else 1, 0)
    for x, y in merges:
        a, b, z = number.get(x), number.get(y), x + y
        if a is None or b is None or not table.allowed(a, b):
            continue  # no path has these arcs: the gadget finds nothing to do
        k = len(symbols)
        symbols.append(z)
        number.setdefault(z, k)
        table.add(table.state_of[b], table.column_of[a])
        table.forbid(a, b)
        if a == b:
            table.forbid(a, k)  # behind an x-arc there is no x-arc any more, nor one beside it
    n = len(table.state_uses)
    width = (len(table.column_uses) + 7) // 8
    # The beginning allows what any token may follow it: all of them.
    table.bits[2] = 0xFF
    spelled = [[_BYTES[c] for c in (t[: -len(suffix)] if ends(t) else t)] for t in symbols]
    for bytes_, t in zip(spelled, symbols, strict=True):
        if ends(t):
            bytes_[-1] += 256
    labels = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
    return {
        "bits": table.bits[:n, :width].tobytes(), "width": width, "state_of": table.state_of, "column_of": table.column_of, "spelled": spelled,
        "ids": [vocab[t] for t in symbols], "labels": labels, "special": special, "pattern": spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"],
    }


class Automaton:
    """A compiled vocabulary, ready to read words."""

    def __init__(self, compiled: dict):
        self.bits, self.width = compiled["bits"], compiled["width"]
        self.state_of, self.column_of, self.ids = compiled["state_of"], compiled["column_of"], compiled["ids"]
        self.lengths = list(map(len, compiled["spelled"]))
        self.labels, self.special = compiled["labels"], compiled["special"]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = _word_pattern(compiled["pattern"])
        #: The tree of spellings: node << 9 | byte leads to a node; 256 is added to the last byte of a word.
        self.tree: dict[int, int] = {}
        self.token_at: dict[int, list[int]] = {}
        self.inner: set[int] = {0}
        nodes = 1
        for symbol, bytes_ in enumerate(compiled["spelled"]):
            at = 0
            for b in bytes_:
                self.inner.add(at)
                if (to := self.tree.get(at << 9 | b)) is None:
                    to = self.tree[at << 9 | b] = nodes
                    nodes += 1
                at = to
            self.token_at.setdefault(at, []).append(symbol)
        self.known: dict[str, tuple[int, ...]] = {}
        self.cache: dict[str, bytes] = {}
        self._begin()

    @classmethod
    def load(cls, text: str) -> Automaton:
        return cls(compile_vocabulary(json.loads(text)))

    def _begin(self) -> None:
        self.next: dict[int, int] = {}
        self.open: list[tuple] = [((0, 2),)]
        self.ended: list[int] = [-1]
        self.index: dict[tuple, int] = {}

    def _step(self, state: int, byte: int) -> int:
        """The state that a byte leads to, put into the table."""
        still, ended = [], -1
        for node, before in self.open[state]:
            if (to := self.tree.get(node << 9 | byte)) is None:
                continue
            if to in self.inner:
                still.append((to, before))
            for symbol in self.token_at.get(to, ()):
                c = self.column_of[symbol]
                if self.bits[before * self.width + (c >> 3)] >> (c & 7) & 1:
                    ended = symbol
        if ended < 0:
            raise ValueError("the vocabulary lacks a byte")
        key = (ended, *still)
        if (out := self.index.get(key)) is None:
            out = self.index[key] = len(self.open)
            self.open.append((*still, (0, self.state_of[ended])))
            self.ended.append(ended)
        self.next[state << 9 | byte] = out
        return out

    def path(self, word: bytes) -> tuple[int, ...]:
        """The tokens of a word."""
        if len(self.open) > STATES:
            self._begin()
        state, passed, last = 0, [0], len(word) - 1
        for i, b in enumerate(word):
            b += 256 if i == last else 0
            if (to := self.next.get(state << 9 | b)) is None:
                to = self._step(state, b)
            passed.append(state := to)
        out, at = [], len(word)
        while at:
            symbol = self.ended[passed[at]]
            out.append(self.ids[symbol])
            at -= self.lengths[symbol]
        return tuple(reversed(out))

    def _chunk(self, chunk: str) -> bytes:
        text = unicodedata.normalize("NFC", chunk).translate(_LOWER).lower()
        out: list[int] = []
        for word in self.words.findall(text):
            ids = self.known.get(word)
            if ids is None:
                ids = self.path(word.encode())
                if len(word) <= 64:
                    if len(self.known) >= _CACHE:
                        self.known.clear()
                    self.known[word] = ids
            out += ids
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        out = []
        cache = self.cache
        for part in self.split.split(text) if self.split else (text,):
            if part in self.special:
                out.append(np.uint32(self.special[part]).tobytes())
                continue
            for chunk in part.split() if not _ODD_SPACES.search(part) else _SPACES.split(part):
                ids = cache.get(chunk)
                if ids is None:
                    ids = self._chunk(chunk)
                    if len(chunk) <= 64:
                        if len(cache) >= _CACHE:
                            cache.clear()
                        cache[chunk] = ids
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels, joined by spaces: what a vocabulary without a decoder gives."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_READY: dict[int, Automaton] = {}


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id_col, n_tokens (long), ids (binary, little-endian unsigned 32-bit) and decoded (string).

    vocabulary: path of the tokenizer's JSON file on the driver, where it is compiled; the automaton goes to the executors
    as a broadcast, whose size follows from the vocabulary alone. Texts are used whole; null counts as empty, and an
    empty text has no tokens. A character without a path can't occur, as all bytes are labels. Repeated rows are encoded
    each, an empty table gives an empty one. Other columns are dropped.
    """
    compiled = compile_vocabulary(json.loads(Path(vocabulary).read_text(encoding="utf-8")))
    sent = docs.sparkSession.sparkContext.broadcast(compiled)
    key = hash((vocabulary, len(compiled["bits"]), len(compiled["ids"])))
    schema = pa.schema([("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = Automaton(sent.value)
        automaton = _READY[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [automaton.encode(t.as_py() or "") for t in part.column(1)]
                columns = [[len(x) // 4 for x in ids], ids, [automaton.decode(x) for x in ids]]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], names=[id_col, *schema.names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded string")
