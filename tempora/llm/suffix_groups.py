"""Suffix arrays by linear grouping construction, and the repeated byte windows that they show.

Suffixes are put into groups that share a Lyndon prefix. Groups are taken in descending order; each member points to the
nearest suffix to its left that lies in a lower group, and the suffixes pointed to move into new groups right above their
own, the more pointers from one group the higher. Then the order inside the groups comes out by one pass over the array in
ascending order along the same pointers. Nothing is renamed and nothing recursive is built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tempora.llm.common import U64, mix

#: Bytes whose values decide whether a token ends after them, and the tokens' mean length in bytes.
CONTEXT, TOKEN = 4, 16
_BYTES = np.random.default_rng(20250611).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def lyndon_groups(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(group of each suffix, first place of each group, pointer of each suffix to its previous smaller one or -1)."""
    n = len(codes)
    names = {c: g for g, c in enumerate(sorted(set(codes)))}
    group = [names[c] for c in codes]
    members: list[list[int]] = [[] for _ in names]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1] if members else []
    place = [0] * len(members)
    previous, jump = [-1] * n, [-1] * n
    done = bytearray(n)
    end, at = n, len(members) - 1
    top = len(members)
    while at >= 0:
        here = [i for i in members[at] if group[i] == at]
        members[at] = []
        end -= len(here)
        place[at] = end
        if len(here) > 1:
            here.sort()
        for i in here:
            done[i] = 1
        pointers: dict[int, int] = {}
        for i in here:
            p = i - 1
            while p >= 0 and done[p]:
                p = jump[p]
            if p != i - 1 and i:
                jump[i - 1] = p
            jump[i] = previous[i] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in pointers.items():
            if size[group[p]] > 1:
                moved.setdefault((-times, group[p]), []).append(p)
        for (_, old), which in sorted(moved.items()) if len(moved) > 1 else moved.items():
            if len(which) == size[old]:
                continue  # what is left of its group moves as a whole: it is in its place
            for p in which:
                group[p] = top
            members.append(which)
            size[old] -= len(which)
            size.append(len(which))
            place.append(0)
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = top
            if up >= 0:
                below[up] = top
            top += 1
        at = below[at]
    return group, place, previous


def suffix_array(codes: list[int]) -> list[int]:
    """The starts of all suffixes in ascending order; a suffix that is a prefix of another comes first."""
    group, place, previous = lyndon_groups(codes)
    n = len(codes)
    order = [0] * n
    placed = bytearray(n)
    j = n - 1
    for k in range(-1, n):
        if k >= 0:
            j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            placed[j] = 1
            j = previous[j]
    return order


class Rolling:
    """Hashes of any byte strings of a buffer: from a to b by one subtraction and one product."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, _BASE, np.uint64)]))
        self.inverse = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n, _INVERSE, np.uint64)]))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * powers[:n], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))


def _tokens(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where tokens start: at the starts given, and after bytes whose last CONTEXT bytes say so."""
    cut = np.zeros(len(data), bool)
    if len(data) > CONTEXT:
        x = np.zeros(len(data) - CONTEXT, np.uint32)
        for j in range(CONTEXT):
            x = x * np.uint32(0x01000193) ^ data[j : len(x) + j]
        x *= np.uint32(0x9E3779B1)
        cut[CONTEXT:] = x >> np.uint32(16) < np.uint32((1 << 16) // TOKEN)
    cut[starts] = True
    return np.flatnonzero(cut)


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """Of each segment, whether each string of `length` bytes in it also starts anywhere else in these segments.

    Token ends are decided by the bytes before them, so equal strings are cut alike once CONTEXT bytes are past. A string is
    what precedes its first such cut, then the suffix that starts there: sorted by both, equal strings are neighbours, and
    neighbours are compared byte by byte. Segments shorter than length have no starts.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    counts = np.maximum(sizes - length + 1, 0)
    total = int(counts.sum())
    ends = np.cumsum(counts)
    if total < 2:
        return [np.zeros(n, bool) for n in counts.tolist()]
    data = np.frombuffer(b"".join(segments), np.uint8)
    heads = _tokens(data, offsets[:-1][sizes > 0])
    bounds = np.append(heads, len(data)).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
    by = np.asarray(pc.sort_indices(tokens.dictionary))
    rank_of = np.empty(len(by), np.int64)
    rank_of[by] = np.arange(len(by))
    order = suffix_array(rank_of[np.asarray(tokens.indices)].tolist())
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    start = np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(offsets[:-1], counts)
    first = np.searchsorted(heads, start + CONTEXT)
    lead = np.minimum(bounds[first], start + length)
    following = np.where(lead < start + length, rank[np.minimum(first, len(rank) - 1)], 0)
    rolling = Rolling(data)
    prefix = rolling.of(start, lead)
    sorted_by = np.lexsort((following, prefix))
    a = start[sorted_by]
    whole = rolling.of(a, a + length)
    near = np.flatnonzero(whole[1:] == whole[:-1])
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    repeated = np.zeros(total, bool)
    for k in range(0, len(near), 1 << 14):
        pair = near[k : k + (1 << 14)]
        pair = pair[(view[a[pair]] == view[a[pair + 1]]).all(axis=1)]
        repeated[pair] = True
        repeated[pair + 1] = True
    out = np.empty(total, bool)
    out[sorted_by] = repeated
    return np.split(out, ends[:-1])
