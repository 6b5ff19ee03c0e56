"""Words of whole batches of texts as arrays: byte classes, 64-bit word hashes, rolling hashes of word windows.

A text is taken as its UTF-8 bytes. Every character outside ASCII consists of bytes of 128 and more, so a word class
whose ASCII part is any set and whose other part is "all" or "none" is a class of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20  # bytes hashed at a time
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class ByteClass:
    """Which bytes make words, and the byte that each is read as."""

    def __init__(self, word: np.ndarray, fold: np.ndarray):
        self.word, self.fold = word, fold


def _byte_class(breaks: list[range], lower: bool) -> ByteClass:
    word = np.ones(256, bool)
    for r in breaks:
        word[list(r)] = False
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return ByteClass(word, fold)


_SPACE = [range(0x20, 0x21), range(0x09, 0x0E)]
SPACED = _byte_class(_SPACE, False)
SPACED_LOWER = _byte_class(_SPACE, True)
#: Letters and digits, and everything outside ASCII, in lower case.
ALNUM_LOWER = _byte_class([range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)], True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same everywhere."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(seed))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93
    powers = np.full(SEGMENT + 1, base, np.uint64)
    powers[0] = 1
    inverse = np.full(SEGMENT + 1, pow(base, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return constants(256, 1), np.cumprod(powers), np.cumprod(inverse)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offset of each text in them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``size`` bytes; a longer text is a range of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0), np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
        yield at, to
        at = to


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of at most ``SEGMENT`` bytes in ascending order."""
    table, powers, inverse = _tables()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
        part = data[base:int(ends[to - 1])]
        if len(part) > SEGMENT:  # one span that is longer: its own digest
            out[at] = np.uint64(int.from_bytes(hashlib.blake2b(part.tobytes(), digest_size=8).digest(), "little"))
        else:
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * powers[:len(part)], out=total[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


class Words:
    """Words of several texts: byte positions ``starts`` and ``ends``, ``first`` word of each text, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: ByteClass):
        self.data, self.offsets, self.kind = data, offsets, kind
        starts, ends, hashes = [], [], []
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        at = 0
        while at < len(data):
            to = min(at + SEGMENT, len(data))
            if to < len(data):
                gaps = np.flatnonzero(~kind.word[data[at:to]] | edge[at:to])
                if len(gaps) and gaps[-1] > 0:
                    to = at + int(gaps[-1])
                else:  # one word fills the segment: take all of it
                    while to < len(data) and kind.word[data[to]] and not edge[to]:
                        to += 1
            s, e, h = self._segment(data[at:to], edge[at:to + 1])
            starts.append(s + at), ends.append(e + at), hashes.append(h)
            at = to
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.starts, self.ends, self.hashes = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)
        self.first = np.searchsorted(self.starts, offsets)

    def _segment(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = self.kind.word[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:len(data)]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | edge[1:len(data)]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        table, powers, inverse = _tables()
        read = table[self.kind.fold[data]]
        if len(data) <= SEGMENT:
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(read * powers[:len(data)], out=total[1:])
            h = (total[ends] - total[starts]) * inverse[starts]
        else:  # a single word longer than a segment: the same polynomial, piece by piece
            h, far = np.zeros(1, np.uint64), np.uint64(1)
            for i in range(0, len(data), SEGMENT):
                part = read[i:i + SEGMENT]
                h = h + far * (part * powers[:len(part)]).sum(dtype=np.uint64)
                far = far * powers[SEGMENT]
        return starts, ends, mix(h + (ends - starts).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, length: int, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and rolling hash of every run of ``length`` words of one text."""
        n = len(self.hashes) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        acc = self.hashes[:n].copy()
        by = np.uint64(multiplier | 1)
        for i in range(1, length):
            acc *= by
            acc += self.hashes[i:i + n]
        at = np.flatnonzero(np.arange(length, n + length) <= np.repeat(self.first[1:], self.counts())[:n])
        return at, mix(acc[at] + np.uint64(length))
