"""Vectorised words, hashes and shingles over Arrow text columns.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]+``, or of what is between other bytes.  Everything here works on the UTF-8 bytes of a whole
batch at once; those separators are single bytes in UTF-8, so bytes and code points give the same words.
Hashes are 64 bits wide and depend on the word's bytes alone, never on the process or the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)
_LONG_WORD = 256
#: Bytes of text that one pass of the vectorised code takes; a longer text is a pass of its own.
PASS_BYTES = 4 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """The words of a run of texts: byte spans, the first word of each text, and on demand hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE):
        self.offsets = offsets - offsets[0]
        n = int(self.offsets[-1])
        padded = np.zeros(n + 16, dtype=np.uint8)
        padded[:n] = data[offsets[0] : offsets[0] + n]
        if lower:
            padded[:n] = _LOWER[padded[:n]]
        self.bytes, self.n_bytes = padded, n
        word = ~between[padded[:n]]
        self.inside = word
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inner = self.offsets[1:-1]
        inner = inner[inner < n]
        begins[inner] |= word[inner]
        last = self.offsets[1:] - 1
        last = last[last >= 0]
        ends[last] |= word[last]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        #: words[k]:words[k + 1] are the words of text k
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def strings(self) -> pa.Array:
        """Each word as a string."""
        ends = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(ends), pa.py_buffer(self.bytes[: self.n_bytes][self.inside]))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hash_spans(self.bytes, self.starts, self.ends)

    def code_points(self) -> np.ndarray:
        """Number of code points of each word."""
        lead = np.zeros(self.n_bytes + 1, dtype=np.int32 if self.n_bytes < 1 << 31 else np.int64)
        np.cumsum((self.bytes[: self.n_bytes] & 0xC0) != 0x80, out=lead[1:])
        return (lead[self.ends] - lead[self.starts]).astype(np.int64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; ``data`` has 16 bytes of padding at its end."""
    at = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    size = ends - starts
    h = mix64(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    live = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
    step = 0
    while len(live):
        left = size[live] - step
        block = at[starts[live] + step] & _TAIL[np.minimum(left, 8)]
        h[live] = mix64(h[live] ^ (block * U64(0xD6E8FEB86659FD93) + U64(step + 1)))
        step += 8
        live = live[left > 8]
    for k in np.flatnonzero(size > _LONG_WORD):
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes())
    return h


#: Odd multipliers for the places of a shingle; the k-th is the splitmix64 output for k.
PLACES = mix64(np.arange(1, 65, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words; fewer words give one shingle of all, none give none."""
    n = len(h)
    if n == 0:
        return h
    w = min(width, n)
    total = np.zeros(n - w + 1, dtype=U64)
    for k in range(w):
        total += h[k : n - w + 1 + k] * PLACES[k]
    return mix64(total + U64(w))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and 64-bit offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buffers = column.buffers()
    n = len(column)
    if buffers[1] is None or n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def passes(column: pa.Array, lower: bool = False, most: int = PASS_BYTES, between: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    """``(from, to, words)`` for runs of rows of at most ``most`` bytes (one row at least).

    ``between`` tells for each of the 256 bytes whether it stands between words."""
    data, offsets = text_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, Words(data, offsets[lo : hi + 1], lower, between)
        lo = hi
