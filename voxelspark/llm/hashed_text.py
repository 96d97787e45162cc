"""Hashed features of texts, and linear models over them.

Words lose closing punctuation; their hashes and those of their first bytes go to a fixed number of slots.  A word's shape
(runs of capitals, small letters, digits, and its other characters) has slots too, and so have the number of words and the
share of distinct ones, in steps, and words that repeat the one before.  A slot's value is the logarithm of its count
(``count``), or the root of its share of the words (``share``), so that length alone does not move a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textcore import U64, Words, hash_spans, mix64, passes

SLOTS = 1 << 18
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[list(b".,;:!?\"')#*$%&|<>")] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(h + U64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) & U64(SLOTS - 1)).astype(np.int64)


def _shapes(words: Words) -> np.ndarray:
    """Hash of each word's shape with equal neighbours joined."""
    code = _SHAPE[words.bytes[: words.n_bytes]]
    new = np.ones(len(code), dtype=bool)
    new[1:] = code[1:] != code[:-1]
    new[words.starts] = True
    at = np.concatenate([[0], np.cumsum(new)])
    packed = np.concatenate([code[new], np.zeros(16, dtype=np.uint8)])
    return hash_spans(packed, at[words.starts], at[words.ends])


def sparse_rows(words: Words, raw: Words | None, prefixes: tuple[int, ...], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each text and the end, slots, values).  ``words`` are lower-cased; ``raw`` gives shapes."""
    starts, ends = words.starts, words.ends.copy()
    for _ in range(6):
        ends -= ((ends - starts > 1) & _CLOSING[words.bytes[ends - 1]]).astype(np.int64)
    text = np.repeat(np.arange(len(words)), np.diff(words.first))
    h = hash_spans(words.bytes, starts, ends)
    texts, slots = [text], [_slot(h, 1)]
    for p in prefixes:
        long = np.flatnonzero(ends - starts > p)
        texts.append(text[long])
        slots.append(_slot(hash_spans(words.bytes, starts[long], starts[long] + p), 1 + p))
    count = np.diff(words.first)
    if raw is not None:
        texts.append(text)
        slots.append(_slot(_shapes(raw), 100))
        again = np.flatnonzero((h[1:] == h[:-1]) & (text[1:] == text[:-1])) + 1
        texts.append(text[again])
        slots.append(np.full(len(again), int(_slot(np.zeros(1, U64), 103)[0])))
        distinct = np.bincount(np.unique(text.astype(U64) * U64(SLOTS) + _slot(h, 1).astype(U64)).astype(np.int64) // SLOTS, minlength=len(words))
        share = np.minimum(20 * distinct // np.maximum(count, 1), 19)
        steps = np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), 20)
        texts += [np.arange(len(words))] * 2
        slots += [_slot((share + 32 * np.minimum(steps, 12) // 3 * 32).astype(U64), 101), _slot(steps.astype(U64), 102)]
    both, n = np.unique(np.concatenate(texts) * SLOTS + np.concatenate(slots), return_counts=True)
    row, slot = both // SLOTS, both % SLOTS
    if kind == "count":
        value = np.log2(1.0 + n).astype(np.float32)
    else:
        value = np.sqrt(np.minimum(n / np.maximum(count[row], 1), 1)).astype(np.float32)
        if raw is not None:
            step = np.isin(slot, slots[-1]) | np.isin(slot, slots[-2])
            value[step] = np.maximum(value[step], 0.5)
    return np.searchsorted(row, np.arange(len(words) + 1)), slot, value


class Rows:
    """Sparse rows of many texts."""

    def __init__(self, texts: list[str], prefixes: tuple[int, ...], kind: str, shapes: bool):
        column = pa.array(texts, pa.large_string())
        parts = list(features(column, prefixes, kind, shapes))
        self.first = np.concatenate([[0], *(np.asarray(f[1:]) + sum(len(x[1]) for x in parts[:i]) for i, (f, _, _) in enumerate(parts))]).astype(np.int64)
        self.slot = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in parts)])
        self.value = np.concatenate([np.zeros(0, np.float32), *(x[2] for x in parts)])
        self.row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.slot] * self.value, minlength=len(self.first) - 1)

    def transposed(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.slot, weights=g[self.row] * self.value, minlength=SLOTS)


def features(column: pa.Array, prefixes: tuple[int, ...], kind: str, shapes: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse rows of each pass of a text column."""
    raws = passes(column) if shapes else None
    for _, _, words in passes(column, lower=True):
        yield sparse_rows(words, next(raws)[2] if raws else None, prefixes, kind)


def linear_scores(column: pa.Array, w: np.ndarray, prefixes: tuple[int, ...], kind: str, shapes: bool) -> np.ndarray:
    """The sum of weighted features of each text; the texts beside it in a batch do not change its last digits."""
    out = [np.zeros(0)]
    for first, slot, value in features(column, prefixes, kind, shapes):
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out.append(np.bincount(row, weights=w[slot].astype(np.float64) * value, minlength=len(first) - 1))
    return np.concatenate(out)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
