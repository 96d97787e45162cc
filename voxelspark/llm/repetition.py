"""Quality rules from suffix arrays: which words of a text lie in substrings that the text holds twice or more.

A pass takes a few megabytes of texts at once.  Suffixes of all its texts are sorted by prefix doubling (only suffixes
that still tie are sorted again).  Longest common prefixes of neighbours come from the ranks of each doubling, or, where a
long text would need too much memory for them, from one walk along the text (Kasai et al., 2001) over the last ranks
alone.  An interval of neighbours with a common prefix is a repeated substring; it is maximal if its places do not all
follow the same word.  The union of the spans of all maximal ones of ``least_words`` words or more is what the text repeats.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bounded_batches
from .textcore import U64, Words, hash_spans, mix64, passes

#: Bytes of the ranks of all doublings that a pass keeps; beyond, only the last are kept.
LEVEL_BYTES = 32 << 20
#: Characters that the rules count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def suffix_ranks(key: np.ndarray, text: np.ndarray, most: int = LEVEL_BYTES) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words; the last list has no ties, and if all lists took more than
    ``most`` bytes it is the only one.

    ``key`` holds a number for each word that differs between texts, ``text`` the number of its text (ascending).  A rank
    is the place of its group's first member among the sorted suffixes."""
    n = len(key)
    kind = np.int32 if n < 1 << 31 else np.int64
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [n]]))
    rank = np.empty(n, dtype=kind)
    rank[order] = np.repeat(first, size)
    levels, tied, step = [rank], order[np.repeat(size, size) > 1].astype(kind), 1
    del order
    while len(tied):
        second = np.zeros(len(tied), dtype=np.int64)
        inside = np.flatnonzero(tied < n - step)
        inside = inside[text[tied[inside] + step] == text[tied[inside]]]
        second[inside] = rank[tied[inside] + step] + 1
        by = np.argsort(rank[tied] * np.int64(n + 1) + second, kind="stable")
        tied, second = tied[by], second[by]
        group = rank[tied]
        starts = np.concatenate([[True], group[1:] != group[:-1]])
        new = np.flatnonzero(starts | np.concatenate([[True], second[1:] != second[:-1]]))
        begin = np.flatnonzero(starts)
        place = new - begin[np.searchsorted(begin, new, side="right") - 1]
        size = np.diff(np.concatenate([new, [len(tied)]]))
        if len(levels) and (len(levels) + 1) * rank.nbytes <= most:
            rank = rank.copy()
        else:
            levels = []
        rank[tied] = np.repeat(group[new] + place, size)
        if levels:
            levels.append(rank)
        tied, step = tied[np.repeat(size, size) > 1], step * 2
    return levels or [rank]


def _walk(key: np.ndarray, text: np.ndarray, suffixes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Longest common prefixes of neighbours, along the texts: a suffix shares at least one word less than the one before."""
    n = len(key)
    before = np.full(n, -1, dtype=rank.dtype)  # the suffix that is sorted just before
    before[suffixes[1:]] = suffixes[:-1]
    ends = np.searchsorted(text, text, side="right").astype(rank.dtype)
    common, keys, other, end = np.zeros(n, dtype=rank.dtype), memoryview(key), memoryview(before), memoryview(ends)
    out, k = memoryview(common), 0
    for i in range(n):
        j = other[i]
        if j < 0:
            k = 0
            continue
        most = min(end[i] - i, end[j] - j)
        k = min(k, most)
        while k < most and keys[i + k] == keys[j + k]:
            k += 1
        out[i] = k
        k = k - 1 if k else 0
    return common[suffixes]


def common_prefixes(key: np.ndarray, text: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and the longest common prefix (in words) of each suffix with the one before it."""
    n, rank = len(text), levels[-1]
    suffixes = np.empty(n, dtype=rank.dtype)
    suffixes[rank] = np.arange(n, dtype=rank.dtype)
    lcp = np.zeros(n, dtype=rank.dtype)
    if n < 2:
        return suffixes, lcp
    if len(levels) == 1 and (key[suffixes[1:]] == key[suffixes[:-1]]).any():
        return suffixes, _walk(key, text, suffixes, rank)
    at = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1
    a, b, common = suffixes[at - 1].astype(np.int64), suffixes[at].astype(np.int64), np.zeros(len(at), dtype=np.int64)
    last = suffixes[at].copy()
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = (text[a[ok]] == text[last[ok]]) & (text[b[ok]] == text[last[ok]])
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        a[ok] += 1 << k
        b[ok] += 1 << k
        common[ok] += 1 << k
    lcp[at] = common
    return suffixes, lcp


def intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of neighbours with a common prefix of ``least`` words or more: (length, first, last, parent), and for each
    place the interval whose length its prefix is (-1 if that is shorter).

    ``parent`` is the number of the next interval around one, -1 if there is none."""
    length, first, last, parent, stack = (array("i") for _ in range(5))
    of = np.full(len(lcp) + 1, -1, dtype=np.int32)

    def close(end: int) -> int:
        k = stack.pop()
        last[k] = end
        if stack:
            parent[k] = stack[-1]
        return k

    places, before = np.flatnonzero(lcp >= least), -1
    for lo in range(0, len(places), 1 << 16):
        at = places[lo : lo + (1 << 16)]
        owners = array("i")
        for i, value in zip(at.tolist(), lcp[at].tolist(), strict=True):
            if i != before + 1:
                while stack:
                    close(before)
            begin, inner = i - 1, -1
            while stack and length[stack[-1]] > value:
                inner = close(i - 1)
                begin = first[inner]
            if not stack or length[stack[-1]] < value:
                length.append(value)
                first.append(begin)
                last.append(-1)
                parent.append(-1)
                stack.append(len(length) - 1)
            if inner >= 0:
                parent[inner] = stack[-1]
            owners.append(stack[-1])
            before = i
        of[at] = owners
    while stack:
        close(before)
    return (*(np.array(x, dtype=np.int32) for x in (length, first, last, parent)), of)


def repeated_reach(key: np.ndarray, text: np.ndarray, least: int = 1, most: int = LEVEL_BYTES) -> np.ndarray:
    """For each word, the length in words of the longest maximal repeated substring (of ``least`` words or more) of its text
    that begins there, 0 if there is none."""
    reach = np.zeros(len(key), dtype=np.int64)
    suffixes, lcp = common_prefixes(key, text, suffix_ranks(key, text, most))
    length, first, last, parent, of = intervals(lcp, least)
    if not len(length):
        return reach
    # maximal: not all places follow the same word; the first word of a text follows none
    opens = np.concatenate([[True], text[1:] != text[:-1]])
    prior = np.where(opens, U64(0), np.concatenate([key[:1], key[:-1]]))[suffixes]
    opens = opens[suffixes]
    change = np.concatenate([[0], np.cumsum((prior[1:] != prior[:-1]) | opens[1:] | opens[:-1])])
    worth = np.where(change[last] > change[first], length, 0).astype(np.int32)
    view, around = memoryview(worth), memoryview(parent)
    outer_first = np.argsort(length, kind="stable")
    for k in outer_first[worth[outer_first] == 0]:
        if around[k] >= 0:
            view[k] = view[around[k]]
    # the innermost interval of a place is that of its longer common prefix, with the place before or after
    after = np.concatenate([lcp[1:], [0]])
    inner = np.where(lcp >= after, of[:-1], of[1:])
    held = np.flatnonzero(inner >= 0)
    reach[suffixes[held]] = worth[inner[held]]
    return reach


def covered(reach: np.ndarray, least_words: int) -> np.ndarray:
    """Which words lie in the union of the repeated substrings of ``least_words`` words or more."""
    n = len(reach)
    at = np.flatnonzero(reach >= least_words)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + reach[at], minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated_lines(words: Words) -> np.ndarray:
    """Per text, its lines that hold a word and equal an earlier line."""
    n, m = words.n_bytes, len(words)
    cut = words.bytes[:n] == 0x0A
    starts = np.unique(np.concatenate([words.offsets[:-1], np.flatnonzero(cut) + 1]))
    starts = starts[starts < n]
    if not len(starts):
        return np.zeros(m, dtype=np.int64)
    ends = np.concatenate([starts[1:], [n]])
    ends = np.where(cut[ends - 1], ends - 1, ends)
    text = np.searchsorted(words.offsets, starts, side="right") - 1
    has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, text = starts[has], ends[has], text[has]
    key = mix64(hash_spans(words.bytes, starts, ends) + mix64(text.astype(U64) + U64(1)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[first] = False
    return np.bincount(text[again], minlength=m).astype(np.int64)


def measures(words: Words, least_words: int) -> dict[str, np.ndarray]:
    """Counts for each text of a pass; see ``repetition_rules``."""
    first, count = words.first, np.diff(words.first)
    text = np.repeat(np.arange(len(words)), count)
    reach = repeated_reach(mix64(words.hashes() + mix64(text.astype(U64) + U64(1))), text, least_words)
    inside = covered(reach, least_words)
    chars = words.code_points()
    longest = np.zeros(len(words), dtype=np.int64)
    np.maximum.at(longest, text, np.where(reach >= least_words, reach, 0))
    return {
        "n_words": count.astype(np.int64),
        "word_chars": _sums(chars, first),
        "n_symbols": np.diff(np.searchsorted(np.flatnonzero(_SYMBOL[words.bytes[: words.n_bytes]]), words.offsets)).astype(np.int64),
        "n_dup_lines": _repeated_lines(words),
        "n_repeat_words": _sums(inside, first),
        "repeat_chars": _sums(np.where(inside, chars, 0), first),
        "longest_repeat": longest,
    }


def _rows(least_words: int):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in passes(batch.column(1)):
                found = measures(words, least_words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(found[x]) for x in names)], ["doc_id", *names])

    return run


def clean_documents(docs: DataFrame, text_col: str = "text", least_words: int = 5, most_covered: int = 20, most_longest: int = 50) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``repetition_rules`` keeps; nothing is shuffled.

    The column names of ``docs`` must differ; nulls, repeated rows and empty tables as there."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, dtype=bool)]
            for _, _, words in passes(batch.column(at)):
                m = measures(words, least_words)
                failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
                keep.append(~failed & (100 * m["repeat_chars"] <= most_covered * m["word_chars"]) & (m["longest_repeat"] <= most_longest))
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def repetition_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5, most_covered: int = 20, most_longest: int = 50
) -> DataFrame:
    """Measure what each text repeats of itself and judge it.

    Returns a row for each row of ``docs``: ``doc_id``; ``n_words``; ``word_chars`` (code points in words); ``n_symbols``
    (characters of ``[#*$%&|<>]``); ``n_dup_lines`` (lines with a word that equal an earlier line); ``n_repeat_words``
    and ``repeat_chars`` (words, and code points in them, in substrings of ``least_words`` words or more that the text
    holds twice or more, the first included); ``longest_repeat`` (words of the longest such substring, 0 if none);
    ``base_failed`` (fewer than 10 words, or over 20 % of them repeated); ``kept``: not ``base_failed``, at most
    ``most_covered`` % of the code points repeated and no repeat over ``most_longest`` words.

    Null, empty and white-space texts have no words and fail.  Substrings may overlap themselves.  Repeated rows give
    equal rows, an empty table an empty result; only the two named columns are read.  Texts are whole at any length."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _rows(least_words),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_chars long, longest_repeat long",
    )
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return rows.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("repeat_chars") <= most_covered * F.col("word_chars")) & (F.col("longest_repeat") <= most_longest)
    )
