"""Best-fit packing by a linear grouping scheme.

Only the histogram of lengths (a row for each length, whatever the corpus) reaches the driver.  There large lengths,
sorted, are cut into groups of equal cardinality and rounded up to the longest of their group; for these few sizes a
linear program over all configurations, solved by column generation, says how often to use which; actual lengths replace
rounded ones; what is left goes best-fit into the space that rounding left, then into the fullest configurations of its
own lengths; small lengths go best-fit into the rest.  The finest grouping, each length a group of its own with
configurations chosen one after the other, is planned too, and the better plan is taken.  Equal bins are handled together,
so a plan has thousands of rows at most: for the pieces of one length, from one rank to another, the bin and the place.
Ranks are counted in parallel, and each piece looks up its row.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, bounded_batches

CAPACITY = 1024
#: Large lengths form about so many groups.
GROUPS = 48
#: Lengths up to the capacity by so much are small: for the groups, and in turn for the finest grouping.
SMALL_PART, FINEST_PARTS = 8, (16, 8, 5, 3)
#: Columns that the linear program may add; its plan is good, if not the best, when it stops there.
COLUMNS_MOST = 400
#: Pieces of a length that one task ranks, and parts of a length at most.
RANK_RUN, RANK_PARTS = 1000, 1 << 16


#: Fixed value: the published pattern of byte-level BPE pre-tokens, which the tokenizer files of that kind imply.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Ids of a byte-level BPE tokenizer file of the ``tokenizers`` library.

    Where the file's merges are in the order of its ids, as in all files of that kind, ``tiktoken`` gives the same ids from
    the same vocabulary in a fraction of the time; else, and for a text it cannot take, ``tokenizers`` does the work.

    ``added_tokens`` gives special tokens of the file that stand in a text their own ids, as the library's plain call does;
    without it they are ordinary text."""

    def __init__(self, path: str, added_tokens: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.fast = None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.own = [t["content"] for t in file.get("added_tokens") or [] if added_tokens or not t.get("special")]
        byte, vocabulary = _byte_of(), model["vocab"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        in_order = all(vocabulary[x] < vocabulary[y] for x, y in pairwise(merged))
        before = file.get("pre_tokenizer") or {}
        plain = file.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        plain = plain and not any(model.get(x) for x in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        if plain and in_order and all(c in byte for token in merged for c in token):
            import tiktoken

            tokens = {*byte, *merged}
            self.fast = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks={bytes(byte[c] for c in x): vocabulary[x] for x in tokens}, special_tokens={})

    def slow(self, text: str) -> bytes:
        """Little-endian 32-bit ids by ``tokenizers``."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.fast is None or any(t in text for t in self.own):
            return self.slow(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except BaseException as e:  # its pattern engine gives up on some very long runs
            if type(e).__name__ not in ("PanicException", "ValueError", "UnicodeEncodeError"):
                raise
            return self.slow(text)


_encoders: dict[tuple[str, bool], Encoder] = {}


def _pieces(path: str, end_id: int, capacity: int, added_tokens: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, added_tokens)
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(*key))
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    blob = encoder.encode(text or "") + end
                    n = len(blob) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n, capacity), n]
                    rows += [(doc_id, k, a, b - a, blob[4 * a : 4 * b]) for k, (a, b) in enumerate(pairwise(cuts))]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                        ["doc_id", "piece", "start", "length", "ids"],
                    )

    return run


def token_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = CAPACITY, added_tokens: bool = True
) -> DataFrame:
    """``(doc_id, piece, start, length, ids)``: the ids of each text and ``end_id``, cut into pieces of ``capacity`` ids
    if there are more; then the first piece may be shorter.  ``ids`` are little-endian unsigned 32-bit numbers.
    ``tokenizer`` is the path of a tokenizers file that every executor has.  A null text is empty: one piece, the end.
    ``added_tokens``: special tokens that stand in a text have their own ids, else they are ordinary text."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_pieces(tokenizer, end_id, capacity, added_tokens), "doc_id long, piece int, start long, length long, ids binary")


class _Bins:
    """Bins in runs of equal content, and the plan rows that fill them."""

    def __init__(self, capacity: int):
        self.capacity, self.opened = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.used: dict[int, int] = {}
        self.free: dict[int, list[tuple[int, int]]] = {}  # space left: runs (first bin, bins)

    def open(self, count: int) -> int:
        self.opened += count
        return self.opened - count

    def put(self, length: int, base: int, count: int, at: int) -> None:
        """One piece of a length into each of ``count`` bins from ``base``, at place ``at``."""
        rank = self.used.get(length, 0)
        self.used[length] = rank + count
        self.rows.append((length, rank, rank + count, base, at))

    def leave(self, left: int, base: int, count: int) -> None:
        if left and count:
            self.free.setdefault(left, []).append((base, count))

    def best_fit(self, length: int, n: int, new: bool = True) -> int:
        """``n`` pieces of a length, each into the bin with the least space that holds it, or else, if ``new``, a new one;
        returns the number of those that found no place."""
        while n:
            left = min((r for r in self.free if r >= length), default=None)
            if left is None:
                if not new:
                    break
                each = self.capacity // length
                left, count = self.capacity, -(-n // each)
                base = self.open(count)
            else:
                base, count = self.free[left].pop()
                if not self.free[left]:
                    del self.free[left]
                each = left // length
            start, full = self.capacity - left, min(count, n // each)
            for k in range(each if full else 0):
                self.put(length, base, full, start + k * length)
            self.leave(left - each * length, base, full)
            n -= full * each
            if full < count:
                some = n  # fewer than ``each``
                for k in range(some):
                    self.put(length, base + full, 1, start + k * length)
                self.leave(left - some * length, base + full, 1)
                self.leave(left, base + full + 1, count - full - 1)
                n = 0
        return n


def _fullest(sizes: list[int], counts: list[int], room: int) -> dict[int, int]:
    """Indexes and numbers of sizes that fill ``room`` as far as possible; long sizes first."""
    came: list[tuple[int, int] | None] = [None] * (room + 1)
    reached, mask = 1, (1 << (room + 1)) - 1
    for i, (s, c) in enumerate(zip(sizes, counts, strict=True)):
        for _ in range(min(c, room // s) if s else 0):
            new = (reached << s) & mask & ~reached
            if not new:
                break
            reached |= new
            x = new
            while x:
                low = x & -x
                came[low.bit_length() - 1] = (i, s)
                x ^= low
        if reached >> room & 1:
            break
    at, chosen = reached.bit_length() - 1, {}
    while at:
        i, s = came[at]
        chosen[i] = chosen.get(i, 0) + 1
        at -= s
    return chosen


def _greedy(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations (numbers by index of size) and how often to use each: the fullest for the longest size left."""
    counts, out = list(counts), []
    for i in range(len(sizes)):
        while counts[i]:
            counts[i] -= 1
            left = [k for k in range(i, len(sizes)) if counts[k]]
            chosen = _fullest([sizes[k] for k in left], [counts[k] for k in left], capacity - sizes[i])
            counts[i] += 1
            config = {i: 1}
            for k, n in chosen.items():
                config[left[k]] = config.get(left[k], 0) + n
            times = min(counts[k] // n for k, n in config.items())
            for k, n in config.items():
                counts[k] -= n * times
            out.append((config, times))
    return out


def _most_worth(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest total worth, by dynamic programming over the space used; sizes ascend."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(int(sizes[0]), capacity + 1):
        k = fits[room]
        value = best[room - sizes[:k]] + worth[:k]
        j = int(value.argmax())
        if value[j] > best[room - 1] + 1e-15:
            best[room], last[room] = value[j], j
        else:
            best[room] = best[room - 1]
    config, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            config[last[room]] += 1
            room -= sizes[last[room]]
    return float(best[capacity]), config


def optimal_configurations(sizes: list[int], counts: list[int], capacity: int, most: int = COLUMNS_MOST) -> list[tuple[dict[int, int], float]]:
    """Configurations and (fractional) numbers of bins that hold ``counts`` pieces of each of ``sizes`` in the fewest bins.

    The linear program over all configurations by column generation: a simplex basis starts with bins of one size each;
    the configuration of the greatest worth at the current prices enters until none is worth more than a bin."""
    order = np.argsort(sizes)
    size, need = np.array(sizes)[order], np.array(counts, dtype=float)[order]
    each = (capacity // size).astype(float)
    basis, inverse, bins = np.diag(each), np.diag(1 / each), need / each
    for _ in range(most):
        value, config = _most_worth(size, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ config
        ratio = np.where(d > 1e-9, bins / np.where(d > 1e-9, d, 1), np.inf)
        p = int(ratio.argmin())
        step = ratio[p]
        bins = np.maximum(bins - step * d, 0)
        bins[p] = step
        basis[:, p] = config
        row = inverse[p] / d[p]
        inverse = inverse - np.outer(d, row)
        inverse[p] = row
    return [({int(order[i]): int(n) for i, n in enumerate(basis[:, p]) if n}, float(bins[p])) for p in range(len(size))]


def _fill(histogram: dict[int, int], capacity: int, groups: int | None, small: int) -> _Bins:
    """A plan; ``groups`` is None for the finest grouping, lengths up to ``small`` are small."""
    bins = _Bins(capacity)
    if histogram.get(capacity):
        bins.put(capacity, bins.open(histogram[capacity]), histogram[capacity], 0)
    large = [(x, histogram[x]) for x in sorted(histogram, reverse=True) if small < x < capacity and histogram[x]]

    def use(runs: list[list[tuple[int, int]]], config: dict[int, int], times: int) -> None:
        """Bins of one configuration, with actual lengths for the sizes of their groups."""

        def taken(i: int) -> list[tuple[int, int]]:
            out, n = [], times
            while n:
                x, have = runs[i][0]
                take = min(n, have)
                out.append((x, take))
                n -= take
                runs[i][0] = (x, have - take)
                if have == take:
                    runs[i].pop(0)
            return out

        slots = [taken(k) for k, n in config.items() for _ in range(n)]
        while slots[0]:
            same = min(s[0][1] for s in slots)
            base, at = bins.open(same), 0
            for s in slots:
                x, n = s[0]
                bins.put(x, base, same, at)
                at += x
                s[0] = (x, n - same)
                if n == same:
                    s.pop(0)
            bins.leave(capacity - at, base, same)

    if groups is not None and large:
        each, room = -(-sum(n for _, n in large) // groups), 0
        runs: list[list[tuple[int, int]]] = []
        for x, n in large:
            if not room or n >= each:
                runs.append([])
                room = each
            runs[-1].append((x, n))
            room = max(0, room - n)
        sizes, counts = [r[0][0] for r in runs], [sum(n for _, n in r) for r in runs]
        for config, times in optimal_configurations(sizes, counts, capacity):
            whole = min([int(times + 1e-6), *(counts[k] // n for k, n in config.items())])
            if whole:
                for k, n in config.items():
                    counts[k] -= n * whole
                use(runs, config, whole)
        large = [(x, bins.best_fit(x, n, new=False)) for r in runs for x, n in r]
        large = [(x, n) for x, n in large if n]
    for config, times in _greedy([x for x, _ in large], [n for _, n in large], capacity):
        use_runs = [[pair] for pair in large]
        use(use_runs, config, times)
        large = [r[0] if r else (x, 0) for r, (x, _) in zip(use_runs, large, strict=True)]
    for x in sorted((x for x in histogram if x <= small and x != capacity), reverse=True):
        bins.best_fit(x, histogram[x])
    return bins


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, from rank, to rank, first bin, place) for pieces by length, and the number of bins.

    The best of some plans: one of ``groups`` groups, and for each limit of small lengths one of the finest grouping."""
    plans = (_fill(histogram, capacity, *how) for how in ((groups, capacity // SMALL_PART), *((None, capacity // part) for part in FINEST_PARTS)))
    best = min(plans, key=lambda bins: bins.opened)
    return best.rows, best.opened


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table with a ``length`` (1 to ``capacity``) for each row.

    Rows of a sequence fill it without gaps from 0; no row is dropped, cut or repeated.  Equal lengths are interchangeable,
    so ties, repeated rows and nulls in other columns need no rule.  Columns named ``sequence_id`` or ``offset`` are
    replaced; any other names stay as they are.  An empty table gives an empty result."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "pack")
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    hashed = [F.col(f"`{c}`") for c, kind in pieces.dtypes if kind != "binary" and "map<" not in kind]
    rows = scratch.table(pieces.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("piece"), F.col("length"), F.xxhash64(*hashed).alias("draw")), "pieces")
    histogram = dict(rows.groupBy("length").agg(F.count("*")).collect())  # at most ``capacity`` rows
    found, _ = plan(histogram, capacity, groups)
    table = spark.createDataFrame(found, "of_length long, lo long, hi long, base long, offset long")
    parts = spark.createDataFrame([(k, min(max(1, n // RANK_RUN), RANK_PARTS)) for k, n in histogram.items()], "length long, parts long")
    ranked = rows.join(F.broadcast(parts), "length").withColumn("part", F.pmod("draw", "parts"))
    counts = ranked.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("draw"))
    ranked = ranked.withColumn("nth", nth - 1).join(counts, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("earlier"))
    placed = ranked.join(F.broadcast(table), F.expr("length = of_length and rank >= lo and rank < hi"))
    return placed.select("piece.*", F.expr("base + rank - lo").alias("sequence_id"), "offset")
