"""Target-distribution importance resampling over hashed features of words.

Equal texts are collapsed by grouping whole texts, so features and weight of a text are computed once and its counts
multiplied by its number of copies; the weight is joined back to the documents before each gets its own noise.  Drawing
the highest sums of weight and Gumbel noise is drawing without replacement in proportion to the exponential of weights.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, bounded_batches
from .textcore import Words, passes

#: A word is a run of what is not in ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``, after A-Z became small.
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[0x00:0x30] = _BETWEEN[0x3A:0x61] = _BETWEEN[0x7B:0x80] = True
_POLYNOMIAL = 0xEDB88320
#: Words of more bytes are hashed one by one.
_LONG = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def _append_tables() -> np.ndarray:
    """``[n, k, b]``: what byte k of a checksum, of value b, becomes when n bytes follow; it is linear over exclusive or."""
    tables = np.zeros((_LONG + 1, 4, 256), dtype=np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(_LONG):
        tables[n + 1] = (tables[n] >> 8) ^ _CRC[tables[n] & 255]
    return tables


_APPEND = _append_tables()


def _followed(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of a checksum that stems from a prefix with checksum ``crc``, when ``n`` bytes follow."""
    out = np.zeros(len(crc), dtype=np.uint32)
    for k in range(4):
        out ^= _APPEND[np.minimum(n, _LONG), k, (crc >> np.uint32(8 * k)) & 255]
    for i in np.flatnonzero(n > _LONG):
        c, left = crc[i : i + 1], int(n[i])
        while left:
            step = min(left, _LONG)
            c, left = _followed(c, np.array([step])), left - step
        out[i] = c[0]
    return out


def word_checksums(words: Words) -> np.ndarray:
    """The CRC-32 of each word's bytes."""
    size = words.ends - words.starts
    crc = np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
    live, step = np.flatnonzero(size <= _LONG), 0
    while len(live):
        now = crc[live]
        crc[live] = (now >> 8) ^ _CRC[(now ^ words.bytes[words.starts[live] + step]) & 255]
        step += 1
        live = live[size[live] > step]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG):
        crc[i] = zlib.crc32(words.bytes[words.starts[i] : words.ends[i]])
    return crc


def run_checksums(words: Words, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, CRC-32) of each run of 1 to ``longest`` consecutive words of a text, joined by one space."""
    text = np.repeat(np.arange(len(words)), np.diff(words.first))
    word, size = word_checksums(words), words.ends - words.starts
    space, run = np.uint32(zlib.crc32(b" ")), word
    for n in range(longest):
        if n:
            run = _followed(_followed(run[:-1], np.ones(max(len(run) - 1, 0), dtype=np.int64)) ^ space, size[n:]) ^ word[n:]
        whole = text[: len(run)] == text[n:]
        yield text[: len(run)][whole], run[whole]


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _features(buckets: int, longest: int):
    """A text's number of words and the buckets of its features, two or four bytes each."""
    names = ["key", "copies", "n_words", "buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in passes(batch.column(2), lower=True, between=_BETWEEN):
                runs = list(run_checksums(words, longest))
                text = np.concatenate([t for t, _ in runs])
                order = np.argsort(text, kind="stable")
                slots = (np.concatenate([c for _, c in runs])[order] % np.uint32(buckets)).astype(_kind(buckets))
                at = np.searchsorted(text[order], np.arange(hi - lo + 1)) * slots.itemsize
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(slots)])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(words.first)), data.cast(pa.binary())], names)

    return run


def text_features(texts: DataFrame, text_col: str, buckets: int, longest: int) -> DataFrame:
    """``(key, copies, n_words, buckets)`` of each different text: groups are of whole texts, the key is a text's SHA-256."""
    bounded_batches(texts.sparkSession)
    whole = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    copies = whole.groupBy("text").agg(F.count("*").alias("copies"))
    keyed = copies.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text")
    return keyed.mapInArrow(_features(buckets, longest), "key binary, copies long, n_words long, buckets binary")


def _buckets_of(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch, and how many each text has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=kind), np.zeros(len(column), dtype=np.int64)
    width = np.dtype(kind).itemsize
    return np.frombuffer(column.buffers()[2], dtype=kind)[offsets[0] // width : offsets[-1] // width], np.diff(offsets) // width


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of each bucket, copies included; the driver gets one row for a bucket."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            slots, sizes = _buckets_of(batch.column(1), kind)
            copies = np.repeat(batch.column(0).to_numpy(), sizes)
            for n in np.unique(copies):
                total += n * np.bincount(slots[copies == n], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = features.select("copies", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(buckets, dtype=np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))`` of each bucket, in doubles."""
    s_all, t_all = float(int(source.sum()) + len(source)), float(int(target.sum()) + len(target))
    return np.array([math.floor(1000 * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def _weights(gains: np.ndarray):
    kind = _kind(len(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, sizes = _buckets_of(batch.column(2), kind)
            sums = np.concatenate([[0], np.cumsum(gains[slots])])
            ends = np.cumsum(sizes)
            weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(weight)], ["key", "n_words", "n_features", "weight"])

    return run


def ranked(rows: DataFrame, scratch: Scratch, order: list, part: int, of: int) -> DataFrame:
    """Adds ``rank`` (1, 2, 3, ... in the given order; null beyond the first ``part`` of ``of`` parts of the rows).

    Ranges of the order are sorted each in a task of its own and written; then only one row for a range meets in a task."""
    placed = scratch.table(rows.withColumn("__tie", F.monotonically_increasing_id()), "placed")
    place = F.monotonically_increasing_id()  # partition and place in it
    ranges = placed.repartitionByRange(*order, F.col("__tie")).sortWithinPartitions(*order, "__tie").withColumn("__place", place)
    ranges = scratch.table(ranges.drop("__tie").withColumn("__range", F.shiftright("__place", 33)), "ranges")
    scratch.drop(placed)
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    most = part * (sizes.agg(F.sum("n")).first()[0] or 0) // of
    starts = sizes.select(F.col("__range"), F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1
    return ranges.join(starts, "__range").withColumn("rank", F.when(rank <= most, rank)).drop("__range", "__place", "__before")


def importance_resampling(
    docs: DataFrame,
    target: DataFrame,
    buckets: int = 10_000,
    longest: int = 2,
    least_words: int = 20,
    percent: int = 25,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Draw the documents that look most like the texts of ``target``, with noise.

    Features are all runs of 1 to ``longest`` consecutive words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z made
    small, joined by one space; a feature's bucket is its CRC-32 modulo ``buckets``.  A bucket gains
    ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))``; a document's ``weight`` is the floored mean gain of its
    features, its ``score`` adds ``floor(-1000 ln(-ln((h + 0.5) / 2^32)))``, h the first 8 hex digits of SHA-256 of
    ``<seed>:<doc_id>``.  Of the documents with ``least_words`` words, the ``percent`` with the highest scores are drawn; ties go
    to the smaller id.

    Returns a row for each row of ``docs``: ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` (1, 2, 3, ...;
    null if not drawn).  Null texts, and texts without words, have no features and weight 0.  A null id has the noise of
    ``<seed>:null`` and comes after other ids; rows with equal ids are drawn each on its own.  Empty tables give empty results,
    an empty target the same gain to buckets of equal counts.  Other columns are not read."""
    scratch = Scratch(docs.sparkSession, "importance")
    features = scratch.table(text_features(docs, text_col, buckets, longest), "features")
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(text_features(target, target_text_col, buckets, longest), buckets))
    weights = features.select("key", "n_words", "buckets").mapInArrow(_weights(gains), "key binary, n_words long, n_features long, weight long")
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("key")
    )
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = named.join(weights, "key").select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))
    scored = scratch.table(scored, "scored")
    drawn = ranked(scored.where(F.col("n_words") >= least_words), scratch, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], percent, 100)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(rest.columns).unionByName(rest)
