"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row for each distinct set of word shingles and a column for each shingle.  Its product with
its own transpose holds all overlaps; two bounds that follow from the sizes keep most of it from being formed:

* sets of n and m shingles with Jaccard similarity t share at least ``t (n + m) / (1 + t)`` of them, so m lies between
  ``t n`` and ``n / t``, and one of the first ``n - ceil(t n) + 1`` columns of each row, in any order of columns that all
  rows share, is common to both;
* if the first common column stands at places i and j of the two rows, at most ``min(n - i, m - j)`` are common.

Columns are ordered by a hash, the frequent ones last, so that common passages seldom join rows.  A column with few rows
gives its pairs; one with many gives a spanning forest of the pairs that pass the bounds.  Forests join rows to clusters
(groups of near copies); a cluster is multiplied in blocks of bounded size, the other pairs one by one.  All overlaps
that decide a link are counted over whole sets, so which columns count as frequent changes the cost, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import Scratch, bounded_batches, filter_bits, filter_has, filter_slots
from .textcore import U64, mix64, passes, shingles

#: Share of the hash space whose shingles are kept for the search; rows that need more keep all.
REGION = 0.35
#: A shingle in so many documents counts as frequent, and at most so many (the most frequent) are broadcast: 16 MB.
FREQUENT, FREQUENT_MOST = 8, 1 << 20
#: A column with more rows than this gives a forest; a column is cut into blocks of so many rows.
PAIRS_MOST, COLUMN_BLOCK = 16, 4096
#: Rows and shingles of a block of a cluster.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 2_000_000


def _key(values: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes(), seed=len(values)))))


def _least(n: int, t: int) -> int:
    """Least overlap with any set for a similarity of t percent."""
    return -(-t * n // 100)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of the text column of a batch, ASCII letters lower-cased."""
    column = batch.column(1)
    for lo, _, words in passes(column, lower=True):
        h = words.hashes()
        for k in range(len(words)):
            yield lo + k, np.unique(shingles(h[words.first[k] : words.first[k + 1]], width))


def _search_rows(width: int, t: int):
    cut = U64(int(REGION * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, size, low = [], [], []
            for _, s in _sets(batch, width):
                n = len(s)
                few = int(np.searchsorted(s, cut))
                key.append(_key(s) if n else None)
                size.append(n)
                low.append((s[:few] if few > n - _least(n, t) else s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(low, pa.binary())], ["doc_id", "k", "n", "low"]
            )

    return run


def _explode_low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[int, bytes] = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(seen.values()), dtype=np.int64))], ["s"])


def _prefixes(t: int, frequent):
    """Rows of the search: shingle, block of its column, class, size and place."""
    cut = U64(int(REGION * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank, blocks = frequent.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            done = set()
            for k, n, low in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k in done:
                    continue
                done.add(k)
                s = np.frombuffer(low, dtype=U64)
                at = np.minimum(np.searchsorted(hot, s), max(len(hot) - 1, 0))
                common = hot[at] == s if len(hot) else np.zeros(len(s), dtype=bool)
                # below the region, then above it; rare ones by hash, then frequent ones by rank
                order = np.lexsort((np.where(common, rank[at] if len(hot) else 0, 0), common, s >= cut))[: n - _least(n, t) + 1]
                s, wide = s[order], np.where(common, blocks[at] if len(hot) else 1, 1)[order]
                place = np.arange(len(s))
                own = mix64(np.array([k], dtype=np.int64).view(U64))[0]
                mine = (own % wide.astype(U64)).astype(np.int64)
                copies = np.repeat(np.arange(len(s)), wide)
                other = np.arange(len(copies)) - np.repeat(np.cumsum(wide) - wide, wide)
                i, j = np.minimum(mine[copies], other), np.maximum(mine[copies], other)
                for column, values in zip(out, (_signed(s[copies]), i * (1 << 24) + j, np.full(len(copies), k), np.full(len(copies), n), place[copies]), strict=True):
                    column.append(values)
            if done:
                arrays = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(kind)) for x, kind in zip(arrays, (np.int64, np.int64, np.int64, np.int32, np.int32), strict=True)], ["s", "blk", "k", "n", "place"]
                )

    return run


def _passing(n: int, place: int, sizes: np.ndarray, places: np.ndarray, t: int) -> np.ndarray:
    """Which sets, none smaller than n, may be similar: the bounds by size and by the places of a common column."""
    least = -(-t * (n + sizes) // (100 + t))
    return (100 * n >= t * sizes) & (n - place >= least) & (sizes - places >= least)


def _candidates(t: int):
    """Pairs (kind 0) of short columns and forests (kind 1) of long ones, from rows sorted by column and size."""

    def column(k: np.ndarray, n: np.ndarray, p: np.ndarray, out: list[list]) -> None:
        long, root = len(k) > PAIRS_MOST, np.arange(len(k))
        for x in range(len(k) - 1):
            hi = x + 1 + int(np.searchsorted(n[x + 1 :], 100 * int(n[x]) // t, side="right"))
            y = np.flatnonzero(_passing(int(n[x]), int(p[x]), n[x + 1 : hi], p[x + 1 : hi], t)) + x + 1
            y = y[k[y] != k[x]]
            if long and len(y):
                merged = np.unique(root[y])
                merged = merged[merged != root[x]]
                y = merged
                root[np.isin(root, merged)] = root[x]
            out[0] += [int(long)] * len(y)
            out[1] += np.minimum(k[x], k[y]).tolist()
            out[2] += np.maximum(k[x], k[y]).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        empty = [np.zeros(0, dtype=np.int64)] * 5

        def work(arrays: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], pa.RecordBatch]:
            s, blk, k, n, p = arrays
            new = np.flatnonzero((s[1:] != s[:-1]) | (blk[1:] != blk[:-1])) + 1
            bounds = np.concatenate([[0], new, [len(s)]]) if len(s) else np.zeros(1, dtype=np.int64)
            if not last:
                keep, bounds = int(bounds[-2]) if len(bounds) > 1 else 0, bounds[:-1]
            else:
                keep = len(s)
            out: list[list] = [[], [], []]
            length = np.diff(bounds)
            two = bounds[:-1][length == 2]
            small, large = n[two], n[two + 1]
            least = -(-t * (small + large) // (100 + t))
            ok = (100 * small >= t * large) & (small - p[two] >= least) & (large - p[two + 1] >= least) & (k[two] != k[two + 1])
            for lo, size in zip(bounds[:-1][length > 2].tolist(), length[length > 2].tolist(), strict=True):
                column(k[lo : lo + size], n[lo : lo + size], p[lo : lo + size], out)
            x, y = k[two[ok]], k[two[ok] + 1]
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.zeros(len(x), np.int32), np.array(out[0], np.int32)])),
                    pa.array(np.concatenate([np.minimum(x, y), np.array(out[1], np.int64)])),
                    pa.array(np.concatenate([np.maximum(x, y), np.array(out[2], np.int64)])),
                ],
                ["kind", "a", "b"],
            )
            return [v[keep:] for v in arrays], made

        for batch in batches:
            arrays = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
            arrays = [np.concatenate([a, b]) for a, b in zip(rest, arrays, strict=True)] if rest else arrays
            rest, made = work(arrays, False)
            if len(made):
                yield made
        yield work(rest or empty, True)[1]

    return run


def _whole_sets(width: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            slots = batch.column(2).flatten().to_numpy().reshape(-1, 3)
            batch = batch.filter(pa.array(filter_has(table, slots)))
            key, size, blob = [], [], []
            for _, s in _sets(batch, width):
                if len(s):
                    key.append(_key(s))
                    size.append(len(s))
                    blob.append(s.tobytes())
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(blob, pa.binary())], ["k", "n", "blob"])

    return run


def _check_pairs(t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), dtype=U64), np.frombuffer(y.as_buffer(), dtype=U64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * both >= t * (len(x) + len(y) - both):
                    keep.append(i)
            if keep:
                a, b = batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([a, b]), pa.concat_arrays([b, a]), pa.array(np.ones(2 * len(keep), np.int64))], ["a", "b", "links"]
                )

    return run


def overlaps(blobs: list[np.ndarray]) -> np.ndarray:
    """The product of an incidence matrix with its transpose: overlaps of all pairs of the given sorted sets."""
    m = len(blobs)
    row = np.repeat(np.arange(m), [len(b) for b in blobs])
    values = np.concatenate(blobs) if blobs else np.zeros(0, U64)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(values)]]))
    total = np.zeros((m, m), dtype=np.int64)
    for c in range(2, 9):  # thin columns: their few products one place at a time
        at = first[count == c]
        for i in range(c):
            for j in range(i + 1, c):
                total += np.bincount(row[at + i] * m + row[at + j], minlength=m * m).reshape(m, m)
    total += total.T
    wide = np.flatnonzero(count > 8)
    for lo in range(0, len(wide), 2048):  # wide columns: dense blocks
        cols = wide[lo : lo + 2048]
        at = np.repeat(first[cols], count[cols]) + np.arange(count[cols].sum()) - np.repeat(np.cumsum(count[cols]) - count[cols], count[cols])
        block = np.zeros((m, len(cols)), dtype=np.float32)
        block[row[at], np.repeat(np.arange(len(cols)), count[cols])] = 1
        total += (block @ block.T).astype(np.int64)
    return total


def _multiply(t: int):
    def run(table: pa.Table) -> pa.Table:
        k, side = table["k"].to_numpy(), table["side"].to_numpy()
        blobs = [np.frombuffer(x, dtype=U64) for x in table["blob"].to_pylist()]
        n = np.array([len(b) for b in blobs])
        both = overlaps(blobs)
        near = 100 * both >= t * (n[:, None] + n[None, :] - both)
        np.fill_diagonal(near, False)
        if table["bi"][0].as_py() != table["bj"][0].as_py():
            near &= side[:, None] != side[None, :]
        root = np.arange(len(k))
        for x in range(len(k)):
            merged = np.unique(root[near[x]])
            merged = merged[merged != root[x]]
            if len(merged):
                root[np.isin(root, merged)] = root[x]
        links = near.sum(axis=1)
        at = np.flatnonzero(links)
        return pa.table({"a": pa.array(k[at]), "b": pa.array(k[root[at]]), "links": pa.array(links[at].astype(np.int64))})

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Link documents whose sets of word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a set has the distinct shingles of ``width`` words,
    or with fewer words the whole sequence.  Returns a row for each row of ``docs``: ``doc_id``, ``n_shingles``,
    ``class_id`` (rows with equal sets share it; null for an empty set), ``n_links`` (classes other than its own that
    are similar) and ``component_id``, the smallest ``doc_id`` that links reach, itself included.

    Null and empty texts, and texts of white space, have an empty set: they link to nothing, copies of them too.  Rows
    with equal sets are linked, repeated rows included; a null ``doc_id`` takes the smallest one of its component, null
    if there is none.  An empty table gives an empty result.  Only ``id_col`` and ``text_col`` are read, so other
    columns may have any name.  Shingles and classes are 64-bit hashes."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    t = percent
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.table(texts.mapInArrow(_search_rows(width, t), "doc_id long, k long, n long, low binary"), "rows")
    some = rows.where("n > 0")

    counts = some.select("k", "low").mapInArrow(_explode_low, "s long").groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= FREQUENT)
    counts = scratch.table(counts, "counts")
    least, have = FREQUENT, {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("c")).cast("int")).count().collect()}
    while sum(v for k, v in have.items() if 2**k >= least) > FREQUENT_MOST:
        least *= 2
    top = counts.where(F.col("c") >= least).toArrow()
    hot, df = top["s"].to_numpy().view(U64), top["c"].to_numpy()
    order = np.argsort(hot)
    hot, df = hot[order], df[order]
    rank = np.empty(len(hot), dtype=np.int64)
    rank[np.lexsort((hot, df))] = np.arange(len(hot))
    frequent = spark.sparkContext.broadcast((hot, rank, np.maximum(-(-df // COLUMN_BLOCK), 1)))
    scratch.drop(counts)

    found = (
        some.select("k", "n", "low")
        .mapInArrow(_prefixes(t, frequent), "s long, blk long, k long, n int, place int")
        .repartition("s", "blk")
        .sortWithinPartitions("s", "blk", "n", "k")
        .mapInArrow(_candidates(t), "kind int, a long, b long")
        .distinct()
    )
    found = scratch.table(found, "found")

    cluster = scratch.table(components(found.where("kind = 1"), scratch).withColumnRenamed("node", "k").withColumnRenamed("label", "cluster"), "clusters")
    pairs = (
        found.where("kind = 0")
        .select("a", "b")
        .join(cluster.select(F.col("k").alias("a"), F.col("cluster").alias("ca")), "a", "left")
        .join(cluster.select(F.col("k").alias("b"), F.col("cluster").alias("cb")), "b", "left")
        .where("ca is null or cb is null or ca != cb")
        .select("a", "b")
    )
    pairs = scratch.table(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).union(cluster.select("k")).distinct()
    classes = scratch.table(some.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "classes")
    bits = spark.sparkContext.broadcast(filter_bits(classes.join(needed, "k", "left_semi").select(F.coalesce("first_id", F.lit(-1)).alias("id")), "id"))
    sets = (
        texts.select("doc_id", "text", filter_slots(F.coalesce("doc_id", F.lit(-1))).alias("slots"))
        .mapInArrow(_whole_sets(width, bits), "k long, n long, blob binary")
        .join(needed, "k", "left_semi")
        .dropDuplicates(["k"])
    )
    sets = scratch.table(sets, "sets")

    single = (
        pairs.join(sets.select(F.col("k").alias("a"), F.col("blob").alias("x")), "a")
        .join(sets.select(F.col("k").alias("b"), F.col("blob").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_check_pairs(t), "a long, b long, links long")
    )
    width_of = cluster.join(sets.select("k", "n"), "k").groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb")
    )
    # blocks are dealt on narrow rows; only then do the sets join, by class, so that no task meets all sets of a cluster
    dealt = cluster.join(width_of, "cluster").withColumn("side", F.pmod(F.xxhash64("k"), F.col("nb")).cast("int"))
    dealt = scratch.table(dealt, "dealt")
    product = (
        dealt.join(sets.select("k", "blob"), "k")
        .withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
        .select("cluster", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "k", "blob")
        .groupBy("cluster", "bi", "bj")
        .applyInArrow(_multiply(t), "a long, b long, links long")
    )
    links = scratch.table(single.union(product), "links")

    label = components(links, scratch).withColumnRenamed("node", "k")
    known = (
        classes.join(label, "k", "left")
        .join(links.groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("n_links")), "k", "left")
        .where("copies > 1 or label is not null")
        .withColumn("label", F.coalesce("label", "k"))
    )
    least_id = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    known = scratch.table(known.join(least_id, "label").select("k", "component_id", "n_links"), "known")
    scratch.drop(found, cluster, pairs, classes, sets, dealt, links)
    return rows.select("doc_id", "k", "n").join(known, "k", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("k").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
