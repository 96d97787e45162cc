"""How the sources of a language differ in their terms, from dense tiles of groups by terms.

The terms that a language keeps are dealt into blocks.  A block is a dense matrix of 64-bit integers, a row for each
(language, source) group and a column for each term.  All pairs of its rows are compared by broadcasting; the partial
matrices of pair sums and the lists of each group's highest terms are merged in the task over all of its blocks, and
then over tasks by grouping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, bounded_batches
from .textcore import passes

#: A term is a run of what is not in ``[\x00-\x40\x5B-\x60\x7B-\x7F]``, with A-Z made small.
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[0x00:0x41] = _BETWEEN[0x5B:0x61] = _BETWEEN[0x7B:0x80] = True
#: Terms of a block: so many for few groups, more for many, but no more entries of a tile than ``TILE``.
BLOCK_TERMS, TILE = 4096, 1 << 22
#: Entries of one broadcast of pairs.
_BROADCAST = 1 << 20

_COUNTS = "lang string, source string, term string, count long, docs long"


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term in each group, and documents that hold it, for each few megabytes of text."""
    for batch in batches:
        for lo, hi, words in passes(batch.column(2), lower=True, between=_BETWEEN):
            if not len(words.starts):
                continue
            terms = words.strings().dictionary_encode()
            term, n = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
            doc = np.repeat(np.arange(hi - lo), np.diff(words.first))
            pair, count = np.unique(doc * n + term, return_counts=True)
            langs, sources = (batch.column(k).slice(lo, hi - lo).dictionary_encode() for k in (0, 1))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            both, at = np.unique(group[pair // n] * n + pair % n, return_inverse=True)
            counts, docs = np.zeros(len(both), dtype=np.int64), np.bincount(at, minlength=len(both))
            np.add.at(counts, at, count)
            g = both // n
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(g // len(sources.dictionary))),
                    sources.dictionary.take(pa.array(g % len(sources.dictionary))),
                    terms.dictionary.take(pa.array(both % n)).cast(pa.string()),
                    pa.array(counts),
                    pa.array(docs),
                ],
                ["lang", "source", "term", "count", "docs"],
            )


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 count / total)`` for ``count <= total``, exact for totals below 9 * 10^15: three digits at a time."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def tile_pairs(p: np.ndarray) -> np.ndarray:
    """``[i, j]``: the sum over columns of ``floor((p_i - p_j)^2 / p_j)``."""
    groups, terms = p.shape
    out = np.zeros((groups, groups), dtype=np.int64)
    step = max(1, _BROADCAST // max(1, groups * terms))
    for i in range(0, groups, step):
        d = p[i : i + step, None, :] - p[None, :, :]
        out[i : i + step] = (d * d // p[None, :, :]).sum(axis=2)
    return out


class _Language:
    """What the blocks of a language have come to so far."""

    def __init__(self, lang: str, most: int):
        self.lang, self.most = lang, most
        self.sources: list[str] = []
        self.pairs = np.zeros((0, 0), dtype=np.int64)
        self.best: list[list[tuple[int, bytes]]] = []

    def add(self, block: pa.Table) -> None:
        head = block.filter(pc.is_null(block["term"]))
        order = pc.sort_indices(head["source"].cast(pa.binary()).combine_chunks())
        head = head.take(order)
        if not self.sources:
            self.sources = head["source"].to_pylist()
            self.pairs = np.zeros((len(self.sources),) * 2, dtype=np.int64)
            self.best = [[] for _ in self.sources]
        total = head["count"].to_numpy() + head["vocabulary"].to_numpy()
        cells = block.filter(pc.is_valid(block["term"]))
        if not len(cells):
            return
        terms = pc.unique(cells["term"].cast(pa.binary()))
        terms = terms.take(pc.sort_indices(terms))
        tile = np.zeros((len(self.sources), len(terms)), dtype=np.int64)
        row = pc.index_in(cells["source"].cast(pa.string()).combine_chunks(), value_set=pa.array(self.sources, pa.string())).to_numpy()
        column = pc.index_in(cells["term"].cast(pa.binary()).combine_chunks(), value_set=terms).to_numpy()
        tile[row, column] = cells["count"].to_numpy()
        p = shares(tile + 1, total[:, None])
        vocabulary = head["vocabulary"][0].as_py()
        q = shares(tile.sum(axis=0) + 1, total.sum() - (len(self.sources) - 1) * vocabulary)
        self.pairs += tile_pairs(p)
        d = p - q
        value = d * d // q
        for i in range(len(self.sources)):
            some = np.flatnonzero((tile[i] > 0) & (d[i] > 0))
            some = some[np.argsort(-value[i, some], kind="stable")[: self.most]]  # columns go by term, so ties do too
            found = self.best[i] + list(zip((-value[i, some]).tolist(), terms.take(pa.array(some)).to_pylist(), strict=True))
            self.best[i] = sorted(found)[: self.most]

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "part", "item", "value"]
        for i, source in enumerate(self.sources):
            others = [j for j in range(len(self.sources)) if j != i]
            items = [self.sources[j] for j in others] + [t.decode() for _, t in self.best[i]]
            values = self.pairs[i, others].tolist() + [-v for v, _ in self.best[i]]
            part = ["pair"] * len(others) + ["term"] * len(self.best[i])
            n = len(items)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in ([self.lang] * n, [source] * n, part, items)] + [pa.array(values, pa.int64())], names)


def _tiles(most: int):
    """Blocks come one after another, sorted by language and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, language = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            langs, blocks = table["lang"].to_pylist(), table["block"].to_numpy()
            cut = [0] + [k for k in range(1, len(langs)) if blocks[k] != blocks[k - 1] or langs[k] != langs[k - 1]] + [len(langs)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                key = (langs[a], int(blocks[a]))
                if now is not None and key != now:
                    language.add(pa.concat_tables(waiting))
                    waiting = []
                    if key[0] != now[0]:
                        yield from language.rows()
                        language = None
                now, language = key, language or _Language(key[0], most)
                waiting.append(table.slice(a, b - a))
        if language is not None:
            language.add(pa.concat_tables(waiting))
            yield from language.rows()

    return run


def source_divergence(
    docs: DataFrame, least_docs: int = 3, most_terms: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """What sets the sources of each language apart.

    Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z made small; a language keeps the V terms that at least ``least_docs`` of
    its documents hold.  In a group (language, source), and in the language as a whole, a kept term that occurs ``count`` times
    among N has ``p = 1 + floor(10^9 (count + 1) / (N + V))``; two shares differ by ``f = floor((p - q)^2 / q)``.

    Returns ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.  Part ``pair``: the sum of f over all kept terms against
    each other source of the language, p the group's.  Part ``term``: f against the language for each kept term that the
    group holds more of than the language, the first ``most_terms``.  Ranks go from 1 in each group and part, by value
    descending, then by item in UTF-8.

    Null texts, languages and sources are empty strings.  A group without terms has pairs all the same, a language that keeps
    no term has pairs of value 0, a language of one source no pairs.  Repeated rows count each.  An empty table gives an empty
    result.  Other columns are not read.  A task holds one tile, the sums of pairs and the lists of terms of one language: all
    grow with the number of its sources alone."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "divergence")
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = plain.mapInArrow(_term_counts, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    first = (F.col("source") == F.min("source").over(same)).cast("long")
    kept = counts.select("lang", "source", "term", "count", F.sum("docs").over(same).alias("docs"), first.alias("first")).where(F.col("docs") >= least_docs)
    kept = scratch.table(kept.select("lang", "source", "term", "count", "first"), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum("first").alias("first"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("first", F.lit(0)).alias("first"))
    lang = Window.partitionBy("lang")
    n_groups = F.count("*").over(lang)
    terms = F.greatest(F.least(F.greatest(F.lit(block_terms), 16 * n_groups), F.floor(F.lit(TILE) / n_groups)), F.lit(1))
    groups = groups.select("lang", "source", "n", F.sum("first").over(lang).alias("vocabulary"), terms.alias("terms"))
    groups = scratch.table(groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / F.col("terms"))).cast("long")), "groups")
    languages = scratch.table(groups.select("lang", "vocabulary", "blocks").distinct(), "languages")
    cells = kept.join(languages, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "count", "vocabulary")
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.col("n").alias("count"), "vocabulary")
    blocks = cells.unionByName(heads).repartition("lang", "block").sortWithinPartitions("lang", "block")
    found = scratch.table(blocks.mapInArrow(_tiles(most_terms), "lang string, source string, part string, item string, value long"), "tiles")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    best = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= most_terms)
    return pairs.withColumn("rank", rank).unionByName(best)
