"""Exact duplicates by Patricia-trie owners.

Texts go to partitions by the length and a hash of their normalised bytes.  Each partition inserts whole byte strings
into a compressed radix trie; the terminal node of a string holds its owner (the row that stays) and the number of its
rows.  A first trie beside the scan joins copies before anything is shuffled, so that a group of any size sends one
string for each scan task.  A trie over its memory budget writes its heaviest subtree to a file, appends later strings
of that subtree there, and builds each such subtree after the others.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch, bounded_batches

#: Deleted before texts are compared.
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes of labels that one trie holds in memory.
TRIE_BYTES = 128 << 20

Owner = tuple[int, int, int]  # code points negated, id, rows: the least is the row that stays
_NO_ID = 1 << 63


def _common(a: bytes, at: int, b: bytes) -> int:
    """Length of the longest common prefix of ``a[at:]`` and ``b``."""
    lo, most = 0, min(len(a) - at, len(b))
    while lo < most and a[at + lo : at + lo + 256] == b[lo : lo + 256] and lo + 256 <= most:
        lo += 256
    while lo < most and a[at + lo] == b[lo]:
        lo += 1
    return lo


def _read(file: str) -> Iterator[tuple[bytes, Owner]]:
    with open(file, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


class _Node:
    __slots__ = ("children", "file", "label", "owner")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, _Node] = {}
        self.owner: Owner | None = None
        self.file: str | None = None  # a spilled subtree: no children, its strings are in the file


class PatriciaTrie:
    """Byte strings to owners; equal strings join their owners."""

    def __init__(self, folder: str, budget: int = TRIE_BYTES):
        self.root, self.folder, self.budget, self.bytes, self.spilled = _Node(b""), folder, budget, 0, 0

    def add(self, key: bytes, owner: Owner) -> None:
        node, at = self.root, 0
        while True:
            if node.file is not None:
                with open(node.file, "ab") as f:
                    pickle.dump((key[at:], owner), f)
                return
            if at == len(key):
                old = node.owner
                node.owner = owner if old is None else (*min(old[:2], owner[:2]), old[2] + owner[2])
                return
            child = node.children.get(key[at])
            if child is None:
                leaf = _Node(key[at:])
                leaf.owner = owner
                node.children[key[at]] = leaf
                self.bytes += len(leaf.label) + 200
                if self.bytes > self.budget:
                    self._spill()
                return
            same = _common(key, at, child.label)
            if same < len(child.label):
                upper = _Node(child.label[:same])
                child.label = child.label[same:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self.bytes += 200
                child = upper
            node, at = child, at + same

    def _weigh(self, node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + 200
            stack += x.children.values()
        return total

    def _spill(self) -> None:
        """Write the heaviest subtree below the first node that branches."""
        node = self.root
        while len(live := [c for c in node.children.values() if c.file is None]) == 1 and live[0].children:
            node = live[0]
        if not live or (len(live) == 1 and not live[0].children):
            return  # one string: nothing to part
        heaviest = max(live, key=self._weigh)
        file = os.path.join(self.folder, f"subtree-{id(self)}-{self.spilled}")
        self.spilled += 1
        self.bytes -= self._weigh(heaviest)
        with open(file, "ab") as f:
            for key, owner in self._walk(heaviest, b""):
                pickle.dump((key, owner), f)
            for head, inner in self._files(heaviest):  # subtrees below that were written earlier
                for key, owner in _read(inner):
                    pickle.dump((head + key, owner), f)
                os.remove(inner)
        heaviest.children, heaviest.owner, heaviest.file = {}, None, file

    def _walk(self, node: _Node, head: bytes) -> Iterator[tuple[bytes, Owner]]:
        stack = [(node, head)]
        while stack:
            x, at = stack.pop()
            if x.owner is not None:
                yield at, x.owner
            for child in x.children.values():
                if child.file is None:
                    stack.append((child, at + child.label))

    def _files(self, node: _Node) -> Iterator[tuple[bytes, str]]:
        """Written subtrees below a node, and what leads to them from there."""
        stack = [(node, b"")]
        while stack:
            x, at = stack.pop()
            if x.file is not None:
                yield at, x.file
            stack += [(child, at + child.label) for child in x.children.values()]

    def items(self) -> Iterator[tuple[bytes, Owner]]:
        """Every string once, with its owner; spilled subtrees last, each built again on its own."""
        yield from self._walk(self.root, b"")
        files = list(self._files(self.root))
        self.root = _Node(b"")
        for head, file in files:
            below = PatriciaTrie(self.folder, self.budget)
            for key, owner in _read(file):
                below.add(key, owner)
            os.remove(file)
            for key, owner in below.items():
                yield head + key, owner


def _emit(trie: PatriciaTrie, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        key, owner = zip(*rows, strict=True) if rows else ((), ())
        points, ids, count = zip(*owner, strict=True) if owner else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([len(k) for k in key], pa.int64()),
                pa.array([xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in key], pa.int64()),
                pa.array(key, pa.binary()),
                pa.array([-p for p in points], pa.int64()),
                pa.array([None if i == _NO_ID else i for i in ids], pa.int64()),
                pa.array(count, pa.int64()),
            ],
            ["size", "hash", "bytes", "points", "id", "rows"],
        )

    for item in trie.items():
        rows.append(item)
        size += len(item[0])
        if size > most:
            yield batch()
            rows, size = [], 0
    yield batch()


_OWNERS = "size long, hash long, bytes binary, points long, id long, rows long"


def _beside_scan(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            trie = PatriciaTrie(folder, 4 * budget)
            for batch in batches:
                for i, text, points in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    trie.add(text.encode().translate(None, WHITE), (-points, _NO_ID if i is None else i, 1))
                    if trie.bytes > budget:  # what comes later meets it after the shuffle
                        yield from _emit(trie)
                        trie = PatriciaTrie(folder, 4 * budget)
            yield from _emit(trie)

    return run


def _owners(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            trie = PatriciaTrie(folder, budget)
            for batch in batches:
                for key, points, i, rows in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    trie.add(key, (-points, _NO_ID if i is None else i, rows))
            sha, points, ids, rows = [], [], [], []
            for key, (p, i, n) in trie.items():
                if n > 1:
                    sha.append(hashlib.sha256(key).digest())
                    points.append(-p)
                    ids.append(None if i == _NO_ID else i)
                    rows.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sha, pa.binary()), pa.array(points, pa.int64()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())],
                ["sha", "best", "keep_id", "group_size"],
            )

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """Group rows whose texts are equal after deleting every character of ``[\\x20\\x09-\\x0D]``.

    Of a group, the row with the most code points in its original text stays, then the one with the smallest id.  Returns
    a row for each row of ``docs``: ``doc_id``, ``keep_id`` (id of the row that stays), ``group_size``, ``kept`` and
    ``text_sha256`` (lowercase hex of the normalised text in UTF-8).

    Null counts as empty; empty and white-space texts are one group.  A null id sorts after all others.  If rows with
    equal ids are in one group, one of them stays.  An empty table gives an empty result.  Only the two named columns are
    read.  ``budget`` is the bytes of labels a trie holds before it spills; texts of any length are compared whole."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # groups of two rows or more; all other rows are their own owners
    owners = (
        texts.select("doc_id", "text", F.length("text").cast("long").alias("points"))
        .mapInArrow(_beside_scan(budget), _OWNERS)
        .repartition("size", "hash")
        .select("bytes", "points", "id", "rows")
        .mapInArrow(_owners(budget), "sha binary, best long, keep_id long, group_size long")
    )
    owners = scratch.table(owners, "owners")
    white = WHITE.decode()
    narrow = texts.select(
        "doc_id", F.length("text").cast("long").alias("points"), F.unhex(F.sha2(F.translate("text", white, "").cast("binary"), 256)).alias("sha")
    )
    joined = narrow.join(owners, "sha", "left")
    # rows that share the id and size of an owner: one of them stays
    twin = joined.withColumn("twin", F.xxhash64("sha", "doc_id", "points"))
    alike = Window.partitionBy("twin").orderBy("sha", "doc_id", "points")
    nth = F.row_number().over(alike) - F.rank().over(alike) + 1
    chosen = F.col("group_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("best")) & (F.col("nth") == 1))
    return twin.withColumn("nth", nth).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        chosen.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
