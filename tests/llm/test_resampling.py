"""Importance resampling and source divergence against brute force in plain Python, with the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from voxelspark.llm import divergence, importance
from voxelspark.llm.textcore import Words, text_buffers

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string"


def words_of(text, pattern):
    return re.findall(pattern, (text or "").translate(SMALL))


def features_of(text, longest=2):
    w = words_of(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled(docs, target, buckets=10_000, longest=2, least=20, percent=25):
    slot = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(slot, features_of(text, longest)[1]))
    for text in target:
        t.update(map(slot, features_of(text, longest)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        n, f = features_of(text, longest)
        weight = sum(gain(slot(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r.append(k + 1)
    return sorted((tuple(r if len(r) == 6 else [*r, None]) for r in rows), key=repr)


def prose(seed, n):
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "ÄRGER", "straße", "x1", "2024", "日本", "o'neil", "long" * 40, "mid" * 22, "é", "a-b", "tab\tbed", "Z"]
    return " ".join(r.choice(vocabulary) for _ in range(n))


DOCS = [(k, prose(k % 37, 5 + k % 60)) for k in range(120)] + [(1, prose(3, 40)), (None, prose(5, 30)), (None, prose(5, 30)), (None, None), (200, None), (201, ""), (202, "!!! ..."), (203, prose(9, 60_000)), (-4, prose(1, 25))]
TARGET = [prose(900 + k, 30) for k in range(5)] + [None, "", prose(900, 30)]


def target_table(spark, texts=TARGET):
    return spark.createDataFrame([(t,) for t in texts], "text string")


@pytest.mark.parametrize("buckets, longest", [(10_000, 2), (70_000, 3), (7, 1)])
def test_resampling_is_brute_force(spark, buckets, longest):
    docs = spark.createDataFrame([(*d, "e", "s") for d in DOCS], SCHEMA).selectExpr("*", "1 as key", "'k' as copies", "3 as score", "4 as rank", "5 as __place")
    got = importance.importance_resampling(docs.repartition(5), target_table(spark), buckets=buckets, longest=longest)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rows = [tuple(r) for r in got.collect()]
    want = resampled(DOCS, TARGET, buckets, longest)
    # rows that share a null id and a score may swap ranks
    assert sorted(rows, key=repr) == want


def test_resampling_of_nothing(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(*d, "e", "s") for d in DOCS[:30]], SCHEMA)
    assert importance.importance_resampling(none, target_table(spark)).count() == 0
    got = importance.importance_resampling(some, target_table(spark, [])).collect()
    assert sorted((tuple(r) for r in got), key=repr) == resampled(DOCS[:30], [])


def test_copies_are_counted_once_each(spark):
    docs = [(k, prose(1, 50)) for k in range(400)] + [(1000 + k, prose(k, 30)) for k in range(20)]
    got = importance.importance_resampling(spark.createDataFrame([(*d, "e", "s") for d in docs], SCHEMA), target_table(spark))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled(docs, TARGET)
    assert importance.text_features(spark.createDataFrame([(*d, "e", "s") for d in docs], SCHEMA), "text", 100, 2).count() < 22


def test_checksums_of_runs():
    import pyarrow as pa

    texts = ["one two three", "", "x" * 65 + " y" + " z" * 3, "ü" * 200 + " " + "k" * 64 + " " + "w" * 1000, None, "lone"]
    words = Words(*text_buffers(pa.array(texts)), lower=True, between=importance._BETWEEN)
    got = sorted((int(t), int(c)) for texts_, crcs in importance.run_checksums(words, 3) for t, c in zip(texts_, crcs, strict=True))
    assert got == sorted((k, zlib.crc32(f.encode())) for k, t in enumerate(texts) for f in features_of(t, 3)[1])


def test_ranks_run_over_ranges(spark):
    from voxelspark.llm.runtime import Scratch

    rows = spark.range(5000).selectExpr("id", "cast(pmod(id * 7919, 97) as int) as score")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        from pyspark.sql import functions as F

        got = importance.ranked(rows, Scratch(spark, "ranks"), [F.col("score").desc(), F.col("id")], 1, 3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(range(5000), key=lambda i: (-(i * 7919 % 97), i))
    want = {i: k + 1 if k < 1666 else None for k, i in enumerate(order)}
    assert {r["id"]: r["rank"] for r in got} == want


# --- divergence --------------------------------------------------------------------------------------------------------


def diverged(docs, least=3, most=200):
    plain = [(lang or "", source or "", words_of(text, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")) for _, text, lang, source in docs]
    out = []
    for lang in {p[0] for p in plain}:
        own = [p for p in plain if p[0] == lang]
        df = Counter(t for p in own for t in set(p[2]))
        kept = [t for t in df if df[t] >= least]
        counts = {s: Counter(t for p in own if p[1] == s for t in p[2] if df[t] >= least) for s in {p[1] for p in own}}
        whole = sum(counts.values(), Counter())
        share = lambda c, k: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(counts[s], 0) for s in counts}, share(whole, 0)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:most]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found)]
    return sorted(out)


def mixed(n=150):
    r = random.Random(4)
    common = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["Größe", "ﬁn", "naïve", "日本", "Z", "z"]
    docs = []
    for k in range(n):
        lang, source = r.choice(["en", "en", "de", None, ""]), r.choice(["a", "a", "B", "é", None, "", "𝒳"])
        docs.append((k, " ".join(r.choice(common[(len(source or "") * 40) :]) for _ in range(r.randint(0, 80))), lang, source))
    return [*docs, *docs[:3], (None, None, "en", "empty"), (7, "", "xx", "only"), (8, "rare words here", "yy", "one"), (9, "rare", "yy", "two"), (1, "mono mono", "zz", "s"), (1, "mono", "zz", "s"), (1, "mono", "zz", "s"), (5, "wa " * 50_000, "de", "a")]


@pytest.mark.parametrize("least, most, block_terms", [(3, 200, 512), (1, 5, 1), (2, 7, 40)])
def test_divergence_is_brute_force(spark, monkeypatch, least, most, block_terms):
    docs = mixed()
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "'x' as term", "2 as count", "3 as n", "4 as block").repartition(4)
    got = divergence.source_divergence(df, least, most, block_terms=block_terms)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == diverged(docs, least, most)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact_beyond_64_bits():
    rng = np.random.default_rng(0)
    total = rng.integers(1, 9 * 10**15, 2000)
    count = (total * rng.random(2000)).astype(np.int64)
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total, strict=True)]


def test_pairs_in_pieces(monkeypatch):
    p = np.random.default_rng(1).integers(1, 10**9, (7, 30))
    want = [[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(p[i], p[j], strict=True)) for j in range(7)] for i in range(7)]
    for size in (1, 500, 1 << 20):
        monkeypatch.setattr(divergence, "_BROADCAST", size)
        assert divergence.tile_pairs(p).tolist() == want
