"""Sharding, mixing, packing and the whole pipeline against brute force."""

import bisect
import collections
import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_joins import SCHEMA, WORD, components_of, corpus, repeats
from voxelspark.llm import mixing, packing, sharding
from voxelspark.llm.queries import public_tokenizer

TOKENIZER = public_tokenizer("byte_bpe_50k.json")


def spark_hash(name, value):
    h = xxhash.xxh64_intdigest(name.encode(), seed=42)
    return h if value is None else xxhash.xxh64_intdigest(struct.pack("<q", value), seed=h)


def shard_by_hand(value, tree):
    def best(children):
        draws = [(-math.log(((spark_hash(n, value) >> 11) + 0.5) / 2**53) / w, i) for i, (n, w) in enumerate(children) if w]
        return min(draws)[1]

    weight = lambda racks: sum(w for _, shards in racks for _, w in shards)
    name, racks = tree[best([(n, weight(r)) for n, r in tree])]
    rack, shards = racks[best([(f"{name}/{k}", sum(w for _, w in s)) for k, s in racks])]
    return shards[best([(f"{name}/{rack}/{s}", w) for s, w in shards])][0]


def test_shards_by_hand(spark):
    tree = sharding.even_tree(16)
    grown = sharding.grown_tree(tree, 16)
    rows = [(i, "é" * (i % 7), 0, 0, 0, 0) for i in range(3000)] + [(None, None, 0, 0, 0, 0), (5, "", 0, 0, 0, 0), (5, "", 0, 0, 0, 0)]
    got = sharding.hash_tree_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), tree, grown).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=repr)
    for r in got[:400] + [r for r in got if r["doc_id"] is None]:
        assert (r["shard"], r["grown_shard"]) == (shard_by_hand(r["doc_id"], tree), shard_by_hand(r["doc_id"], grown))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 16 and all(sorted(v) == list(range(len(v))) and 100 < len(v) < 300 for v in slots.values())
    assert sharding.hash_tree_shards(spark.createDataFrame([], SCHEMA), tree).isEmpty()


@pytest.mark.parametrize("shards", [1, 3, 5])
def test_fewer_shards_than_racks(spark, shards):
    rows = sharding.hash_tree_shards(spark.range(600).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), sharding.even_tree(shards)).collect()
    count = collections.Counter(r["shard"] for r in rows)
    assert sorted(count) == list(range(shards)) and min(count.values()) > 300 // shards
    assert all(r["shard"] == shard_by_hand(r["doc_id"], sharding.even_tree(shards)) for r in rows[:100])


def test_changed_weight_moves_rows_only_into_its_subtree(spark):
    tree = [("a", [("x", [(0, 1), (1, 1)]), ("y", [(2, 2)])]), ("b", [("z", [(3, 1), (4, 0)])])]
    more = [("a", [("x", [(0, 1), (1, 3)]), ("y", [(2, 2)])]), tree[1]]
    rows = sharding.hash_tree_shards(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), tree, more).collect()
    moved = collections.Counter((r["shard"], r["grown_shard"]) for r in rows if r["shard"] != r["grown_shard"])
    # region a and rack x gained weight: rows come to region a, and inside it to rack x
    assert moved and all(new in (0, 1, 2) if old == 3 else new in (0, 1) for old, new in moved) and all((old, new) != (1, 0) for old, new in moved)
    assert 4 not in {r["shard"] for r in rows}


def water(sizes, weights, cap):
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        if not free:
            return {s: float(cap * sizes[s]) for s in sizes}
        level = (total - sum(cap * sizes[s] for s in capped)) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] >= cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in capped else level * weights[s] for s in sizes}
        capped |= over


DOCS = "doc_id long, text string, lang string, source string, n_chars long, epochs string, part int"


def sourced(n=400):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) or None, "en", rng.choice(["s0"] * 12 + ["s1", "s2", "é", None]), 0, "x", 0) for i in range(n)]
    return [*rows, (n, "one big text " * 900, "en", "z", 0, "x", 0), (n + 1, None, "en", "empty", 0, "x", 0), (None, "no id here", None, "s1", None, None, None), rows[7]]


def test_mix_meets_its_targets(spark):
    rows = sourced()
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(df).collect()
    words = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = water(sizes, {s: i % 3 + 1 for i, s in enumerate(order)}, 3)
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]], abs=1e-5) and r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
    assert {s: taken[s] for s in sizes} == {s: round(target[s]) for s in sizes}
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=repr) == sorted(((r[0], words(r[1])) for r in rows), key=repr)
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(((r["doc_id"], r["taken"]) for r in got), key=repr) == sorted(((r["doc_id"], r["taken"]) for r in again), key=repr)
    assert mixing.mix_sources(df.limit(0)).isEmpty()


def test_mixed_documents_hold_what_the_mix_takes(spark):
    rows = [r for r in sourced() if r[0] is not None]
    df = spark.createDataFrame(list(dict.fromkeys(rows)), DOCS)
    mix = mixing.mix_sources(df)
    out = mixing.mixed_documents(df, mix)
    assert out.columns == df.columns
    got = collections.Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert {k: v for k, v in got.items() if v} == {r["doc_id"]: r["taken"] for r in mix.collect() if r["taken"]}


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30), st.integers(1, 12))
def test_plans_place_every_piece_once(histogram, groups):
    rows, count = packing.plan(histogram, 64, groups)
    bins, ranks = collections.defaultdict(list), collections.Counter()
    for length, lo, hi, base, at in sorted(rows):
        assert lo == ranks[length]
        ranks[length] = hi
        for k in range(hi - lo):
            bins[base + k].append((at, length))
    assert dict(ranks) == histogram and len(bins) == count
    for content in bins.values():
        end = 0
        for at, length in sorted(content):
            assert at == end
            end += length
        assert end <= 64


def best_fit_decreasing(histogram, capacity):
    left, count = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            k = bisect.bisect_left(left, length)
            room = left.pop(k) if k < len(left) else capacity
            count += room == capacity
            if room > length:
                bisect.insort(left, room - length)
    return count


LENGTHS = {
    "uniform": lambda rng: rng.randint(1, 1024),
    "few": lambda rng: rng.choice([330, 345, 360, 690, 700]),
    "middle": lambda rng: rng.randint(350, 900),
    "thirds": lambda rng: rng.randint(150, 400),
    "log-normal": lambda rng: min(1024, max(1, int(rng.lognormvariate(5.2, 0.9)))),
}


@pytest.mark.parametrize("name", LENGTHS)
def test_plans_are_as_tight_as_best_fit_decreasing(name):
    rng = random.Random(1)
    histogram = dict(collections.Counter(LENGTHS[name](rng) for _ in range(20000)))
    assert packing.plan(histogram)[1] <= best_fit_decreasing(histogram, 1024)


def test_few_documents_of_many_lengths_gain_from_configurations():
    rng = random.Random(1)
    histogram = dict(collections.Counter(rng.randint(200, 520) for _ in range(300)))
    assert packing.plan(histogram)[1] < best_fit_decreasing(histogram, 1024)


def test_the_linear_program_is_optimal():
    # sizes 6, 4, 3 in 10: patterns 6+4 and 3+3+3, and a rest; no fewer bins can hold them
    found = packing.optimal_configurations([6, 4, 3], [30, 30, 30], 10)
    assert sum(x for _, x in found) == pytest.approx(40)
    for i, n in enumerate((30, 30, 30)):
        assert sum(c.get(i, 0) * x for c, x in found) >= n - 1e-6
    # against all maximal patterns of small random sizes, by the dual: no pattern is worth more than a bin
    rng = random.Random(3)
    for _ in range(20):
        sizes = rng.sample(range(5, 30), 5)
        counts = [rng.randint(1, 40) for _ in sizes]
        found = packing.optimal_configurations(sizes, counts, 40)
        basis = np.array([[c.get(i, 0) for c, _ in found] for i in range(5)], dtype=float)
        price = np.linalg.solve(basis.T, np.ones(5))
        worth, config = packing._most_worth(np.sort(sizes), price[np.argsort(sizes)], 40)
        assert worth <= 1 + 1e-6 and (basis @ [x for _, x in found] >= np.array(counts) - 1e-6).all()


def test_names_of_other_columns_stay(spark):
    names = ["lo", "hi", "base", "n", "part", "draw", "rank", "nth", "piece", "earlier", "of_length", "offset", "sequence_id"]
    rows = spark.range(300).select("id", (F.col("id") % 200 + 400).alias("length"), *[F.lit(k).alias(c) for k, c in enumerate(names)])
    got = packing.pack(rows)
    assert got.columns == ["id", "length", *names[:-2], "sequence_id", "offset"]
    got = got.collect()
    check_sequences(got)
    assert sorted((r["id"], r["length"], r["lo"], r["earlier"]) for r in got) == [(i, i % 200 + 400, 0, 9) for i in range(300)]


ODD = [None, "", " ", "  a  b\n\n c\t\td", "x y　 z", "<|endoftext|> hi", "a" * 5000, " " * 3000 + "x", "don't I'll 123 abc!!! ### x", "\r\n\r\n  \x85 \x1c z", "日本語 テキスト 🙂🙂"]


def pieces_by_hand(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(want, key=repr)


def check_sequences(rows):
    found = collections.defaultdict(list)
    for r in rows:
        found[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in found.values():
        end = 0
        for at, n in sorted(content):
            assert at == end
            end += n
        assert end <= 1024
    return len(found)


def test_packing(spark):
    rng = random.Random(6)
    texts = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choice(["the", "otter", "zyx,", "Ünder"]) for _ in range(rng.randint(1, 3000)))) for i in range(120)]
    texts += [(3, ODD[3]), (None, "no id"), (100, texts[11][1])]
    df = spark.createDataFrame([(i, t, 0, 0, 0, 0) for i, t in texts], SCHEMA)
    rows = packing.pack(packing.token_pieces(df, TOKENIZER).withColumn("ids_crc32", F.crc32("ids"))).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr) == pieces_by_hand(texts)
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert check_sequences(rows) <= 1.05 * sum(r["length"] for r in rows) / 1024 + 1
    assert packing.pack(packing.token_pieces(df.limit(0), TOKENIZER)).isEmpty()


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = [(i, t, "en", ("a", "b", None)[n % 3], None if t is None else len(t), "x", n) for n, (i, t, *_) in enumerate(corpus())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, epochs int"
    kept = [d for d in docs if repeats(d[1])[-1]]
    stages = dict(corpus_pipeline.STAGES)
    as_rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    first = stages["quality_rules"](spark, spark.createDataFrame(docs, schema), "")
    assert as_rows(first) == sorted(kept, key=repr)
    plain = lambda t: "".join(WORD.findall(t or ""))
    best = {}
    for d in kept:
        rank = (-len(d[1]), d[0] is None, d[0] or 0)
        if plain(d[1]) not in best or rank < best[plain(d[1])][0]:
            best[plain(d[1])] = (rank, d)
    second = stages["exact_duplicates"](spark, first, "")
    assert sorted((r["doc_id"] or -1, plain(r["text"])) for r in second.collect()) == sorted((d[0] or -1, p) for p, (_, d) in best.items())
    left = [tuple(r) for r in second.collect()]
    groups = collections.Counter(c for *_, c in components_of(left, 5, 80))
    third = stages["near_duplicates"](spark, second, "")
    ids = [r["doc_id"] for r in third.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(c for c in groups if c is not None)
    fourth = stages["mix_sources"](spark, third, "")
    assert fourth.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert {r["doc_id"] for r in fourth.collect()} <= set(ids) and all(r["n_chars"] == len(r["text"]) for r in fourth.collect())
    packed = stages["packing"](spark, fourth, "").collect()
    got = collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert got == collections.Counter(r["doc_id"] for r in fourth.collect())
    check_sequences(packed)


@pytest.mark.parametrize("name", ["quality_rules", "exact_duplicates", "near_duplicates", "mix_sources", "packing"])
def test_stages_take_empty_tables(spark, name):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.isEmpty() and (name == "packing" or out.columns == docs.columns)
