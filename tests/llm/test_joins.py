"""Duplicates: n-gram join, tries and suffix arrays against brute force."""

import collections
import hashlib
import itertools
import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelspark.llm import exact_dedup, ngram_join, repetition, textcore

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, k long, size long, group_size long, component_id long"


def shingle_set(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def corpus(seed=5):
    """Near copies in a large and some small groups, a common line, copies, odd texts, repeated rows, a null id."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    line = " ".join(word() for _ in range(13))
    texts = [None, "", " \t\n", "one", "One", "one two", "x " * 50, "word word next"]
    base = [word() for _ in range(160)]
    for n, edits in ((45, 2), (5, 3), (3, 1)):
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        base = [word() for _ in range(rng.randint(30, 400))]
    texts += [f"{line}\n" + " ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(40)]
    texts += [texts[8].upper(), texts[9].replace(" ", "\n"), texts[-1]]
    rows = [(100 + i, t, 1, 2, 3, 4) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[3], (None, texts[10], 0, 0, 0, 0), (None, "nobody else has this text", 0, 0, 0, 0)]


def components_of(rows, width, percent):
    sets = [shingle_set(r[1], width) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((r[0], len(s), ids[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_join_finds_all_components(spark, width, percent):
    rows = corpus()
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA).repartition(3), width=width, percent=percent)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=repr) == components_of(rows, width, percent)


def test_join_of_nothing(spark):
    assert ngram_join.ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_candidates_cover_links_with_long_columns_cut_into_blocks():
    rows = [r for r in corpus(9) if r[1]]
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    width, t = 4, 85
    table = [b for b in ngram_join._search_rows(width, t)([batch])][0]
    counts = collections.Counter(v for low in set(table.column(3).to_pylist()) for v in np.frombuffer(low, dtype=np.uint64).tolist())
    hot = np.array(sorted(s for s, c in counts.items() if c >= 8), dtype=np.uint64)
    df = np.array([counts[s] for s in hot.tolist()])
    rank = np.argsort(np.lexsort((hot, df)))

    class Shared:
        value = (hot, rank, np.maximum(df // 10, 1))  # blocks of ten rows

    search = pa.RecordBatch.from_arrays([table.column(i) for i in (1, 2, 3)], ["k", "n", "low"]).filter(pa.array([n > 0 for n in table.column(2).to_pylist()]))
    found = pa.Table.from_batches(ngram_join._prefixes(t, Shared)([search])).sort_by([(c, "ascending") for c in ("s", "blk", "n", "k")])
    out = pa.Table.from_batches(ngram_join._candidates(t)(found.to_batches(max_chunksize=97))).to_pylist()
    pairs = {(r["a"], r["b"]) for r in out if r["kind"] == 0}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in out:
        if r["kind"]:
            parent[find(r["a"])] = find(r["b"])
    key = {}
    for k, r in zip(table.column(1).to_pylist(), rows):
        if k is not None:
            key[k] = shingle_set(r[1], width)
    links = 0
    for (a, x), (b, y) in itertools.combinations(sorted(key.items()), 2):
        both = len(x & y)
        if 100 * both >= t * (len(x) + len(y) - both):
            links += 1
            assert (a, b) in pairs or (a in parent and b in parent and find(a) == find(b))
    assert links > 100, links


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), max_size=20), min_size=1, max_size=24))
def test_overlaps_are_intersections(sets):
    got = ngram_join.overlaps([np.array(sorted(s), dtype=np.uint64) for s in sets])
    want = [[len(a & b) if i != j else got[i, i] for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert got.tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6) | st.text(alphabet="ab", min_size=20, max_size=60).map(str.encode) | st.sampled_from([b"abcabc" * 9, b"abcabc" * 9 + b"x"]), st.integers(0, 3), st.integers(0, 9)), max_size=60), st.sampled_from([500, 1500, 10**9]))
def test_trie_owns_as_a_dict_does(tmp_path_factory, rows, budget):
    trie, want = exact_dedup.PatriciaTrie(str(tmp_path_factory.mktemp("trie")), budget), {}
    for key, points, i in rows:
        trie.add(key, (-points, i, 1))
        old = want.get(key)
        want[key] = (-points, i, 1) if old is None else (*min(old[:2], (-points, i)), old[2] + 1)
    got = list(trie.items())
    assert dict(got) == want and len(got) == len(want)


@pytest.mark.parametrize("budget", [2000, 1 << 20])
def test_exact_duplicates(spark, budget):
    rows = [*corpus(), (7, "A b\tc", 0, 0, 0, 0), (8, "A  b c", 0, 0, 0, 0), (6, "Ab c", 0, 0, 0, 0), (900, "é" * 70_000, 0, 0, 0, 0), (901, "é" * 69_999 + " é", 0, 0, 0, 0)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), budget=budget).collect()
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i))
    want = sorted(((i, min(groups[plain(t)])[2], len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_duplicates_of_nothing(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).isEmpty()


def repeats(text):
    text = text or ""
    w = WORD.findall(text)

    def again(m):
        c = collections.Counter(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
        return [i for i in range(len(w) - m + 1) if c[tuple(w[i : i + m])] > 1]

    inside = {j for i in again(5) for j in range(i, i + 5)}
    longest = 0
    while again(max(longest + 1, 5)):
        longest = max(longest + 1, 5)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, chars, rep = len(w), sum(map(len, w)), sum(len(w[i]) for i in inside)
    failed = n < 10 or 100 * len(inside) > 20 * n
    return n, chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), rep, longest, failed, not failed and 100 * rep <= 20 * chars and longest <= 50


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n|", max_size=80), max_size=6))
def test_repeats_of_small_texts(texts):
    got = []
    for _, _, words in textcore.passes(pa.array(texts, pa.string()), most=64):
        got += list(zip(*(v.tolist() for v in repetition.measures(words, 5).values())))
    assert got == [repeats(t)[:7] for t in texts]


def maximal_repeats_by_hand(words, least):
    """{substring: places} of those that no word before or behind all places extends."""
    found = {}
    for m in range(least, len(words)):
        places = collections.defaultdict(list)
        for i in range(len(words) - m + 1):
            places[tuple(words[i : i + m])].append(i)
        for s, at in places.items():
            before = {words[i - 1] if i else None for i in at}
            behind = {words[i + m] if i + m < len(words) else (None, i) for i in at}
            if len(at) > 1 and (len(before) > 1 or None in before) and len(behind) > 1:
                found[s] = at
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=24), min_size=1, max_size=4), st.integers(1, 3), st.sampled_from([0, 1 << 20]))
def test_intervals_are_repeats(texts, least, most):
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    key = textcore.mix64(np.array([k * 10 + w + 1 for k, t in enumerate(texts) for w in t], dtype=np.uint64))
    suffixes, lcp = repetition.common_prefixes(key, text, repetition.suffix_ranks(key, text, most))
    flat = [(k, w) for k, t in enumerate(texts) for w in t]
    ends = [sum(len(x) for x in texts[: k + 1]) for k, _ in flat]
    for a, b, n in zip(suffixes[:-1], suffixes[1:], lcp[1:]):
        x, y = flat[a : ends[a]], flat[b : ends[b]]
        assert n == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    length, first, last, parent, _ = repetition.intervals(lcp, least)
    found = {tuple(flat[suffixes[a] : suffixes[a] + n]): sorted(suffixes[a : b + 1].tolist()) for n, a, b in zip(length, first, last)}
    assert all(length[p] < n and first[p] <= a and last[p] >= b for n, a, b, p in zip(length, first, last, parent) if p >= 0)
    reach, want, start = repetition.repeated_reach(key, text, least, most), np.zeros(len(flat), dtype=bool), 0
    for k, t in enumerate(texts):
        for s, at in maximal_repeats_by_hand(t, least).items():
            assert found[tuple((k, w) for w in s)] == [start + i for i in at]
            for i in at:
                want[start + i : start + i + len(s)] = True
                assert reach[start + i] >= len(s)
        start += len(t)
    assert (repetition.covered(reach, least) == want).all()


LONG_TEXT = """
import resource, sys
import pyarrow as pa
from voxelspark.llm import repetition, textcore
phrase = " ".join(f"word{i:020d}" for i in range(1000)) + " "
text = phrase * (20_000_000 // len(phrase))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = repetition.measures(next(textcore.passes(pa.array([text])))[2], 5)
n = text.count(" ")
assert found["n_repeat_words"].tolist() == [n] and found["longest_repeat"].tolist() == [n - 1000]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_long_text_that_repeats_itself_takes_memory_in_proportion():
    out = subprocess.run([sys.executable, "-c", LONG_TEXT], capture_output=True, text=True, check=True).stdout
    assert int(out.split()[-1]) < 320  # MB, for 20 MB of text


def test_rules_on_rows(spark):
    clean = " ".join(f"w{i}" for i in range(150))
    long = " ".join(f"v{i}" for i in range(60))
    texts = [None, "", "\n \t", "a b c", clean, clean + "\n" + clean, f"{long}\n{clean}\n{clean.replace('w', 'u')}\n{long}", "x " * 200, "é# |ö " * 4, "#" * 300]
    rows = [(i, t, 0, 0, 0, 0) for i, t in enumerate(texts)] + [(4, clean, 9, 9, 9, 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words repeat_chars longest_repeat base_failed kept".split()
    got = repetition.repetition_rules(df).collect()
    assert sorted((r["doc_id"], *(r[n] for n in names)) for r in got) == sorted((i, *repeats(t)) for i, t, *_ in rows)
    assert sorted(tuple(r) for r in repetition.clean_documents(df).collect()) == sorted(r for r in rows if repeats(r[1])[-1])
    assert repetition.repetition_rules(df.limit(0)).isEmpty() and repetition.clean_documents(df.limit(0)).isEmpty()


def test_hashes_do_not_depend_on_the_pass():
    texts = ["a bb " + "c" * 300, "", "bb a", "d" * 1000 + " a"]
    whole = [h for _, _, w in textcore.passes(pa.array(texts)) for h in w.hashes().tolist()]
    single = [h for t in texts for _, _, w in textcore.passes(pa.array([t])) for h in w.hashes().tolist()]
    assert whole == single and len(set(whole)) == 4


def test_words_are_the_pattern(spark):
    text = "a\x0bb\x0cc\x85d e f \x1c g\r\nh"
    words = next(textcore.passes(pa.array([text])))[2]
    assert [bytes(words.bytes[a:b]).decode() for a, b in zip(words.starts, words.ends)] == WORD.findall(text)
    assert spark.range(1).select(F.regexp_count(F.lit(text), F.lit(r"[^\x20\x09-\x0D]+"))).first()[0] == len(WORD.findall(text))
