"""Classifiers, page extraction and dialogue views on small fixtures."""

import random
import time
import zlib
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from voxelspark.llm import html_blocks, ordinal_quality, perspectives, toxicity
from voxelspark.llm.hashed_text import SLOTS, Rows, linear_scores

DOCS = "doc_id long, text string, score double, held_out string, y int"


def supplied(name):
    """Rows of a supplied table, where there are any."""
    path = Path(f"/root/testdata/sf0.1/{name}.parquet")
    if not path.exists():
        pytest.skip("needs the supplied tables")
    return pq.read_table(path).to_pylist()


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def labelled(n, seed=1):
    rng = random.Random(seed)
    plain, rude = [f"plain{i}" for i in range(60)], ["idiot", "scum", "moron"]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(20, 60))
        bad = i % 3 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        # toxic texts mention one group far more often: a bias that the swap must take out
        if rng.random() < (0.8 if bad else 0.1):
            words.insert(0, "muslim")
        rows.append((i, " ".join(words), bad))
    return rows


def test_toxicity_of_held_out_rows(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t, 0.0, "x", 1) for i, t, _ in rows] + [(None, None, 0.0, "x", 1), (5000, "", 0.0, "x", 1)], DOCS)
    labels = spark.createDataFrame([(i, 0, int(b)) for i, _, b in rows] + [(1, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 302 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (i is None or held(i)) for i, r in got.items())
    tested = [(got[i]["predicted"], b) for i, _, b in rows if held(i)]
    assert sum(p == b for p, b in tested) >= 0.95 * len(tested)
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).isEmpty()
    assert {r["predicted"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}


def test_swaps_spare_neutral_mentions():
    rows = labelled(400)
    texts, y = [t for _, t, _ in rows], np.array([b for *_, b in rows], dtype=float)
    rng = random.Random(7)
    neutral = pa.array(["muslim " + " ".join(rng.choices([f"plain{i}" for i in range(60)], k=30)) for _ in range(200)])
    score = lambda w, b: linear_scores(neutral, w, toxicity.PREFIXES, "count", False) + b
    plain, fair = (score(*toxicity.fit(texts, y, np.ones(len(y)), swap=s)) for s in (0.0, 5.0))
    without = linear_scores(pa.array([t[7:] for t in neutral.to_pylist()]), toxicity.fit(texts, y, np.ones(len(y)), swap=5.0)[0], toxicity.PREFIXES, "count", False)
    assert fair.mean() < plain.mean() - 0.3
    assert abs((fair - without).std()) < 0.2
    assert toxicity.swapped("A Muslim, and menhir") == "A jewish, and menhir"
    assert toxicity.swapped("an old house, old people and le vieux port") == "an old house, young people and le vieux port"


def slope_by_hand(f, theta, at, h=1e-5):
    up, down = theta.copy(), theta.copy()
    up[at] += h
    down[at] -= h
    return (f(up) - f(down)) / (2 * h)


def test_toxicity_loss_by_hand():
    texts, toxic = ["you idiot women", "plain words here", "plain muslim idiot", ""], np.array([1.0, 0.0, 1.0, 0.0])
    weight, swap = np.array([0.1, 0.4, 0.2, 0.3]), 3.0
    x, change = Rows(texts, toxicity.PREFIXES, "count", False), toxicity.Changes(texts)
    others = [toxicity.counterfactual(t, i) for i, t in enumerate(texts)]
    assert others[0] == "you idiot men" and others[2] == "plain jewish idiot" and all(len(o) > len(t) for o, t in zip(others[1::2], texts[1::2]))
    rng = np.random.default_rng(5)
    w, b = rng.normal(size=SLOTS) * 0.3, 0.2
    score = lambda ts: linear_scores(pa.array(ts), w.astype(np.float64), toxicity.PREFIXES, "count", False) + b
    plain, other = score(texts), score(others)
    nll = lambda z: -(toxic * np.log(1 / (1 + np.exp(-z))) + (1 - toxic) * np.log(1 - 1 / (1 + np.exp(-z))))
    loss, g, gb = toxicity.loss_and_gradient(x, change, toxic, weight, swap, w, b)
    assert loss == pytest.approx((weight * (nll(plain) + nll(other))).sum() / 2 + swap * np.mean((other - plain) ** 2), rel=1e-5)
    f = lambda v: toxicity.loss_and_gradient(x, change, toxic, weight, swap, v, b)[0]
    for at in {*x.slot.tolist(), *change.slot.tolist()}:
        assert g[at] == pytest.approx(slope_by_hand(f, w, at), abs=1e-6)
    assert gb == pytest.approx(slope_by_hand(lambda v: toxicity.loss_and_gradient(x, change, toxic, weight, swap, w, v[0])[0], np.array([b]), 0), abs=1e-6)


def test_ordinal_loss_by_hand():
    texts, grade = ["a b c", "A! B! C!", "d e f", "G! h I!", ""], np.array([2, 0, 2, 1, 0])
    weight = np.array([0.3, 0.1, 0.2, 0.2, 0.2])
    x = Rows(texts, ordinal_quality.PREFIXES, "share", True)
    rng = np.random.default_rng(6)
    w, p = rng.normal(size=SLOTS), np.array([-0.4, 0.3])
    cut = [-0.4, -0.4 + np.exp(0.3)]
    score = linear_scores(pa.array(texts), w, ordinal_quality.PREFIXES, "share", True)
    tail = lambda s, k: 1.0 if k == 0 else 0.0 if k == 3 else 1 / (1 + np.exp(cut[k - 1] - s))
    want = -sum(v * np.log(tail(s, g) - tail(s, g + 1)) for v, s, g in zip(weight, score, grade))
    loss, dw, dp = ordinal_quality.loss_and_gradient(x, grade, weight, w, p)
    assert loss == pytest.approx(want, rel=1e-6)
    for at in set(x.slot.tolist()):
        assert dw[at] == pytest.approx(slope_by_hand(lambda v: ordinal_quality.loss_and_gradient(x, grade, weight, v, p)[0], w, at), abs=1e-6)
    for at in range(2):
        assert dp[at] == pytest.approx(slope_by_hand(lambda v: ordinal_quality.loss_and_gradient(x, grade, weight, w, v)[0], p, at), abs=1e-6)


def test_mentions_of_groups_in_the_supplied_documents():
    """A biased sample (toxic texts name groups more often) and neutral held-out texts that name one, in four languages."""
    labels = {r["doc_id"]: r["toxic"] for r in supplied("labels") if r["toxic"] is not None}
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in supplied("documents") if r["doc_id"] in labels and r["text"]]
    rng = random.Random(8)
    names = {"en": "muslims", "de": "muslime", "fr": "musulmans", "es": "musulmanes"}
    learn, tested = [], []
    for i, text, lang in docs:
        named = f"{text} {names[lang]}"
        if held(i) and not labels[i]:
            tested.append((named, lang))
        elif not held(i) and (labels[i] or rng.random() < 0.35):
            learn.append((named if rng.random() < (0.8 if labels[i] else 0.02) else text, labels[i]))
    texts, y = [t for t, _ in learn], np.array([v for _, v in learn], dtype=float)
    assert len(toxicity.Changes(texts).value) and (np.bincount(toxicity.Changes(texts).row, minlength=len(texts)) > 0).all()  # every row has a counterfactual
    wrong = {}
    for swap in (0.0, 5.0):
        w, b = toxicity.fit(texts, y, np.ones(len(y)), swap)
        score = linear_scores(pa.array([t for t, _ in tested]), w, toxicity.PREFIXES, "count", False) + b
        wrong[swap] = {lang: np.mean([s >= 0 for s, (_, x) in zip(score, tested) if x == lang]) for lang in names}
    print("neutral mentions marked, without and with the penalty:", wrong, len(tested), len(texts))
    assert all(wrong[5.0][x] <= min(wrong[0.0][x], 0.03) for x in names)
    assert np.mean(list(wrong[5.0].values())) < np.mean(list(wrong[0.0].values()))


def test_repeated_rows_and_ties(spark):
    """Repeated documents get equal scores and do not weigh more in the fit; a very long text is scored whole."""
    rows = labelled(120)
    long = "plain1 " * 300_000 + "idiot scum moron " * 300_000
    docs = [(i, t, 0.0, "x", 1) for i, t, _ in rows]
    labels = spark.createDataFrame([(i, int(not b), int(b)) for i, _, b in rows] * 2, "doc_id long, quality int, toxic int")
    once = spark.createDataFrame([*docs, (9000, long, 0.0, "x", 1)], DOCS)
    twice = spark.createDataFrame([*docs, *docs, (9000, long, 0.0, "x", 1)], DOCS)
    for run in (
        lambda d: toxicity.toxicity(d, labels).select("doc_id", "score"),
        lambda d: ordinal_quality.ordinal_quality(d, labels.selectExpr("doc_id", "quality as grade"), 2).select("doc_id", "expected_grade"),
    ):
        a, b = {tuple(r) for r in run(once).collect()}, [tuple(r) for r in run(twice).collect()]
        assert set(b) == a and len(b) == 241
    assert toxicity.toxicity(once, labels).where("doc_id = 9000").first()["predicted"] == 1


def test_ordinal_grades(spark):
    rng = random.Random(2)
    rows, grades = [], []
    for i in range(400):
        grade = rng.randrange(3)
        words = [f"word{rng.randrange(80)}" for _ in range(60)]
        words = [w.upper() + "!!" if rng.random() < (0.8, 0.3, 0.0)[grade] else w for w in words]
        rows.append((i, " ".join(words), 0.0, "x", 0))
        grades.append((i, grade))
    docs = spark.createDataFrame([*rows, (None, None, 0.0, "x", 0), (7000, "", 0.0, "x", 0)], DOCS)
    ratings = spark.createDataFrame([*grades, (1, 7), (2, None)], "doc_id long, grade int")
    got = {r["doc_id"]: r for r in ordinal_quality.ordinal_quality(docs, ratings, 3).collect()}
    tested = [(got[i]["expected_grade"], got[i]["kept"], g) for i, g in grades if held(i)]
    assert np.mean([abs(e - g) for e, _, g in tested]) < 0.35
    assert np.mean([k == (g >= 1) for _, k, g in tested]) > 0.85
    assert len(got) == 402 and all(0 <= r["expected_grade"] <= 2 for r in got.values())
    assert ordinal_quality.ordinal_quality(docs.limit(0), ratings.limit(0), 3).isEmpty()
    assert not any(r["kept"] for r in ordinal_quality.ordinal_quality(docs, ratings.limit(0), 3).collect())


def test_thresholds_ascend():
    texts = ["a b c", "A! B! C!", "d e f", "G! h I!"] * 10
    _, cut = ordinal_quality.fit(texts, np.array([2, 0, 2, 1] * 10), 3, np.ones(40))
    assert cut[0] < cut[1]


PARAGRAPH = "This is a paragraph of an article with enough words to look like prose and an &amp; sign."
PAGES = {
    "article": (
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=1>Home</a></ul></nav><div class='ad'>Buy this now please, it is a good one.</div>"
        f"<article><h1>A  title</h1><p><b>{PARAGRAPH}<br><p>Short.</p><script>var t='</p>';</script><p>Two\n lines &lt;b&gt;</p></article><aside>{PARAGRAPH}</aside><footer>&copy; site</footer>",
        ["A title", PARAGRAPH.replace("&amp;", "&"), "Short.", "Two lines <b>"],
    ),
    "containers": (
        f"<div id=header><p>{PARAGRAPH}</p></div><div class=main-content><h2>Head</h2><p>{PARAGRAPH}</p><div class='share-buttons'><a href=x>Share</a></div></div>"
        f"<div id='comments'><article><p>{PARAGRAPH}</p></article></div><form><p>{PARAGRAPH}</p></form><div class='cookie-notice'>{PARAGRAPH}</div>",
        ["Head", PARAGRAPH.replace("&amp;", "&")],
    ),
    "untold": (
        f"<table><tr><td><a href=1>Home</a><td><a href=2>About</a></table><p>{PARAGRAPH}<p>{PARAGRAPH}<p><a href=3>Next</a> <a href=4>Back</a>",
        [PARAGRAPH.replace("&amp;", "&")] * 2,
    ),
    "quote in a bare value": ("<article><p title=don't>Don't stop.</p><p>it's here</p></article>", ["Don't stop.", "it's here"]),
    "state names": (f"<article class='comments-open'><p>{PARAGRAPH}</p></article>", [PARAGRAPH.replace("&amp;", "&")]),
    "post with comments": (f"<div class='post has-comments'><p>{PARAGRAPH}</p></div><div class=post-with-social>Short one.</div><div class='comments-area'><p>{PARAGRAPH}</p></div>", [PARAGRAPH.replace("&amp;", "&"), "Short one."]),
    "last word of a name": (f"<div class='widget-article'><p>{PARAGRAPH}</p></div><div class=article-comments><p>{PARAGRAPH}</p></div>", [PARAGRAPH.replace("&amp;", "&")]),
    "unclosed button": (f"<article><p>{PARAGRAPH}</p><button>x<p>After it.</p></article>", [PARAGRAPH.replace("&amp;", "&"), "x", "After it."]),
    "anchor": ("<article><a name=x><p>Short.</p><p>Also short.</p><p><a href=y>linked<p>Not linked.</p></article>", ["Short.", "Also short.", "linked", "Not linked."]),
    "advert in a paragraph": ("<article><p>Before <span class='ad'>buy now</span> after <span class=x>it</span>.</p></article>", ["Before after it ."[:-2] + "."]),
    "comment marks": (f"<main><!-- <p>not this</p> --><p>{PARAGRAPH}</p><noscript><p>nor this</p></noscript></main>", [PARAGRAPH.replace("&amp;", "&")]),
    "bad": ("<main><p>a < b and <", None),
    "nothing": ("<nav><a href=1>x</a></nav>", []),
}


@pytest.mark.parametrize("name", [k for k, v in PAGES.items() if v[1] is not None])
def test_main_text(name):
    page, want = PAGES[name]
    assert html_blocks.main_text(page) == "\n\n".join(want)


def test_pages_as_rows(spark):
    rows = [(i, f"u{i}", page, "x") for i, (page, _) in enumerate(PAGES.values())] + [(None, None, None, "x"), (0, "u0", PAGES["article"][0], "x"), (99, "u", "", "x")]
    got = html_blocks.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sorted((r["page_id"] or -1, r["text"]) for r in got) == sorted((r[0] or -1 if r[0] is None else r[0], html_blocks.main_text(r[2])) if r[0] else (-1, html_blocks.main_text(r[2])) for r in rows)


def test_tree_learns_its_table():
    x = np.array(html_blocks.LABELLED, dtype=float)
    assert (html_blocks.TREE.decide(x[:, :-1]) == (x[:, -1] > 0.5)).all()


class Splitter(HTMLParser):
    """A plain block splitter for well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.skip, self.inside = [], [], 0, False

    def end_block(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.out.append((text, self.inside))
        self.text = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        if tag in html_blocks.BLOCKS:
            self.end_block()
            self.inside |= tag == "article"
        if tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        if tag in html_blocks.BLOCKS:
            self.end_block()
            self.inside &= tag != "article"

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


@pytest.fixture(scope="module")
def held_out_pages():
    """Supplied pages that gave no labelled block, as (blocks, blocks in the article by another parser)."""
    pages = supplied("pages")
    found = []
    for row in pages:
        if row["page_id"] >= 500:
            splitter = Splitter()
            splitter.feed(row["html"])
            splitter.close()
            splitter.end_block()
            found.append((html_blocks.blocks(row["html"]), splitter.out))
    return found


def test_blocks_are_those_of_another_parser(held_out_pages):
    assert len(held_out_pages) == 2000
    for ours, theirs in held_out_pages:
        assert [b.text for b in ours] == [t for t, _ in theirs]


def measured(held_out_pages, features):
    """Precision and recall of article blocks by a tree that sees some features only, without the check that follows it."""
    table = np.array(html_blocks.LABELLED, dtype=float)
    tree = html_blocks.Tree(tuple(map(tuple, table[:, [*features, 6]])))
    chosen = np.concatenate([tree.decide(html_blocks.features(ours)[:, features]).astype(bool) for ours, _ in held_out_pages])
    article = np.array([inside for _, theirs in held_out_pages for _, inside in theirs])
    return (chosen & article).sum() / chosen.sum(), (chosen & article).sum() / article.sum()


def test_words_and_link_density_of_neighbours_carry_the_result(held_out_pages):
    precision, recall = measured(held_out_pages, [0, 1, 2, 3, 4, 5])
    assert precision > 0.999 and recall > 0.995
    for fewer in ([0, 2, 4], [1, 3, 5], [0, 1]):  # without link density, words, neighbours
        precision, recall = measured(held_out_pages, fewer)
        assert min(precision, recall) < 0.96


def test_whole_articles_of_held_out_pages(held_out_pages):
    for ours, theirs in held_out_pages:
        assert [b.text for b, k in zip(ours, html_blocks.is_article(ours)[1], strict=True) if k] == [t for t, inside in theirs if inside]


def test_no_block_gets_in_by_what_a_page_declares(held_out_pages):
    class Always:
        def __init__(self, value):
            self.value = value

        def decide(self, x):
            return np.full(len(x), self.value)

    pages = [ours for ours, theirs in held_out_pages if ours]
    kept = [html_blocks.is_article(b)[1] for b in pages]
    none = [html_blocks.is_article(b, Always(False))[1] for b in pages]
    assert not any(k.any() for k in none) and sum(k.any() for k in kept) > 0.9 * len(pages)
    alone = [html_blocks.is_article(b, second=None)[1] for b in pages]
    assert 0 < sum((a != k).sum() for a, k in zip(alone, kept, strict=True)) < 0.01 * sum(k.sum() for k in kept)
    # pages that declare nothing at all: the two trees alone
    plain = [[html_blocks.Block(b.text, b.words, b.link_density, 1) for b in page] for page in pages]
    assert all((html_blocks.is_article(b)[1] | ~k).all() for b, k in zip(plain, kept, strict=True))
    everything = [html_blocks.is_article(b, Always(True))[1] for b in plain]
    assert sum((e != k).any() for e, k in zip(everything, kept, strict=True)) > 0.9 * len(pages)


def test_a_very_long_page():
    page = "<nav><a href=1>x</a></nav><article>" + "<p>" + "word " * 60 + "</p>" * 1 + "<p>short</p>" * 30000 + "<a name=1>" * 20000 + "<button>" * 20000 + "</article><footer>c</footer>"
    assert html_blocks.main_text(page).count("short") == 30000


@pytest.mark.parametrize(
    "page",
    ["<div>x" * 180_000, "<span>x " * 130_000, "<div>" * 100_000 + "</section>x" * 60_000, "<td>x " * 160_000, "<li>x<ul>" * 90_000, "<p><span class=ad>x" * 50_000, "<b><div><span>x</div></span>" * 40_000],
    ids=["div", "span", "stray ends", "td", "li", "spans that are adverts", "crossed"],
)
def test_a_megabyte_of_elements_without_end_takes_seconds(page):
    began = time.process_time()
    found = html_blocks.blocks(page)
    html_blocks.is_article(found)
    assert time.process_time() - began < 5 and len(found) < 500_000


def test_what_open_elements_tell():
    found = html_blocks.blocks('<div class=comments><article>a<p>b</p></article></div><div class=ad>c<main>d</main>e</div>f<p>g<span class=ad>gone</span>h<div>i</section>j</div>k')
    assert [(b.text, b.place) for b in found] == [("a", 0), ("b", 0), ("c", 0), ("d", 2), ("e", 0), ("f", 1), ("gh", 1), ("i", 1), ("j", 1), ("k", 1)]


def render(turns, speaker):
    text, mask = "", []
    for _, role, t in turns:
        head = "<|system|>\n" if role == "system" else "<|assistant|>\n" if role == speaker else f"<|user name={role or 'unknown'}|>\n"
        if role == speaker:
            mask.append(f"{len(text) + len(head)}-{len(text) + len(head) + len(t or '')}")
        text += head + (t or "") + "\n"
    return text, ",".join(mask)


def test_every_participant_gets_a_view(spark):
    rows = [(1, 2, "bob", "é two"), (1, 1, "amy", "one"), (1, 0, "system", "rules"), (1, 3, "eve", None), (1, 3, None, "who?"), (1, 4, "amy", "bye"), (1, 4, "amy", "bye"), (2, 0, None, "alone"), (None, 0, "amy", "x"), (None, 1, "bob", "<|assistant|>\ny")]
    rows += [(3, i, "ab"[i % 2], f"turn {i}") for i in range(600)]
    rows += [(4, -100, "amy", "long before"), (4, None, "bob", "no number"), (4, -1, None, "just before"), (4, 0, "bob", "zero"), (4, 1 << 40, "amy", "late " * 200_000)]
    got = perspectives.rotate_perspectives(spark.createDataFrame([(*r, 0, "r") for r in rows], "conv_id long, turn long, role string, text string, start int, run string")).collect()
    dialogues = {}
    for c, n, role, t in rows:
        dialogues.setdefault(c, []).append((n, role, t))
    want = {}
    for c, turns in dialogues.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0], x[1] or "", x[2] or ""))
        for s in {r for _, r, _ in turns} - {None, "system"}:
            start = 0
            for k in range(0, len(turns), 256):
                text, mask = render(turns[k : k + 256], s)
                want[c, s, k // 256] = (text, mask, start)
                start += len(text)
    assert {(r["conv_id"], r["speaker"], r["run"]): (r["text"], r["mask"], r["start"]) for r in got} == want and len(got) == len(want)
    text, mask, _ = want[1, "amy", 0]
    assert [text[int(a) : int(b)] for a, b in (m.split("-") for m in mask.split(","))] == ["one", "bye", "bye"]
    assert perspectives.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()
