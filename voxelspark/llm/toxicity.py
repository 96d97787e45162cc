"""Toxicity by a counterfactually regularised classifier.

Logistic regression on hashed words and word beginnings.  Every labelled text has a counterfactual: identity terms that
it holds are swapped for other terms of their group, and a text that names no group gets a mention of one.  The
counterfactuals are learnt with the label of their text, and the squared change of the score between the two is added to
the loss, so that the terms themselves cannot carry weight and neutral mentions of a group are not marked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed_text import SLOTS, Rows, linear_scores, sigmoid
from .runtime import bounded_batches

#: Identity terms by group; a term is swapped for the next one of its group.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "atheisten"),
    ("schwarze", "weiße", "türken", "araber"),
    ("ausländer", "einwanderer", "flüchtlinge", "einheimische"),
    ("behinderte", "blinde", "alte", "schwule"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "athées"),
    ("noirs", "blancs", "arabes", "asiatiques"),
    ("étrangers", "immigrés", "réfugiés", "autochtones"),
    ("handicapés", "aveugles", "vieux", "homosexuels"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("cristianos", "musulmanes", "judíos", "ateos"),
    ("negros", "árabes", "asiáticos", "latinos"),
    ("extranjeros", "inmigrantes", "refugiados", "nativos"),
    ("discapacitados", "ciegos", "ancianos", "gais"),
)
#: Terms that are everyday adjectives too: they count before a word for persons only, and stand so where they are put in.
EVERYDAY = {t: "people" for t in ("old", "young", "straight", "native", "blind", "deaf", "black", "white")} | {"alte": "menschen", "blinde": "menschen", "weiße": "menschen", "schwarze": "menschen", "vieux": "messieurs"}
_PERSONS = "people|persons?|men|women|man|woman|folks?|kids|students|workers|menschen|leute|männer|frauen|messieurs|gens|hommes"
_NEXT = {t: g[(i + 1) % len(g)] for g in IDENTITY_TERMS for i, t in enumerate(g)}
_TERM = re.compile(
    rf"(?<![^\W_])(?:{'|'.join(sorted(set(_NEXT) - set(EVERYDAY), key=len, reverse=True))}|(?:{'|'.join(EVERYDAY)})(?=\s+(?:{_PERSONS})(?![^\W_])))(?![^\W_])",
    re.IGNORECASE,
)
PREFIXES = (4, 5, 6)
#: Labelled rows of each class that the fit takes, those with the least hash of their id.
SAMPLE = 3000


def swapped(text: str) -> str:
    """The text with every identity term exchanged for the next of its group; an everyday adjective is one before a word for
    persons."""
    return _TERM.sub(lambda m: _NEXT[m[0].lower()], text)


def mention(k: int) -> str:
    """The ``k``-th term, over all groups in turn, so that terms of all languages come equally often."""
    group = IDENTITY_TERMS[k % len(IDENTITY_TERMS)]
    term = group[k // len(IDENTITY_TERMS) % len(group)]
    return f"{term} {EVERYDAY[term]}" if term in EVERYDAY else term


def counterfactual(text: str, k: int) -> str:
    """The text with its identity terms swapped, or, if it names no group, with the ``k``-th mention in its middle."""
    if _TERM.search(text):
        return swapped(text)
    at = text.find(" ", len(text) // 2)
    at = len(text) if at < 0 else at
    return f"{text[:at]} {mention(k)}{text[at:]}"


class Changes:
    """Sparse rows of what features change from each text to its counterfactual."""

    def __init__(self, texts: list[str]):
        rows, slots, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for lo in range(0, len(texts), 500):
            part = texts[lo : lo + 500]
            x, z = Rows(part, PREFIXES, "count", False), Rows([counterfactual(t, lo + i) for i, t in enumerate(part)], PREFIXES, "count", False)
            key, at = np.unique(np.concatenate([x.row, z.row]) * SLOTS + np.concatenate([x.slot, z.slot]), return_inverse=True)
            value = np.bincount(at, weights=np.concatenate([-x.value, z.value]), minlength=len(key))
            live = np.abs(value) > 1e-6
            rows.append(key[live] // SLOTS + lo)
            slots.append(key[live] % SLOTS)
            values.append(value[live])
        self.row, self.slot, self.value, self.n = np.concatenate(rows), np.concatenate(slots), np.concatenate(values), len(texts)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.slot] * self.value, minlength=self.n)

    def transposed(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.slot, weights=g[self.row] * self.value, minlength=SLOTS)


def loss_and_gradient(x: Rows, change: Changes, toxic: np.ndarray, weight: np.ndarray, swap: float, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
    """Log loss over texts and counterfactuals (a half each) plus ``swap`` times the mean squared change of the score, its
    gradient by the weights and by the intercept.  ``weight`` sums to 1."""
    score, moved = x.times(w) + b, change.times(w)
    log_loss = lambda z: np.logaddexp(0, z) - toxic * z
    loss = float((weight * (log_loss(score) + log_loss(score + moved))).sum() / 2 + swap * (moved**2).mean())
    own, other = (weight * (sigmoid(z) - toxic) / 2 for z in (score, score + moved))
    g = x.transposed(own + other) + change.transposed(other + 2 * swap / len(moved) * moved)
    return loss, g, float((own + other).sum())


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, swap: float = 5.0, l1: float = 1e-3, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of the minimum of weighted log loss, the penalty ``swap`` on score changes, and ``l1``.

    Slots that no two texts share keep the weight 0, but for those that counterfactuals change."""
    x, change = Rows(texts, PREFIXES, "count", False), Changes(texts)
    scale = np.where((np.bincount(x.slot, minlength=SLOTS) >= 2) | (np.bincount(change.slot, minlength=SLOTS) >= 2), 1.0, 0.0)
    weight = weight / weight.sum()
    w, m, v = np.zeros(SLOTS), np.zeros(SLOTS), np.zeros(SLOTS)
    rate = float(np.clip((weight * toxic).sum(), 1e-3, 1 - 1e-3))
    b = float(np.log(rate / (1 - rate)))
    bm = bv = 0.0
    for k in range(1, steps + 1):
        _, g, gb = loss_and_gradient(x, change, toxic, weight, swap, w, b)
        g *= scale
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 / np.sqrt(k) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        w = w - step * m / (1 - 0.9**k)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        bm, bv = 0.9 * bm + 0.1 * gb, 0.99 * bv + 0.01 * gb * gb
        b -= 0.1 / np.sqrt(k) * bm / (1 - 0.9**k) / (np.sqrt(bv / (1 - 0.99**k)) + 1e-6)
    return w, b


def held_out(id_col: Column) -> Column:
    """Rows whose crc32 of the id as text is divisible by 5: never learnt from.  A null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str, text_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most ``most`` learnable rows of each label; weights restore the labels' shares.

    Of rows that share an id the least text counts, so that the sample keeps its bound."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out(F.col("doc_id")))
    counts = dict(usable.groupBy("y").agg(F.count("*")).collect())
    chosen = None
    for y in sorted(counts):
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return [], np.zeros(0), np.zeros(0)
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropna()
    rows = pairs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = rows["y"].to_numpy()
    taken = {k: max(1, int((y == k).sum())) for k in counts}
    return rows["text"].to_pylist(), y, np.array([counts[k] / taken[k] for k in y.tolist()], dtype=np.float64)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, swap: float = 5.0) -> DataFrame:
    """Score every text after learning ``labels(doc_id, toxic)``.

    The fit takes at most ``sample`` rows of each label (those with the least hash of the id) among ids that are not held
    out (``held_out``).  Returns a row for each row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1) and
    ``predicted`` (1 if the score is 0.5 or more).

    Only the text enters a score.  Null and empty texts get the score of the intercept.  Labels that are null, or whose
    document is missing, are ignored; of repeated labels the highest counts.  Without labels, or with one class only,
    every score is the share of toxic labels, 0 without any.  Empty tables give empty results."""
    texts, y, weight = labelled_sample(docs, labels, "toxic", sample, id_col, text_col)
    if len(texts) and 0 < y.sum() < len(y):
        w, b = fit(texts, (y > 0).astype(np.float64), weight, swap)
    else:
        w, b = np.zeros(SLOTS), 40.0 if len(y) and y.all() else -40.0
    model = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            score = sigmoid(linear_scores(batch.column(2), w, PREFIXES, "count", False) + b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "held_out", "score"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
