"""Quality by ordinal regression with cumulative links.

One vector of weights over hashed text gives a latent quality; ordered thresholds cut it into grades:
P(grade >= k) = sigmoid(x.w - threshold_k).  Thresholds are kept in order by learning the logarithms of their gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashed_text import SLOTS, Rows, linear_scores, sigmoid
from .runtime import bounded_batches
from .toxicity import held_out, labelled_sample

PREFIXES = (4,)
#: Labelled rows of each grade that the fit takes.
SAMPLE = 2500


def thresholds_of(p: np.ndarray) -> np.ndarray:
    return p[0] + np.concatenate([[0.0], np.cumsum(np.exp(p[1:]))])


def loss_and_gradient(x: Rows, grade: np.ndarray, weight: np.ndarray, w: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted negative log likelihood of grades, its gradient by the weights and by the thresholds' parameters."""
    t, s, n = thresholds_of(p), x.times(w), len(p)
    upper = np.column_stack([np.ones(len(s)), sigmoid(s[:, None] - t[None, :]), np.zeros(len(s))])  # P(grade >= j)
    at = np.arange(len(s))
    a, c = upper[at, grade], upper[at, grade + 1]
    chance = np.maximum(a - c, 1e-12)
    da, dc = a * (1 - a), c * (1 - c)  # 0 at both ends
    dt = np.array([(weight * (da * (grade == j + 1) - dc * (grade == j)) / chance).sum() for j in range(n)])
    dp = np.concatenate([[dt.sum()], [dt[j:].sum() * np.exp(p[j]) for j in range(1, n)]])
    return float(-(weight * np.log(chance)).sum()), x.transposed(-weight * (da - dc) / chance), dp


def fit(texts: list[str], grade: np.ndarray, grades: int, weight: np.ndarray, l2: float = 1e-4, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the ``grades - 1`` ascending thresholds of the likeliest model."""
    x = Rows(texts, PREFIXES, "share", True)
    seen = np.where(np.bincount(x.slot, minlength=SLOTS) >= 2, 1.0, 0.0)
    weight = weight / weight.sum()
    tail = np.array([np.clip((weight * (grade >= k)).sum(), 1e-3, 1 - 1e-3) for k in range(1, grades)])
    cut = np.log((1 - tail) / tail)
    theta = np.concatenate([np.zeros(SLOTS), [cut[0]], np.log(np.maximum(np.diff(cut), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        w = theta[:SLOTS]
        _, dw, dp = loss_and_gradient(x, grade, weight, w, theta[SLOTS:])
        g = np.concatenate([dw * seen + l2 * w, dp])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.3 / np.sqrt(k) * m / (1 - 0.9**k) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return theta[:SLOTS], thresholds_of(theta[SLOTS:])


def ordinal_quality(
    docs: DataFrame, ratings: DataFrame, grades: int, select_grade: int = 1, least_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> DataFrame:
    """Grade every text after learning ``ratings(doc_id, grade)`` with grades 0 to ``grades`` - 1.

    The fit takes at most ``sample`` rows of each grade among ids that are not held out (as for toxicity).  Returns a row
    for each row of ``docs``: ``doc_id``, ``held_out``, ``expected_grade``, ``tail_probability`` (of ``select_grade`` or
    better) and ``kept`` (tail probability of ``least_tail`` or more).

    Only the text enters a grade.  Null and empty texts have no features and get the grade of the thresholds alone.  Ratings
    that are null, out of range, or without a document are ignored; of repeated ratings the highest counts.  Without
    ratings, or with one grade only, that grade (0 without any) is expected of every text.  Empty tables give empty results."""
    usable = ratings.where(F.col("grade").between(0, grades - 1))
    texts, grade, weight = labelled_sample(docs, usable, "grade", sample, id_col, text_col)
    if len(texts) and grade.min() < grade.max():
        w, cut = fit(texts, grade, grades, weight)
    else:
        w, cut = np.zeros(SLOTS), np.where(np.arange(1, grades) <= (int(grade[0]) if len(grade) else 0), -40.0, 40.0)
    model = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), cut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cut = model.value
        for batch in batches:
            tail = sigmoid(linear_scores(batch.column(2), w, PREFIXES, "share", True)[:, None] - cut[None, :])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tail.sum(axis=1)), pa.array(tail[:, select_grade - 1])], ["doc_id", "held_out", "expected_grade", "tail_probability"]
            )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, expected_grade double, tail_probability double"
    )
    return scored.withColumn("kept", F.col("tail_probability") >= least_tail)
