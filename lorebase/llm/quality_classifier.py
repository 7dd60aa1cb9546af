"""Ordinal quality classifier: cumulative-link regression on graded ratings (operator 4).

Grades are ordered; P(grade <= k) is the logistic of a threshold of k less the text's score, with one
set of hashed-text weights for all thresholds.  Learnt from a sample of the rated rows of
about ``BUDGET`` characters, in equal parts for all grades and weighted by their rows; gives the expected grade and the probability of a grade of at
least ``tail``, by which documents are selected.

A null text counts as empty; repeated rows are scored alike; an empty table gives an empty
result; with ratings of one grade only, that grade is expected everywhere (0 without any).
Columns other than ``doc_id`` and ``text`` are not read.
"""

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lorebase.llm.common import held_out
from lorebase.llm.hashed_text import Rows, minimised, sample_rows, style_ids, word_ids

BUDGET = 10_000_000
LEAST, RIDGE = 4, 0.0003
#: Documents are kept when a grade of at least TAIL has this probability.
TAIL, KEEP = 1, 0.3


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _ids(text, known):
    return style_ids(text) | word_ids(text, known)


@dataclass
class Model:
    grades: int
    thresholds: list[float] = field(default_factory=list)
    weights: dict[int, float] = field(default_factory=dict)
    only: int = 0

    def at_least(self, ids) -> np.ndarray:
        """P(grade >= k) for k = 1 to the highest grade."""
        if not self.thresholds:
            return np.array([float(self.only >= k) for k in range(1, self.grades)])
        score = sum(self.weights.get(i, 0.0) for i in sorted(ids))
        return _sigmoid(score - np.array(self.thresholds))


def fit_rows(grades: np.ndarray, ids: list[np.ndarray], weight=1.0) -> Model:
    """Fit on feature ids; ``weight`` of each row, 1 on average."""
    count = int(grades.max(initial=0)) + 1
    if len(np.unique(grades)) < 2:
        return Model(max(count, 2), only=int(grades.max(initial=0)))
    x = Rows(ids, LEAST)
    n, d, m = len(grades), len(x.features), count - 1

    def thresholds(t):
        # The first as it is, each next one a positive step above: they stay ordered.
        return np.cumsum(np.append(t[0], np.exp(np.clip(t[1:], -20, 20))))

    def gradient(w):
        t, score = thresholds(w[d:]), x.times(w[:d])
        # Edges of each row's grade; the outer ones are infinite.
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        low, high = edges[grades] - score, edges[grades + 1] - score
        below, above = _sigmoid(low), _sigmoid(high)
        p = np.maximum(above - below, 1e-9) / weight
        d_low, d_high = below * (1 - below), above * (1 - above)
        d_low[~np.isfinite(low)] = 0
        d_high[~np.isfinite(high)] = 0
        by_score = (d_high - d_low) / p / n
        by_t = np.zeros(m + 2)
        np.add.at(by_t, grades + 1, -d_high / p / n)
        np.add.at(by_t, grades, d_low / p / n)
        by_t = by_t[1 : m + 1]
        step = np.append(1.0, np.exp(np.clip(w[d + 1 :], -20, 20)))
        return np.concatenate([x.transposed(by_score) + RIDGE * w[:d], np.cumsum(by_t[::-1])[::-1] * step])

    w = minimised(gradient, d + m)
    return Model(count, thresholds(w[d:]).tolist(), {int(f): float(v) for f, v in zip(x.features, w[:d]) if abs(v) > 0.02})


def fit(docs: DataFrame, ratings: DataFrame, budget: int = BUDGET) -> Model:
    """Learn from the rows of ``ratings`` (``doc_id, grade``) that are not held out."""
    known: dict[str, tuple[int, ...]] = {}
    rated = ratings.filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.max("grade").alias("grade_"))
    found = sample_rows(docs, rated, "grade_", lambda text: (_ids(text, known), []), budget)
    return fit_rows(found["label"].to_numpy(int), [np.asarray(i, np.int64) for i in found["ids"]], found["weight"].to_numpy())


def scored(docs: DataFrame, model: Model, tail: int = TAIL, keep: float = KEEP) -> DataFrame:
    """``doc_id, held_out, expected_grade, tail_probability, kept`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            p = np.array([model.at_least(_ids(t or "", known)) for t in b["text"]]).reshape(len(b), model.grades - 1)
            tails = p[:, tail - 1] if tail < model.grades else np.zeros(len(b))
            yield b[["doc_id", "held_out"]].assign(expected_grade=p.sum(1), tail_probability=tails, kept=tails >= keep)

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, expected_grade double, tail_probability double, kept boolean")


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings of the label table: 0 low quality, 1 good but toxic, 2 good."""
    good = F.col("quality").cast("int")
    return labels.select("doc_id", (good + F.when((good == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)).alias("grade"))
