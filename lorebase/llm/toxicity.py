"""Counterfactual-regularised toxicity classifier (operator 5).

Logistic regression on hashed words and word beginnings, the latter also by how many words of
the text share them, fitted on a sample of the labelled rows of about ``BUDGET`` characters, in equal parts
for both labels and weighted by their rows.  In every sampled text that holds an identity term, the
term is swapped for each other term of its group, and the features of the swapped text are made.
The squared change of the score, a probability, is added to the loss, so that the mere mention of a group
does not move the score.  Features that the sample lacks have no weight.

A null text counts as empty and is scored by the intercept; repeated rows are scored alike; an
empty table gives an empty result; without labels of both kinds every score is the share
of toxic labels (0 without any).  Columns other than ``doc_id`` and ``text`` are not read;
null labels and rows with a null ``doc_id`` are not learnt from.
"""

import json
from collections import Counter
from itertools import chain
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lorebase.llm.common import held_out
from lorebase.llm.hashed_text import BUCKETS, REMEMBERED, Rows, minimised, sample_rows, word_features, word_set

BUDGET = 10_000_000
THRESHOLD = 0.3
#: Rows of the sample that must have a feature.
LEAST = 4
RIDGE, SWAP = 0.0001, 30.0
#: Numbers of words from which a shared feature has a weight more.
LEVELS = (2, 3, 5)
#: Weight of absolute values in the first fit, which chooses the features of the second.
SPARSE = 0.002

#: Names of groups, in sets whose members may be swapped for each other.
IDENTITY_TERMS = [
    ["muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "buddhists", "catholic", "catholics", "atheist", "atheists"],
    ["women", "woman", "men", "man", "female", "male", "girls", "boys", "transgender"],
    ["gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"],
    ["black", "white", "asian", "african", "european", "arab", "latino", "hispanic"],
    ["immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners", "migrant", "migrants"],
    ["elderly", "young", "disabled", "deaf", "blind", "autistic"],
    ["musulman", "musulmans", "chrétien", "chrétiens", "juif", "juifs", "femmes", "hommes", "immigrés", "réfugiés"],
    ["muslime", "christen", "juden", "frauen", "männer", "ausländer", "flüchtlinge"],
    ["musulmanes", "cristianos", "judíos", "mujeres", "hombres", "inmigrantes", "refugiados"],
]
_GROUP = {t: tuple(x for x in group if x != t) for group in IDENTITY_TERMS for t in group}


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _at_level(feature: int, n: int) -> int:
    return (feature * 40_503 + n * 7_919) % BUCKETS


def set_ids(words, known: dict[str, tuple[int, ...]]) -> set[int]:
    """Features of a set of words; ``known`` remembers those of a word."""
    if len(known) > REMEMBERED:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = word_features(w)
    times = Counter(chain.from_iterable(map(known.__getitem__, words)))
    return set(times).union(_at_level(f, n) for f, k in times.items() if k > 1 for n in LEVELS if k >= n)


def swaps_of(words: set[str], known: dict[str, tuple[int, ...]]) -> list[tuple[list[int], list[int]]]:
    """Features lost and gained by each swap of an identity term among the words."""
    ids = set_ids(words, known)
    swapped = (set_ids(words - {a} | {b}, known) for a in sorted(words.intersection(_GROUP)) for b in _GROUP[a])
    return [(sorted(ids - s), sorted(s - ids)) for s in swapped]


@dataclass
class Model:
    intercept: float
    weights: dict[int, float] = field(default_factory=dict)

    def scorer(self):
        """A function of one text; words without a weighted feature are remembered as such."""
        known: dict[str, tuple[int, ...]] = {}
        weights = self.weights
        steps: dict[int, list[tuple[int, float]]] = {}  # of a feature: from how many words on, and the weight

        def of(word):
            for f in word_features(word):
                if f not in steps:
                    found = [(n, weights.get(f if n == 1 else _at_level(f, n))) for n in (1, *LEVELS)]
                    steps[f] = [(n, w) for n, w in found if w is not None]
                if steps[f]:
                    yield f

        def score(text: str) -> float:
            words = word_set(text)
            if len(known) > REMEMBERED:
                known.clear()
                steps.clear()
            for w in words.difference(known):
                known[w] = tuple(of(w))
            times = Counter(chain.from_iterable(map(known.__getitem__, words)))
            return float(_sigmoid(self.intercept + sum(w for f in sorted(times) for n, w in steps[f] if times[f] >= n)))

        return score


class Swaps:
    """Swapped rows as what they lose and gain: ``row`` and ``weight`` of each, over the features of ``x``."""

    def __init__(self, x: Rows, swaps: list[list], weight: np.ndarray):
        place = {int(f): k for k, f in enumerate(x.features)}
        self.row = np.repeat(np.arange(len(swaps)), [len(s) for s in swaps]).astype(np.int64)
        self.weight = weight[self.row] / np.maximum(1, [len(s) for s in swaps])[self.row] if len(self.row) else np.empty(0)
        changes = [[(place[i], sign) for ids, sign in zip(change, (-1.0, 1.0)) for i in ids if i in place] for s in swaps for change in s]
        self.swap = np.repeat(np.arange(len(changes)), [len(c) for c in changes]).astype(np.int64)
        self.column = np.array([i for c in changes for i, _ in c], np.int64)
        self.sign = np.array([v for c in changes for _, v in c])
        self.width, self.n = len(x.features), len(swaps)

    def moved(self, w: np.ndarray) -> np.ndarray:
        """The change of the sum of weights by each swap."""
        return np.bincount(self.swap, self.sign * w[self.column], minlength=len(self.row))


def loss_and_gradient(x: Rows, swaps: Swaps, labels: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log loss, ridge, and the mean squared change of the score over the swaps of a row.

    ``w`` ends with the intercept.
    """
    n, d = len(labels), swaps.width
    z = x.times(w[:d]) + w[d]
    p = _sigmoid(z)
    loss = -(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / n + RIDGE / 2 * (w[:d] ** 2).sum()
    error = weight * (p - labels) / n
    if len(swaps.row):
        q = _sigmoid(z[swaps.row] + swaps.moved(w))
        change, scale = q - p[swaps.row], SWAP * swaps.weight / n
        loss += (scale * change**2).sum()
        to_q = 2 * scale * change * q * (1 - q)
        error = error + np.bincount(swaps.row, to_q - 2 * scale * change * (p * (1 - p))[swaps.row], minlength=n)
    g = np.append(x.transposed(error) + RIDGE * w[:d], error.sum())
    if len(swaps.column):
        g[:d] += np.bincount(swaps.column, swaps.sign * to_q[swaps.swap], minlength=d)
    return loss, g


def fit_rows(labels: np.ndarray, ids: list[np.ndarray], swaps: list[list], weight=None) -> Model:
    """Fit on feature ids; ``swaps`` has for each row what its swaps lose and gain, ``weight`` is that of each row, 1 on average."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(-35.0 if share == 0 else 35.0)
    weight = np.ones(len(labels)) if weight is None else weight
    first = Rows(ids, LEAST)
    w = _solved(first, labels, swaps, weight, sparse=SPARSE)
    second = Rows(ids, only=first.features[w[:-1] != 0])
    w = _solved(second, labels, swaps, weight)
    return Model(float(w[-1]), {int(f): float(v) for f, v in zip(second.features, w[:-1])})


def _solved(x: Rows, labels: np.ndarray, swaps: list[list], weight: np.ndarray, sparse: float = 0.0) -> np.ndarray:
    """Weights of the features of ``x`` and the intercept."""
    swapped, d = Swaps(x, swaps, weight), len(x.features)
    return minimised(lambda w: loss_and_gradient(x, swapped, labels, weight, w)[1], d + 1, sparse=np.append(np.full(d, sparse), 0.0))


def fit(docs: DataFrame, labels: DataFrame, budget: int = BUDGET) -> Model:
    """Learn from the labelled rows that are not held out."""
    known: dict[str, tuple[int, ...]] = {}

    def featurise(text):
        words = word_set(text)
        return set_ids(words, known), [json.dumps(s) for s in swaps_of(words, known)]

    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic_"))
    found = sample_rows(docs, marked, "toxic_", featurise, budget)
    swaps = [[json.loads(s) for s in more] for more in found["more"]]
    return fit_rows(found["label"].to_numpy(float), [np.asarray(i, np.int64) for i in found["ids"]], swaps, found["weight"].to_numpy())


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        score = model.scorer()
        for b in batches:
            s = np.array([score(t or "") for t in b["text"]], float)
            yield b[["doc_id", "held_out"]].assign(score=s, predicted=(s >= threshold).astype("int32"))

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
