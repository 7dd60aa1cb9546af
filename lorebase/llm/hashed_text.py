"""Hashed features of texts and the small matrices that models are fitted on."""

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lorebase.llm.common import class_sample, held_out
from lorebase.sources.scratch import kept

BUCKETS = 1 << 18
#: Distinct words whose features one Python worker remembers.
REMEMBERED = 400_000
#: Characters that a sampled row costs at least, so that short texts are bounded in number too.
SHORT = 32
_LETTERS = re.compile(r"[^\W\d_]+").findall
_MARKS = re.compile(r"[^\w\s]+").findall


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def word_features(word: str) -> tuple[int, ...]:
    """The word and its beginnings of four to six letters."""
    return tuple({bucket("w " + word), *(bucket("p " + word[:k]) for k in (4, 5, 6) if len(word) >= k)})


def word_set(text: str) -> set[str]:
    return set(_LETTERS(text.lower()))


def word_ids(text: str, known: dict[str, tuple[int, ...]]) -> set[int]:
    """Features of the distinct words of a text; ``known`` remembers words."""
    words = word_set(text)
    if len(known) > REMEMBERED:
        known.clear()
    for w in words.difference(known):
        known[w] = word_features(w)
    return set().union(*map(known.__getitem__, words))


def _level(share: float) -> int:
    return round(10 * share)


def style_ids(text: str) -> set[int]:
    """Features of form: marks, capitals, repetition, line and word lengths, in steps."""
    words = text.split()
    n = max(1, len(words))
    marks = _MARKS(text)
    lines = [x for x in text.split("\n") if x.strip()]
    out = {"m " + m[:3] for m in set(marks)}
    out |= {
        f"marks {_level(min(2, len(marks) / n))}",
        f"capitals {_level(sum(w.isupper() and len(w) > 1 for w in words) / n)}",
        f"same as last {_level(sum(a == b for a, b in zip(words, words[1:])) / n)}",
        f"distinct {_level(len(set(words)) / n) if n >= 50 else 'few'}",
        f"lines {_level(len(set(lines)) / max(1, len(lines)))}",
        f"size {min(12, len(text).bit_length())}",
        f"word length {min(12, round(sum(map(len, words)) / n))}",
    }
    return {bucket("s " + x) for x in out}


class Rows:
    """Sparse rows of 0 and 1 over the features that enough rows have, or over ``only``."""

    def __init__(self, ids: list[np.ndarray], least: int = 1, only=None):
        flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
        have = np.bincount(flat, minlength=BUCKETS) >= least
        if only is not None:
            have &= np.isin(np.arange(BUCKETS), only)
        self.features = np.flatnonzero(have)
        column = np.cumsum(have) - 1
        kept = have[flat]
        row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])[kept]
        self.row, self.column, self.n = row, column[flat[kept]], len(ids)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.n)

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=r[self.row], minlength=len(self.features))


def minimised(gradient, size: int, steps: int = 200, rate: float = 0.1, sparse=None) -> np.ndarray:
    """Adam from zero on a gradient of the whole sample; ``sparse`` gives the weight of each
    coordinate's absolute value, which is taken off by soft thresholds."""
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - (t - 1) / steps) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        x -= step * m / (1 - 0.9**t)
        if sparse is not None:
            x = np.sign(x) * np.maximum(0, np.abs(x) - step * sparse)
    return x


def sample_rows(docs: DataFrame, marks: DataFrame, label: str, featurise, budget: int) -> pd.DataFrame:
    """``label, ids, more, weight`` of about ``budget`` characters of ``docs`` that ``marks`` labels, a row counting as ``SHORT`` at least.

    ``featurise(text)`` gives the feature ids and a list of words to keep.  Every label is in the
    sample, with an equal part of the budget; ``weight`` is the number of rows that a row
    stands for, 1 on average.  Only lengths are joined to find the rows to take, and only these
    rows' ids meet the texts; what reaches the driver is bounded by the budget.
    """
    rows = docs.filter(~held_out(F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marks = marks.select("doc_id", F.col(label).cast("int").alias("label"))
    lengths = kept(rows.select("doc_id", F.length("text").alias("n")).join(marks, "doc_id"), "lengths")
    sample = class_sample(lengths, "label", F.col("doc_id"), F.greatest("n", F.lit(SHORT)), budget, F.col("n") > 0)
    chosen = lengths.filter(sample.takes(F.col("label"), F.col("doc_id"))).select("doc_id", "label").distinct()
    some = rows.join(F.broadcast(chosen), "doc_id").select(sample.cut(F.col("label"), F.col("text")).alias("text"), "label")

    def run(batches):
        for b in batches:
            found = [featurise(t) for t in b["text"]]
            yield pd.DataFrame({"label": b["label"], "ids": [sorted(f[0]) for f in found], "more": [f[1] for f in found]})

    found = some.mapInPandas(run, "label int, ids array<int>, more array<string>").toPandas()
    stands = found["label"].map(sample.rows) / found.groupby("label")["label"].transform("size")
    return found.assign(weight=(stands / stands.mean()).astype(float))
