"""Language identification with string kernels (operator 10).

The blended-spectrum presence kernel of two texts counts the byte n-grams, n = 1 to 4, that
both have, divided by the root of the product of how many each has.  Texts are cut
into segments of up to 4096 bytes, all of which count.  Nyström: segments of a bounded sample are
mapped to their kernels with landmark segments, whitened by the landmarks' own kernel matrix;
one-versus-rest kernel ridge regression is solved there.  N-grams are numbered by a
hash, so a segment is a row of 0 and 1, and its scores are that row times one matrix:
the landmarks' rows combined by the solution.  The scores of a text are the mean over its segments.

Where only texts in a known language are wanted, the score that a text must reach is found on the labelled texts:
nearly all of them reach it when they are scored by a model that has not learnt them.

A text that is null or has no letter gets ``und`` and 0; repeated rows are judged alike; an
empty table gives an empty result; without any known language every text gets ``und``.
Columns other than ``doc_id``, ``text`` and, to learn, ``lang`` are not read.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from lorebase.llm.common import class_sample, held_out

#: Characters of the texts learnt from, about, in equal parts for all languages; and segments used of them.
BUDGET, LEARNT = 6_000_000, 3000
LANDMARKS = 160
RIDGE = 0.01
SEGMENT = 4096
#: Numbers for the n-grams of each n.
WIDTHS = {1: 256, 2: 4096, 3: 8192, 4: 8192}
WIDTH = sum(WIDTHS.values())
#: Rows of the matrices multiplied at once.
ROWS = 64
UNKNOWN = "und"
#: Share of the labelled texts that may score lower than a known language must, and how far from there to the score
#: of a text that is like all languages the line is drawn.
MISSED, SLACK = 0.001, 0.1

_LETTER = regex.compile(r"\p{L}").search
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def segments(data: bytes) -> list[bytes]:
    return [data[i : i + SEGMENT] for i in range(0, len(data), SEGMENT)] or [b""]


def presence(parts: list[bytes]) -> np.ndarray:
    """A row per segment, 1 where it has an n-gram of that number."""
    out = np.zeros((len(parts), WIDTH), np.float32)
    flat, lengths = out.reshape(-1), np.array([len(p) for p in parts])
    data = _LOWER[np.frombuffer(b"".join(parts), np.uint8)]
    row = np.repeat(np.arange(len(parts), dtype=np.int64) * WIDTH, lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # bytes to the segment's end
    gram, base = data.copy(), 0
    for n, width in WIDTHS.items():
        if n > 1:
            gram = (gram[:-1] << 8) | data[n - 1 :]
        fits = left[: len(gram)] >= n
        number = gram if n == 1 else (gram * np.uint32(2654435761)) >> np.uint32(32 - width.bit_length() + 1)
        flat[row[: len(gram)][fits] + base + number[fits]] = 1
        base += width
    return out


def normed(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # WIDTH x languages
    least: float = 0.0  # score of a text whose language counts as known

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Mean scores of the segments of each text."""
        parts = [segments(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        flat = [s for p in parts for s in p]
        total = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(flat), ROWS):
            x = presence(flat[at : at + ROWS])
            one = (x @ self.matrix) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
            np.add.at(total, owner[at : at + ROWS], one)
        return total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None]


def fit_texts(texts: list[bytes], langs: list[str], seed: int = 5) -> Model:
    """Nyström features of the segments, then ridge regression per language."""
    names = sorted(set(langs))
    parts = [(s, lang) for t, lang in zip(texts, langs) for s in segments(t)]
    if not names:
        return Model([], np.zeros((WIDTH, 0), np.float32))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(parts))
    by = {n: [k for k in order if parts[k][1] == n] for n in names}
    share = max(1, LEARNT // len(names))
    chosen = [k for n in names for k in by[n][:share]]
    marks = [k for n in names for k in by[n][: max(1, LANDMARKS // len(names))]]
    stacked = lambda ks: np.concatenate([normed(presence([parts[j][0] for j in ks[i : i + ROWS]])) for i in range(0, len(ks), ROWS)])
    land = stacked(marks)
    values, vectors = np.linalg.eigh((land @ land.T).astype(float))
    fine = values > 1e-6 * values.max()
    whiten = vectors[:, fine] / np.sqrt(values[fine])
    kernels = np.concatenate([normed(presence([parts[j][0] for j in chosen[i : i + ROWS]])) @ land.T for i in range(0, len(chosen), ROWS)])
    phi = kernels @ whiten
    truth = np.array([[1.0 if parts[k][1] == n else -1.0 for n in names] for k in chosen])
    # Each language weighs the same, however many segments it has.
    weight = np.array([1 / min(share, len(by[parts[k][1]])) for k in chosen])[:, None]
    solved = np.linalg.solve(phi.T @ (phi * weight) + RIDGE * np.eye(phi.shape[1]), phi.T @ (truth * weight))
    return Model(names, (land.T @ (whiten @ solved)).astype(np.float32))


def least_score(texts: list[bytes], langs: list[str]) -> float:
    """The score that a text of a learnt language reaches, but for a share of ``MISSED``.

    Each half of the texts is scored by what the other half teaches; only texts whose language is found count.
    """
    names = sorted(set(langs))
    turn = {n: 0 for n in names}
    half = np.zeros(len(texts), int)
    for k, lang in enumerate(langs):
        half[k], turn[lang] = turn[lang] % 2, turn[lang] + 1
    scores = []
    for h in (0, 1):
        learnt, asked = np.flatnonzero(half != h), np.flatnonzero(half == h)
        model = fit_texts([texts[k] for k in learnt], [langs[k] for k in learnt])
        found, score = predict([texts[k].decode() for k in asked], model)
        scores += [s for k, f, s in zip(asked, found, score) if f == langs[k]]
    if not scores:
        return 0.0
    low = float(np.quantile(scores, MISSED, method="lower"))
    return low - SLACK * (low - 1 / len(names))


def fit(docs: DataFrame, budget: int = BUDGET, calibrated: bool = False) -> Model:
    """Learn from the rows that have a language and are not held out, a sample of every language.

    If ``calibrated`` the same rows say which score a known language has (``least``).
    """
    rows = docs.filter("text is not null and lang is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    rows = rows.select("doc_id", "text", "lang")
    sample = class_sample(rows, "lang", F.col("doc_id"), F.length("text"), budget)
    some = rows.filter(sample.takes(F.col("lang"), F.col("doc_id"))).select(sample.cut(F.col("lang"), F.col("text")).alias("text"), "lang")
    some = some.orderBy("lang", "text").toPandas()
    texts, langs = [t.encode() for t in some["text"]], some["lang"].tolist()
    model = fit_texts(texts, langs)
    if calibrated:
        model.least = least_score(texts, langs)
    return model


def predict(texts, model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; None counts as empty."""
    found, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    some = [k for k, t in enumerate(texts) if t and _LETTER(t)] if model.languages else []
    size, block = 0, []
    for i, k in enumerate(some):
        block.append(k)
        size += len(texts[k])
        if size > 1_000_000 or i == len(some) - 1:
            s = model.scores([texts[j].encode() for j in block])
            e = np.exp(4 * (s - s.max(1, keepdims=True)))
            p = e / e.sum(1, keepdims=True)
            for j, c, q in zip(block, s.argmax(1), p.max(1)):
                found[j], score[j] = model.languages[c], q
            size, block = 0, []
    return found, score


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found, score = predict(b["text"].tolist(), model)
            yield b[["doc_id", "held_out"]].assign(lang_pred=found, score=score)

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def known_documents(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The rows whose language is known with a score of at least ``least``, all columns as they were."""

    def run(batches):
        for b in batches:
            found, score = predict(b.column("text").to_pylist(), model)
            yield b.filter(pa.array((np.array(found, object) != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
