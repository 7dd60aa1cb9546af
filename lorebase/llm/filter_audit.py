"""Interaction audit of five filters by Hart and Mas-Colell potentials (operator 11).

A document fails some of five filters: A too few words, B too few distinct words, C too many
capitals, D holds marks of code or markup, E equals the text of a document with a smaller id.
Which ones it fails is a number of five bits, and the documents of each part are counted by
it.  All else follows from these 32 counts:

- v(S), the documents that the filters of coalition S remove together, as sums of counts.
- The potential of the game of removals: P(S) = (v(S) + sum of P(S without i)) / |S|.  It is
  kept as |S|! P(S), a whole number.
- The Shapley value of a filter is P(all) - P(all without it), here times 120: the sum of what it
  removes over the 120 orders.  What a step of an order removes is v(S with it) - v(S).

Null texts are empty: no words, no distinct ones, A alone fails (and E, if an empty text with a
smaller id is there).  A null id is larger than every id; rows with one id and one text are
copies of which none has the smaller id, so all of them are first or none.  A null ``lang`` is the
part ''.  Repeated rows count each.  A document is good (toxic) if any of its rows of ``labels`` says
so; rows without an id have no labels.  An empty table has no parts.  Other columns are not read.
Equal texts are found by SHA-256.
"""

from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lorebase.llm.buckets import LAST
from lorebase.llm.common import let, words
from lorebase.sources.scratch import kept

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
ALL = (1 << len(FILTERS)) - 1
#: Bounds of the filters that look at one text.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; ``text`` is not null."""
    def bits(ws):
        n = F.size(ws)
        return (
            F.when(n < MIN_WORDS, 1).otherwise(0)
            + F.when(F.size(F.array_distinct(ws)) * 100 < n * MIN_DISTINCT, 2).otherwise(0)
            + F.when(F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * MAX_CAPITALS, 4).otherwise(0)
            + F.when(text.rlike(MARKS), 8).otherwise(0)
        )

    return let(words(text), bits)


def failures(docs: DataFrame) -> DataFrame:
    """``part, doc_id, mask, n``: rows with one part, id and text counted together.

    Rows meet the smallest id of their text by text and id together, so that a text which a
    third of the rows share is spread over all tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.coalesce("lang", F.lit("")).alias("part"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"),
        F.col("doc_id").isNull().alias("no_id"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"), own_failures(text).alias("own"),
    )
    rows = kept(rows.groupBy("digest", "no_id", "id", "part", "own").agg(F.count(F.lit(1)).alias("n")), "texts")
    first = rows.groupBy("digest").agg(F.min(F.struct("no_id", "id")).alias("first")).select("digest", "first.no_id", "first.id", F.lit(0).alias("same"))
    found = rows.join(first, ["digest", "no_id", "id"], "left")
    mask = F.col("own") + F.coalesce("same", F.lit(16))
    return found.select("part", F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), mask.alias("mask"), "n")


def counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part: arrays ``n, good, toxic`` of 32 counts, by the bits of the filters failed."""
    marks = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic")
    )
    of = lambda c: F.col("n") * c.cast("long")
    no = F.lit(0).cast("long")
    every = failed.select("part", "mask", "n", no.alias("good"), no.alias("toxic"))
    marked = failed.join(marks, "doc_id").select("part", "mask", no.alias("n"), of(F.col("is_good")).alias("good"), of(F.col("is_toxic")).alias("toxic"))
    by_mask = every.unionByName(marked).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    at = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), no) for m in range(ALL + 1)))
    return by_mask.groupBy("part").agg(*(at(c).alias(c) for c in ("n", "good", "toxic")))


def removals(by_mask: np.ndarray) -> np.ndarray:
    """v(S) for every coalition S (last axis): the documents that fail a filter of S."""
    meets = (np.arange(ALL + 1)[:, None] & np.arange(ALL + 1)[None, :]) != 0
    return by_mask @ meets.T.astype(np.int64)


def potentials(v: np.ndarray) -> np.ndarray:
    """|S|! P(S) for every coalition S, smaller coalitions first."""
    q = np.zeros_like(v)
    factorial = 1
    for size in range(1, len(FILTERS) + 1):
        for members in combinations(range(len(FILTERS)), size):
            s = sum(1 << i for i in members)
            q[:, s] = factorial * v[:, s] + sum(q[:, s ^ (1 << i)] for i in members)
        factorial *= size
    return q


def shapley(v: np.ndarray) -> np.ndarray:
    """120 times the Shapley value of each filter."""
    q = potentials(v)
    return np.stack([q[:, ALL] - len(FILTERS) * q[:, ALL ^ (1 << i)] for i in range(len(FILTERS))], axis=1)


_OUT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, "
    "shapley long, filter string"
)


def _steps(batches):
    """600 rows for each part."""
    for b in batches:
        n, good, toxic = (removals(np.array([list(x) for x in b[c]], np.int64).reshape(-1, ALL + 1)) for c in ("n", "good", "toxic"))
        total = np.array([sum(x) for x in b["n"]], np.int64)
        value = shapley(n)
        for order in ORDERS:
            before = 0
            for step, name in enumerate(order, 1):
                i = FILTERS.index(name)
                after = before | 1 << i
                removed = n[:, after] - n[:, before]
                yield pd.DataFrame({
                    "part": b["part"].to_numpy(), "filter_order": order, "step": step, "kept": total - n[:, after], "removed": removed,
                    "redundant": n[:, 1 << i] - removed, "unique_fails": n[:, ALL] - n[:, ALL ^ (1 << i)],
                    "good_lost": good[:, after] - good[:, before], "toxic_lost": toxic[:, after] - toxic[:, before],
                    "shapley": value[:, i], "filter": name,
                })
                before = after


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step."""
    return counts(kept(failures(docs), "failures"), labels).mapInPandas(_steps, _OUT)
