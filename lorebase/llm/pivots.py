"""Exact top-k by inner product with a pivot table (operator 2).

Components become integers, floor(1024 * x).  The table holds each vector's distances to a
few pivots.  For a query q, the largest difference between its distance and that of x to
a pivot is a lower bound of their distance, hence an upper bound of their product:
2 q·x = |q|² + |x|² - d². Candidates are evaluated in the order of that bound,
a block at a time, until no bound reaches the k-th best score found.

Queries go in blocks of bounded size; each block is sent to the tasks, which read the table
once per block.  A task keeps k rows per query; those are merged in two steps.
The pivots come from a bounded sample; they decide the speed, never the result.

Vectors that are null or hold null or non-finite components take no part; a vector is
compared with those of its own length only; rows with a null ``vec_id`` take no part;
of rows with one ``vec_id`` each takes part, but never against its own id; products
beyond 64 bits stop at the limits.  An empty table gives an empty result.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lorebase.sources.scratch import kept

SCALE = 1024
#: Rows that pivots are chosen from.
SAMPLE = 4096
PIVOTS = 24
#: Queries sent to the tasks at once.
QUERY_BLOCK = 4096
#: Candidates of a task that are ranked by their bounds together, and evaluated at once.
GROUP, STEP = 8192, 512
#: Parts in which the best rows of a query are merged first.
MERGE_PARTS = 32
_EXACT = 2.0**52


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, n``: floored components of the vectors that take part, and their number."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine).select(
        "vec_id", F.transform(e, lambda x: F.floor(x * SCALE).cast("double")).alias("v"), F.size("embedding").alias("n")
    )


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each next pivot is the sample's vector farthest from those chosen."""
    at, nearest, chosen = 0, np.full(len(sample), np.inf), []
    for _ in range(min(count, len(sample))):
        chosen.append(at)
        nearest = np.minimum(nearest, _distances(sample, sample[at : at + 1])[:, 0])
        at = int(nearest.argmax())
    return sample[chosen]


def pivot_table(ints: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``ints`` with ``far``: the distances to the pivots."""

    def run(batches):
        for b in batches:
            if len(b):
                yield b.assign(far=list(_distances(_matrix(b["v"]), pivots)))

    return ints.mapInPandas(run, "vec_id bigint, v array<double>, n int, far array<double>")


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products as 64-bit integers, or Python integers held within 64 bits."""
    largest = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if largest < _EXACT:
        return np.rint(q @ x.T).astype(np.int64)
    wide = np.array([[int(c) for c in r] for r in q], object).reshape(q.shape) @ np.array([[int(c) for c in r] for r in x], object).reshape(x.shape).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of one query; ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores, ids):
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == -(2**63) else -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    @property
    def least(self):
        return self.scores[-1] if len(self.scores) == self.k else None


def search_block(query_ids, queries, query_far, ids, vectors, far, k, best, evaluated=None):
    """Add the candidates of one group to ``best``, in the order of their bounds."""
    norms = (vectors * vectors).sum(1)
    own = (queries * queries).sum(1)
    trusted = max(norms.max(initial=0), own.max(initial=0)) < _EXACT
    for i in range(len(queries)):
        gap = np.abs(far - query_far[i]).max(1, initial=0.0) if trusted else np.zeros(len(ids))
        # Distances are rounded: bounds are widened by far more than the rounding.
        gap = np.maximum(0.0, gap * (1 - 1e-9) - 1e-3)
        bound = (own[i] + norms - gap * gap) / 2 + 1 if trusted else np.full(len(ids), np.inf)
        order = np.argsort(-bound, kind="stable")
        for at in range(0, len(order), STEP):
            least = best[i].least
            if least is not None and bound[order[at]] < least:
                break
            some = order[at : at + STEP]
            if least is not None:
                some = some[bound[some] >= least]
            some = some[ids[some] != query_ids[i]]
            if evaluated is not None:
                evaluated[0] += len(some)
            best[i].add(_products(queries[i : i + 1], vectors[some])[0], ids[some])


def _first_merge(rows: DataFrame, k: int) -> DataFrame:
    """The k best per query of many tasks' rows: by parts, then together."""
    order = (F.col("score").desc(), F.col("vec_id"))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(MERGE_PARTS))
    once = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` rows for each query row."""
    spark = vectors.sparkSession
    ints = kept(integers(vectors), "integers")
    lengths = [r["n"] for r in ints.select("n").distinct().collect()]
    found = None
    for n in sorted(lengths):
        mine = ints.filter(F.col("n") == n)
        sample = mine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
        pivots = choose_pivots(_matrix(sample["v"]), PIVOTS)
        table = kept(pivot_table(mine, pivots), "pivots")
        queries = table.filter(is_query)
        total = queries.count()
        blocks = -(-total // QUERY_BLOCK)
        block_of = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, blocks)))
        for block in range(blocks):
            sent = queries.filter(block_of == block).orderBy("vec_id").toPandas()
            part = _searched(table, sent, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return _first_merge(found, k)


def _searched(table: DataFrame, sent: pd.DataFrame, k: int) -> DataFrame:
    query_ids = sent["vec_id"].to_numpy(np.int64)
    queries, query_far = _matrix(sent["v"]) if len(sent) else None, _matrix(sent["far"]) if len(sent) else None

    def run(batches):
        best = [Best(k) for _ in query_ids]
        for b in batches:
            for at in range(0, len(b) if len(best) else 0, GROUP):
                g = b.iloc[at : at + GROUP]
                search_block(query_ids, queries, query_far, g["vec_id"].to_numpy(np.int64), _matrix(g["v"]), _matrix(g["far"]), k, best)
        for q, x in zip(query_ids, best):
            if len(x.ids):
                yield pd.DataFrame({"query_id": q, "vec_id": x.ids, "score": x.scores})

    return table.mapInPandas(run, "query_id bigint, vec_id bigint, score bigint")
