"""Nearest-neighbour candidates for a batch of query vectors.

Exact search scans the corpus once per block of queries.  The queries are counted and
cut by a hash into blocks of bounded size; a block goes to every task, which keeps only
its best ``k`` per query.  So the corpus is never shuffled, the shuffle carries at most ``k`` rows
per query and task, and never a list of pairs; those rows are merged in two steps.
"""

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lorebase.functions.columns import top_per_key
from lorebase.functions.vectors import DISTANCE_DECIMALS, unit_rows
from lorebase.operators.ranked_sets import _ranges
from lorebase.sources.scratch import kept

# Most bytes of vectors, or of running best lists, in one block.
BLOCK_BYTES = 64 << 20
MOST_BLOCKS = 64  # blocks whose scans are one plan; the rows found by more are written, so many blocks at a time
SCAN_ROWS = 200_000  # rows that a task scans at least, if there are tasks enough
MERGE_PARTS = 32  # parts of a query's rows that are merged first
_SLICE_ROWS, _CHUNK_QUERIES = 2048, 512  # most corpus rows and queries multiplied at a time; eight queries share a byte
_MARGIN = 1e-11  # what rounding may add to a distance, and more
_MARKED_ROWS = 100_000  # rows that are held against the marks of their queries at a time
_UNDEFINED = 3.0  # distance to an all-zero vector while sorting: after all others

#: Queries searched exactly to fit the cells, and the share of their nearest rows that the cells must reach.
FITTED_QUERIES, FITTED_RECALL = 200, 0.93
#: Rows of a cell, about, as long as the number of signs is within these bounds.
CELL_ROWS, LEAST_BITS, MOST_BITS = 8, 10, 14

_FOUND = "qid string, id long, tenant_id string, d double"
_COUNTED = "qid string, slot int, rows long"


def candidate_limit(limit: int) -> int:
    """Fixed rule of the source: 50 candidates per wanted hit, 200 at least."""
    return max(50 * limit, 200)


@dataclass
class SignCells:
    """Cells of the approximate search: the sign pattern of random projections.

    Near vectors share most signs, and those that differ are mostly signs of small
    projections.  With ``reach`` a query looks into the cells whose differing signs cost that
    much at most, a sign costing the square of the unit query's projection; without, into
    those with up to ``radius`` differing signs.  Vectors in other cells are never
    compared.  :func:`fitted_cells` chooses ``bits`` and ``reach`` for a corpus.
    """

    bits: int = 6
    radius: int = 2
    seed: int = 7
    reach: float | None = None

    def _projected(self, matrix: np.ndarray) -> np.ndarray:
        return matrix @ np.random.default_rng(self.seed).standard_normal((matrix.shape[1], self.bits))

    def of(self, matrix: np.ndarray) -> np.ndarray:
        return ((self._projected(matrix) > 0) << np.arange(self.bits)).sum(axis=1)

    def _prices(self, vectors: np.ndarray) -> np.ndarray:
        """What each differing sign costs each query; nothing for an all-zero query."""
        return self._projected(np.nan_to_num(unit_rows(vectors))) ** 2

    def costs(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The cost of one cell for each query."""
        differing = ((self.of(vectors) ^ cells)[:, None] >> np.arange(self.bits)) & 1
        return (differing * self._prices(vectors)).sum(axis=1)

    def _looks(self, vectors: np.ndarray):
        """256 queries at a time, all cells across: does the query look into the cell?"""
        own = self.of(vectors)
        prices = np.ones((len(vectors), self.bits)) if self.reach is None else self._prices(vectors)
        limit = self.radius if self.reach is None else self.reach
        signs = ((np.arange(1 << self.bits)[:, None] >> np.arange(self.bits)) & 1).astype(float)
        for at in range(0, len(vectors), 256):
            price, sign = prices[at : at + 256], signs[own[at : at + 256]]
            # A sign costs where the cell has 1 and the query 0, or the other way round.
            cost = (price * sign).sum(axis=1, keepdims=True) + (price * (1 - 2 * sign)) @ signs.T
            yield cost <= limit + 1e-9

    def looked_into(self, vectors: np.ndarray) -> np.ndarray:
        """Queries down, all cells across."""
        return np.concatenate(list(self._looks(vectors)))

    def looked_into_bits(self, vectors: np.ndarray) -> np.ndarray:
        """The same as bits, eight queries to a row."""
        return np.concatenate([np.packbits(x, axis=0) for x in self._looks(vectors)])


def fitted_cells(
    queries: DataFrame, corpus: DataFrame, limit: int = 10, *, tenant_filter: str = "post", share: float = FITTED_RECALL
) -> SignCells:
    """Cells that grow with the corpus, and the reach by which a sample of the queries finds
    ``share`` of its ``limit`` nearest rows.

    The sample, chosen by a hash of the query id, is searched exactly first.
    """
    rows = corpus.filter("embedding is not null")
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, rows.count()) / CELL_ROWS)))))
    some = queries.filter("query_vector is not null").orderBy(F.xxhash64(F.col("qid").cast("string")), "qid").limit(FITTED_QUERIES)
    some = kept(some.select("qid", "tenant_id", "query_vector"), "fitted")
    nearest = top_per_key(vec_candidates(some, rows, limit, tenant_filter=tenant_filter), ["qid"], ["d", "id"], limit, rank="place")
    found = rows.select(F.col("id").cast("long").alias("id"), "embedding").join(F.broadcast(nearest.select("qid", "id")), "id")
    pairs = found.join(F.broadcast(some.select(F.col("qid").cast("string").alias("qid"), "query_vector")), "qid").toPandas()
    cells = SignCells(bits=bits, reach=0.0)
    if len(pairs):
        asked, near = (np.stack(pairs[c].to_numpy()).astype(np.float64) for c in ("query_vector", "embedding"))
        cells.reach = float(np.quantile(cells.costs(asked, cells.of(near)), share, method="higher"))
    return cells


def with_cells(corpus: DataFrame, cells: SignCells) -> DataFrame:
    """Corpus with its cell number; written ``partitionBy('cell')`` a search reads
    only the folders its queries look into."""

    @F.arrow_udf(T.IntegerType())
    def cell(vectors: pa.Array) -> pa.Array:
        return pa.array(cells.of(_matrix(vectors)), pa.int32())

    return corpus.filter("embedding is not null").withColumn("cell", cell("embedding"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one Arrow column as rows; vectors of unequal length are an error."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(np.unique(sizes)) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(set(sizes.tolist()))}")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


class _BestLists:
    """Running best ``k`` corpus rows for each query of one block."""

    def __init__(self, qids, tenants, vectors, k, same_tenant, cells):
        self.k = k
        self.tenant_names: list[str] = []
        self.tenant_code: dict[str, int] = {}
        codes = self._codes(pa.array(tenants.tolist(), pa.string()))
        # Queries of one tenant lie together, so that most chunks of them need its rows only.
        order = np.argsort(codes, kind="stable") if same_tenant else np.arange(len(codes))
        self.qids, self.own_codes, vectors = qids[order], codes[order], vectors[order]
        self.units, self.same_tenant, self.cells = unit_rows(vectors), same_tenant, cells
        self.looks = cells.looked_into_bits(vectors) if cells else None
        shape = (len(qids), k)
        self.d = np.full(shape, np.inf)  # inf: place not taken
        self.ids = np.full(shape, np.iinfo(np.int64).max)
        self.codes = np.zeros(shape, dtype=np.int32)
        self.waiting = [[] for _ in range(0, len(qids), _CHUNK_QUERIES)]  # rows near enough for the list of a query, by chunk

    def _codes(self, tenants: pa.Array) -> np.ndarray:
        """Numbers of the tenants of one column; only its distinct names are looked up."""
        coded = tenants.dictionary_encode(null_encoding="encode")
        numbers = np.array([self.tenant_code.setdefault(t, len(self.tenant_code)) for t in coded.dictionary.to_pylist()], np.int32)
        self.tenant_names = list(self.tenant_code)
        return numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(numbers) else np.empty(0, np.int32)

    def scan(self, batch) -> None:
        for start in range(0, batch.num_rows, _SLICE_ROWS):
            part = batch.slice(start, _SLICE_ROWS)
            corpus = _matrix(part.column("embedding"))
            if corpus.shape[1] != self.units.shape[1]:
                raise ValueError(f"query vectors have {self.units.shape[1]} dimensions, corpus {corpus.shape[1]}")
            codes = self._codes(part.column("tenant_id"))
            ids = part.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            unit, cell = unit_rows(corpus), self.cells.of(corpus) if self.cells else None
            for at in range(0, len(self.qids), _CHUNK_QUERIES):
                self._meet(at, unit, cell, ids, codes)

    def _meet(self, at: int, unit, cell, ids, codes) -> None:
        """One chunk of queries and one slice of the corpus."""
        own = slice(at, at + _CHUNK_QUERIES)
        query, row, d = self._near(own, unit, cell, codes)
        if not len(query):
            return
        waiting = self.waiting[at // _CHUNK_QUERIES]
        waiting.append((query, d, ids[row], codes[row]))
        if sum(len(w[0]) for w in waiting) >= _CHUNK_QUERIES * self.k:
            self._merge(at)

    def _near(self, own: slice, unit, cell, codes):
        """Query of the chunk, row of the slice and distance, of all that come into a list as it stands."""
        units, worst = self.units[own], self.d[own, -1]
        lines = np.arange(len(unit))
        if self.same_tenant:
            lines = np.flatnonzero(np.isin(codes, self.own_codes[own]))
        if self.cells is None:
            groups = [(np.arange(len(units)), lines)] if len(lines) else []
        else:
            first = own.start // 8
            looks = ((c, np.flatnonzero(np.unpackbits(self.looks[first : first + -(-len(units) // 8), c], count=len(units)))) for c in np.unique(cell[lines]))
            groups = [(asking, lines[cell[lines] == c]) for c, asking in looks if len(asking)]
        found = []
        for asking, rows in groups:
            product = units[asking] @ unit[rows].T
            # Not below what the last place asks for; undefined ones pass, too.
            query, row = np.nonzero(~(product < (1.0 - worst[asking] - _MARGIN)[:, None]))
            d = np.round(1.0 - product[query, row], DISTANCE_DECIMALS)
            found.append((asking[query], rows[row], np.where(np.isnan(d), _UNDEFINED, d)))
        if not found:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        query, row, d = (np.concatenate(x) for x in zip(*found))
        fits = d <= worst[query]
        if self.same_tenant:
            fits &= self.own_codes[own][query] == codes[row]
        return query[fits], row[fits], d[fits]

    def _merge(self, at: int) -> None:
        """Take the waiting rows of one chunk of queries into their lists."""
        number = at // _CHUNK_QUERIES
        if not self.waiting[number]:
            return
        own = slice(at, at + _CHUNK_QUERIES)
        kept_query, place = np.nonzero(self.d[own] < np.inf)
        held = (kept_query, self.d[own][kept_query, place], self.ids[own][kept_query, place], self.codes[own][kept_query, place])
        query, d, ids, codes = (np.concatenate(x) for x in zip(held, *self.waiting[number]))
        self.waiting[number] = []
        order = np.lexsort((ids, d, query))
        query = query[order]
        starts = np.searchsorted(query, np.arange(len(self.qids[own])))
        place = np.arange(len(query)) - starts[query]
        best = place < self.k
        query, place, order = query[best], place[best], order[best]
        self.d[own][query, place], self.ids[own][query, place], self.codes[own][query, place] = d[order], ids[order], codes[order]

    def found(self):
        """The lists, a chunk of queries at a time."""
        names = np.array(self.tenant_names or [""], dtype=object)
        for at in range(0, len(self.qids), _CHUNK_QUERIES):
            self._merge(at)
            own = slice(at, at + _CHUNK_QUERIES)
            which, place = np.nonzero(self.d[own] < np.inf)
            d = self.d[own][which, place]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.qids[own][which], pa.string()),
                    pa.array(self.ids[own][which, place], pa.int64()),
                    pa.array(names[self.codes[own][which, place]], pa.string()),
                    pa.array(np.where(d == _UNDEFINED, np.nan, d), pa.float64(), from_pandas=False),
                ],
                names=["qid", "id", "tenant_id", "d"],
            )


class _Before(_BestLists):
    """For each query of one block, the rows that lie before its marks (``d, id`` in order).

    A query with fewer marks than others has first ones that nothing lies before.
    """

    def __init__(self, qids, tenants, vectors, mark_d, mark_id, cells):
        most = max(map(len, mark_d))
        super().__init__(qids, tenants, vectors, most, False, cells)
        self.d[:], self.ids[:] = -np.inf, np.iinfo(np.int64).min
        self.missing = np.array([most - len(x) for x in mark_d])
        for q, (d, ids) in enumerate(zip(mark_d, mark_id)):
            self.d[q, self.missing[q] :] = np.where(np.isnan(d), _UNDEFINED, d)
            self.ids[q, self.missing[q] :] = ids
        self.rows = np.zeros((len(qids), most + 1), np.int64)  # by the number of marks that are not after them

    def _meet(self, at: int, unit, cell, ids, codes) -> None:
        query, row, d = self._near(slice(at, at + _CHUNK_QUERIES), unit, cell, codes)
        for part in range(0, len(query), _MARKED_ROWS):
            q, own_d, own_id = (x[part : part + _MARKED_ROWS, None] for x in (at + query, d, ids[row]))
            mark_d, mark_id = self.d[q[:, 0]], self.ids[q[:, 0]]
            slot = ((mark_d < own_d) | ((mark_d == own_d) & (mark_id <= own_id))).sum(axis=1)
            np.add.at(self.rows, (q[:, 0], slot), 1)

    def found(self):
        for at in range(0, len(self.qids), _CHUNK_QUERIES):
            which, slot = np.nonzero(self.rows[at : at + _CHUNK_QUERIES])
            which += at
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.qids[which], pa.string()), pa.array((slot - self.missing[which]).astype(np.int32)), pa.array(self.rows[which, slot])],
                names=["qid", "slot", "rows"],
            )


def _blocks(asked: DataFrame, blocks: int, block_bytes: int):
    """The queries of each block that has any.

    They are written with their block, and as many blocks as are of bounded size together are collected at once.
    """
    asked = kept(asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))), "asked")
    step = max(1, BLOCK_BYTES // block_bytes)
    for first in range(0, blocks, step):
        some = asked.filter(F.col("block").between(first, first + step - 1)).toPandas()  # by the count before
        for _, block in some.groupby("block"):
            yield block


def _stored(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows that several scans read are written first, and not made for each; those stored by cell are read as they lie.

    The scans run beside each other, and each task of one gives lists of its own: a scan has no more of them than it needs.
    """
    if blocks == 1 or "cell" in rows.columns:
        return rows
    rows = kept(rows, "vector-rows")
    parts = max(-(-rows.sparkSession.sparkContext.defaultParallelism // blocks), -(-rows.count() // SCAN_ROWS))
    return rows.coalesce(parts) if parts > 1 else kept(rows.repartition(1), "vector-rows")


def _together(parts, empty: DataFrame, cut) -> DataFrame:
    """``cut`` of all parts, which share no query; beyond ``MOST_BLOCKS`` it is written for some parts at a time."""
    some, done = [], []
    for part in parts:
        some.append(part)
        if len(some) == MOST_BLOCKS:
            done.append(kept(cut(reduce(DataFrame.unionByName, some)), "found"))
            some = []
    if some or not done:
        done.append(cut(reduce(DataFrame.unionByName, some or [empty])))
    return reduce(DataFrame.unionByName, done)


def _scanned(block, rows: DataFrame, k: int, same_tenant: bool, cells) -> DataFrame:
    """The best rows of each task for one block of queries."""
    vectors = np.stack(block["query_vector"].to_numpy()).astype(np.float64)
    qids, tenants = block["qid"].to_numpy(dtype=object), block["tenant_id"].to_numpy(dtype=object)
    if cells and "cell" in rows.columns:
        looked = cells.looked_into_bits(vectors).any(axis=0)
        rows = rows.filter(F.col("cell").isin(np.nonzero(looked)[0].tolist()))

    def run(batches):
        best = _BestLists(qids, tenants, vectors, k, same_tenant, cells)
        for batch in batches:
            best.scan(batch)
        yield from best.found()

    return rows.select("id", "tenant_id", "embedding").mapInArrow(run, _FOUND)


def vec_candidates(
    queries: DataFrame,
    corpus: DataFrame,
    limit: int = 10,
    *,
    tenant_filter: str = "post",
    cells: SignCells | None = None,
    block_bytes: int = BLOCK_BYTES,
    keep: int | None = None,
) -> DataFrame:
    """Nearest rows for each query vector: ``(qid, id, tenant_id, d)``.

    ``queries``: qid, tenant_id, query_vector; rows without a vector get nothing.
    ``corpus``: id, tenant_id, embedding.  With ``tenant_filter='post'`` candidates
    of all tenants compete for the places, as in the source; with ``'pre'`` only
    rows of the query's tenant do.  ``cells`` makes the search approximate; ``keep`` is
    the number of rows per query where it is not that of the source's rule.
    """
    k = keep or candidate_limit(limit)
    asked = queries.filter("query_vector is not null").select(
        F.col("qid").cast("string").alias("qid"), "tenant_id", "query_vector"
    )
    extra = ["cell"] if "cell" in corpus.columns else []
    rows = corpus.filter("embedding is not null").select(
        F.col("id").cast("long").alias("id"), F.col("tenant_id").cast("string").alias("tenant_id"), "embedding", *extra
    )
    size = asked.agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.size("query_vector")), F.lit(0)).alias("dim")
    ).first()
    if size["n"] == 0:
        return queries.sparkSession.createDataFrame([], _FOUND)
    same_tenant = tenant_filter == "pre"
    vector_bytes = 8 * size["dim"]
    blocks = -(-size["n"] * max(vector_bytes, 20 * k) // block_bytes)
    rows = _stored(rows, blocks)
    parts = (_scanned(block, rows, k, same_tenant, cells) for block in _blocks(asked, blocks, block_bytes))
    empty = queries.sparkSession.createDataFrame([], _FOUND)
    return _together(parts, empty, lambda found: top_per_key(found, ["qid"], ["d", "id"], k, rank="place", parts=MERGE_PARTS).drop("place"))


def vec_ranks(candidates: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Candidates of the query's own tenant, ranked and cut to four per wanted hit."""
    tenants = queries.select(F.col("qid").cast("string").alias("qid"), "tenant_id")
    own = candidates.join(tenants, ["qid", "tenant_id"])
    return top_per_key(own, ["qid"], ["d", "id"], 4 * limit, rank="vec_rk").select("qid", "id", "d", "vec_rk")


def own_ranks(queries: DataFrame, corpus: DataFrame, limit: int = 10, *, cells: SignCells | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``vec_ranks(vec_candidates(...))``, without lists of the other tenants' candidates.

    Only the nearest rows of the query's own tenant are listed.  They are candidates while fewer than
    ``candidate_limit`` rows of all tenants lie before them: a second scan counts those, by the
    marks of a query, so what is shuffled does not grow with the number of candidates.
    """
    keep, most = 4 * limit, candidate_limit(limit)
    own = kept(vec_candidates(queries, corpus, limit, tenant_filter="pre", cells=cells, block_bytes=block_bytes, keep=keep), "nearest")
    marks = own.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("marks"))
    asked = queries.filter("query_vector is not null").select(F.col("qid").cast("string").alias("qid"), "tenant_id", "query_vector")
    asked = kept(asked.join(marks, "qid").select("qid", "tenant_id", "query_vector", F.col("marks.d").alias("mark_d"), F.col("marks.id").alias("mark_id")), "marks")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("query_vector")), F.lit(0)).alias("dim")).first()
    if size["n"] == 0:
        return vec_ranks(own, queries, limit)
    rows = corpus.filter("embedding is not null").select(
        F.col("id").cast("long").alias("id"), F.col("tenant_id").cast("string").alias("tenant_id"), "embedding", *(["cell"] if "cell" in corpus.columns else [])
    )
    # A mark has a distance, an id and a count.
    blocks = -(-size["n"] * (8 * size["dim"] + 24 * keep) // block_bytes)
    rows = _stored(rows, blocks)
    parts = (_counted(block, rows, cells) for block in _blocks(asked, blocks, block_bytes))
    empty = queries.sparkSession.createDataFrame([], _COUNTED)
    counts = _together(parts, empty, lambda found: found.groupBy("qid", "slot").agg(F.sum("rows").alias("rows")))
    counts = counts.groupBy("qid").agg(F.collect_list(F.struct("slot", "rows")).alias("counts"))
    order = Window.partitionBy("qid").orderBy("d", "id")
    placed = own.withColumns({"place": F.row_number().over(order) - 1, "equal": F.row_number().over(order) - F.rank().over(order)}).join(counts, "qid")
    before = F.aggregate(F.filter("counts", lambda c: c["slot"] <= F.col("place")), F.lit(0).cast("long"), lambda n, c: n + c["rows"])
    return vec_ranks(placed.filter(before + F.col("equal") < most).select(*own.columns), queries, limit)


def _counted(block, rows: DataFrame, cells) -> DataFrame:
    """Each task's rows before the marks of one block of queries."""
    vectors = np.stack(block["query_vector"].to_numpy()).astype(np.float64)
    qids, tenants = block["qid"].to_numpy(dtype=object), block["tenant_id"].to_numpy(dtype=object)
    mark_d, mark_id = ([np.asarray(x) for x in block[c]] for c in ("mark_d", "mark_id"))
    if cells and "cell" in rows.columns:
        rows = rows.filter(F.col("cell").isin(np.nonzero(cells.looked_into_bits(vectors).any(axis=0))[0].tolist()))

    def run(batches):
        before = _Before(qids, tenants, vectors, mark_d, mark_id, cells)
        for batch in batches:
            before.scan(batch)
        yield from before.found()

    return rows.select("id", "tenant_id", "embedding").mapInArrow(run, _COUNTED)


def distances(queries: DataFrame, corpus: DataFrame, pairs: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact distances of the pairs ``qid, id``: ``qid, id, tenant_id, d``.

    A block of queries goes to the vectors with the ids that each asks for, so no vector is shuffled.
    """
    named = pairs.groupBy("qid").agg(F.collect_list("id").alias("ids"))
    asked = queries.filter("query_vector is not null").select(F.col("qid").cast("string").alias("qid"), "query_vector").join(named, "qid")
    asked = kept(asked, "named")
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("query_vector")), F.lit(0)).alias("dim"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("pairs")).first()
    blocks = max(1, -(-(8 * size["n"] * size["dim"] + 16 * size["pairs"]) // block_bytes))
    rows = corpus.filter("embedding is not null").select(
        F.col("id").cast("long").alias("id"), F.col("tenant_id").cast("string").alias("tenant_id"), "embedding"
    )
    rows = _stored(rows, blocks)
    parts = (_distances(block, rows) for block in _blocks(asked, blocks, block_bytes))
    return _together(parts, queries.sparkSession.createDataFrame([], _FOUND), lambda found: found)


def _distances(block, rows: DataFrame) -> DataFrame:
    """The pairs of one block of queries whose rows a task has."""
    units = unit_rows(np.stack(block["query_vector"].to_numpy()).astype(np.float64))
    qids = block["qid"].to_numpy(dtype=object)
    ids = np.concatenate([np.asarray(x, np.int64) for x in block["ids"]])
    owner = np.repeat(np.arange(len(block)), [len(x) for x in block["ids"]])
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]

    def run(batches):
        for batch in batches:
            own = batch.column("id").to_numpy(zero_copy_only=False)
            low = np.searchsorted(ids, own)
            count = np.searchsorted(ids, own, side="right") - low
            if not count.sum():
                continue
            unit, homes = unit_rows(_matrix(batch.column("embedding"))), batch.column("tenant_id")
            pair, row = _ranges(low, count), np.repeat(np.arange(len(own)), count)
            for at in range(0, len(pair), _MARKED_ROWS):
                q, r = owner[pair[at : at + _MARKED_ROWS]], row[at : at + _MARKED_ROWS]
                d = np.round(1.0 - np.einsum("ij,ij->i", units[q], unit[r]), DISTANCE_DECIMALS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[q], pa.string()), pa.array(own[r], pa.int64()), homes.take(pa.array(r)), pa.array(d, pa.float64(), from_pandas=False)],
                    names=["qid", "id", "tenant_id", "d"],
                )

    return rows.mapInArrow(run, _FOUND)


def recall(approximate: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """Share of each query's ``k`` nearest rows that the approximate search found."""
    nearest = top_per_key(exact, ["qid"], ["d", "id"], k, rank="place").select("qid", "id")
    hits = nearest.join(approximate.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hits.agg(
        F.count("*").alias("exact_rows"),
        F.count("hit").alias("found_rows"),
        F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"),
    )
