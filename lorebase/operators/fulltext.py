"""Full-text retrieval: postings, all-words match and proximity rank."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lorebase.functions.text import lexemes
from lorebase.sources.scratch import kept

#: Word sets that are sent out at once; more are matched in several scans of the corpus.
BLOCK_SETS = 100_000

# Fixed values of the source's text rank.
WEIGHT = 0.1
SERIES_LIMIT = 1.64493406685  # sum of 1/j^2
FAR = 100  # words further apart than this add nothing
FAR_SCORE = WEIGHT * 1e-15  # what a match with no near pair is worth


def analyze(df: DataFrame, text: str, keys, config: str = "english") -> DataFrame:
    """One row per token that is not a stop word: keys, lexeme, position from 1."""
    return (
        df.select(*keys, F.posexplode(lexemes(F.col(text), config)).alias("place", "lexeme"))
        .filter("lexeme is not null")
        .select(*keys, "lexeme", (F.col("place") + 1).alias("position"))
    )


@F.arrow_udf(T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
def _places(words: pa.Array) -> pa.Array:
    """For each row's list of words: word to its places, from 1; nulls hold a place."""
    lengths = np.nan_to_num(words.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    row = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(1, len(row) + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    coded = words.flatten().dictionary_encode()
    there = coded.is_valid().to_numpy(zero_copy_only=False)
    code = coded.indices.drop_null().to_numpy()
    row, at = row[there], at[there]
    order = np.lexsort((at, code, row))
    row, at, code = row[order], at[order], code[order]
    first = np.flatnonzero(np.diff(row, prepend=-1).astype(bool) | np.diff(code, prepend=-1).astype(bool))
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at, pa.int32()))
    starts = np.searchsorted(row[first], np.arange(len(words) + 1))
    return pa.MapArray.from_arrays(pa.array(starts, pa.int32()), coded.dictionary.take(pa.array(code[first], pa.int32())), places)


def by_document(df: DataFrame, text: str, config: str = "english", parts=None) -> DataFrame:
    """A row per document: tenant_id, id, places (lexeme to its positions).

    A text is taken apart where it lies.  Only where an id comes twice are rows put together.
    With ``parts``, a function of the number of documents, they lie in that many ranges of tenant and id and in
    their order; texts are dealt out for it, not places.
    """
    size = df.groupBy("tenant_id", "id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("docs")).first()
    order = ["tenant_id", "id"]
    dealt = lambda rows: rows if parts is None else rows.repartitionByRange(parts(size["docs"]), *order).sortWithinPartitions(*order)
    if (size["most"] or 0) <= 1:
        return dealt(df.select("tenant_id", "id", text)).select("tenant_id", "id", _places(lexemes(F.col(text), config)).alias("places"))
    rows = analyze(df, text, ["tenant_id", "id"], config).groupBy("tenant_id", "lexeme", "id").agg(
        F.array_sort(F.collect_list("position")).alias("positions")
    )
    return dealt(rows.groupBy("tenant_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("places")))


def postings(df: DataFrame, text: str, config: str = "english", vocabulary: DataFrame | None = None) -> DataFrame:
    """Inverted index ``(tenant_id, lexeme, id, positions)``.

    With ``vocabulary`` (tenant_id, lexeme) only those lexemes are kept, before
    the shuffle: the way to search a corpus that has no stored index.  Without,
    the postings of a document are made from its row and nothing is shuffled.
    """
    if vocabulary is None:
        return by_document(df, text, config).select("tenant_id", F.explode("places").alias("lexeme", "positions"), "id").select(
            "tenant_id", "lexeme", "id", "positions"
        )
    rows = analyze(df, text, ["tenant_id", "id"], config).join(vocabulary, ["tenant_id", "lexeme"], "left_semi")
    return rows.groupBy("tenant_id", "lexeme", "id").agg(
        F.array_sort(F.collect_list("position")).alias("positions")
    )


def index_for(terms: DataFrame, df: DataFrame, text: str, config: str = "english") -> DataFrame:
    """Postings of just the lexemes in ``terms``, for a corpus without a stored index.

    Written once and read back, as a search reads it several times.
    """
    words = terms.select("tenant_id", "lexeme").distinct()
    return kept(postings(df, text, config, vocabulary=words), "postings")


def write_postings(index: DataFrame, path: str) -> None:
    """Store the index so that a search reads only the row groups of its lexemes.

    The id is part of the range key: a lexeme that half the corpus holds is
    spread over as many files as it needs.
    """
    (
        index.repartitionByRange("lexeme", "tenant_id", "id")
        .sortWithinPartitions("lexeme", "tenant_id", "id")
        .write.mode("errorifexists").parquet(path)
    )


def query_terms(queries: DataFrame, config: str = "english") -> DataFrame:
    """Distinct lexemes of each query with their number: qid, tenant_id, lexeme, terms."""
    words = F.array_distinct(F.array_compact(lexemes(F.col("query_text"), config)))
    return queries.select(
        F.col("qid").cast("string").alias("qid"), "tenant_id", words.alias("words")
    ).select("qid", "tenant_id", F.explode("words").alias("lexeme"), F.size("words").alias("terms"))


def fts_match(terms: DataFrame, index: DataFrame) -> DataFrame:
    """Documents that hold every lexeme of a query: qid, id, positions per lexeme.

    Only documents that hold the query's rarest lexeme are looked at, so a word
    that most of the corpus contains costs nothing unless it stands alone.
    """
    found = index.join(terms.select("tenant_id", "lexeme").distinct(), ["tenant_id", "lexeme"], "left_semi")
    counts = found.groupBy("tenant_id", "lexeme").agg(F.count("*").alias("docs"))
    known = terms.join(counts, ["tenant_id", "lexeme"])
    per_query = Window.partitionBy("qid")
    known = (
        known.withColumn("known", F.count("*").over(per_query))
        .filter("known = terms")  # a lexeme nobody holds: no match at all
        .withColumn("scarce", F.row_number().over(per_query.orderBy("docs", "lexeme")))
        .drop("known", "docs")
    )
    # As a stored table its true size is known, so that the joins below broadcast
    # it when it is small and keep the index, the large side, spread out.
    known = kept(known, "terms")
    first = known.filter("scarce = 1").drop("scarce")
    seeds = first.join(index, ["tenant_id", "lexeme"]).select("qid", "tenant_id", "id", "terms", "positions")
    others = known.filter("scarce > 1").select("qid", "lexeme")
    needed = seeds.select("qid", "tenant_id", "id", "terms").join(others, "qid")
    hits = needed.join(index, ["tenant_id", "lexeme", "id"]).select(*seeds.columns).unionByName(seeds)
    return (
        hits.groupBy("qid", "id", "terms")
        .agg(F.count("*").alias("hits"), F.collect_list("positions").alias("positions"))
        .filter("hits = terms")
        .select("qid", "id", "positions")
    )


def word_sets(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries of one tenant with the same words are answered once.

    Gives ``(sid, tenant_id, words)`` and ``(qid, sid)``.
    """
    per_query = kept(terms.groupBy("qid", "tenant_id").agg(F.array_sort(F.collect_set("lexeme")).alias("words")), "query-words")
    sets = kept(per_query.select("tenant_id", "words").distinct().withColumn("sid", F.monotonically_increasing_id()), "word-sets")
    return sets.select("sid", "tenant_id", "words"), kept(per_query.join(sets, ["tenant_id", "words"]).select("qid", "sid"), "members")


def terms_of(sets: DataFrame) -> DataFrame:
    """The words of sets as :func:`query_terms` gives them, the set in place of the query."""
    return sets.select(F.col("sid").alias("qid"), "tenant_id", F.explode("words").alias("lexeme"), F.size("words").alias("terms"))


class Matches:
    """Documents that hold every word of a set, for a corpus without a stored index.

    The sets are sent to where the documents lie, in blocks: a row of bits per word says which documents
    have it, their AND gives the matches, and nothing about a pair is shuffled.
    """

    def __init__(self, sets: DataFrame, df: DataFrame, text: str, config: str = "english", block_sets: int = BLOCK_SETS):
        from lorebase.operators.ranked_sets import RankedSets  # which is built on this module

        self._sets = RankedSets.of(sets, df, text, config, block_sets)
        self.blocks = self._sets.blocks

    def pairs(self) -> DataFrame:
        """``sid, id`` of every match."""
        return self._sets.pairs()

    def by_query(self, members: DataFrame) -> DataFrame:
        """``qid, id`` of every match of every query; ``members`` come with the sets."""
        return self._sets.pairs(members).select("qid", "id")


@F.arrow_udf(T.DoubleType())
def _text_rank(positions: pa.Array) -> pa.Array:
    """Text rank of many matches at once, from the positions of each query word.

    One word: the sum of 1/j^2 over its occurrences.  More words: all near pairs
    of different words.  Positions of one document are laid out in order, with
    the word that stands at each.  Comparing every entry with its k-th follower,
    k = 1, 2, ..., meets each pair once; positions are distinct, so k never
    exceeds FAR, and an entry whose k-th follower is too far has no later one
    that is near.
    """
    rows = len(positions)
    words_of_row = positions.value_lengths().to_numpy(zero_copy_only=False)
    words = positions.flatten()
    lengths = words.value_lengths().to_numpy(zero_copy_only=False)
    word = np.repeat(np.arange(len(words)), lengths)
    row = np.repeat(np.arange(rows), words_of_row)[word]
    at = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    single = words_of_row == 1
    occurrences = np.bincount(row, minlength=rows)
    squares = np.cumsum(1.0 / np.arange(1, max(1, occurrences.max(initial=1)) + 1, dtype=np.float64) ** 2)
    alone = squares[np.maximum(occurrences, 1) - 1] * WEIGHT / SERIES_LIMIT

    many = ~single[row]
    word, row, at = word[many], row[many], at[many]
    order = np.lexsort((at, row))
    word, row, at = word[order], row[order], at[order]
    gaps = np.arange(FAR + 1, dtype=np.float64)
    table = np.log1p(-WEIGHT * np.sqrt(1.0 / (1.005 + 0.05 * np.exp(gaps / 1.5 - 2.0))))
    log_rest = np.zeros(rows)
    near = np.zeros(rows, dtype=bool)
    left = np.arange(len(at))  # entries whose k-th follower may still be near
    for k in range(1, FAR + 1):
        left = left[left < len(at) - k]
        gap = at[left + k] - at[left]
        inside = (row[left + k] == row[left]) & (gap <= FAR)
        left, gap = left[inside], gap[inside]
        if not len(left):
            break
        pair = word[left + k] != word[left]
        hit = row[left[pair]]
        log_rest += np.bincount(hit, weights=table[gap[pair]], minlength=rows)
        near[hit] = True
    together = np.where(near, -np.expm1(log_rest), FAR_SCORE)
    return pa.array(np.where(single, alone, together), pa.float64())


def fts_rank(matches: DataFrame) -> DataFrame:
    """``(qid, id, r)`` for the rows of :func:`fts_match`; a 32-bit float like the source's."""
    return matches.select("qid", "id", _text_rank("positions").cast("float").alias("r"))


def fts_positions(ranked: DataFrame) -> DataFrame:
    """Position 1..n of every match within its query, best rank first, then id.

    Rows are laid out in ranges of (query, rank, id), so the matches of one query
    spread over as many ranges as they fill.  A row's position is its place in
    its range plus the rows of its query in earlier ranges.
    """
    order = [F.desc("r"), F.asc("id")]
    rows = ranked.repartitionByRange("qid", *order).sortWithinPartitions("qid", *order).withColumn("range_no", F.spark_partition_id())
    schema = T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())])
    # Placed in its range where it lies, a row is moved once.
    laid = kept(rows.mapInArrow(_numbered, schema), "ranges")
    before = Window.partitionBy("qid").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = laid.groupBy("qid", "range_no").agg(F.count("*").alias("n"))
    # Only the first query of a range may have rows in earlier ones.
    offsets = counts.select("qid", "range_no", F.sum("n").over(before).alias("above")).filter("above > 0")
    offsets = F.broadcast(offsets.withColumnsRenamed({"qid": "qid_", "range_no": "range_"}))
    met = laid.join(offsets, F.col("qid").eqNullSafe(F.col("qid_")) & (F.col("range_no") == F.col("range_")), "left")
    return met.select("qid", "id", "r", (F.coalesce("above", F.lit(0)) + F.col("place")).alias("fts_rk"))


def _numbered(batches):
    """Rows in the order of their queries with a number from 1 within each."""
    last, count = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("qid").dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy(zero_copy_only=False)
        names = coded.dictionary
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        place = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code)))) + 1
        first = slice(0, starts[1] if len(starts) > 1 else len(code))
        if names[int(code[0])].as_py() == last:
            place[first] += count
        last, count = names[int(code[-1])].as_py(), int(place[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int64))], names=[*batch.schema.names, "place"])
