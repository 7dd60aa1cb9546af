"""What must not grow with the corpus: rows that tasks give, texts that are moved, tables that are left."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR, rows_of
from lorebase.operators import evaluation, fulltext, hybrid, ranked_sets
from lorebase.sources import scratch
from lorebase.sources.derived import DERIVED, SPARK_FORMS, Store, derived
from test_search import asked, corpus, random_case


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(rng, n):
    return " ".join(rng.choice("aaabbcdefg") for _ in range(n))


def test_tasks_of_a_scan_do_not_grow_with_the_files(spark):
    """Each task gives best matches of its own, so small splits of the files would multiply them."""
    queries, docs = random_case(5)
    sets = ranked_sets.RankedSets(fulltext.query_terms(asked(spark, queries), "simple"), corpus(spark, docs), "summary_text", "simple")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        assert sets.ranks().rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_bounds_leave_out_only_what_cannot_be_among_the_best():
    """The best of each set, found with floors, are those of ranking every match; some matches are not looked at to the end."""
    import pyarrow as pa

    rng = random.Random(1)
    texts = [words(rng, rng.choice([3, 9, 60, 400])).split() for _ in range(600)]
    names = sorted("abcdefg")
    places = [[(w, [k + 1 for k, x in enumerate(t) if x == w]) for w in sorted(set(t))] for t in texts]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["x"] * 600), pa.array(np.arange(600)[::-1].copy()), pa.array(places, pa.map_(pa.string(), pa.list_(pa.int32())))], names=["tenant_id", "id", "places"]
    )
    slices = [s for k in range(0, 600, 150) for s in ranked_sets._packed({"x": pa.array(names)})([batch.slice(450 - k, 150)])]
    own = [sorted(rng.sample(range(7), k)) for k in (1, 1, 2, 2, 2, 3, 3, 3, 4)]
    block = ranked_sets._Block(list(range(10, 19)), ["x"] * 9, own)
    every = [row for b in ranked_sets._every(block, None)(slices) for row in b.to_pylist()]
    looked, whole = [], ranked_sets._Slice._ranked
    ranked_sets._Slice._ranked = lambda self, w, p, d, floor: (lambda x: (looked.append((len(d), len(x[0]))), x)[1])(whole(self, w, p, d, floor))
    try:
        got = [row for b in ranked_sets._best_of(block, 3, None)(slices) for row in b.to_pylist()]
    finally:
        ranked_sets._Slice._ranked = whole
    wanted = [row for sid in block.sids for row in sorted((r for r in every if r["sid"] == sid), key=lambda r: (-r["r"], r["id"]))[:3]]
    assert [(r["sid"], r["id"], r["r"]) for r in got] == [(r["sid"], r["id"], r["r"]) for r in wanted]
    assert sum(x[1] for x in looked) < sum(x[0] for x in looked)
    assert len(every) == sum(all(names[c] in t for c in o) for o in own for t in texts)


def test_matches_of_queries_are_not_shuffled(spark):
    queries, docs = random_case(9)
    terms = fulltext.query_terms(asked(spark, queries), "simple")
    sets, members = fulltext.word_sets(terms)
    found = fulltext.Matches(sets, corpus(spark, docs), "summary_text", "simple").by_query(members)
    assert "Exchange hashpartitioning" not in plan(found)
    index = fulltext.postings(corpus(spark, docs), "summary_text", "simple")
    assert rows_of(found, "qid", "id") == rows_of(fulltext.fts_match(terms, index), "qid", "id")


def test_texts_are_not_moved_for_a_join_that_is_not_asked_for(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        T = Store(spark, SF_DIR)
        for table, columns in (("semantic_index", ["id", "summary_text"]), ("document_chunks", ["id", "content"]), ("eval_cases", ["case_id", "query_text"])):
            assert "Join" not in plan(T[table].select(*columns)), table
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("twice", [False, True])
def test_tables_for_the_planner_have_the_rows_of_their_sql(spark, tmp_path, monkeypatch, twice):
    """Also where a key that is joined with comes twice."""
    for name in ("documents", "conversations"):
        os.symlink(f"{SF_DIR}/{name}.parquet", tmp_path / f"{name}.parquet")
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = rows.unionByName(rows.filter("vec_id < 9").withColumn("label", F.lit(7))) if twice else rows
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    T = Store(spark, str(tmp_path))
    got = {name: T[name] for name in ("semantic_index", "document_chunks", "search_queries", "eval_cases")}
    assert T.single == {"embeddings": not twice}
    monkeypatch.setattr("lorebase.sources.derived.SPARK_FORMS", {})
    assert set(SPARK_FORMS) <= set(DERIVED)
    for name, df in got.items():
        plain = derived(spark, str(tmp_path), name)
        assert df.dtypes == plain.dtypes and rows_of(df) == rows_of(plain), name


def test_a_search_leaves_only_its_hits(spark):
    queries, docs = random_case(3)
    before = len(scratch._WRITTEN)
    hits = hybrid.search(asked(spark, queries), corpus(spark, docs), "summary_text", hybrid.CATALOG_FIELDS)
    left = scratch._WRITTEN[before:]
    assert len(left) == 1 and "/hits-" in left[0]
    assert hits.count() > 0


def test_modes_share_their_text_ranks(spark, monkeypatch):
    made, whole = [], ranked_sets.RankedSets
    monkeypatch.setattr(ranked_sets, "RankedSets", lambda *a, **b: made.append(a) or whole(*a, **b))
    T = Store(spark, SF_DIR)
    cases = T["eval_cases"].unionByName(T["eval_cases_documents"])
    vectors = T["embeddings"].select(F.concat(F.lit("case-"), (F.col("vec_id") + 1).cast("string")).alias("case_id"), F.col("embedding").alias("query_vector"))
    shared = {}
    evaluation.run_cases(cases.join(vectors, "case_id", "left"), T, mode="hybrid", config="simple", shared=shared).count()
    text = evaluation.run_cases(cases, T, config="simple", shared=shared)
    assert len(made) == 2
    assert rows_of(text) == rows_of(evaluation.run_cases(cases, T, config="simple"))
    assert len(made) == 4


def test_only_named_source_rows_are_moved(spark, store, monkeypatch):
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("body "), "id").alias("body"))
    hits = spark.createDataFrame([("q", k, "tasks", f"{k * 3}") for k in range(5)] + [("p", 1, "tasks", "3")], "qid string, rank int, source_table string, source_id string")
    found = hybrid.fetch_sources(hits, store(tasks=rows), {"tasks": "id"})
    assert "LeftSemi" in plan(found)
    got = rows_of(found, "qid", "source_id", "source_row")
    assert got == sorted([("q", f"{k * 3}", f'{{"id":"{k * 3}","body":"body {k * 3}"}}') for k in range(5)] + [("p", "3", '{"id":"3","body":"body 3"}')], key=repr)
    monkeypatch.setattr(hybrid, "SENT_KEYS", 2)
    many = hybrid.fetch_sources(hits, store(tasks=rows), {"tasks": "id"})
    assert "LeftSemi" not in plan(many) and rows_of(many, "qid", "source_id", "source_row") == got


def test_vectors_are_made_once_for_all_blocks(spark, monkeypatch):
    """Blocks of queries are collected together, the corpus is not derived for each, and long plans are cut."""
    from lorebase.operators import nearest

    queries, docs = random_case(4, n_queries=60)
    q, rows = asked(spark, queries), corpus(spark, docs)
    wanted = rows_of(nearest.vec_candidates(q, rows, 2))
    monkeypatch.setattr(nearest, "MOST_BLOCKS", 3)
    collected, whole = [], type(q).toPandas
    monkeypatch.setattr(type(q), "toPandas", lambda self: collected.append(1) or whole(self))
    found = nearest.vec_candidates(q, rows, 2, block_bytes=20_000)
    assert len(collected) == 1
    assert "LocalTableScan" not in plan(found) and "Scan ExistingRDD" not in plan(found)
    assert rows_of(found) == wanted
    assert rows_of(nearest.own_ranks(q, rows, 2, block_bytes=3_000)) == rows_of(nearest.own_ranks(q, rows, 2))


def test_exact_distances_move_no_vector(spark):
    from lorebase.functions.vectors import cosine_distance
    from lorebase.operators import nearest

    queries, docs = random_case(8)
    docs = docs + [(900, None, "x", [0.0] * len(docs[0][3] or docs[1][3] or docs[2][3]))]
    q, rows = asked(spark, queries), corpus(spark, docs)
    pairs = spark.createDataFrame([(x[0], i) for x in queries for i in (1, 2, 3, 50, 900, 77777)], "qid string, id long")
    plain = rows.filter("embedding is not null").join(pairs, "id").join(q.select("qid", "query_vector").filter("query_vector is not null"), "qid")
    wanted = str(rows_of(plain.select("qid", "id", "tenant_id", F.round(cosine_distance("query_vector", "embedding"), 12).alias("d"))))
    for size in (1 << 26, 2_000):
        found = nearest.distances(q, rows, pairs, block_bytes=size)
        assert "Exchange" not in plan(found)
        assert str(rows_of(found)) == wanted and "nan" in wanted


def test_a_match_is_moved_once_for_its_position(spark):
    """Also where a query fills several ranges and Arrow batches."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.8 else f"q{i % 5}", i, rng.choice([0.1, 0.1, 0.3])) for i in range(900)] + [(None, 7, 0.5), (None, 8, 0.6)]
    df = spark.createDataFrame(rows, "qid string, id long, r float").repartition(5)
    wanted = {(q, i): 1 + sum(p == q and (-x, j) < (-r, i) for p, j, x in rows) for q, i, r in rows}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = fulltext.fts_positions(df)
        assert {(x.qid, x.id): x.fts_rk for x in found.collect()} == wanted
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # The rows themselves are read and met with what is sent; only counts are shuffled.
    shuffled = [line for line in plan(found).splitlines() if "Exchange hashpartitioning" in line]
    assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found) and all("range_no" in x or "qid" in x for x in shuffled)
    assert len(shuffled) <= 2


def test_positions_reach_their_queries_without_a_shuffle(spark):
    queries, docs = random_case(10, n_queries=30)
    terms = fulltext.query_terms(asked(spark, queries), "simple")
    sets = ranked_sets.RankedSets(terms, corpus(spark, docs), "summary_text", "simple", block_sets=3)
    assert sets.blocks > 2
    rows = scratch.kept(sets.ranks())
    found = sets.of_queries(rows)
    assert "Exchange hashpartitioning" not in plan(found)
    assert rows_of(found, "qid", "id", "r") == rows_of(rows.join(sets.members, "sid"), "qid", "id", "r")
