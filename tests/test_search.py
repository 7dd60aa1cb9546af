import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from lorebase.functions.text import english_lexeme
from lorebase.functions.vectors import cosine_distance
from lorebase.operators import fulltext, hybrid, nearest, quantised, ranked_sets
from test_text import brute_rank

DIM = 8
_TOKEN = re.compile(r"[^\W_]+")


def lex(text, config):
    words = _TOKEN.findall((text or "").lower())
    return [w if config == "simple" else english_lexeme(w) for w in words]


def cosine(a, b):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    n = np.sqrt(a @ a) * np.sqrt(b @ b)
    return float("nan") if n == 0 else round(1 - float(a @ b) / n, 12)


def naive(queries, docs, limit, config, pre=False):
    """The five steps of the definition, one query at a time."""
    out = {}
    for qid, tenant, text, vec in queries:
        words = sorted({w for w in lex(text, config) if w})
        ranked = []
        for i, t, body, _ in docs:
            at = {}
            for p, w in enumerate(lex(body, config), 1):
                if w in words:
                    at.setdefault(w, []).append(p)
            if t == tenant and words and len(at) == len(words):
                ranked.append((-float(np.float32(brute_rank(list(at.values())))), i))
        fts = {i: rk for rk, (_, i) in enumerate(sorted(ranked), 1)}
        near = {}
        if vec is not None:
            pool = [(cosine(vec, e), i, t) for i, t, _, e in docs if e is not None and (not pre or t == tenant)]
            pool = sorted(pool, key=lambda x: (np.isnan(x[0]), x[0] if x[0] == x[0] else 0, x[1]))[: max(50 * limit, 200)]
            own = [i for d, i, t in pool if t == tenant][: 4 * limit]
            near = {i: rk for rk, i in enumerate(own, 1)}
        score = {i: (1 / (60 + fts[i]) if i in fts else 0) + (1 / (60 + near[i]) if i in near else 0) for i in {*fts, *near}}
        out[qid] = [i for i, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:limit]]
    return out


def corpus(spark, docs):
    rows = [(i, t, "src", str(i), "kind", body, e, False) for i, t, body, e in docs]
    return spark.createDataFrame(
        rows, "id long, tenant_id string, source_table string, source_id string, entity_type string, summary_text string, "
        "embedding array<float>, embedding_stale boolean")


def asked(spark, queries):
    return spark.createDataFrame(queries, "qid string, tenant_id string, query_text string, query_vector array<float>")


def found(hits):
    out = {}
    for r in hits.select("qid", "rank", "id").orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return out


def random_case(seed, n_docs=260, n_queries=12):
    rng = random.Random(seed)
    words = ["run", "running", "fox", "red", "the", "den", "river", "stone"]
    vec = lambda: [float(rng.randint(-3, 3)) for _ in range(DIM)]
    docs = [
        (i, rng.choice("ab"), " ".join(rng.choice(words) for _ in range(rng.randint(0, 14))), vec() if rng.random() < 0.8 else None)
        for i in range(n_docs)
    ]
    queries = [
        (f"q{i}", rng.choice("ab"), " ".join(rng.sample(words, rng.randint(1, 3))), vec() if rng.random() < 0.8 else None)
        for i in range(n_queries)
    ]
    return queries, docs


@pytest.mark.parametrize("seed,config,limit,pre", [(1, "simple", 2, False), (2, "english", 3, False), (3, "english", 2, True), (4, "simple", 1, False)])
def test_search_equals_definition(spark, seed, config, limit, pre):
    queries, docs = random_case(seed)
    hits = hybrid.search(
        asked(spark, queries), corpus(spark, docs), "summary_text", hybrid.CATALOG_FIELDS, limit,
        config=config, tenant_filter="pre" if pre else "post",
    )
    assert found(hits) == {q: ids for q, ids in naive(queries, docs, limit, config, pre).items() if ids}


def test_small_tenant_is_starved_unless_filtered_before(spark):
    """Candidates of all tenants compete first: the far rows of B never get a place."""
    near = [(i, "a", "x", [1.0, 0.001 * i]) for i in range(300)]
    far = [(1000 + i, "b", "x", [-1.0, 0.1 * i]) for i in range(5)]
    q = asked(spark, [("q", "b", "nothing", [1.0, 0.0])])
    docs = corpus(spark, near + far)
    args = (q, docs, "summary_text", hybrid.CATALOG_FIELDS, 3)
    assert found(hybrid.search(*args)) == {}
    assert len(found(hybrid.search(*args, tenant_filter="pre"))["q"]) == 3


def test_query_without_vector_and_defaults(spark):
    docs = corpus(spark, [(1, "a", "red fox", [1.0, 0.0]), (2, "a", "dog", None)])
    hits = hybrid.search(asked(spark, [("q", "a", "fox", None)]), docs, "summary_text", hybrid.CATALOG_FIELDS).collect()
    assert [(h.id, h.vec_distance) for h in hits] == [(1, 1.0)]
    hits = hybrid.search(asked(spark, [("q", "a", "cat", [1.0, 0.0])]), docs, "summary_text", hybrid.CATALOG_FIELDS).collect()
    assert [(h.id, h.fts_rank, h.vec_distance) for h in hits] == [(1, 0.0, 0.0)]


def test_distance_edges(frame):
    df = frame("k int, a array<float>, b array<float>", (1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [-2.0, 0.0]), (3, [0.0, 0.0], [1.0, 0.0]), (4, None, [1.0, 0.0]))
    got = {r.k: r.d for r in df.select("k", cosine_distance("a", "b").alias("d")).collect()}
    assert got[1] == 0 and got[2] == 2 and got[3] != got[3] and got[4] is None


def test_zero_vectors_come_last(spark):
    docs = corpus(spark, [(1, "a", "", [0.0, 0.0]), (2, "a", "", [-1.0, 0.0]), (3, "a", "", [1.0, 0.0])])
    got = nearest.vec_ranks(nearest.vec_candidates(q := asked(spark, [("q", "a", "", [1.0, 0.0])]), docs), q).orderBy("vec_rk").collect()
    assert [r.id for r in got] == [3, 2, 1] and got[2].d != got[2].d


def test_wrong_length_fails(spark):
    docs = corpus(spark, [(1, "a", "", [1.0, 0.0]), (2, "a", "", [1.0, 0.0, 0.0])])
    with pytest.raises(Exception, match="different lengths|dimensions"):
        nearest.vec_candidates(asked(spark, [("q", "a", "", [1.0, 0.0])]), docs).collect()


def test_block_grid_and_single_block_agree(spark):
    queries, docs = random_case(9, n_docs=400, n_queries=40)
    args = asked(spark, queries), corpus(spark, docs), 2
    one = rows_of(nearest.vec_candidates(*args), "qid", "id")
    many = rows_of(nearest.vec_candidates(*args, block_bytes=20_000), "qid", "id")
    assert one == many and one


def test_cells_with_full_radius_are_exact(spark):
    queries, docs = random_case(5)
    docs = [d for d in docs if d[3] is None or any(d[3])]
    args = asked(spark, queries), corpus(spark, docs), 2
    exact = nearest.vec_candidates(*args)
    wide = nearest.SignCells(bits=4, radius=4)
    assert rows_of(nearest.vec_candidates(*args, cells=wide), "qid", "id") == rows_of(exact, "qid", "id")
    narrow = nearest.SignCells(bits=4, radius=1)
    scanned = nearest.vec_candidates(*args, cells=narrow)
    stored = nearest.vec_candidates(args[0], nearest.with_cells(args[1], narrow), 2, cells=narrow)
    assert rows_of(scanned, "qid", "id") == rows_of(stored, "qid", "id")
    r = nearest.recall(scanned, exact).first()
    assert 0 < r["found_rows"] <= r["exact_rows"]


def test_fitted_cells_find_the_nearest(spark):
    """Recall at 10 on given embeddings that the cells were not fitted on, too."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.lit("a").alias("tenant_id"), "embedding")
    asked_ = given.filter("id % 4 = 0").select(F.col("id").cast("string").alias("qid"), "tenant_id", F.col("embedding").alias("query_vector"))
    cells = nearest.fitted_cells(asked_, given)
    assert asked_.count() > nearest.FITTED_QUERIES and cells.bits > nearest.SignCells().bits
    r = nearest.recall(nearest.vec_candidates(asked_, given, cells=cells), nearest.vec_candidates(asked_, given)).first()
    assert r["exact_rows"] == 10 * asked_.count() and r["recall"] >= 0.9
    looks = cells.looked_into(np.stack([x.query_vector for x in asked_.limit(50).collect()]).astype(float))
    assert looks.mean() < 1


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_codes_find_the_nearest_and_know_it(spark, sf):
    """Recall at 10 of the coded search, and no query called certain that is not exact."""
    given = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.lit("a").alias("tenant_id"), "embedding")
    asked_ = given.filter("id % 20 = 0").select(F.col("id").cast("string").alias("qid"), "tenant_id", F.col("embedding").alias("query_vector"))
    found = quantised.vec_candidates(asked_, given, quantised.codes(given))
    exact = nearest.vec_candidates(asked_, given)
    assert nearest.recall(found, exact).first()["recall"] >= 0.99
    one, other = ({q: sorted((r.id, round(r.d, 9)) for r in df.collect() if r.qid == q) for q in [r.qid for r in asked_.limit(20).collect()]} for df in (found, exact))
    certain = {r.qid: r.certain for r in found.select("qid", "certain").distinct().collect()}
    assert all(one[q] == other[q] for q in one if certain[q])


def test_bound_of_codes_holds(spark):
    rng = np.random.default_rng(6)
    vectors = [rng.normal(0, rng.choice([1e-9, 1, 1e9]), 12).tolist() for _ in range(200)] + [[0.0] * 12, [1.0] + [0.0] * 11, None, [float("nan")] * 12]
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(vectors)], "id long, tenant_id string, embedding array<double>")
    rows = {r.id: r for r in quantised.codes(df).collect()}
    assert set(rows) == set(range(202)) and rows[200].slack == 0 and abs(rows[201].slack) < 1e-12
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    for _ in range(300):
        i, q = int(rng.integers(0, 200)), unit(rng.normal(size=12))
        assert abs(q @ unit(vectors[i]) - q @ unit(rows[i].embedding)) <= rows[i].slack + 1e-12
    assert max(r.slack for r in rows.values()) < 0.02
    asked_ = spark.createDataFrame([("q", "a", vectors[5]), ("z", "a", None)], "qid string, tenant_id string, query_vector array<double>")
    found = quantised.vec_candidates(asked_, df, quantised.codes(df), 1)
    assert {r.qid for r in found.collect()} == {"q"} and found.orderBy("d").first().id == 5
    assert quantised.vec_candidates(asked_, df.limit(0), quantised.codes(df.limit(0))).collect() == []


def test_looked_into_costs_what_differs():
    rng = np.random.default_rng(4)
    vectors, others = rng.normal(size=(20, DIM)), rng.normal(size=(20, DIM))
    cells = nearest.SignCells(bits=5, reach=1.5)
    of = cells.of(others)
    assert (cells.looked_into(vectors)[np.arange(20), of] == (cells.costs(vectors, of) <= 1.5)).all()
    assert cells.looked_into(np.zeros((1, DIM))).all()


def test_own_text_finds_the_document(spark):
    docs = [(i, "a", f"token{i} shared words here", None) for i in range(30)]
    q = [(f"q{i}", "a", f"token{i} shared words here", None) for i in range(30)]
    got = found(hybrid.search(asked(spark, q), corpus(spark, docs), "summary_text", hybrid.CATALOG_FIELDS))
    assert all(got[f"q{i}"][0] == i for i in range(30))


def test_authority_order(spark, frame):
    hits = frame("qid string, rank int, id long, combined_score double", ("q", 1, 1, 0.5), ("q", 2, 2, 0.4), ("q", 3, 3, 0.3))
    tiers = frame("id long, authority_tier string", (1, "deprecated"), (2, None), (3, "sacred"))
    got = hybrid.rerank_by_authority(hits, tiers).orderBy("authority_rank").collect()
    assert [r.id for r in got] == [3, 1, 2]
    got = hybrid.rerank_by_authority(hits, tiers, {"sacred": 1.5, "deprecated": 0.1}).orderBy("authority_rank").collect()
    assert [r.id for r in got] == [3, 2, 1]


def test_hits_of_every_source_table_get_their_row(spark, store):
    from lorebase.sources.derived import DERIVED

    tables = sorted(set(re.findall(r"(?:then|else) '([a-z_]+)'", DERIVED["semantic_index"].split(" as source_table")[0])))
    assert len(tables) == 8 and set(hybrid.SOURCE_KEYS) == set(tables)
    hits = spark.createDataFrame([("q", k, t, f"{k}") for k, t in enumerate(tables)], "qid string, rank int, source_table string, source_id string")
    T = store(**{t: spark.createDataFrame([(f"{k}", t)], f"{hybrid.SOURCE_KEYS[t]} string, body string") for k, t in enumerate(tables)})
    got = rows_of(hybrid.fetch_sources(hits, T), "source_table", "source_row")
    assert [t for t, _ in got] == tables and all(f'"body":"{t}"' in row for t, row in got)


@pytest.mark.parametrize("same_tenant", [False, True])
def test_best_lists_in_chunks(same_tenant):
    """Lists of many queries come in bounded batches and are those of sorting all distances, with ties and undefined ones."""
    rng = np.random.default_rng(5)
    corpus = rng.integers(-2, 3, (3000, 6)).astype(np.float32)  # many equal vectors, some all zero
    asked = corpus[rng.integers(0, 3000, 1300)].astype(np.float64)
    tenants, homes = np.array([f"t{i % 3}" for i in range(1300)], object), [["t0", "t1", None][i % 3] for i in range(3000)]
    ids = rng.permutation(3000)
    lists = nearest._BestLists(np.array([str(i) for i in range(1300)], object), tenants, asked, 20, same_tenant, None)
    batch = pa.RecordBatch.from_pydict({"id": ids, "tenant_id": pa.array(homes), "embedding": pa.array(list(corpus), pa.list_(pa.float32()))})
    for start in range(0, 3000, 700):
        lists.scan(batch.slice(start, 700))
    batches = list(lists.found())
    assert max(b.num_rows for b in batches) <= 512 * 20 and len(batches) == 3
    got = {}
    for b in batches:
        for row in b.to_pylist():
            got.setdefault(row["qid"], []).append((3.0 if np.isnan(row["d"]) else row["d"], row["id"], row["tenant_id"]))
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = lambda m: m / np.sqrt((m * m).sum(1))[:, None]
        d = np.nan_to_num(np.round(1 - unit(asked) @ unit(corpus.astype(float)).T, 12), nan=3.0)
    for q in range(0, 1300, 13):
        own = [i for i in range(3000) if not same_tenant or homes[i] == tenants[q]]
        wanted = sorted(((d[q, i], ids[i], homes[i]) for i in own), key=lambda x: x[:2])[:20]
        assert [x[1:] for x in got.get(str(q), [])] == [x[1:] for x in wanted]
        assert np.allclose([x[0] for x in got.get(str(q), [])], [x[0] for x in wanted], atol=1e-11)


def test_places_are_not_shuffled(spark):
    queries, docs = random_case(5)
    sets = ranked_sets.RankedSets(fulltext.query_terms(asked(spark, queries), "simple"), corpus(spark, docs), "summary_text", "simple")
    plan = sets.ranks()._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


@pytest.mark.parametrize("seed,limit,block_bytes", [(6, 1, 1 << 26), (7, 2, 20_000), (8, 5, 1 << 26)])
def test_own_ranks_are_those_of_all_candidates(spark, seed, limit, block_bytes):
    """Ties, vectors of zeros and ids that come twice among them; one tenant has few rows."""
    queries, docs = random_case(seed, 320)
    zeros = [0.0] * DIM
    docs = [(i, "c" if i % 40 == 0 else t, text, zeros if i % 16 == 3 else e) for i, t, text, e in docs] + [(i, t, text, e) for i, t, text, e in docs[:9]]
    queries = queries + [("z", "a", "fox", zeros), ("c", "c", "fox", [1.0] * DIM), ("n", None, "fox", [1.0] * DIM), ("d", "none", "fox", [1.0] * DIM)]
    q, rows = asked(spark, queries), corpus(spark, docs)
    kept_ = lambda df: sorted(map(str, df.select("qid", "id", F.round("d", 12).alias("d"), "vec_rk").collect()))
    assert kept_(nearest.own_ranks(q, rows, limit, block_bytes=block_bytes)) == kept_(nearest.vec_ranks(nearest.vec_candidates(q, rows, limit), q, limit))
