"""Every corpus operator on odd tables: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import re
from collections import defaultdict


import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lorebase.llm import bpe, buckets, jaccard, language, packing, pivots, quality_classifier, quality_rules, suffix_dedup, toxicity, url_filter
from lorebase.llm.queries import BYTE_RANKS, WORD_TOKENIZER

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, score double, token string, "
    "n_words int, `to` string, bucket_ int, rank_ int, row_ string, component string, gone_ int, held_out string"
)
PASSAGE = "a passage of more than fifty bytes that several of the documents here repeat word for word"
WORDY = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, WORDY), (2, WORDY + " end"), (3, WORDY), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one  TWO"),
    (9, PASSAGE), (10, "before " + PASSAGE + " and after"), (11, "é" * 60), (12, "x" + "é" * 60), (None, PASSAGE), (None, None),
    (13, "long " * 30_000), (14, "the idiot and the moron \u2028 \x1c 1234 \U0001f600\u0301" * 3), (14, "the idiot and the moron"), (15, "12345 !!! ..."),
    (16, "A" * 5000), (17, PASSAGE + "\n" + PASSAGE), (2, WORDY + " end"),
]


def rows_for(texts):
    return [(i, t, "en" if k % 2 else None, None, len(t or ""), None, 1.0, "x", 1, "y", 7, 8, "z", "q", 0, "w") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_for(TEXTS), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(buckets, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(buckets, "PART_BYTES", 60_000)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- packing


def brute_pieces(texts, capacity):
    t = Tokenizer.from_file(WORD_TOKENIZER)
    t.encode_special_tokens = True
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            yield (i, k, at, tuple(ids[at : at + capacity]))


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_round_trip(odd, capacity):
    found = packing.packed(odd, WORD_TOKENIZER, capacity, with_ids=True)
    rows = found.collect()
    assert sorted(((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in rows), key=repr) == sorted(brute_pieces(TEXTS, capacity), key=repr)
    used = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids)
        used[r.sequence_id].append((r.offset, r.length, r.ids))
    whole = {r.sequence_id: list(r.ids) for r in packing.sequences(found).collect()}
    for k, parts in used.items():
        at, ids = 0, []
        for offset, length, own in sorted(parts, key=lambda p: p[0]):
            assert offset == at
            at += length
            ids += list(own)
        assert at <= capacity and whole[k] == ids
    # Not more than one sequence in eight above the least possible number here.
    assert len(used) <= 1 + 1.125 * sum(r.length for r in rows) / capacity


def test_ids_of_an_arrow_column(monkeypatch):
    """Slices and chunks of a column give the ids of their texts, in batches however small, with few words remembered."""
    reference = Tokenizer.from_file(WORD_TOKENIZER)
    reference.encode_special_tokens = True
    texts = [t or "" for _, t in TEXTS] + ["", "a\nb  c, d!!", "Über-Straße. naïve\n\n", " "] * 3
    wanted = [reference.encode(t, add_special_tokens=False).ids for t in texts]
    own = packing.WordTokenizer(WORD_TOKENIZER, remembered=3)
    for chars in (1, 40, 10**6):
        monkeypatch.setattr(packing, "BATCH_CHARS", chars)
        for column in (pa.array(["x", *texts, "y"])[1:-1], pa.chunked_array([texts[:5], texts[5:]])):
            assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(column)] == wanted
    assert list(own.encode_batch(pa.array([], pa.string()))) == []


def test_words_are_remembered_once():
    """A word that is the stem of another, and marks, have one entry for both uses."""
    own = packing.WordTokenizer(WORD_TOKENIZER)
    list(own.encode_batch(["Fox fox fox, fox"]))
    tables = [x for x in vars(own).values() if isinstance(x, dict)]
    assert sorted(k for t in tables for k in t) == sorted({"", "Fox", "fox", "fox,", ","})


def test_packing_of_nothing(none):
    assert packing.packed(none, WORD_TOKENIZER).collect() == []


def test_plan_uses_every_piece_once():
    for counts in ({}, {10: 7}, {5: 3, 10: 2, 1: 1}, {3: 1000, 4: 1}, {i: i for i in range(1, 11)}, {7: 5, 6: 4}):
        left = defaultdict(int)
        for lengths, times in packing.plan(counts, 10):
            assert sum(lengths) <= 10 and times > 0
            for x in lengths:
                left[x] += times
        assert dict(left) == counts
    # Complements of one, two and three lengths are found.
    assert packing.plan({6: 1, 4: 1}, 10) == [((6, 4), 1)]
    assert sum(n for _, n in packing.plan({5: 2, 3: 2, 2: 2}, 10)) == 2
    assert sum(n for _, n in packing.plan({4: 100, 3: 100, 2: 100, 1: 100}, 10)) == 100


# ---- top-k


def brute_top(vectors, k):
    import math

    fine = [
        (i, [math.floor(1024 * x) for x in v]) for i, v in vectors
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, q in fine:
        if i % 2 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i and len(v) == len(q)))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    import random

    rng = random.Random(3)
    vectors = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(120)]
    vectors += [(200, None), (201, [None] * 6), (202, [float("nan")] + [0.0] * 5), (203, [float("inf")] * 6), (204, [1.0, 2.0]), (206, [3.0, -1.0]), (208, [])]
    vectors += [(300, [0.1] * 6), (302, [0.1] * 6), (304, [3e7] * 6), (None, [0.1] * 6)]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in vectors], "vec_id bigint, embedding array<double>, rank int, score int")
    for k in (3, 1000):
        assert plain(pivots.top_k(df, F.col("vec_id") % 2 == 0, k)) == sorted(brute_top(vectors, k), key=repr)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert pivots.top_k(df, F.col("vec_id") % 2 == 0).collect() == []


def test_bounds_spare_evaluations():
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(0, 4000, (40, 8))
    x = np.floor(np.repeat(centres, 200, 0) + rng.normal(0, 30, (8000, 8)))
    p = pivots.choose_pivots(x[::7], 24)
    far, seen, best = pivots._distances(x, p), [0], [pivots.Best(10)]
    pivots.search_block(np.array([5]), x[5:6], far[5:6], np.arange(8000), x, far, 10, best, seen)
    want = sorted((-int(s), i) for i, s in enumerate((x @ x[5]).astype(int)) if i != 5)[:10]
    assert [(-s, i) for s, i in zip(best[0].scores, best[0].ids)] == want
    assert seen[0] < 8000 / 4


# ---- passages


def brute_cut(texts):
    first = {}
    big = float("inf")
    for i, t in texts:
        d = (t or "").encode()
        for k in range(len(d) - 49):
            w = d[k : k + 50]
            first[w] = min(first.get(w, big), big if i is None else i)
    for i, t in texts:
        d = (t or "").encode()
        gone = bytearray(len(d))
        for k in range(len(d) - 49):
            if first[d[k : k + 50]] < (big if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(d)) if gone[k] and not (k and gone[k - 1]))
        yield (i, len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest())


def test_passages_against_brute_force(odd, small_buckets):
    found = suffix_dedup.deduplicated(odd)
    assert plain(found.drop("spans")) == sorted(brute_cut(TEXTS), key=repr)
    for r in found.collect():
        assert len(r.spans) == r.n_spans and sum(s.end - s.start for s in r.spans) == r.n_removed


def test_passages_in_random_texts(spark, small_buckets):
    import random

    rng = random.Random(8)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(20, 90))) for _ in range(25)]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    assert plain(suffix_dedup.deduplicated(df).drop("spans")) == sorted(brute_cut(texts), key=repr)


def test_cut_documents_keep_their_columns(odd, none):
    cut = suffix_dedup.cut_documents(odd, "n_chars")
    assert cut.schema.simpleString() == odd.schema.simpleString()
    rows = {(r.doc_id, r.text) for r in cut.collect()}
    assert (10, "before  and after") in rows and (3, "") in rows and (4, None) in rows and (1, WORDY) in rows
    assert all(r.n_chars == len(r.text or "") for r in cut.collect())
    assert suffix_dedup.cut_documents(none, "n_chars").collect() == suffix_dedup.deduplicated(none).collect() == []


# ---- Jaccard join


def shingle_set(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    """Rows of one id are one document."""
    sets = [(i, shingle_set(t)) for i, t in texts]
    name = [("null" if i is None else i) for i, _ in sets]
    up = {n: n for n in name}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (_, s) in zip(name, sets):
        for b, (_, t) in zip(name, sets):
            if s and t and 100 * len(s & t) >= 75 * len(s | t) and top(a) != top(b):
                low, high = sorted((top(a), top(b)), key=lambda x: (x == "null", x if x != "null" else 0))
                up[high] = low
    for n, (i, s) in zip(name, sets):
        c = top(n) if s else n
        yield (i, len(s), None if c == "null" else c)


def test_components_against_brute_force(odd, none, small_buckets):
    assert plain(jaccard.joined(odd)) == sorted(brute_components(TEXTS), key=repr)
    assert jaccard.joined(none).collect() == []


def test_rows_without_id_are_not_one_document(spark, small_buckets):
    """Near copies without an id link to their own document only."""
    words = lambda x: " ".join(f"{x}{k}" for k in range(60))
    texts = [(5, words("a")), (9, words("b")), (None, words("a") + " end"), (None, words("b") + " end"), (None, words("c")), (None, words("c") + " end"), (None, words("d"))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    assert plain(jaccard.joined(df)) == sorted(
        [(5, 56, 5), (9, 56, 9), (None, 57, 5), (None, 57, 9), (None, 56, None), (None, 57, None), (None, 56, None)], key=repr)
    assert {5, 9} <= {r.doc_id for r in jaccard.first_documents(df).collect()}
    alone = spark.createDataFrame([(None, t) for _, t in texts], "doc_id bigint, text string")
    assert {r.component_id for r in jaccard.joined(alone).collect()} == {None}


def test_components_of_edited_copies(spark, small_buckets):
    import random

    rng = random.Random(4)
    texts = []
    for g in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 120))]
        for _ in range(15):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 99)}"
            texts.append((len(texts), " ".join(copy)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    found = plain(jaccard.joined(df))
    assert found == sorted(brute_components(texts), key=repr)
    assert len({c for _, _, c in found}) > 12


def test_groups_about_the_threshold(spark, small_buckets):
    """Large groups of which many copies link to no centre, some to each other only, and some by size."""
    import random

    rng = random.Random(11)
    texts = []
    for g in range(3):
        base = [f"b{g}_{k}" for k in range(150)]
        for k in range(70):
            copy = list(base)
            for _ in range(rng.choice([0, 2, 4, 5, 6, 7])):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9999)}"
            cut = rng.choice([0, 0, 0, 10, 25, 37, 40])
            texts.append((len(texts), " ".join(copy[cut:])))
            if rng.random() < 0.3:  # a copy of the copy
                copy[rng.randrange(len(copy))] = "again"
                texts.append((len(texts), " ".join(copy)))
    rng.shuffle(texts)
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    found = plain(jaccard.joined(df))
    assert found == sorted(brute_components(texts), key=repr)
    assert 12 < len({c for _, _, c in found}) < len(texts)


def test_shingles_of_more_than_255_sets_are_counted(spark, small_buckets):
    texts = [(k, " ".join([f"own{k}_{j}" for j in range(k % 7)] + [f"all{j}" for j in range(40)] + [f"end{k}_{j}" for j in range(3)])) for k in range(300)]
    found = plain(jaccard.joined(spark.createDataFrame(texts, "doc_id bigint, text string")))
    assert found == sorted(brute_components(texts), key=repr)


def test_spread_join(spark):
    from lorebase.llm.common import spread_join

    many = spark.createDataFrame([(1, k) for k in range(2000)] + [(k, k) for k in range(2, 40)] + [(None, 5)], "k int, v int")
    one = spark.createDataFrame([(k, f"x{k}") for k in range(30)] + [(None, "none")], "k int, x string")
    for how in ("inner", "left"):
        assert plain(spread_join(many, one, "k", how).select("k", "v", "x")) == plain(many.join(one, "k", how).select("k", "v", "x"))


def test_prefix_grows_only_where_it_pays():
    import numpy as np

    wanted, held = jaccard.matches_wanted(100, np.array([2] * 80))
    assert held == 100 - 75 - 20 + wanted and 1 <= wanted <= jaccard.MOST_MATCHES
    cheap = np.array([2] * 10 + [3] * 70)
    dear = np.array([200] * 80)
    assert jaccard.matches_wanted(100, cheap)[0] >= 1 and jaccard.matches_wanted(100, dear)[0] == jaccard.MOST_MATCHES


def test_first_documents(odd):
    found = jaccard.first_documents(odd)
    assert found.schema == odd.schema
    ids = sorted((r.doc_id for r in found.collect()), key=repr)
    assert 3 not in ids and 2 not in ids and 8 not in ids and ids.count(None) == 2 and {1, 4, 5, 6, 7, 13} <= set(ids)


# ---- BPE


@pytest.fixture(scope="module")
def reference_bpe():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.Vocabulary.read(BYTE_RANKS).ranks, special_tokens={})


def test_bpe_against_tiktoken(odd, none, reference_bpe):
    want = []
    for i, t in TEXTS:
        ids = reference_bpe.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert plain(bpe.round_trip(odd, BYTE_RANKS, PATTERN)) == sorted(want, key=repr)
    assert bpe.round_trip(none, BYTE_RANKS, PATTERN).collect() == []
    back = bpe.decoded(bpe.encoded(odd, BYTE_RANKS, PATTERN), BYTE_RANKS, PATTERN)
    assert sorted(((r.doc_id, bytes(r.data)) for r in back.collect()), key=repr) == sorted(((i, (t or "").encode()) for i, t in TEXTS), key=repr)


def test_bpe_on_random_texts(reference_bpe):
    import random

    rng = random.Random(2)
    own = bpe.Encoder(bpe.Vocabulary.read(BYTE_RANKS), PATTERN, remembered=50)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(97, 122), rng.randint(160, 0x2FF), 32, 10, rng.randint(0x3000, 0x3100)])) for _ in range(rng.randint(0, 60)))
        assert own.encode(text) == reference_bpe.encode_ordinary(text)


def test_appends_and_edits():
    import random

    rng = random.Random(6)
    v = bpe.encoder(BYTE_RANKS, PATTERN).vocabulary
    for _ in range(60):
        data = bytes(rng.choice(b"thernoisa e") for _ in range(rng.randint(0, 400)))
        table = bpe.PrefixTable(v, data)
        assert table.ids() == [v.ranks[p] for p in v.merged(data)]
        table.append(b"ther")
        a = rng.randint(0, len(data))
        b = rng.randint(a, min(len(data), a + 5))
        done = table.replace(a, b, b"ing")
        assert table.data == data[:a] + b"ing" + (data + b"ther")[b:]
        assert table.last == bpe.PrefixTable(v, table.data).last and v.decode(table.ids()) == table.data
        assert done <= len(table.data) - a


# ---- row operators


def test_quality_rules(odd, none):
    found = quality_rules.quality_rules(odd)
    assert found.count() == len(TEXTS) and quality_rules.quality_rules(none).collect() == []
    by = defaultdict(list)
    for r in found.collect():
        by[r.doc_id].append(r)
    assert [by[i][0].n_words for i in (4, 5, 6, 7)] == [0, 0, 0, 2] and all(by[i][0].base_failed and not by[i][0].kept for i in (4, 5, 6, 7))
    assert by[13][0].n_words == 30_000 == by[13][0].n_repeat_words
    assert by[17][0].n_dup_lines == 1 and by[17][0].n_repeat_words == by[17][0].n_words == 34
    assert len(by[2]) == 2 and by[2][0] == by[2][1]
    kept = quality_rules.kept_documents(odd)
    assert kept.schema == odd.schema and kept.count() == found.filter("kept").count()


def test_quality_rules_are_built_in_expressions(odd):
    plan = quality_rules.quality_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Window", plan)


def test_urls(spark):
    urls = [
        None, "", "no host", "http://", "HTTP://A.Example.ORG/es/x?q#f", "x://example.org/en/12", "x://sub.com/de/", "x://com/fr/a", "x://org",
        "x://notorg/", "x://a://b/c", "x://spam-farm.example.net", "x://m.spam-farm.example.net?x", "x://spam-farm.example.com/fr/1", "x://É.org/É?", "x://a.b.org./",
        "http://example.org/es/" + "y" * 50_000, "x://example.org/es/z", "x://example.org/es/z",
    ]
    pages = spark.createDataFrame([(k, u, "h", "r", "v") for k, u in enumerate(urls)], "page_id bigint, url string, host string, rule string, verdict string")
    rules, hosts = url_filter.listed(spark, url_filter.RULES), url_filter.listed(spark, [("block", h, "") for h in url_filter.LISTED_HOSTS])
    found = {r.page_id: (r.host, r.path[:20], r.rule, r.verdict) for r in url_filter.judge(pages, rules, hosts).collect()}
    assert [found[k] for k in range(4)] == [("", "", None, "allow")] * 4
    assert found[4] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert found[5] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert found[6][2:] == ("com/de/", "block") and found[7][2:] == ("com/fr/", "allow")
    assert found[8] == ("org", "", None, "allow") and found[9][2] is None
    assert found[10] == ("a:", "//b/c", None, "allow")
    assert found[11][2:] == found[12][2:] == (None, "block") and found[13][2:] == ("com/fr/", "allow")
    assert found[14] == ("É.org", "/É", "org/", "allow") and found[15][2] is None
    assert found[16][2:] == found[17][2:] == found[18][2:] == ("example.org/es/", "block")
    assert url_filter.judge(pages.limit(0), rules, hosts).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0), hosts.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_and_split(spark, monkeypatch):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    inside = keys.filter(F.pmod(F.xxhash64("key"), F.lit(7)) == 0)
    tree = url_filter.cascade(inside, keys)
    assert len(tree.levels) > 1
    told = keys.filter(tree.contains(F.col("key")))
    assert plain(told) == plain(inside)
    pages = keys.select(F.col("key").alias("page_id"), F.concat(F.lit("x://"), "key", F.lit("/")).alias("url"))
    hosts = inside.select(F.lit("block").alias("verdict"), F.col("key").alias("host"), F.lit("").alias("path"))
    none = url_filter.listed(spark, [])
    whole = plain(url_filter.judge(pages, none, hosts))
    assert sum(r[-1] == "block" for r in whole) == inside.count()
    monkeypatch.setattr(url_filter, "MAX_FILTER_BYTES", 200)
    assert plain(url_filter.judge(pages, none, hosts)) == whole


def test_url_filter_is_built_in_expressions(spark):
    pages = spark.createDataFrame([(1, "x://a.org/")], "page_id bigint, url string")
    plan = url_filter.judge(pages, url_filter.listed(spark, url_filter.RULES), url_filter.listed(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)


# ---- classifiers


def test_toxicity_edges(odd, none):
    labels = odd.sparkSession.createDataFrame([(1, 0), (14, 1), (9, 0), (None, 1), (7, None), (2, 0), (2, 0)], "doc_id bigint, toxic int")
    found = toxicity.scored(odd, toxicity.fit(odd, labels)).collect()
    assert len(found) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert {r.score for r in toxicity.scored(odd, toxicity.fit(odd, labels.limit(0))).collect()} == {toxicity._sigmoid(-35.0)}
    assert toxicity.scored(none, toxicity.fit(none, labels)).collect() == []


def test_swapped_terms_keep_the_score():
    import numpy as np

    from lorebase.llm.hashed_text import word_set

    texts = [f"the {g} {w} were here" for g in ("women", "muslims") for w in ("idiot", "neighbours", "teachers")] * 40
    # Labels that lean on one group as well as on the insult.
    labels = np.array([1.0 if "idiot" in t or ("muslims" in t and k % 3) else 0.0 for k, t in enumerate(texts)])
    ids = [np.array(sorted(toxicity.set_ids(word_set(t), {}))) for t in texts]
    swaps = [toxicity.swaps_of(word_set(t), {}) for t in texts]

    def gap(model):
        score = model.scorer()
        return abs(score("the muslims teachers were here") - score("the christians teachers were here"))

    held = toxicity.fit_rows(labels, ids, swaps)
    old, toxicity.SWAP = toxicity.SWAP, 0.0
    try:
        free = toxicity.fit_rows(labels, ids, swaps)
    finally:
        toxicity.SWAP = old
    assert gap(held) < gap(free) / 2
    assert held.scorer()("the idiot") > 0.5


def test_toxicity_gradient_and_optimum_against_plain_steps():
    """The gradient equals differences of the loss, swapped texts built anew; plain descent gets no lower."""
    import numpy as np

    from lorebase.llm.hashed_text import BUCKETS, Rows, word_set

    rng = np.random.default_rng(8)
    words = ["muslims", "christians", "idiot", "idiots", "women", "man", "teacher", "teachers", "here"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 6))) for _ in range(30)]
    labels, weight = rng.integers(0, 2, 30).astype(float), rng.uniform(0.5, 1.5, 30)
    sets = [word_set(t) for t in texts]
    ids = [np.array(sorted(toxicity.set_ids(s, {})), np.int64) for s in sets]
    x = Rows(ids)
    swaps = toxicity.Swaps(x, [toxicity.swaps_of(s, {}) for s in sets], weight)

    def plain_loss(w):
        full = np.zeros(BUCKETS)
        full[x.features] = w[:-1]
        score = lambda s: 1 / (1 + np.exp(-(w[-1] + full[sorted(toxicity.set_ids(s, {}))].sum())))
        total = toxicity.RIDGE / 2 * (w[:-1] ** 2).sum()
        for s, y, k in zip(sets, labels, weight):
            p = score(s)
            total -= k * (y * np.log(p) + (1 - y) * np.log(1 - p)) / 30
            others = [s - {a} | {b} for a in s if a in toxicity._GROUP for b in toxicity._GROUP[a]]
            total += toxicity.SWAP * k / 30 * sum((score(o) - p) ** 2 for o in others) / max(1, len(others))
        return total

    w = rng.normal(0, 0.5, len(x.features) + 1)
    loss, g = toxicity.loss_and_gradient(x, swaps, labels, weight, w)
    assert abs(loss - plain_loss(w)) < 1e-9
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-6
        assert abs((plain_loss(w + step) - plain_loss(w - step)) / 2e-6 - g[k]) < 1e-6
    model = toxicity._solved(x, labels, [toxicity.swaps_of(s, {}) for s in sets], weight)
    w = np.zeros(len(x.features) + 1)
    for _ in range(20_000):
        w -= 0.05 * toxicity.loss_and_gradient(x, swaps, labels, weight, w)[1]
    value = lambda v: toxicity.loss_and_gradient(x, swaps, labels, weight, v)[0]
    assert value(model) < value(w) + 0.005


def test_scorer_sums_the_features_of_a_text():
    import numpy as np

    from lorebase.llm.hashed_text import word_set

    text = "idiots idiotic idiot réeuxelle réeuxen réeuxtion réeuxa réeuxb the women and the men"
    found = toxicity.set_ids(word_set(text), {})
    weights = {f: 0.01 * (k % 7 - 3) for k, f in enumerate(sorted(found))}
    wanted = toxicity._sigmoid(0.2 + sum(weights[f] for f in sorted(found)))
    assert abs(toxicity.Model(0.2, weights).scorer()(text) - wanted) < 1e-12 and len(found) > len(word_set(text))
    assert np.isclose(toxicity.Model(0.2, weights).scorer()(""), toxicity._sigmoid(0.2))


def test_quality_classifier_edges(odd, none):
    ratings = odd.sparkSession.createDataFrame([(1, 2), (9, 1), (13, 0), (16, 0), (None, 1), (7, None)], "doc_id bigint, grade int")
    found = quality_classifier.scored(odd, quality_classifier.fit(odd, ratings)).collect()
    assert len(found) == len(TEXTS) and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in found)
    same = quality_classifier.fit(odd, ratings.filter("grade = 2"))
    assert {r.expected_grade for r in quality_classifier.scored(odd, same).collect()} == {2.0}
    assert {r.expected_grade for r in quality_classifier.scored(odd, quality_classifier.fit(odd, ratings.limit(0))).collect()} == {0.0}
    assert quality_classifier.scored(none, same).collect() == []


def test_language_edges(odd, none):
    found = {(r.doc_id, r.lang_pred): r.score for r in language.identified(odd, language.fit(odd)).collect()}
    assert (4, "und") in found and (5, "und") in found and (15, "und") in found and (1, "en") in found
    assert all(0 <= s <= 1 for s in found.values())
    assert {r.lang_pred for r in language.identified(odd, language.fit(none)).collect()} == {"und"}
    assert language.identified(none, language.fit(odd)).collect() == []
    known = language.known_documents(odd, language.fit(odd))
    assert known.schema == odd.schema and known.filter("doc_id in (4, 5, 6, 15)").count() == 0


def test_every_class_is_learnt_at_every_size(spark):
    """A language, grade or label of a few rows stays when the sample is far smaller than the table."""
    rows = [(i, f"the common words of text {i} again", "en", 0) for i in range(3000)] + [(9000, "żółw jęż łódź " * 400, "pl", 2), (9002, "vous êtes là", "fr", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, grade int")
    free = docs.filter(~language.held_out(F.col("doc_id")))
    assert free.filter("lang <> 'en'").count() == 2
    assert language.fit(docs, budget=300).languages == ["en", "fr", "pl"]
    assert quality_classifier.fit(docs, docs.select("doc_id", "grade"), budget=300).grades == 3
    toxic = docs.select("doc_id", F.when(F.col("doc_id") == 9002, 1).otherwise(0).alias("toxic"))
    assert abs(toxicity.fit(docs, toxic, budget=300).intercept) < 35
    long = spark.createDataFrame([(k, f"{'word ' * 20_000}{k}", "en") for k in range(8)], "doc_id bigint, text string, lang string")
    assert language.fit(long, budget=500).languages == ["en"]


def test_sampled_classes_keep_their_weight(spark):
    from lorebase.llm.hashed_text import sample_rows

    docs = spark.createDataFrame([(i, f"text {i:05d}") for i in range(4000)], "doc_id bigint, text string")
    marks = docs.select("doc_id", F.when(F.col("doc_id") % 20 == 0, 1).otherwise(0).alias("mark"))
    found = sample_rows(docs, marks, "mark", lambda t: ({1}, []), 4000)
    assert len(found) < 1000 and (found["label"] == 1).mean() > 0.25
    assert abs(found["weight"].mean() - 1) < 1e-9 and abs((found["weight"] * found["label"]).mean() - 0.05) < 0.01


# ---- pipeline


def test_stages_on_odd_tables(spark, odd, none, small_buckets):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


def test_pipeline_against_brute_force(spark):
    """Each stage, on what the one before kept, next to plain Python."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, sf_dir)
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, k in verdict.items() if k}
    known = stages["language identification"](spark, good, sf_dir)
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in good.collect()}
    first = stages["n-gram Jaccard join"](spark, known, sf_dir)
    texts = [(r.doc_id, r.text) for r in known.collect()]
    assert sorted(r.doc_id for r in first.collect()) == sorted(i for i, _, c in brute_components(texts) if i == c)
    cut = stages["suffix-array dedup"](spark, first, sf_dir).collect()
    texts = [(r.doc_id, r.text) for r in first.collect()]
    want = {i: (n, removed) for i, n, removed, _, _ in brute_cut(texts)}
    assert len(cut) == len(texts)
    for r in cut:
        n, removed = want[r.doc_id]
        assert len(r.text.encode()) <= n - removed and len(r.text.encode()) >= n - removed - 12
    rows = corpus_pipeline.run(spark, sf_dir)
    whole = {}
    for r in rows.collect():
        whole.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    assert set(whole) == {r.doc_id for r in cut}


def test_sums_of_keys_in_ranges():
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 400):
        keys = [np.unique(rng.integers(0, 1 << 48, rng.integers(0, size + 1)) % 977).astype(np.uint64) for _ in range(7)]
        counts = [rng.integers(1, 9, len(k)).astype(np.uint32) for k in keys]
        whole = defaultdict(int)
        for k, c in zip(keys, counts):
            for a, b in zip(k.tolist(), c.tolist()):
                whole[a] += b
        assert [x.tolist() for x in jaccard._sums(keys, counts)] == [[whole[a] for a in k.tolist()] for k in keys]
    most = [np.array([5], np.uint64)] * 2, [np.array([2**32 - 1], np.uint32)] * 2
    assert [x.tolist() for x in jaccard._sums(*most)] == [[2**32 - 1]] * 2


def test_texts_in_no_learnt_language_go(spark):
    """Planted foreign texts go in the pipeline's stage, and the documents of the learnt languages stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = quality_rules.kept_documents(docs)
    foreign = {
        "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza.",
        "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    }
    rows = [(10**9 + k, text, None, "planted", len(text)) for k, text in enumerate(foreign.values())]
    planted = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").select(*docs.columns)
    stage = dict(corpus_pipeline.STAGES)["language identification"]
    kept = stage(spark, good.unionByName(planted), "")
    assert kept.filter(F.col("doc_id") >= 10**9).count() == 0
    assert kept.count() >= 0.995 * good.count()
    model = language.fit(good, calibrated=True)
    assert 1 / len(model.languages) < model.least < 0.9
    assert language.known_documents(planted, language.fit(good)).count() == len(foreign)
    assert language.fit(good.limit(0), calibrated=True).least == 0


def test_the_least_score_of_few_texts():
    assert language.least_score([], []) == 0.0
    assert language.least_score([b"one text"], ["en"]) == 0.0
    assert 0 <= language.least_score([b"the house of the man", b"the man in the house"], ["en", "en"]) <= 1
