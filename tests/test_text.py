import math
import random

import pytest
from conftest import rows_of
from lorebase.functions.text import STOP_WORDS, english_lexeme, stem
from lorebase.operators import fulltext, ranked_sets

# Published examples of the English stemmer.
STEMS = """consign consign consigned consign consignment consign consistency consist consolatory consolatori
consolidating consolid consolingly consol conspicuously conspicu conspiracy conspiraci constable constabl
knackeries knackeri knavish knavish kneeling kneel knightly knight knitting knit knives knive knocker knocker
generously generous cries cri ties tie gas gas this this kiwis kiwi hopping hop hoping hope luxuriated luxuri
relational relat happy happi by by say say flies fli skies sky dying die communism communism
proceed proceed news news sensational sensat hopefulness hope running run falling fall""".split()


@pytest.mark.parametrize("word,expected", list(zip(STEMS[::2], STEMS[1::2])))
def test_stem(word, expected):
    assert stem(word) == expected


def test_lexemes():
    assert len(STOP_WORDS) == 127
    assert english_lexeme("the") is None
    assert english_lexeme("running2") == "running2"


def test_analyze_edges(frame):
    docs = frame("id long, t string", (1, None), (2, ""), (3, "the and of"), (4, "Runs runs RUNNING the run"), (5, "Élan-vital 3x"))
    got = rows_of(fulltext.analyze(docs, "t", ["id"]))
    assert got == [(4, "run", 1), (4, "run", 2), (4, "run", 3), (4, "run", 5), (5, "3x", 3), (5, "vital", 2), (5, "élan", 1)]


def brute_rank(positions):
    """The rank formula, pair by pair."""
    if len(positions) == 1:
        return 0.1 * sum(1 / j**2 for j in range(1, len(positions[0]) + 1)) / 1.64493406685
    rest, near = 1.0, False
    for i in range(len(positions)):
        for j in range(i):
            for a in positions[i]:
                for b in positions[j]:
                    d = abs(a - b)
                    if d <= 100:
                        near = True
                        rest *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    return 1 - rest if near else 1e-16


def test_rank_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        spots = rng.sample(range(1, rng.choice([30, 400, 3000])), rng.randint(3, 25))
        words = rng.randint(1, min(4, len(spots)))
        cut = [sorted(spots[w::words]) for w in range(words)]
        rows.append((str(i), i, cut))
    df = spark.createDataFrame(rows, "qid string, id long, positions array<array<int>>")
    got = {r.id: r.r for r in fulltext.fts_rank(df).collect()}
    for _, i, positions in rows:
        assert got[i] == pytest.approx(brute_rank(positions), rel=1e-5, abs=1e-15)


def test_match_needs_every_word(frame):
    docs = frame("id long, tenant_id string, t string", (1, "a", "red fox"), (2, "a", "red dog"), (3, "b", "red fox"), (4, "a", "fox den red"))
    queries = frame("qid string, tenant_id string, query_text string", ("1", "a", "fox red"), ("2", "a", "the of"), ("3", "a", "fox unicorn"), ("4", "b", "FOX"))
    terms = fulltext.query_terms(queries)
    found = fulltext.fts_match(terms, fulltext.postings(docs, "t"))
    assert rows_of(found, "qid", "id") == [("1", 1), ("1", 4), ("4", 3)]


def test_stored_index_gives_same_matches(spark, frame, tmp_path):
    docs = frame("id long, tenant_id string, t string", *[(i, "a", f"word{i % 3} word{i % 5} common") for i in range(60)])
    queries = frame("qid string, tenant_id string, query_text string", ("1", "a", "word1 common"), ("2", "a", "word2 word4"))
    terms = fulltext.query_terms(queries, "simple")
    index = fulltext.postings(docs, "t", "simple")
    fulltext.write_postings(index, str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert rows_of(fulltext.fts_match(terms, stored), "qid", "id") == rows_of(fulltext.fts_match(terms, index), "qid", "id")


def test_positions_of_a_hot_query(spark):
    """Most matches belong to one query and most ranks tie."""
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.9 else f"q{i % 7}", i, rng.choice([0.1, 0.1, 0.1, 0.2, 0.3])) for i in range(3000)]
    df = spark.createDataFrame(rows, "qid string, id long, r float").repartition(8)
    wanted = {}
    for qid in {q for q, _, _ in rows}:
        own = sorted((-r, i) for q, i, r in rows if q == qid)
        wanted.update({(qid, i): n for n, (_, i) in enumerate(own, 1)})
    assert {(r.qid, r.id): r.fts_rk for r in fulltext.fts_positions(df).collect()} == wanted


def test_postings_are_made_where_the_texts_lie(frame):
    """No word is shuffled; rows of one id are put together all the same."""
    docs = frame("id long, tenant_id string, t string", (1, "a", "red den red"), (2, None, "fox"), (3, "b", None), (4, "b", ""))
    index = fulltext.postings(docs, "t", "simple")
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert rows_of(index) == sorted([("a", "den", 1, [2]), ("a", "red", 1, [1, 3]), (None, "fox", 2, [1])], key=repr)
    twice = fulltext.postings(docs.unionByName(frame("id long, tenant_id string, t string", (1, "a", "old red"))), "t", "simple")
    assert ("a", "red", 1, [1, 2, 3]) in rows_of(twice) and ("a", "den", 1, [2]) in rows_of(twice)


def test_sets_meet_documents_where_they_lie(frame):
    """The same matches as on postings, in several blocks; copies of a query are one set, and no pair is shuffled."""
    rng = random.Random(4)

    def text(n):
        return " ".join(rng.choice("abcdefgh") for _ in range(n))

    docs = frame("id long, tenant_id string, t string", *[(i, "xyz"[i % 3], text(rng.randint(0, 40))) for i in range(300)], (900, None, "a b"), (901, "x", None))
    asked = [("xy"[i % 2], text(rng.randint(1, 5))) for i in range(30)]
    rows = [(str(i), *asked[i % 30]) for i in range(90)] + [("none", "x", "a unheard"), ("void", "x", "")]
    terms = fulltext.query_terms(frame("qid string, tenant_id string, query_text string", *rows), "simple")
    wanted = rows_of(fulltext.fts_match(terms, fulltext.postings(docs, "t", "simple")), "qid", "id")
    sets, members = fulltext.word_sets(terms)
    assert sets.count() <= 31
    matches = fulltext.Matches(sets, docs, "t", "simple", block_sets=7)
    assert matches.blocks > 2
    pairs = matches.pairs()
    assert "Exchange hashpartitioning" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert rows_of(pairs.join(members, "sid"), "qid", "id") == wanted


def test_ranks_are_found_with_the_documents(frame, monkeypatch):
    """The same ranks and positions as on postings, in several blocks and parts, and no match is shuffled."""
    rng = random.Random(6)

    def text(n):
        return " ".join(rng.choice("aaabbcdefg") for _ in range(n))

    docs = frame("id long, tenant_id string, t string", *[(i, "xyz"[i % 3], text(rng.choice([0, 9, 40, 300]))) for i in range(200)], (900, None, "a b"), (901, "x", None))
    rows = [(str(i), "xy"[i % 2], text(i % 15 // 3 + 1)) for i in range(60)] + [("none", "x", "a unheard"), ("void", "x", ""), ("nobody", None, "a")]
    terms = fulltext.query_terms(frame("qid string, tenant_id string, query_text string", *rows), "simple")
    ranked = fulltext.fts_rank(fulltext.fts_match(terms, fulltext.postings(docs, "t", "simple")))
    wanted = {(r.qid, r.id): r.r for r in ranked.collect()}
    monkeypatch.setattr(ranked_sets, "SLICE_PAIRS", 500)
    sets = ranked_sets.RankedSets(terms, docs, "t", "simple", block_sets=7)
    assert sets.blocks > 2
    found = sets.by_query()
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.qid, r.id): r.r for r in found.collect()}
    assert set(got) == set(wanted) and all(got[k] == pytest.approx(wanted[k], rel=1e-6) for k in got)

    every = {(r.sid, r.id): r.r for r in sets.ranks().collect()}
    place = {(s, i): 1 + sum((-x, j) < (-r, i) for (t, j), x in every.items() if t == s) for (s, i), r in every.items() if i % 7 < 4}
    marks = frame("sid long, id long", *[k for k in place if k[1] % 7 == 3], (next(iter(every))[0], 77777))
    got = {(r.sid, r.id): r.fts_rk for r in sets.positions(2, marks).collect()}
    assert all(n == place[k] for k, n in got.items() if k in place)
    assert {k for k in place if k[1] % 7 == 3} <= set(got) and set(got) - set(place) <= {k for k in every if k[1] % 7 > 3}
    assert len(got) < len(every)
    assert {(r.sid, r.id) for r in sets.best(2).collect()} == {(r.sid, r.id) for r in sets.positions(2, marks).filter("fts_rk <= 2").collect()}
