import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR, rows_of
from lorebase.operators import connectors, embedding, quality, snapshots
from lorebase.sources import scratch, tables
from lorebase.sources.derived import derived
from lorebase.sources.model import DEFAULTS, SCHEMAS, Reference

TIER = "id long, tenant_id string, summary_text string, embedding array<float>, embedding_stale boolean, model_version string, embedded_at timestamp"


def test_checkpoint_dir_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    df = scratch.kept(spark.range(5), "probe")
    assert df.count() == 5
    assert all(f"file://{named}/probe-" in p for p in df.inputFiles())


def test_release_deletes_own_folders(spark):
    import os

    df = scratch.kept(spark.range(5), "probe")
    folder = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder) and scratch.release(spark) >= 1 and not os.path.exists(folder)


def test_snapshot_versions_and_grain(spark, tmp_path):
    s = scratch.Snapshots(spark, str(tmp_path / "s"))
    assert s.latest() is None
    check = lambda rows: snapshots.check_grain(rows, ["id"])
    assert s.write(spark.range(3), check=check) == 1
    with pytest.raises(ValueError):
        s.write(spark.range(3).union(spark.range(1)), check=check)
    assert s.latest() == 1 and s.read().count() == 3
    reading = s.read()
    assert s.write(reading.filter("id < 2"), check=check) == 2  # reads the version it replaces
    assert s.read().count() == 2 and s.read(1).count() == 3


def test_typed_load_and_defaults(spark, frame, tmp_path):
    rows = frame("id long, tenant_id string, knowledge_type string, title string, detail string, is_active boolean", (1, None, "k", "t", "d", None))
    tables.store(rows, str(tmp_path), "project_knowledge")
    got = tables.load(spark, str(tmp_path), "project_knowledge").first()
    assert got.tenant_id == "main" and got.is_active is True


@pytest.mark.parametrize("name", list(SCHEMAS))
def test_declared_schemas_read_their_tables(spark, tmp_path, name):
    rows = derived(spark, SF_DIR, name)
    tables.store(rows, str(tmp_path), name)
    got = tables.load(spark, str(tmp_path), name)
    assert sorted(got.columns) == sorted(rows.columns)
    filled = set(DEFAULTS.get(name, {}))
    same = [c for c in rows.columns if c not in filled]
    assert rows_of(got, *same) == rows_of(rows, *same)
    assert all(got.filter(F.col(c).isNull()).isEmpty() for c in filled)


def tier(spark, n=120):
    rows = [(i, "ab"[i % 2], None if i == 7 else f"text {i}" * (1 + i), None if i % 3 else [1.0] * 4, i % 5 == 0, None, None) for i in range(n)]
    return spark.createDataFrame(rows, TIER)


def test_refresh_ends_with_nothing_pending(spark):
    rows = tier(spark)
    embedder = embedding.CodePointEmbedder(4)
    vectors = embedding.embed(embedding.pending(rows, "summary_text"), embedder, dimensions=4)
    after = embedding.apply_embeddings(rows, vectors, "summary_text", "m1", "2024-01-01 00:00:00")
    T = {"semantic_index": after, "document_chunks": after}
    assert {r.pending for r in embedding.pending_counts(T).collect()} == {0}
    one = after.filter("id = 1").first()
    assert one.model_version == "m1" and np.allclose(one.embedding, embedder(["text 1" * 2])[0], atol=1e-6)
    untouched = after.filter("id = 3").first()
    assert untouched.model_version is None and untouched.embedding == [1.0] * 4


def test_text_changed_meanwhile_stays_stale(spark):
    rows = tier(spark, 10)
    vectors = embedding.embed(embedding.pending(rows, "summary_text"), embedding.CodePointEmbedder(4), dimensions=4)
    edited = rows.withColumn("summary_text", F.when(F.col("id") == 1, "edited").otherwise(F.col("summary_text")))
    after = embedding.apply_embeddings(edited, vectors, "summary_text", "m", "2024-01-01 00:00:00")
    assert rows_of(after.filter("embedding_stale"), "id") == [(1,)]


def test_batches_order_and_cut(spark):
    def spy(texts):
        assert len(texts) <= 7 and all(len(t) <= 5 for t in texts)
        return np.array([[len(t), 0.123456789] for t in texts])

    vectors = embedding.embed(embedding.pending(tier(spark), "summary_text"), spy, dimensions=2, batch=7, max_chars=5)
    got = {r.id: r.vector for r in vectors.collect()}
    assert got[1][0] == 5 and got[7][0] == 0 and got[1][1] == pytest.approx(0.12345679, abs=1e-8)


def test_wrong_dimension_fails_the_run(spark):
    bad = embedding.embed(embedding.pending(tier(spark), "summary_text"), embedding.CodePointEmbedder(3), dimensions=4)
    with pytest.raises(Exception, match="embedder gave"):
        bad.collect()


def test_key_check_and_reference_audits(frame, store):
    T = store(
        p=frame("id int", (1,), (2,)),
        c=frame("id int, a string, b string, p_id int, q_id int", (1, "x", None, 1, 2), (1, "x", None, 9, 2), (2, "x", "y", None, 3), (3, "x", "y", 2, None)),
        q=frame("id int", (2,)),
    )
    assert rows_of(quality.uniqueness_audit(T, {"c": [["id"], ["a", "b"]]}), "key_columns", "duplicate_keys", "extra_rows") == [("a, b", 1, 1), ("id", 1, 1)]
    assert rows_of(quality.check_audit(T, {"c": {"b": "b = 'z'", "id": "id < 3"}}), "rule_name", "violations") == [("b", 2), ("id", 1)]
    refs = [Reference("c", "p_id", "p", "id", "cascade"), Reference("c", "q_id", "q", "id", "null")]
    assert rows_of(quality.reference_audit(T, refs), "parent", "dangling_rows") == [("p", 1), ("q", 1)]
    after = quality.propagate_deletes(T, "q", frame("id int", (2,)), refs)
    assert rows_of(after["c"], "id", "q_id") == [(1, None), (1, None), (2, 3), (3, None)]
    after = quality.propagate_deletes(T, "p", frame("id int", (1,)), refs)
    assert sorted(after) == ["c", "p"] and rows_of(after["c"], "id", "p_id") == [(1, 9), (2, None), (3, 2)]


def test_deletes_run_in_circles_and_meet_again(frame, store):
    """Self reference, a circle of two tables, and a child reached over two parents."""
    T = store(
        n=frame("id int, up int", (1, 4), (2, 1), (3, 2), (4, 3), (5, 5), (6, 5), (7, None)),
        a=frame("id int, b_id int", (1, 2), (3, 9), (4, 1)), b=frame("id int, a_id int", (2, 1), (1, 3), (9, None)),
        top=frame("id int", (1,), (2,)), left_=frame("id int, top_id int", (10, 1), (11, 2)), right_=frame("id int, top_id int", (20, 1), (21, 2)),
        leaf=frame("id int, l int, r int", (1, 10, 20), (2, 10, 21), (3, 11, 21), (4, None, None)),
    )
    own = [Reference("n", "up", "n", "id", "cascade")]
    assert rows_of(quality.propagate_deletes(T, "n", frame("id int", (2,)), own)["n"], "id") == [(5,), (6,), (7,)]
    assert rows_of(quality.propagate_deletes(T, "n", frame("id int", (5,)), own)["n"], "id") == [(1,), (2,), (3,), (4,), (7,)]
    circle = [Reference("b", "a_id", "a", "id", "cascade"), Reference("a", "b_id", "b", "id", "cascade")]
    after = quality.propagate_deletes(T, "a", frame("id int", (1,)), circle)
    assert rows_of(after["a"], "id") == [(3,), (4,)] and rows_of(after["b"], "id") == [(1,), (9,)]
    after = quality.propagate_deletes(T, "a", frame("id int", (3,)), circle)
    assert rows_of(after["a"], "id") == [(1,)] and rows_of(after["b"], "id") == [(2,), (9,)]
    diamond = [
        Reference("left_", "top_id", "top", "id", "cascade"), Reference("right_", "top_id", "top", "id", "cascade"),
        Reference("leaf", "l", "left_", "id", "cascade"), Reference("leaf", "r", "right_", "id", "cascade"),
    ]
    after = quality.propagate_deletes(T, "top", frame("id int", (1,)), diamond)
    assert {t: rows_of(after[t], "id") for t in after} == {"top": [(2,)], "left_": [(11,)], "right_": [(21,)], "leaf": [(3,), (4,)]}
    clear = [*diamond[:2], Reference("leaf", "l", "left_", "id", "cascade"), Reference("leaf", "r", "right_", "id", "null")]
    after = quality.propagate_deletes(T, "top", frame("id int", (1,)), clear)
    assert rows_of(after["leaf"], "id", "r") == [(3, 21), (4, None)]


def connector_store(frame, store):
    return store(
        sessions=frame("id int, tenant_id string, platform string", (1, "a", "web"), (2, "a", None)),
        connectors=frame(
            "connector_id string, tenant_id string, display_name string, criticality string, active boolean, is_blocked boolean, block_reason string, platform_availability array<string>, probe_status string, last_probed_at timestamp_ntz",
            ("c1", "a", "n", "critical", True, False, None, None, "connected", None), ("c2", "a", "n", "standard", True, True, None, [], "weird", None),
            ("c3", "a", "n", "enhancement", True, False, None, ["web"], None, None), ("c4", "a", "n", "critical", False, False, None, None, None, None)),
        session_status=frame("session_id int, connector_id string, tenant_id string, probe_result string, fallback_active boolean, platform string, probe_note string, probed_at timestamp_ntz",
                             (1, "c1", "a", "blocked", True, "desk", "old", None)),
    )


def test_status_seed(frame, store):
    T = connector_store(frame, store)
    got = rows_of(connectors.session_status_rows(T), "session_id", "connector_id", "platform", "probe_result", "probe_note")
    assert got == [(2, "c1", "unknown", "connected", None), (2, "c2", "unknown", "untested", "Blocked: no reason recorded")]
    got = rows_of(connectors.session_status_rows(T, 1), "connector_id", "probe_result", "probe_note")
    assert got == [("c2", "untested", "Blocked: no reason recorded"), ("c3", "untested", "No prior probe on record")]


def test_probes(frame, store):
    T = connector_store(frame, store)
    probes = frame("seq long, connector_id string, session_id int, result string, note string",
                   (1, "c1", 1, "unavailable", "x"), (2, "c1", 1, "connected", None), (3, "c3", 2, "blocked", "why"), (4, "c2", 99, "connected", "y"))
    ts = datetime.datetime(2024, 6, 1)
    registry, status = connectors.record_probes(T, probes, ts)
    assert rows_of(registry, "connector_id", "last_probed_at") == [("c1", ts), ("c2", ts), ("c3", ts), ("c4", None)]
    assert rows_of(status, "connector_id", "tenant_id", "platform", "probe_note", "probed_at") == [("c1", "a", "desk", None, ts), ("c3", "main", "unknown", "why", ts)]
    assert rows_of(registry, "connector_id", "probe_status") == [("c1", "connected"), ("c2", "connected"), ("c3", "blocked"), ("c4", None)]
    assert rows_of(status, "session_id", "connector_id", "probe_result", "fallback_active") == [(1, "c1", "connected", False), (2, "c3", "blocked", False)]
