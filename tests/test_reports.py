"""Edge cases of the reports: audiences, runs, empty tables, canonical text."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR, rows_of
from lorebase.functions.columns import capitalised
from lorebase.functions.documents import canonical_text
from lorebase.operators import governance, profiles, reports, runs
from lorebase.sources import derived

RULES = "id long, tenant_id string, category string, rule string, rule_type string, applies_to string, enforcement string, updated_at timestamp_ntz"


def rules_for(frame, *audiences):
    return frame(RULES, *[(i, "a", "startup", "r", "sop", w, "halt", None) for i, w in enumerate(audiences)])


def test_audiences(frame, store):
    T = store(known_rules=rules_for(frame, "", "{}", "{a}", "{a,,b}", " a , b ", "all", None))
    assert rows_of(governance.rules_by_agent(T, ["x", "y"]), "id", "agent_name") == [
        (2, "a"), (3, ""), (3, "a"), (3, "b"), (4, "a"), (4, "b"), (5, "x"), (5, "y")]
    assert rows_of(governance.startup_rules(T), "id", "agent") == [
        (2, "a"), (3, "a"), (3, "b"), (4, "a"), (4, "b"), (5, "all")]


def test_agreement_counts_a_rule_once(frame, store):
    agreements = frame("id long, tenant_id string, agent_name string, agreement_version string, required_rule_types array<string>, enforcement_model string",
                       (1, "a", "a", "1", ["sop", "gate", "gate"], "x"), (2, "a", "b", "1", [], "x"))
    T = store(known_rules=rules_for(frame, "a", "{a}", " a ", "all", "{b, a}", None), factory_agreements=agreements)
    got = {r.agent_name: r for r in governance.agreement_status(T).collect()}
    assert got["a"].loaded_rules == 3 and got["a"].missing_rule_types == ["gate", "gate"] and got["a"].status_label.startswith("WARN")
    assert got["b"].loaded_rules == 2 and got["b"].status_label == "READY"


def test_retired_terms(frame, store):
    T = store(
        project_knowledge=frame("id long, tenant_id string, knowledge_type string, title string, detail string",
                                (1, "a", "k", "Old NAME", "x" * 300), (2, "a", "k", None, "olx"), (3, "b", "k", "old name", ""), (4, "a", "k", "100% sure", "")),
        decommissioned_terms=frame("term string, tenant_id string", ("old name", "a"), ("ol_", "a"), ("name", "a")),
        decommissioned_term_allowlist=frame("tenant_id string, source_table string, source_id string, term string",
                                            ("a", "project_knowledge", "1", "name"), ("a", "known_rules", "2", "ol_")),
    )
    got = rows_of(governance.knowledge_with_retired_terms(T), "id", "matched_terms", "hit_count", F.length("detail_preview"))
    assert got == [(1, ["ol_", "old name"], 2, 200), (2, ["ol_"], 1, 3)]
    blocked = governance.knowledge_with_retired_terms(T, block_bytes=40)
    assert rows_of(blocked, "id", "matched_terms", "hit_count", F.length("detail_preview")) == got


def test_many_retired_terms_equal_plain_search(frame, store):
    """10,000 terms of two tenants, with repeats, cases, overlaps, an empty and a null one, in several blocks."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abAB é") for _ in range(n))
    terms = sorted({(word(r.randint(1, 9)), r.choice("ab")) for _ in range(14000)})[:9996] + [("", "b"), (None, "a"), ("a_b", "a"), ("b", None)]
    texts = [(i, r.choice(["a", "b", "c", None]), "k", r.choice([None, "", word(12)]), word(r.randint(0, 60))) for i in range(60)]
    T = store(
        project_knowledge=frame("id long, tenant_id string, knowledge_type string, title string, detail string", *texts),
        decommissioned_terms=frame("term string, tenant_id string", *terms, *terms[:50]),
        decommissioned_term_allowlist=frame("tenant_id string, source_table string, source_id string, term string"),
    )

    def inside(term, text):
        low = (text or "").lower()
        if text is None:
            return False
        return any(low[i] == "a" and low[i + 2] == "b" for i in range(len(low) - 2)) if term == "a_b" else term.lower() in low

    wanted = {}
    for i, tenant, _, title, detail in texts:
        hits = sorted(t for t, of in terms if t is not None and of is not None and of == tenant and (inside(t, title) or inside(t, detail)))
        if hits:
            wanted[i] = hits
    for block in (1 << 20, 100_000):
        got = governance.knowledge_with_retired_terms(T, block_bytes=block).collect()
        assert {x.id: x.matched_terms for x in got} == wanted
        assert all(x.hit_count == len(x.matched_terms) for x in got)


def test_dead_references_match_titles_by_prefix(frame, store):
    T = store(
        known_rules=frame(RULES, (1, "a", "c", "SOP-1 SOP-12 SOP-9 xSOP-77", "sop", None, None, None)),
        sop_registry=frame("sop_id string, tenant_id string, title string, status string",
                           ("SOP-1", "a", "t", "active"), ("OTHER", "a", "see sop-123 and SOP-9", "deprecated"), ("SOP-77", "b", "t", "active")),
    )
    # SOP-1 meets OTHER by prefix as well; that row is not active, so it counts as dead
    assert rows_of(governance.dead_references(T, "a"), "sop_ref", "sop_id") == [
        ("SOP-1", "OTHER"), ("SOP-12", "OTHER"), ("SOP-77", None), ("SOP-9", "OTHER")]


RUN = ("id long, run_date timestamp_ntz, agent_name string, layer int, score decimal(5,2), pass boolean, criteria_results string, "
       "factory_id string, factory_tenant string, model_tested string, agent_version string, notes string")


def run_frame(spark, rows):
    base = spark.createDataFrame(rows, "id long, day string, agent_name string, layer int, score double, pass boolean, criteria_results string")
    return base.selectExpr(
        "id", "cast(day as timestamp_ntz) run_date", "agent_name", "layer", "cast(score as decimal(5,2)) score", "pass", "criteria_results",
        "'f' factory_id", "'a' factory_tenant", "'m' model_tested", "'v' agent_version", "'n' notes", "'full' run_mode", "'s' agent_sig")


def test_failures_and_readiness(spark, store):
    d = "2024-01-0{} 10:00:00".format
    T = store(eval_runs=run_frame(spark, [
        (1, d(1), "X", 1, 1.0, False, "{}"), (2, d(1), "x", 1, 9.0, True, "{}"),      # pass at the same instant: still active
        (3, d(2), "y", 1, 1.0, False, "{}"), (4, d(3), "Y", 1, 9.0, True, "{}"),      # passed later
        (5, d(2), "z", 2, None, True, "{}"),                                           # layer 2 only
        (6, d(2), "w", 1, None, None, "{}"), (7, d(3), "y", 2, 1.0, False, "{}"),
    ]))
    assert rows_of(runs.active_failures(T), "agent_name", "layer") == [("x", 1), ("y", 2)]
    tiers = {r.agent_name: r.readiness_tier for r in runs.readiness(T, "a").collect()}
    assert tiers == {"x": "L1_PASS_AWAITING_L2", "y": "DEFERRED", "z": "DEFERRED", "w": "NOT_EVALUATED"}
    tiers = {r.agent_name: r.readiness_tier for r in runs.canonical_readiness(T, "a").collect()}
    assert tiers == {"x": "L1_PASS_AWAITING_L2", "y": "L1_PASS_AWAITING_L2", "z": "NOT_EVALUATED", "w": "NOT_EVALUATED"}


def test_evidence_flags_are_typed(spark, store):
    rows = [(1, '{"evidence_samples": 0}'), (2, '{"evidence_samples": "0"}'), (3, '{"insufficient_evidence": true}'), (4, '{"evidence_samples": 3}'), (5, "{}")]
    T = store(eval_runs=run_frame(spark, [(i, "2024-01-01 00:00:00", "x", 2, 1.0, None, c) for i, c in rows]))
    assert runs.layer2_coverage(T).first()["insufficient_evidence"] == 2


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_drift_equals_plain_lag(spark, store, bucket):
    from pyspark.sql import Window

    rng = random.Random(5)
    rows = [(i, f"2024-0{rng.randint(1, 3)}-{rng.randint(1, 28):02d} {rng.randint(0, 3):02d}:00:00", rng.choice("xy"), 1,
             rng.choice([None, 1.0, 2.5, 7.25]), None, "{}") for i in range(300)]
    T = store(eval_runs=run_frame(spark, rows))
    w = Window.partitionBy("agent_name", "factory_id").orderBy("run_date", "id")
    plain = T["eval_runs"].select("id", F.lag("score").over(w).alias("p"))
    assert rows_of(runs.drift(T, bucket), "id", "previous_score") == rows_of(plain)


def test_capitalised(frame):
    df = frame("a string", ("b-team x2y ÉLAN the_end",))
    assert df.select(capitalised(F.col("a")).alias("x")).first()["x"] == "B-Team X2y Élan The_End"


def test_canonical_json_text():
    import json
    from lorebase.functions.documents import _Number

    parsed = json.loads('{"bb":1.50,"a":[true,null,{"z":"é\\n"}],"ab":"x"}', parse_int=_Number, parse_float=_Number)
    assert canonical_text(parsed) == '{"a": [true, null, {"z": "é\\n"}], "ab": "x", "bb": 1.50}'


class EmptyStore(derived.Store):
    def __missing__(self, name):
        self[name] = super().__missing__(name).limit(0)
        return self[name]



@pytest.mark.parametrize("name", ["task_dashboard", "catalog_coverage", "system_inventory", "governance_health", "retired_term_counts", "quality_checks"])
def test_reports_on_empty_tables(spark, name):
    fns = {
        "task_dashboard": reports.task_dashboard,
        "catalog_coverage": lambda T: reports.catalog_coverage(T, "t0"),
        "system_inventory": lambda T: reports.system_inventory(T, "t0"),
        "governance_health": lambda T: governance.governance_health(T, "t0"),
        "retired_term_counts": lambda T: governance.retired_term_counts(T, "t0"),
        "quality_checks": __import__("lorebase.operators.quality", fromlist=["x"]).check_audit,
    }
    rows = fns[name](EmptyStore(spark, SF_DIR)).collect()
    assert rows
    if name == "task_dashboard":
        assert rows[0].open_tasks == 0 and rows[0].last_session_date is None
    if name == "catalog_coverage":
        assert {r.coverage_status for r in rows} == {"OK"} and len(rows) == 8


def test_empty_groups_give_no_rows(spark):
    T = EmptyStore(spark, SF_DIR)
    for fn in (reports.embedding_health, reports.retrieval_health, reports.memory_usage, reports.tasks_by_owner, runs.latest_by_agent,
               runs.cross_factory, runs.drift, runs.active_failures, runs.layer2_coverage, governance.agreement_status,
               profiles.identity_signatures, profiles.render_documents, reports.recent_sessions):
        assert fn(T).collect() == []
    assert reports.startup_summary(T, "t0").first()["open_tasks"] is None


def test_coverage_sketches_are_near_and_merge(spark, store):
    """Estimates within four standard errors, from days merged in any parts."""
    day = F.expr("timestamp_ntz '2024-01-01 08:00:00' + make_interval(0, 0, 0, cast(id % 9 as int))")
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "t0").otherwise("t1").alias("factory_tenant"), F.concat(F.lit("A"), F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("agent_name"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 2 == 0).alias("pass"), day.alias("run_date"))
    T = store(eval_runs=rows)
    exact = {r.factory_tenant: r for r in runs.factory_coverage(T).collect()}
    days = runs.agent_sketches(T)
    assert days.count() == 18 - 9  # a tenant of every third id has three days, the other one six
    for r in runs.factory_coverage_estimated(days).collect():
        e = exact[r.factory_tenant]
        assert r.last_eval == e.last_eval
        for c in ("agents_tested", "agents_passed", "agents_failed", "agents_unscored"):
            assert abs(r[c] - e[c]) <= 4 * 1.04 / 2 ** (runs.SKETCH_BITS / 2) * e[c]
    late = runs.factory_coverage_estimated(days, "2024-01-06").collect()
    assert sum(r.agents_tested for r in late) < sum(e.agents_tested for e in exact.values())
    assert runs.factory_coverage_estimated(runs.agent_sketches(store(eval_runs=rows.limit(0)))).collect() == []
