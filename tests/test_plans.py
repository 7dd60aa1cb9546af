"""What the planner makes of the operators: pruning, pushdown, joins, sizes."""

import re

from lorebase.operators import catalog as rules, hybrid, reports, runs, upsert
from lorebase.sources import tables
from lorebase.sources.scratch import kept
from test_search import asked, corpus, random_case


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tenant_scan_prunes_folders_and_columns(spark, frame, tmp_path):
    rows = frame("id long, tenant_id string, summary_text string, embedding array<float>, embedding_stale boolean",
                 *[(i, "ab"[i % 2], "t", [1.0], False) for i in range(10)])
    tables.store(rows, str(tmp_path), "semantic_index", by_tenant=True)
    df = tables.tenant(tables.load(spark, str(tmp_path), "semantic_index"), "a").select("id")
    text = plan(df)
    assert df.count() == 5
    assert re.search(r"PartitionFilters: \[[^\]]*tenant_id", text)
    assert "embedding" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_report_reads_only_its_columns(spark, store, frame, tmp_path):
    frame("id long, status string, category string, priority int, title string, description string", (1, "open", "SITE", 1, "t", "d")).write.parquet(str(tmp_path / "t"))
    T = store(tasks=spark.read.parquet(str(tmp_path / "t")))
    assert "description" not in plan(reports.task_counts(T["tasks"]))
    pushed = plan(T["tasks"].filter(reports.is_open()).select("id"))
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,open)]" in pushed


def test_top_n_limits_before_the_shuffle(spark, store):
    from test_reports import run_frame

    T = store(eval_runs=run_frame(spark, [(1, "2024-01-01 00:00:00", "x", 1, 1.0, True, "{}")]))
    for df in (runs.compliance_trend(T), runs.latest_by_agent(T)):
        text = plan(df)
        assert re.search(r"WindowGroupLimit[^\n]*Partial", text) and re.search(r"WindowGroupLimit[^\n]*Final", text)


def test_payload_join_does_not_shuffle_the_corpus(spark):
    queries, docs = random_case(1, n_docs=50, n_queries=5)
    rows = kept(corpus(spark, docs))
    hits = hybrid.search(asked(spark, queries), rows, "summary_text", hybrid.CATALOG_FIELDS)
    text = plan(hits)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text


def test_small_change_set_leaves_the_catalog_in_place(spark, frame):
    catalog = kept(frame("id long, tenant_id string, source_table string, source_id string, summary_text string, embedding array<float>, embedding_stale boolean",
                         *[(i, "a", "decisions", str(i), "t", [1.0], False) for i in range(50)]))
    columns = "id long, tenant_id string, title string, decision string, rationale string"
    old, new = frame(columns, (1, "a", "t", "d", None)), frame(columns, (1, "a", "u", "d", None))
    marked = rules.mark_stale(catalog, "decisions", old, new)
    assert "SortMergeJoin" not in plan(marked)
    assert marked.filter("embedding_stale").count() == 1
    log = frame("seq long, tenant_id string, source_table string, source_id string, kind string, entity_type string, summary_text string, model_version string, authority_tier string",
                (1, "a", "decisions", "3", "delete", None, None, None, None))
    folded = rules.fold(catalog, log)
    wide = [line for line in plan(folded).splitlines() if "Exchange hashpartitioning" in line]
    assert folded.count() == 49 and not any("embedding" in line for line in wide)
    assert "SortMergeJoin FullOuter" not in plan(upsert.upsert(catalog, frame("id long, summary_text string", (1, "x")), ["id"]))


def test_pickled_helpers_do_not_need_the_package():
    """Functions sent to executors carry their code along."""
    from pyspark import cloudpickle

    from lorebase.functions.text import english_lexeme
    from lorebase.operators.nearest import SignCells

    for thing in (english_lexeme, SignCells):
        assert b"lorebase.functions.text\x94\x8c\x0eenglish_lexeme" not in cloudpickle.dumps(thing)
        assert len(cloudpickle.dumps(thing)) > 500
