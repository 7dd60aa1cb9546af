"""Health, task, session, content and evaluation-run reports."""

from pyspark.sql import functions as F

from lorebase.operators import reports, runs
from lorebase.plans.registry import REGISTRY, joined, query, rounded
from lorebase.sources.scratch import kept, scratch_path
from lorebase.streaming import health

TENANT = "t0"


def report(name, sql, tables, fn, **decimals):
    """Register a report that needs nothing but the store."""
    query(name, sql, tables)(lambda T: rounded(fn(T), **decimals) if decimals else fn(T))


# --- health ------------------------------------------------------------------------
_HEALTH = """select '{0}' as tier, tenant_id, count(*) as total_rows, count(embedding) as embedded,
  count(*) filter (where embedding is null) as unembedded, count(*) filter (where embedding_stale) as stale,
  count(distinct model_version) as distinct_models, min(embedded_at) as oldest_embed, max(embedded_at) as newest_embed from {0} group by tenant_id"""
_HEALTH_SQL = _HEALTH.format("semantic_index") + " union all " + _HEALTH.format("document_chunks")

report("embedding_health", _HEALTH_SQL, ["semantic_index", "document_chunks"], reports.embedding_health)
report(
    "embedding_contract_breaks",
    f"select * from ({_HEALTH_SQL}) h where stale > 0 or unembedded > 0 or distinct_models <> 1",
    ["semantic_index", "document_chunks"],
    lambda T: reports.unhealthy_tiers(reports.embedding_health(T)),
)
report(
    "retrieval_health",
    """select tenant_id, count(*) as event_count, count(*) filter (where used_vector) as vector_event_count,
  count(*) filter (where not used_vector) as fts_only_event_count,
  round(cast(sum(latency_ms) as double) / count(latency_ms), 2) as avg_latency_ms, max(created_at) as last_event_at
from retrieval_events group by tenant_id""",
    ["retrieval_events"], reports.retrieval_health, avg_latency_ms=2,
)
report(
    "memory_usage",
    """select tenant_id, session_id, count(*) filter (where event_type = 'brain_search') as brain_searches,
  count(*) filter (where event_type = 'session_open') as session_opens, max(created_at) filter (where event_type = 'brain_search') as last_brain_search,
  case when count(*) filter (where event_type = 'brain_search') = 0 then 'dark' else 'active' end as brain_status
from session_log group by tenant_id, session_id""",
    ["session_log"], reports.memory_usage,
)


def _windows(T, table: str, kind: health.Report):
    """The windows that a stream of the events of a table keeps, when it has read them all."""
    path = scratch_path(T.spark, "health")
    T[table].write.parquet(f"{path}/events")
    events = T.spark.readStream.schema(T[table].schema).parquet(f"{path}/events")
    health.health_stream(events, kind, f"{path}/windows", f"{path}/progress").awaitTermination()
    rows = health.stored_windows(T.spark, f"{path}/windows", kind)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in rows.dtypes if t == "timestamp"})


report(
    "retrieval_health_windows",
    """select date_trunc('hour', created_at) as window_start, date_trunc('hour', created_at) + interval 1 hour as window_end, tenant_id,
  count(*) as event_count, count(*) filter (where used_vector) as vector_event_count, count(*) filter (where not used_vector) as fts_only_event_count,
  cast(sum(latency_ms) as bigint) as latency_sum, count(latency_ms) as latency_events, max(created_at) as last_event_at,
  round(cast(sum(latency_ms) as double) / count(latency_ms), 2) as avg_latency_ms
from retrieval_events group by all""",
    ["retrieval_events"],
    lambda T: health.with_derived(_windows(T, "retrieval_events", health.RETRIEVAL), health.RETRIEVAL).withColumn("latency_sum", F.col("latency_sum").cast("long")),
    avg_latency_ms=2,
)
report(
    "retrieval_health_stream", REGISTRY["retrieval_health"].sql, [],
    lambda T: health.totals(_windows(T, "retrieval_events", health.RETRIEVAL), health.RETRIEVAL).drop("latency_sum", "latency_events"), avg_latency_ms=2,
)
report(
    "memory_usage_stream", REGISTRY["memory_usage"].sql, [],
    lambda T: health.totals(_windows(T, "session_log", health.MEMORY), health.MEMORY),
)
_EXPECTED = " union all ".join(
    f"select '{name}' as source_table, count(*) as source_rows from {table} where tenant_id = '{TENANT}'{extra}"
    for name, table, extra in [
        ("tasks", "tasks", ""), ("decisions", "decisions", ""), ("brand_messaging", "brand_messaging", ""),
        ("project_knowledge", "project_knowledge", " and coalesce(is_active, true)"), ("known_rules", "known_rules", ""),
        ("sop_registry", "sop_registry", ""), ("agent_identity", "agent_identity", ""), ("mcp_registry", "connectors", ""),
    ]
)
report(
    "catalog_coverage",
    f"""with expected as ({_EXPECTED}), indexed as (select source_table, count(*) as n,
  count(*) filter (where embedding is null or embedding_stale) as pending from semantic_index where tenant_id = '{TENANT}' group by source_table)
select source_table, source_rows, coalesce(n, 0) as tier1_rows, coalesce(pending, 0) as pending_embed,
  case when coalesce(n, 0) = 0 and source_rows > 0 then 'MISSING' when coalesce(n, 0) < source_rows then 'PARTIAL' else 'OK' end as coverage_status
from expected left join indexed using (source_table)""",
    ["semantic_index", "tasks", "decisions", "brand_messaging", "project_knowledge", "known_rules", "sop_registry", "agent_identity", "connectors"],
    lambda T: reports.catalog_coverage(T, TENANT),
)

# --- tasks ---------------------------------------------------------------------------
_COUNTS = ", ".join(
    ["count(*) filter (where status = 'open') as open_tasks"]
    + [f"count(*) filter (where status = 'open' and priority = {p}) as {n}" for n, p in [("critical", 1), ("high", 2), ("normal", 3), ("low", 4)]]
    + [f"count(*) filter (where status = 'open' and category = '{c}') as {c.lower()}_tasks" for c in ["SITE", "BUILD", "CONTENT", "INFRA", "OPS", "GATE"]]
)
report(
    "task_dashboard",
    f"""select t.*, a.*, s.* from (select {_COUNTS} from tasks) t,
  (select count(*) filter (where status = 'active') as active_agents, count(*) filter (where status = 'standalone') as standalone_agents from agents) a,
  (select session_date as last_session_date, platform as last_platform, resume_notes from sessions order by session_date desc, id desc limit 1) s""",
    ["tasks", "agents", "sessions"], reports.task_dashboard,
)
report(
    "open_tasks",
    """select t.id, t.priority, t.category, t.owner, t.title, t.description, t.ref_id, t.blocked_by, b.title as blocked_by_title,
  cast(t.created_at as date) as added from tasks t left join tasks b on b.id = t.blocked_by where t.status = 'open'""",
    ["tasks"], reports.open_tasks,
)
report(
    "actionable_tasks",
    """select id, priority, category, owner, title, ref_id from tasks t where status = 'open'
  and (blocked_by is null or exists (select 1 from tasks b where b.id = t.blocked_by and b.status = 'closed'))""",
    ["tasks"], reports.actionable_tasks,
)
report(
    "blocked_tasks",
    """select t.id, t.priority, t.category, t.title as blocked_task, b.id as blocker_id, b.title as blocker_title, b.status as blocker_status
from tasks t join tasks b on b.id = t.blocked_by where t.status = 'open'""",
    ["tasks"], reports.blocked_tasks,
)
report(
    "tasks_by_owner",
    """select owner, count(*) as open_tasks, cast(sum(case when priority = 1 then 1 else 0 end) as bigint) as critical,
  cast(sum(case when priority = 2 then 1 else 0 end) as bigint) as high, cast(sum(case when priority = 3 then 1 else 0 end) as bigint) as normal,
  cast(sum(case when priority = 4 then 1 else 0 end) as bigint) as low, string_agg(distinct category, ', ' order by category) as categories
from tasks where status = 'open' group by owner""",
    ["tasks"], reports.tasks_by_owner,
)
report(
    "open_tasks_of_category",
    "select id, priority, owner, ref_id, title, description from tasks where status = 'open' and category = 'SITE'",
    ["tasks"], lambda T: reports.open_tasks_of(T, "SITE"),
)

# --- agents, sessions, content ----------------------------------------------------------
report(
    "agent_roster",
    """select agent_name, factory, status, role, version, state_sig, source_file, cast(updated_at as date) as last_updated,
  case factory when 'closed_factory' then 1 when 'standalone' then 2 else 3 end as roster_group from agents""",
    ["agents"], reports.agent_roster,
)


@query(
    "recent_sessions",
    """select session_date, platform, session_type, summary, resume_notes, coalesce(array_to_string(agents_active, '|'), '') as agents_active
from sessions order by session_date desc, id desc limit 5""",
    ["sessions"],
)
def recent_sessions(T):
    return joined(reports.recent_sessions(T), "agents_active").fillna("", "agents_active")


report(
    "decisions_log", "select decision_date, category, title, decision, rationale, made_by from decisions", ["decisions"], reports.decisions_log,
)
report(
    "content_workflow",
    """select id, title, content_type, status, assigned_to, target_page_id, file_path is not null as has_file, cast(created_at as date) as created_date,
  cast(published_at as date) as published_date, case status when 'approved' then 1 when 'staged' then 2 when 'draft' then 3 when 'published' then 4 end as status_order
from content_staging where status <> 'archived'""",
    ["content_staging"], reports.content_workflow,
)


@query(
    "active_research",
    """select id, topic, left(summary, 200) as summary_preview, coalesce(array_to_string(tags, '|'), '') as tags, collected_by, session_id,
  cast(created_at as date) as collected_date from research where status = 'active'""",
    ["research"],
)
def active_research(T):
    return joined(reports.active_research(T), "tags").fillna("", "tags")


report(
    "file_rollup",
    "select category, count(*) as file_count, cast(sum(case when conversion_required then 1 else 0 end) as bigint) as needs_conversion from file_registry group by category",
    ["file_registry"], reports.file_rollup,
)


@query(
    "active_procedures",
    """select sop_id, title, version, owner, trigger_condition, array_to_string(trigger_phrases, '|') as trigger_phrases, summary, status, file_path, updated_at
from sop_registry where status = 'active'""",
    ["sop_registry"],
)
def active_procedures(T):
    return joined(reports.active_procedures(T), "trigger_phrases")


report(
    "doctrine",
    f"""select 'doctrine' as layer, source_name as source, chunk_index as ord, content from document_chunks where tenant_id = '{TENANT}' and source_type = 'user'
union all select 'distilled', category || '/' || sub_type, id, content from brand_messaging where tenant_id = '{TENANT}'
  and (category in ('origin-story', 'brand-identity') or sub_type in ('voice-canon', 'sideways-language', 'human-cyber-work-teams', 'closing-line', 'hero-claim'))""",
    ["document_chunks", "brand_messaging"], lambda T: reports.doctrine(T, TENANT, source_type="user"),
)
report("settings", f"select key, category, value, notes, updated_at, updated_by from factory_config where tenant_id = '{TENANT}'", ["factory_config"], lambda T: reports.settings(T, TENANT))


@query(
    "settings_object",
    f"""select string_agg(key || '=' || value, ';' order by key) as settings from factory_config where tenant_id = '{TENANT}' and category = 'general'""",
    ["factory_config"],
)
def settings_object(T):
    one = reports.settings_object(T, TENANT, "general")
    pairs = F.map_entries(F.from_json("settings", "map<string,string>"))
    texts = F.transform(F.array_sort(pairs), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return one.select(F.array_join(texts, ";").alias("settings"))


@query(
    "lanes",
    """select lane, tenant_id, array_to_string(owner_agents, '|') as owner_agents, reviewer_agent, parallel_eligible,
  coalesce(array_to_string(exclusive_resources, '|'), '') as exclusive_resources, notes from factory_lanes""",
    ["factory_lanes"],
)
def lanes(T):
    return joined(reports.lanes(T), "owner_agents", "exclusive_resources").fillna("", "exclusive_resources")


report(
    "active_claims",
    "select id, tenant_id, resource_type, resource_id, claimed_by, session_id, claimed_at, expires_at, released_at, released_by, status, factory_id, platform, claim_note from work_claims where status = 'active'",
    ["work_claims"], reports.active_claims,
)
report(
    "claims", "select id, tenant_id, resource_type, resource_id, claimed_by, session_id, claimed_at, expires_at, released_at, released_by, status, factory_id, platform, claim_note from work_claims", ["work_claims"], reports.claims,
)

# --- whole system ---------------------------------------------------------------------------
_INVENTORY_TABLES = ["sop_registry", "sop_steps", "connectors", "known_rules", "factory_agreements", "brand_messaging", "project_knowledge", "agents"]
report(
    "system_inventory",
    "select " + ", ".join(f"true as has_{d}" for d in reports._DATASETS) + f""",
  (select count(*) from sop_registry where tenant_id = '{TENANT}' and status = 'active') as active_sops,
  (select count(*) from sop_steps) as sop_steps_total,
  (select count(*) from connectors where tenant_id = '{TENANT}' and active) as active_connections,
  (select count(*) from connectors where tenant_id = '{TENANT}' and is_blocked) as blocked_connections,
  (select count(*) from known_rules where tenant_id = '{TENANT}') as governance_rule_count,
  (select count(*) from factory_agreements where tenant_id = '{TENANT}') as agent_agreement_count,
  (select count(*) from brand_messaging where tenant_id = '{TENANT}') as brand_message_count,
  (select count(*) from project_knowledge where tenant_id = '{TENANT}' and is_active) as knowledge_item_count,
  (select count(*) from agents where tenant_id = '{TENANT}' and status = 'active') as active_agents,
  'COMPLETE' as kernel_status""",
    _INVENTORY_TABLES, lambda T: reports.system_inventory(T, TENANT),
)

@query(
    "startup_lists",
    f"""select 'p1_tasks' as section, category as group_key, cast(id as varchar) as item_key, title as label from tasks where status = 'open' and priority = 1
union all select 'agents', status, agent_name, version from agents
union all select 'sop_index', '', sop_id, title from sop_registry where tenant_id = '{TENANT}' and status = 'active'""",
    ["tasks", "agents", "sop_registry"],
)
def startup_lists(T):
    label = F.coalesce(F.get_json_object("item", "$.title"), F.get_json_object("item", "$.version"))
    return reports.startup_lists(T, TENANT).select("section", "group_key", "item_key", label.alias("label"))


# --- evaluation runs -----------------------------------------------------------------------
_RUNS = ["eval_runs"]
_SCORE = "cast(score as double) as score"
report(
    "runs_latest_by_agent",
    f"""select agent_name, model_tested, layer, {_SCORE}, pass, cast(run_date as date) as last_run from eval_runs
qualify row_number() over (partition by agent_name order by run_date desc, id desc) = 1""",
    _RUNS, runs.latest_by_agent, score=2,
)
_LATEST = """select * from eval_runs qualify row_number() over (partition by agent_name, factory_id order by run_date desc, id desc) = 1"""
report(
    "runs_latest_by_agent_and_factory",
    f"""select agent_name, factory_id, factory_tenant, model_tested, layer, {_SCORE}, pass, run_mode, agent_version, agent_sig, cast(run_date as date) as last_run from ({_LATEST}) x""",
    _RUNS, runs.latest_by_agent_and_factory, score=2,
)
report(
    "runs_cross_factory",
    f"""select factory_id, factory_tenant, count(distinct agent_name) as agents_tested, cast(round(sum(score) / count(score), 2) as double) as avg_score,
  cast(sum(case when pass then 1 else 0 end) as bigint) as passed, cast(sum(case when not pass then 1 else 0 end) as bigint) as failed,
  max(cast(run_date as date)) as last_run from ({_LATEST}) x group by factory_id, factory_tenant""",
    _RUNS, runs.cross_factory, avg_score=2,
)
report(
    "runs_compliance_trend",
    f"""select agent_name, factory_id, layer, cast(run_date as date) as run_date, {_SCORE}, pass, model_tested, agent_version, agent_sig, recency from (
  select *, cast(row_number() over (partition by agent_name, factory_id order by run_date desc, id desc) as int) as recency from eval_runs) x where recency <= 10""",
    _RUNS, runs.compliance_trend, score=2,
)
report(
    "runs_drift",
    """select id, agent_name, factory_id, cast(score as double) as current_score, cast(lag(score) over w as double) as previous_score,
  cast(score - lag(score) over w as double) as delta, cast(run_date as date) as run_date
from eval_runs window w as (partition by agent_name, factory_id order by run_date, id)""",
    _RUNS, runs.drift, current_score=2, previous_score=2, delta=2,
)
report(
    "runs_active_failures",
    f"""select lower(agent_name) as agent_name, factory_tenant, layer, {_SCORE}, notes, cast(run_date as date) as run_date from eval_runs r
where pass = false and not exists (select 1 from eval_runs p where lower(p.agent_name) = lower(r.agent_name)
  and p.factory_tenant = r.factory_tenant and p.layer = r.layer and p.pass and p.run_date > r.run_date)""",
    _RUNS, runs.active_failures, score=2,
)
report(
    "runs_history", f"select id, cast(run_date as date) as run_date, agent_name, model_tested, layer, {_SCORE}, pass, notes from eval_runs",
    _RUNS, runs.history, score=2,
)
report(
    "runs_layer1_improvement",
    """select lower(agent_name) as agent_name, factory_tenant, count(*) as total_l1_runs, cast(min(score) as double) as first_score,
  cast(max(score) as double) as best_score, cast(max(score) - min(score) as double) as score_delta, bool_or(pass) as ever_passed, cast(max(run_date) as date) as last_run
from eval_runs where layer = 1 and score is not null and score <= 5 group by 1, 2 having count(*) > 1""",
    _RUNS, runs.layer1_improvement, first_score=2, best_score=2, score_delta=2,
)


def _layer_sql(n: int, extra: str = "") -> str:
    return f"""l{n} as (select lower(agent_name) as agent, score, pass, notes, agent_version, run_date from eval_runs
  where factory_tenant = '{TENANT}' and layer = {n}{extra}
  qualify row_number() over (partition by lower(agent_name) order by run_date desc, id desc) = 1)"""


report(
    "runs_readiness",
    f"""with {_layer_sql(1)}, {_layer_sql(2)}
select coalesce(l1.agent, l2.agent) as agent_name, cast(l1.score as double) as l1_score, l1.pass as l1_pass, cast(l2.score as double) as l2_score, l2.pass as l2_pass,
  case when l1.pass and l2.pass then 'PRODUCTION_READY' when l1.pass and l2.pass is null then 'L1_PASS_AWAITING_L2' when l1.pass = false then 'REWRITE_REQUIRED'
    when l1.pass is null and l2.pass is null then 'NOT_EVALUATED' else 'DEFERRED' end as readiness_tier, l1.notes as l1_notes, l2.notes as l2_notes
from l1 full join l2 on l1.agent = l2.agent""",
    _RUNS, lambda T: runs.readiness(T, TENANT), l1_score=2, l2_score=2,
)
report(
    "runs_canonical_readiness",
    f"""with {_layer_sql(1)}, {_layer_sql(2, " and pass is distinct from false")}
select coalesce(l1.agent, l2.agent) as agent_name, cast(l1.score as double) as l1_score, l1.pass as l1_pass, l1.agent_version as l1_agent_version,
  cast(l1.run_date as date) as l1_run_date, cast(l2.score as double) as l2_score, l2.pass as l2_pass, cast(l2.run_date as date) as l2_run_date,
  case when l1.pass and l2.pass then 'PRODUCTION_READY' when l1.pass and (l2.pass is null or not l2.pass) then 'L1_PASS_AWAITING_L2'
    when l1.pass = false then 'REWRITE_REQUIRED' when l1.pass is null then 'NOT_EVALUATED' else 'DEFERRED' end as readiness_tier
from l1 full join l2 on l1.agent = l2.agent""",
    _RUNS, lambda T: runs.canonical_readiness(T, TENANT), l1_score=2, l2_score=2,
)
report(
    "runs_factory_coverage",
    """select factory_tenant, count(distinct lower(agent_name)) as agents_tested, count(distinct lower(agent_name)) filter (where pass) as agents_passed,
  count(distinct lower(agent_name)) filter (where not pass) as agents_failed, count(distinct lower(agent_name)) filter (where pass is null) as agents_unscored,
  max(run_date) as last_eval from eval_runs group by factory_tenant""",
    _RUNS, runs.factory_coverage,
)
report(
    "runs_factory_coverage_estimated", None, _RUNS, lambda T: runs.factory_coverage_estimated(kept(runs.agent_sketches(T), "sketches")),
)
report(
    "runs_rewrite_queue",
    f"""select lower(agent_name) as agent_name, cast(score as double) as l1_score, notes as reviewer_notes, run_date from eval_runs
where layer = 1 and (pass = false or pass is null) and factory_tenant = '{TENANT}'""",
    _RUNS, lambda T: runs.rewrite_queue(T, TENANT), l1_score=2,
)
report(
    "runs_layer2_coverage",
    """select factory_tenant, count(distinct lower(agent_name)) as agents_with_l2, count(*) as total_l2_runs, count(*) filter (where pass) as l2_passes,
  count(*) filter (where pass is null) as unscored,
  count(*) filter (where json_extract_string(criteria_results, '$.correction_evidence_found') = 'true') as correction_evidence_found,
  count(*) filter (where coalesce(json_extract_string(criteria_results, '$.insufficient_evidence') = 'true', false)
    or coalesce(cast(json_extract(criteria_results, '$.evidence_samples') as varchar) = '0', false)) as insufficient_evidence,
  cast(max(run_date) as date) as last_collection from eval_runs where layer = 2 group by factory_tenant""",
    _RUNS, runs.layer2_coverage,
)
