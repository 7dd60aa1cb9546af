"""Health, coverage, task and session reports.

Every report makes one pass over each table it reads.  Reports that the source
presents in a certain order are returned unordered unless a limit depends on it;
callers sort at the end.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lorebase.functions.columns import count_if
from lorebase.operators.embedding import is_pending

# Fixed values of the source.
TASK_CATEGORIES = ["SITE", "BUILD", "CONTENT", "INFRA", "OPS", "GATE"]
PRIORITIES = {"critical": 1, "high": 2, "normal": 3, "low": 4}
CONTENT_ORDER = ["approved", "staged", "draft", "published"]
DOCTRINE_TYPE = "brand-doctrine"
DOCTRINE_CATEGORIES = ["origin-story", "brand-identity"]
DOCTRINE_SUB_TYPES = ["voice-canon", "sideways-language", "human-cyber-work-teams", "closing-line", "hero-claim"]
PREVIEW = 200


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def is_open():
    return F.col("status") == "open"


# --- embeddings, retrieval, memory ---------------------------------------------------
def embedding_health(T) -> DataFrame:
    """Per tier and tenant: rows, embedded, stale, models, first and last embedding."""
    def tier(name):
        return (
            T[name].groupBy("tenant_id").agg(
                F.count("*").alias("total_rows"),
                F.count("embedding").alias("embedded"),
                count_if(F.col("embedding").isNull()).alias("unembedded"),
                count_if(F.col("embedding_stale")).alias("stale"),
                F.count_distinct("model_version").alias("distinct_models"),
                F.min("embedded_at").alias("oldest_embed"),
                F.max("embedded_at").alias("newest_embed"),
            ).withColumn("tier", F.lit(name))
        )

    return tier("semantic_index").unionByName(tier("document_chunks"))


def unhealthy_tiers(health: DataFrame) -> DataFrame:
    """Tiers that break the contract: nothing stale or unembedded, one model."""
    return health.filter("stale > 0 or unembedded > 0 or distinct_models <> 1")


def retrieval_health(T) -> DataFrame:
    return T["retrieval_events"].groupBy("tenant_id").agg(
        F.count("*").alias("event_count"),
        count_if(F.col("used_vector")).alias("vector_event_count"),
        count_if(~F.col("used_vector")).alias("fts_only_event_count"),
        F.round(F.avg(F.col("latency_ms").cast("decimal(18,0)")), 2).alias("avg_latency_ms"),
        F.max("created_at").alias("last_event_at"),
    )


def memory_usage(T) -> DataFrame:
    search = F.col("event_type") == "brain_search"
    return T["session_log"].groupBy("tenant_id", "session_id").agg(
        count_if(search).alias("brain_searches"),
        count_if(F.col("event_type") == "session_open").alias("session_opens"),
        F.max(F.when(search, F.col("created_at"))).alias("last_brain_search"),
        F.when(count_if(search) == 0, "dark").otherwise("active").alias("brain_status"),
    )


def catalog_coverage(T, tenant: str) -> DataFrame:
    """Source rows against catalog rows per source table, with what waits for a vector."""
    tables = [
        "tasks", "decisions", "brand_messaging", "project_knowledge",
        "known_rules", "sop_registry", "agent_identity", "mcp_registry",
    ]

    def expected(name):
        rows = T["connectors" if name == "mcp_registry" else name].filter(F.col("tenant_id") == tenant)
        if name == "project_knowledge":
            rows = rows.filter(F.coalesce(F.col("is_active"), F.lit(True)))
        return rows.agg(F.count("*").alias("source_rows")).withColumn("source_table", F.lit(name))

    indexed = T["semantic_index"].filter(F.col("tenant_id") == tenant).groupBy("source_table").agg(
        F.count("*").alias("tier1_rows"), count_if(is_pending()).alias("pending_embed")
    )
    held = F.coalesce("tier1_rows", F.lit(0))
    return (
        _union([expected(t) for t in tables])
        .join(indexed, "source_table", "left")
        .select(
            "source_table", "source_rows", held.alias("tier1_rows"),
            F.coalesce("pending_embed", F.lit(0)).alias("pending_embed"),
            F.when((held == 0) & (F.col("source_rows") > 0), "MISSING")
            .when(held < F.col("source_rows"), "PARTIAL").otherwise("OK").alias("coverage_status"),
        )
    )


# --- tasks ----------------------------------------------------------------------------
def task_counts(tasks: DataFrame) -> DataFrame:
    opened = is_open()
    return tasks.agg(
        count_if(opened).alias("open_tasks"),
        *[count_if(opened & (F.col("priority") == p)).alias(name) for name, p in PRIORITIES.items()],
        *[count_if(opened & (F.col("category") == c)).alias(f"{c.lower()}_tasks") for c in TASK_CATEGORIES],
    )


def task_dashboard(T) -> DataFrame:
    """One row: open tasks by urgency and category, agents, the last session."""
    agents = T["agents"].agg(
        F.struct(
            count_if(F.col("status") == "active").alias("active_agents"),
            count_if(F.col("status") == "standalone").alias("standalone_agents"),
        ).alias("v")
    )
    last = T["sessions"].agg(
        F.max_by(
            F.struct(F.col("session_date").alias("last_session_date"), F.col("platform").alias("last_platform"), "resume_notes"),
            F.struct("session_date", "id"),
        ).alias("v")
    )
    one = task_counts(T["tasks"]).withColumns({"_a": agents.scalar(), "_s": last.scalar()})
    return one.select("*", "_a.*", "_s.*").drop("_a", "_s")


def _blockers(T) -> DataFrame:
    return T["tasks"].select(
        F.col("id").alias("blocker_id"), F.col("title").alias("blocker_title"), F.col("status").alias("blocker_status")
    )


def _open_with_blocker(T, how: str) -> DataFrame:
    return T["tasks"].filter(is_open()).join(_blockers(T), F.col("blocked_by") == F.col("blocker_id"), how)


def open_tasks(T) -> DataFrame:
    return _open_with_blocker(T, "left").select(
        "id", "priority", "category", "owner", "title", "description", "ref_id", "blocked_by",
        F.col("blocker_title").alias("blocked_by_title"), F.to_date("created_at").alias("added"),
    )


def actionable_tasks(T) -> DataFrame:
    ready = F.col("blocked_by").isNull() | (F.col("blocker_status") == "closed")
    return _open_with_blocker(T, "left").filter(ready).select("id", "priority", "category", "owner", "title", "ref_id")


def blocked_tasks(T) -> DataFrame:
    return _open_with_blocker(T, "inner").select(
        "id", "priority", "category", F.col("title").alias("blocked_task"), "blocker_id", "blocker_title", "blocker_status"
    )


def tasks_by_owner(T) -> DataFrame:
    return T["tasks"].filter(is_open()).groupBy("owner").agg(
        F.count("*").alias("open_tasks"),
        *[F.sum(F.when(F.col("priority") == p, 1).otherwise(0)).alias(n) for n, p in PRIORITIES.items()],
        F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("_c"),
    ).withColumn("categories", F.when(F.col("_c") != "", F.col("_c"))).drop("_c")


def open_tasks_of(T, category: str) -> DataFrame:
    return T["tasks"].filter(is_open() & (F.col("category") == category)).select(
        "id", "priority", "owner", "ref_id", "title", "description"
    )


# --- people, sessions, content ----------------------------------------------------------
def agent_roster(T) -> DataFrame:
    place = F.when(F.col("factory") == "closed_factory", 1).when(F.col("factory") == "standalone", 2).otherwise(3)
    return T["agents"].select(
        "agent_name", "factory", "status", "role", "version", "state_sig", "source_file",
        F.to_date("updated_at").alias("last_updated"), place.alias("roster_group"),
    )


def recent_sessions(T, n: int = 5) -> DataFrame:
    newest = T["sessions"].orderBy(F.desc("session_date"), F.desc("id")).limit(n)
    return newest.select("session_date", "platform", "session_type", "summary", "resume_notes", "agents_active")


def decisions_log(T) -> DataFrame:
    return T["decisions"].select("decision_date", "category", "title", "decision", "rationale", "made_by")


def content_workflow(T) -> DataFrame:
    place = F.array_position(F.lit(CONTENT_ORDER), F.col("status"))
    return T["content_staging"].filter("status <> 'archived'").select(
        "id", "title", "content_type", "status", "assigned_to", "target_page_id",
        F.col("file_path").isNotNull().alias("has_file"),
        F.to_date("created_at").alias("created_date"), F.to_date("published_at").alias("published_date"),
        F.when(place > 0, place).cast("int").alias("status_order"),
    )


def active_research(T) -> DataFrame:
    return T["research"].filter("status = 'active'").select(
        "id", "topic", F.left("summary", F.lit(PREVIEW)).alias("summary_preview"), "tags", "collected_by", "session_id",
        F.to_date("created_at").alias("collected_date"),
    )


def file_rollup(T) -> DataFrame:
    return T["file_registry"].groupBy("category").agg(
        F.count("*").alias("file_count"),
        F.sum(F.when(F.col("conversion_required"), 1).otherwise(0)).alias("needs_conversion"),
    )


def active_procedures(T) -> DataFrame:
    return T["sop_registry"].filter("status = 'active'").select(
        "sop_id", "title", "version", "owner", "trigger_condition", "trigger_phrases", "summary", "status", "file_path", "updated_at"
    )


def doctrine(T, tenant: str, source_type: str = DOCTRINE_TYPE) -> DataFrame:
    """Chunks of one source type and selected messages, tagged by layer."""
    chunks = T["document_chunks"].filter((F.col("tenant_id") == tenant) & (F.col("source_type") == source_type)).select(
        F.lit("doctrine").alias("layer"), F.col("source_name").alias("source"), F.col("chunk_index").alias("ord"), "content"
    )
    chosen = F.col("category").isin(DOCTRINE_CATEGORIES) | F.col("sub_type").isin(DOCTRINE_SUB_TYPES)
    messages = T["brand_messaging"].filter((F.col("tenant_id") == tenant) & chosen).select(
        F.lit("distilled").alias("layer"), F.concat("category", F.lit("/"), "sub_type").alias("source"),
        F.col("id").alias("ord"), "content",
    )
    return chunks.unionByName(messages)


def settings(T, tenant: str) -> DataFrame:
    return T["factory_config"].filter(F.col("tenant_id") == tenant).select("key", "category", "value", "notes", "updated_at", "updated_by")


def settings_object(T, tenant: str, category: str) -> DataFrame:
    """Settings of one category as a single map; the key is unique within a tenant."""
    rows = settings(T, tenant).filter(F.col("category") == category)
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    return rows.agg(F.to_json(F.map_from_entries(pairs)).alias("settings"))


def lanes(T) -> DataFrame:
    return T["factory_lanes"].select(
        "lane", "tenant_id", "owner_agents", "reviewer_agent", "parallel_eligible", "exclusive_resources", "notes"
    )


def claims(T) -> DataFrame:
    return T["work_claims"].select(
        "id", "tenant_id", "resource_type", "resource_id", "claimed_by", "session_id", "claimed_at", "expires_at",
        "released_at", "released_by", "status", "factory_id", "platform", "claim_note",
    )


def active_claims(T) -> DataFrame:
    return claims(T).filter("status = 'active'")


# --- whole-system reports -----------------------------------------------------------------
_DATASETS = [
    "factory_config", "known_rules", "sop_registry", "sop_steps", "connectors",
    "session_log", "brand_messaging", "project_knowledge", "agents", "factory_agreements",
]
_REQUIRED = ["sop_steps", "connectors", "brand_messaging", "project_knowledge"]


def system_inventory(T, tenant: str, present=None) -> DataFrame:
    """One row: which datasets exist, how many rows count, complete or not.

    ``present`` is the dataset manifest; by default everything the store can name.
    """
    present = set(_DATASETS if present is None else present)
    mine = F.col("tenant_id") == tenant

    def count(table, condition=None):
        if table not in present:
            return F.lit(0).cast("long")
        rows = T[table] if condition is None else T[table].filter(condition)
        return rows.agg(F.count("*")).scalar()

    links = count("connectors", mine & F.col("active")), count("connectors", mine & F.col("is_blocked"))
    complete = all(d in present for d in _REQUIRED)
    return T.spark.range(1).select(
        *[F.lit(d in present).alias(f"has_{d}") for d in _DATASETS],
        count("sop_registry", mine & (F.col("status") == "active")).alias("active_sops"),
        count("sop_steps").alias("sop_steps_total"),
        links[0].alias("active_connections"),
        links[1].alias("blocked_connections"),
        count("known_rules", mine).alias("governance_rule_count"),
        count("factory_agreements", mine).alias("agent_agreement_count"),
        count("brand_messaging", mine).alias("brand_message_count"),
        count("project_knowledge", mine & F.col("is_active")).alias("knowledge_item_count"),
        count("agents", mine & (F.col("status") == "active")).alias("active_agents"),
        F.lit("COMPLETE" if complete else "INCOMPLETE").alias("kernel_status"),
    )


def current_session(T) -> DataFrame:
    """The session with the largest id, one row."""
    return T["sessions"].agg(
        F.max_by(F.struct("id", "session_date", "platform", "session_type", "resume_notes"), "id").alias("s")
    ).select(F.col("s.id").alias("last_session_id"), "s.session_date", "s.platform", "s.session_type", "s.resume_notes")


def json_object_of(rows: DataFrame, key: str, value) -> DataFrame:
    """One JSON object from a small rollup, NULL when there are no rows."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))))
    return rows.filter(F.col(key).isNotNull()).agg(
        F.when(F.count("*") > 0, F.to_json(F.map_from_entries(entries))).alias("o")
    )


def startup_summary(T, tenant: str) -> DataFrame:
    """One row about the last session with rollups as JSON; each rollup is small by
    construction (a few categories, two tiers, a handful of counters)."""
    from lorebase.operators import governance

    opened = T["tasks"].filter(is_open())
    by_category = json_object_of(opened.groupBy("category").agg(F.count("*").alias("n")), "category", F.col("n"))
    health = embedding_health(T).filter(F.col("tenant_id") == tenant)
    health = json_object_of(
        health, "tier",
        F.struct(F.col("total_rows").alias("total"), "embedded", "stale", "unembedded"),
    )
    scans = governance.retired_term_counts(T, tenant)
    counters = governance.governance_health(T, tenant).agg(F.to_json(F.first(F.struct("*"))).alias("o"))
    return current_session(T).withColumns({
        "open_tasks": by_category.scalar(),
        "open_task_total": opened.agg(F.count("*")).scalar(),
        "embedding_health": health.scalar(),
        "decommissioned_terms": scans.agg(F.to_json(F.first(F.struct("*"))).alias("o")).scalar(),
        "governance_health": counters.scalar(),
    })


def startup_lists(T, tenant: str) -> DataFrame:
    """The long lists of the startup report, one row per item: section, sort key, item.

    The source packs each list into one JSON value; rows keep them distributed
    whatever their length.
    """
    urgent = T["tasks"].filter(is_open() & (F.col("priority") == 1)).select(
        F.lit("p1_tasks").alias("section"), F.col("category").alias("group_key"), F.col("id").cast("string").alias("item_key"),
        F.to_json(F.struct("id", "title", "category", "owner")).alias("item"),
    )
    agents = T["agents"].select(
        F.lit("agents").alias("section"), F.col("status").alias("group_key"), F.col("agent_name").alias("item_key"),
        F.to_json(F.struct(F.col("agent_name").alias("name"), "version", F.col("state_sig").alias("sig"), "status")).alias("item"),
    )
    procedures = T["sop_registry"].filter((F.col("tenant_id") == tenant) & (F.col("status") == "active")).select(
        F.lit("sop_index").alias("section"), F.lit("").alias("group_key"), F.col("sop_id").alias("item_key"),
        F.to_json(F.struct("sop_id", "title", "summary", "trigger_phrases")).alias("item"),
    )
    return urgent.unionByName(agents).unionByName(procedures)
