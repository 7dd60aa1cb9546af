"""Data model as data: column types, defaults, keys, checks and references.

Types cover the tables whose readers need them fixed; other tables keep the
types of their Parquet files.
"""

from dataclasses import dataclass

DEFAULT_TENANT = "main"

# Column names and types of the central tables.
SCHEMAS = {
    "semantic_index": "id bigint, tenant_id string, source_table string, source_id string, entity_type string, "
    "summary_text string, embedding array<float>, model_version string, embedded_at timestamp, "
    "embedding_stale boolean, authority_tier string",
    "document_chunks": "id bigint, source_type string, source_id bigint, chunk_index bigint, content string, "
    "source_name string, tenant_id string, embedding array<float>, model_version string, embedded_at timestamp, "
    "embedding_stale boolean",
    "project_knowledge": "id bigint, tenant_id string, knowledge_type string, title string, detail string, is_active boolean",
    "brand_messaging": "id bigint, tenant_id string, category string, sub_type string, content string",
    "decisions": "id bigint, decision_date date, tenant_id string, category string, title string, decision string, "
    "rationale string, made_by string",
    "known_rules": "id bigint, tenant_id string, category string, rule string, rule_type string, applies_to string, enforcement string, "
    "updated_at timestamp_ntz",
    "tasks": "id bigint, tenant_id string, category string, title string, description string, status string, owner string, "
    "priority int, blocked_by bigint, created_at timestamp_ntz, ref_id string",
    "retrieval_events": "id bigint, tenant_id string, search_function string, used_vector boolean, latency_ms int, "
    "created_at timestamp_ntz, query_text string, result_ids string",
    "eval_cases": "case_id string, tenant_id string, query_text string, target_function string, active boolean, expected_sources string",
    "eval_results": "result_id bigint, run_id bigint, case_id string, top_k int, returned_sources string, expected_found boolean, "
    "first_match_rank int, latency_ms int, created_at timestamp_ntz",
    "eval_runs": "id bigint, run_date timestamp_ntz, agent_name string, layer int, score decimal(5,2), pass boolean, "
    "criteria_results string, factory_id string, factory_tenant string, session_id int, model_tested string, agent_version string, notes string, "
    "run_mode string, agent_sig string",
    "sop_registry": "sop_id string, tenant_id string, title string, summary string, full_body string, status string, domain string, "
    "trigger_phrases array<string>, version string, owner string, trigger_condition string, file_path string, updated_at timestamp_ntz",
    "factory_agreements": "id int, tenant_id string, agent_name string, agreement_version string, required_rule_types array<string>, "
    "enforcement_model string",
    "sessions": "id int, session_date date, tenant_id string, platform string, session_type string, resume_notes string, "
    "summary string, agents_active array<string>",
    "connectors": "connector_id string, tenant_id string, display_name string, criticality string, active boolean, is_blocked boolean, "
    "block_reason string, platform_availability array<string>, probe_status string, category string, agent_primary string, "
    "fallback_behavior string, last_probed_at timestamp_ntz",
    "session_status": "session_id int, connector_id string, tenant_id string, probe_result string, fallback_active boolean, "
    "platform string, probe_note string, probed_at timestamp_ntz",
    "session_log": "id bigint, tenant_id string, session_id string, event_type string, created_at timestamp_ntz",
    "work_claims": "id bigint, tenant_id string, resource_type string, resource_id string, claimed_by string, status string, "
    "claimed_at timestamp_ntz, session_id int, expires_at timestamp_ntz, released_at timestamp_ntz, released_by string, factory_id string, "
    "platform string, claim_note string",
    "agents": "agent_name string, tenant_id string, callsign string, primary_domain string, voice_anchor string, status string, factory string, "
    "role string, version string, state_sig bigint, updated_at timestamp_ntz, source_file string",
    "agent_identity": "agent_name string, tenant_id string, callsign string, primary_domain string, voice_anchor string",
    "content_staging": "id bigint, title string, content_type string, status string, file_path string, assigned_to string, research_id bigint, "
    "session_id int, target_page_id string, created_at timestamp_ntz, published_at timestamp_ntz",
    "research": "id bigint, topic string, summary string, status string, collected_by string, superseded_by bigint, session_id int, "
    "tags array<string>, created_at timestamp_ntz",
    "file_registry": "id bigint, file_path string, category string, conversion_required boolean",
    "factory_config": "key string, value string, category string, tenant_id string, notes string, updated_at timestamp_ntz, updated_by string",
    "factory_lanes": "lane string, tenant_id string, owner_agents array<string>, parallel_eligible boolean, reviewer_agent string, "
    "exclusive_resources array<string>, notes string",
}

# What a missing value stands for.
DEFAULTS = {
    "semantic_index": {"tenant_id": DEFAULT_TENANT, "embedding_stale": False, "authority_tier": "operational"},
    "document_chunks": {"tenant_id": DEFAULT_TENANT, "embedding_stale": False},
    "project_knowledge": {"tenant_id": DEFAULT_TENANT, "is_active": True},
    "brand_messaging": {"tenant_id": DEFAULT_TENANT},
    "decisions": {"tenant_id": DEFAULT_TENANT},
    "known_rules": {"tenant_id": DEFAULT_TENANT},
    "tasks": {"status": "open", "priority": 3},
    "retrieval_events": {"tenant_id": DEFAULT_TENANT, "result_ids": "[]"},
    "eval_cases": {"tenant_id": DEFAULT_TENANT, "active": True, "expected_sources": "[]"},
    "eval_results": {"top_k": 10, "returned_sources": "[]", "expected_found": False},
    "eval_runs": {"criteria_results": "{}"},
    "sop_registry": {"tenant_id": DEFAULT_TENANT, "status": "active"},
    "connectors": {"tenant_id": DEFAULT_TENANT, "active": True, "is_blocked": False, "probe_status": "unknown", "criticality": "standard"},
    "session_status": {"tenant_id": DEFAULT_TENANT, "fallback_active": False},
    "session_log": {"tenant_id": DEFAULT_TENANT},
    "work_claims": {"tenant_id": DEFAULT_TENANT, "status": "active"},
}

# Primary and unique keys.
KEYS: dict[str, list[list[str]]] = {
    "semantic_index": [["id"], ["tenant_id", "source_table", "source_id"]],
    "document_chunks": [["id"], ["tenant_id", "source_type", "source_name", "chunk_index"]],
    "project_knowledge": [["id"]],
    "research": [["id"]],
    "file_registry": [["id"], ["file_path"]],
    "brand_messaging": [["id"]],
    "content_staging": [["id"]],
    "agent_identity": [["agent_name"]],
    "agents": [["agent_name"]],
    "decisions": [["id"]],
    "decommissioned_terms": [["tenant_id", "term"]],
    "decommissioned_term_allowlist": [["tenant_id", "source_table", "source_id", "term"]],
    "factory_agreements": [["id"], ["tenant_id", "agent_name"]],
    "factory_config": [["key", "tenant_id"]],
    "factory_lanes": [["tenant_id", "lane"]],
    "sessions": [["id"]],
    "known_rules": [["id"]],
    "connectors": [["connector_id"]],
    "session_status": [["session_id", "connector_id"]],
    "eval_runs": [["id"]],
    "tasks": [["id"]],
    "sop_registry": [["sop_id"]],
    "sop_steps": [["id"], ["sop_id", "step_number"]],
    "session_log": [["id"]],
    "retrieval_events": [["id"]],
    "eval_cases": [["case_id"]],
    "work_claims": [["id"]],
    "profile": [["agent_name"]],
    "profile_version": [["id"], ["agent_name", "version"]],
    "profile_bible": [["id"]],
    "profile_voice": [["id"]],
    "profile_lane": [["id"]],
    "profile_archetype": [["id"], ["version_id", "layer"]],
    "profile_dimension": [["id"], ["version_id", "dimension"]],
    "profile_strength": [["id"], ["version_id", "strength"]],
    "profile_tool": [["id"], ["version_id", "tool_name"]],
    "profile_build": [["id"]],
    "profile_asset": [["id"], ["agent_name", "asset_type", "variant"]],
    "profile_export_target": [["id"], ["agent_name", "target_type"]],
    "profile_drift_check": [["id"]],
    "profile_eval_criteria": [["id"], ["agent_name", "criterion"]],
    "profile_provenance": [["id"]],
    "agent_memory": [["id"]],
    "brand_assets": [["id"], ["rel_path"]],
    "signature_log": [["id"]],
    "process_changelog": [["id"]],
    "sample_suite": [["id"]],
    "eval_batches": [["run_id"]],
    "eval_results": [["result_id"]],
}

# Fixed value: a key that holds only among some rows.
PARTIAL_KEYS = {"work_claims": ("status = 'active'", ["tenant_id", "resource_type", "resource_id"])}


def _one_of(column: str, values: str) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values.split())})"


_TARGETS = "l1_skill plugin_skill gpt l2_agent roster_card voice_avatar"

# Rules a row must not break; NULL breaks none.
CHECKS: dict[str, dict[str, str]] = {
    "project_knowledge": {"knowledge_type": _one_of(
        "knowledge_type", "framework project-context design-standard operator-context product architecture process")},
    "research": {"status": _one_of("status", "active archived superseded")},
    "semantic_index": {"authority_tier": _one_of("authority_tier", "sacred canon operational experimental archived deprecated")},
    "brand_messaging": {"category": _one_of(
        "category", "differentiator pitch consideration-pitch objection cta verbal-identity product-messaging origin-story brand-identity")},
    "content_staging": {
        "content_type": _one_of("content_type", "article post page-copy blurb social email"),
        "status": _one_of("status", "draft staged approved published archived"),
    },
    "profile": {"factory_type": _one_of("factory_type", "closed standalone")},
    "factory_agreements": {"enforcement_model": _one_of("enforcement_model", "halt_on_missing advisory_only")},
    "known_rules": {
        "enforcement": _one_of("enforcement", "advisory required halt"),
        "rule_type": _one_of("rule_type", "routing voice behavior sop gate brand infra"),
        "category_length": "length(category) <= 50",
    },
    "connectors": {"criticality": _one_of("criticality", "critical standard enhancement")},
    "eval_runs": {"layer": "layer in (1, 2)", "score_range": "abs(score) < 1000"},
    "profile_archetype": {"layer": _one_of(
        "layer", "primary character_flavor operational_mode crisis_mode deep_function ethic")},
    "eval_cases": {
        "expected_sources": "expected_sources like '[%]'",
        "target_function": _one_of("target_function", "fn_search_semantic fn_search_documents"),
    },
    "retrieval_events": {"latency_ms": "latency_ms >= 0", "result_ids": "result_ids like '[%]'"},
    "session_log": {"event_type": _one_of(
        "event_type", "session_open session_close agent_handoff brand_review_pending brand_approved mcp_failure "
        "connector_blind_use task_opened task_closed sig_updated decision_logged file_write operator_decision_required brain_search")},
    "session_status": {"probe_result": _one_of("probe_result", "connected unavailable blocked untested")},
    "work_claims": {"status": _one_of("status", "active released expired")},
    "decisions": {"title_length": "length(title) <= 200"},
    "tasks": {"title_length": "length(title) <= 120"},
    "sop_registry": {"domain": _one_of("domain", "governance orchestration operations brand product-agents infrastructure")},
    "profile_version": {"review_status": _one_of("review_status", "draft in_review approved published superseded")},
    "profile_asset": {"asset_type": _one_of("asset_type", "thumbnail badge icon full_body wordmark")},
    "profile_build": {"target_type": _one_of("target_type", _TARGETS)},
    "profile_export_target": {
        "status": _one_of("status", "pending generated published stale retired"),
        "target_type": _one_of("target_type", _TARGETS),
    },
    "profile_drift_check": {"result": _one_of("result", "pass warn fail untested")},
    "profile_eval_criteria": {"severity": _one_of("severity", "blocker warn")},
    "sample_suite": {"quality": _one_of("quality", "gold silver bronze")},
    "eval_batches": {"embedding_mode": _one_of("embedding_mode", "fts_only hybrid")},
    "eval_results": {
        "first_match_rank": "first_match_rank > 0",
        "latency_ms": "latency_ms >= 0",
        "returned_sources": "returned_sources like '[%]'",
        "top_k": "top_k > 0",
    },
}


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str
    parent_column: str
    on_delete: str  # cascade, null or none


# References between tables and what a deleted parent does.
REFERENCES = [
    Reference("research", "session_id", "sessions", "id", "null"),
    Reference("research", "superseded_by", "research", "id", "null"),
    Reference("content_staging", "research_id", "research", "id", "null"),
    Reference("content_staging", "session_id", "sessions", "id", "null"),
    Reference("eval_runs", "session_id", "sessions", "id", "null"),
    Reference("eval_results", "case_id", "eval_cases", "case_id", "cascade"),
    Reference("eval_results", "run_id", "eval_batches", "run_id", "cascade"),
    Reference("agent_identity", "agent_name", "agents", "agent_name", "none"),
    Reference("profile_version", "agent_name", "profile", "agent_name", "cascade"),
    Reference("profile", "current_version", "profile_version", "id", "none"),
    Reference("profile_archetype", "version_id", "profile_version", "id", "cascade"),
    Reference("profile_bible", "version_id", "profile_version", "id", "cascade"),
    Reference("profile_dimension", "version_id", "profile_version", "id", "cascade"),
    Reference("profile_lane", "version_id", "profile_version", "id", "cascade"),
    Reference("profile_strength", "version_id", "profile_version", "id", "cascade"),
    Reference("profile_tool", "version_id", "profile_version", "id", "cascade"),
    Reference("profile_voice", "version_id", "profile_version", "id", "cascade"),
    Reference("profile_asset", "agent_name", "profile", "agent_name", "cascade"),
    Reference("profile_drift_check", "agent_name", "profile", "agent_name", "cascade"),
    Reference("profile_drift_check", "export_target_id", "profile_export_target", "id", "cascade"),
    Reference("profile_drift_check", "version_id", "profile_version", "id", "null"),
    Reference("profile_eval_criteria", "agent_name", "profile", "agent_name", "none"),
    Reference("profile_export_target", "agent_name", "profile", "agent_name", "cascade"),
    Reference("profile_export_target", "generated_from_version", "profile_version", "id", "none"),
    Reference("profile_provenance", "agent_name", "profile", "agent_name", "cascade"),
    Reference("profile_provenance", "version_id", "profile_version", "id", "cascade"),
    Reference("profile_build", "agent_name", "profile", "agent_name", "none"),
    Reference("profile_build", "version_id", "profile_version", "id", "none"),
    Reference("session_status", "connector_id", "connectors", "connector_id", "none"),
    Reference("session_status", "session_id", "sessions", "id", "cascade"),
    Reference("sop_steps", "sop_id", "sop_registry", "sop_id", "cascade"),
    Reference("tasks", "blocked_by", "tasks", "id", "none"),
]
