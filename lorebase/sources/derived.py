"""Knowledge-store tables derived from the star-schema test tables.

Each table is one SQL text that runs unchanged in Spark and in the checking
engine, so that both sides read the same rows.  A text may read raw parquet
tables and other derived tables; ``with_clause`` strings them together.
"""

import re

from pyspark.sql import DataFrame, SparkSession

from lorebase.sources.scratch import scratch_path

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

DERIVED = {
    # --- the two memory tiers -------------------------------------------------
    "semantic_index": """
select d.doc_id as id, 't' || cast(d.doc_id % 3 as string) as tenant_id,
  case d.doc_id % 8 when 0 then 'project_knowledge' when 1 then 'brand_messaging' when 2 then 'agent_identity'
    when 3 then 'decisions' when 4 then 'known_rules' when 5 then 'sop_registry' when 6 then 'tasks' else 'document_chunks' end as source_table,
  case d.doc_id % 8 when 2 then 'agent' || cast(d.doc_id as string) when 5 then 'SOP-' || cast(d.doc_id as string)
    else cast(d.doc_id as string) end as source_id,
  d.source as entity_type, d.text as summary_text, e.embedding as embedding,
  case when e.vec_id is null then null else 'model-' || cast(e.label % 2 as string) end as model_version,
  case when e.vec_id is null then null else cast('2024-01-0' || cast(1 + d.doc_id % 9 as string) || ' 00:00:00' as timestamp) end as embedded_at,
  d.doc_id % 11 = 0 as embedding_stale,
  case d.doc_id % 6 when 0 then 'sacred' when 1 then 'canon' when 2 then 'operational' when 3 then 'experimental'
    when 4 then 'archived' else 'deprecated' end as authority_tier
from documents d left join embeddings e on e.vec_id = d.doc_id and d.doc_id % 5 <> 4""",
    "document_chunks": """
select c.conv_id * 1000 + c.turn as id, c.role as source_type, c.conv_id as source_id, c.turn as chunk_index, c.text as content,
  'conv-' || cast(c.conv_id as string) as source_name, 't' || cast(c.conv_id % 3 as string) as tenant_id,
  e.embedding as embedding, case when e.vec_id is null then null else 'model-0' end as model_version,
  case when e.vec_id is null then null else cast('2024-02-0' || cast(1 + c.turn % 9 as string) || ' 00:00:00' as timestamp) end as embedded_at,
  (c.conv_id + c.turn) % 9 = 0 as embedding_stale
from (select *, (conv_id * 7 + turn) % (select count(*) from embeddings) as vec from conversations) c
left join embeddings e on e.vec_id = c.vec and c.turn % 4 <> 3""",
    # --- source tables --------------------------------------------------------
    "known_rules": """
select case when doc_id % 40 = 4 then doc_id + 1000000 else doc_id end as id, 't' || cast(doc_id % 3 as string) as tenant_id,
  case when doc_id % 5 = 0 then 'startup' else 'cat' || cast(doc_id % 7 as string) end as category,
  'See SOP-' || cast(doc_id % 60 as string) || ' and SOP-' || cast(doc_id % 7 as string) || '. ' || text as rule,
  case doc_id % 7 when 0 then 'routing' when 1 then 'voice' when 2 then 'behavior' when 3 then 'sop' when 4 then 'gate'
    when 5 then 'brand' else 'infra' end as rule_type,
  case doc_id % 9 when 0 then 'all' when 1 then 'all-agents' when 2 then 'agent3' when 3 then '{agent1,agent2}'
    when 4 then '{agent4, agent5}' when 5 then '["agent6" , "Agent7"]' when 6 then '' when 7 then null else 'agent8' end as applies_to,
  case doc_id % 4 when 0 then 'halt' when 1 then 'required' else 'advisory' end as enforcement,
  cast('2024-03-0' || cast(1 + doc_id % 9 as string) || ' 12:00:00' as timestamp) as updated_at
from documents""",
    "project_knowledge": """
select case when doc_id % 40 = 0 then doc_id + 1000000 else doc_id end as id, 't' || cast(doc_id % 3 as string) as tenant_id,
  case doc_id % 3 when 0 then 'framework' when 1 then 'product' else 'process' end as knowledge_type,
  lang || ' note from ' || source as title, text as detail,
  case doc_id % 6 when 0 then null when 2 then false else true end as is_active
from documents""",
    "brand_messaging": """
select doc_id as id, 't' || cast(doc_id % 3 as string) as tenant_id,
  case doc_id % 4 when 0 then 'pitch' when 1 then 'origin-story' else 'cta' end as category,
  case doc_id % 5 when 1 then 'manifest-a' when 3 then 'voice-canon' else null end as sub_type, text as content
from documents""",
    "decisions": """
select doc_id as id, cast('2024-02-' || lpad(cast(1 + doc_id % 28 as string), 2, '0') as date) as decision_date,
  't' || cast(doc_id % 3 as string) as tenant_id, lang as category, lang || ' ruling on ' || source as title,
  text as decision, case when doc_id % 5 = 0 then null else source end as rationale,
  'agent' || cast(doc_id % 12 as string) as made_by
from documents""",
    "sop_registry": """
select 'SOP-' || cast(item_id as string) as sop_id, 't' || cast(item_id % 3 as string) as tenant_id, 'Procedure ' || cast(item_id as string) as title,
  case when item_id % 5 = 0 then null else text end as summary, text as full_body,
  case item_id % 10 when 7 then 'deprecated' when 8 then 'tombstoned' else 'active' end as status,
  case item_id % 6 when 0 then null when 1 then 'brand' when 2 then 'finance' else 'operations' end as domain,
  case when item_id % 4 = 0 then null else split('run ' || cast(item_id as string) || ',start', ',') end as trigger_phrases,
  '1.' || cast(item_id % 3 as string) as version, 'agent' || cast(item_id % 12 as string) as owner,
  case when item_id % 3 = 0 then null else 'on request' end as trigger_condition, 'sops/' || cast(item_id as string) || '.md' as file_path,
  cast('2024-03-0' || cast(1 + item_id % 9 as string) || ' 12:00:00' as timestamp) as updated_at
from benchmark""",
    "sop_steps": """
select item_id * 10 + 1 as id, 'SOP-' || cast(item_id as string) as sop_id, 1 as step_number, 'Read' as title, text as content from benchmark
union all select item_id * 10 + 2, 'SOP-' || cast(item_id as string), 2, 'Do', text from benchmark""",
    "decommissioned_terms": """
select term, tenant_id from (values ('onesen', 't0'), ('onesen', 't1'), ('ERBLEST', 't1'), ('le', 't2'), ('er_', 't0')) x(term, tenant_id)""",
    "decommissioned_term_allowlist": """
select 't' || cast(doc_id % 3 as string) as tenant_id, 'project_knowledge' as source_table, cast(doc_id as string) as source_id, 'onesen' as term
from labels where quality = 1
union all select 't' || cast(doc_id % 3 as string), 'known_rules', cast(doc_id as string), 'onesen' from labels where quality = 1""",
    "factory_agreements": """
select n_nationkey as id, 't' || cast(n_nationkey % 3 as string) as tenant_id, 'agent' || cast(n_nationkey as string) as agent_name, '1.0' as agreement_version,
  case n_nationkey % 3 when 0 then split('sop,gate', ',') when 1 then split('routing,voice,behavior', ',') else split('brand', ',') end as required_rule_types,
  case n_nationkey % 2 when 0 then 'halt_on_missing' else 'advisory_only' end as enforcement_model
from nation""",
    "agents": """
select 'agent' || cast(s_suppkey as string) as agent_name, 't' || cast(s_suppkey % 3 as string) as tenant_id, s_name as callsign,
  'nation ' || cast(s_nationkey as string) as primary_domain, case when s_suppkey % 3 = 0 then null else s_name end as voice_anchor,
  case s_suppkey % 3 when 0 then 'active' when 1 then 'standalone' else 'retired' end as status,
  case s_suppkey % 4 when 0 then 'closed_factory' when 1 then 'standalone' else 'other' end as factory,
  'role ' || cast(s_nationkey as string) as role, '1.' || cast(s_suppkey % 10 as string) as version, s_suppkey as state_sig,
  cast('2024-03-0' || cast(1 + s_suppkey % 9 as string) || ' 12:00:00' as timestamp) as updated_at,
  case when s_suppkey % 5 = 4 then null else 'agents/' || cast(s_suppkey as string) || '.md' end as source_file
from supplier""",
    "agent_identity": "select agent_name, tenant_id, callsign, primary_domain, voice_anchor from agents",
    "chunk_catalog": """
select id, tenant_id, 'document_chunks' as source_table, cast(id as string) as source_id, source_type as entity_type, content as summary_text,
  embedding, model_version, embedded_at, embedding_stale, 'operational' as authority_tier
from document_chunks""",
    "chunks_after": """
select id, source_type, source_id, chunk_index, case when source_type = 'user' then content || ' (edited)' else content end as content,
  source_name, tenant_id, embedding, model_version, embedded_at, embedding_stale
from document_chunks where not (source_type = 'assistant' and embedding is null)""",
    # --- work -----------------------------------------------------------------
    "tasks": """
select o_orderkey as id, 't' || cast(o_orderkey % 3 as string) as tenant_id,
  case o_custkey % 7 when 0 then 'SITE' when 1 then 'BUILD' when 2 then 'CONTENT' when 3 then 'INFRA' when 4 then 'OPS' when 5 then 'GATE' else null end as category,
  'Order ' || cast(o_orderkey as string) as title, o_orderpriority as description,
  case o_orderstatus when 'O' then 'open' when 'F' then 'closed' else 'in_progress' end as status,
  'agent' || cast(o_custkey % 12 as string) as owner, cast(substr(o_orderpriority, 1, 1) as int) as priority,
  case when o_orderkey % 5 = 0 then o_orderkey + 1 else null end as blocked_by, o_orderdate as created_at,
  'ref-' || cast(o_custkey as string) as ref_id
from orders""",
    "tasks_before": "select * from tasks where status <> 'in_progress'",
    "tasks_after": """
select id, tenant_id, category, case when priority = 1 then title || ' (revised)' else title end as title,
  description, status, owner, priority, blocked_by, created_at, ref_id
from tasks where status <> 'closed' or priority <= 3""",
    "work_claims": """
select o_orderkey as id, 't' || cast(o_custkey % 3 as string) as tenant_id, 'task' as resource_type, cast(o_custkey as string) as resource_id,
  'agent' || cast(o_custkey % 12 as string) as claimed_by,
  case o_orderstatus when 'O' then 'active' when 'F' then 'released' else 'expired' end as status, o_orderdate as claimed_at,
  cast(o_custkey % 120 as int) as session_id, o_orderdate as expires_at, case o_orderstatus when 'F' then o_orderdate end as released_at,
  case o_orderstatus when 'F' then 'agent' || cast(o_custkey % 5 as string) end as released_by, 'f' || cast(o_custkey % 4 as string) as factory_id,
  'platform-t' || cast(o_custkey % 2 as string) as platform, o_orderpriority as claim_note
from orders""",
    # --- evaluation runs, telemetry, sessions -----------------------------------
    "eval_runs": """
select event_id as id, ts as run_date, case when event_id % 3 = 0 then 'AGENT' else 'agent' end || cast(user_id % 20 as string) as agent_name,
  cast(1 + event_id % 2 as int) as layer, case when event_id % 13 = 0 then null else cast(value % 8 as decimal(5,2)) end as score,
  case event_type when 'error' then false when 'view' then null else true end as pass,
  case when event_id % 5 = 0 then '{"correction_evidence_found": true, "evidence_samples": 0}' when event_id % 5 = 1 then '{"insufficient_evidence": true}' else props end as criteria_results,
  'f' || cast(user_id % 4 as string) as factory_id, 't' || cast(user_id % 3 as string) as factory_tenant,
  case when event_id % 3 = 0 then null else cast(event_id % 120 as int) end as session_id,
  'model-' || cast(user_id % 2 as string) as model_tested, 'v' || cast(event_id % 4 as string) as agent_version, event_type as notes,
  case event_id % 3 when 0 then 'full' when 1 then 'quick' end as run_mode, cast(event_id % 50 as string) as agent_sig
from events""",
    "retrieval_events": """
select event_id as id, 't' || cast(user_id % 3 as string) as tenant_id, case when event_id % 2 = 0 then 'fn_search_semantic' else 'fn_search_documents' end as search_function,
  event_type = 'click' as used_vector, case when event_id % 10 = 0 then null else cast(floor(value) as int) end as latency_ms, ts as created_at,
  'query ' || cast(user_id as string) as query_text, case when event_id % 4 = 0 then null else '[' || cast(user_id as string) || ']' end as result_ids
from events""",
    "session_log": """
select event_id as id, 't' || cast(user_id % 3 as string) as tenant_id, 's' || cast(user_id % 50 as string) as session_id,
  case when event_type = 'view' and user_id % 50 < 10 then 'agent_handoff' when event_type = 'view' then 'brain_search'
    when event_type = 'signup' then 'session_open' when event_type = 'purchase' then 'task_closed'
    when event_type = 'click' then 'file_write' else 'mcp_failure' end as event_type,
  ts as created_at
from events""",
    "sessions": """
select cast(extract(doy from session_date) * 3 + tenant_no as int) as id, session_date, 't' || cast(tenant_no as string) as tenant_id,
  case when tenant_no = 2 then null else 'platform-t' || cast(tenant_no as string) end as platform, 'build' as session_type,
  'notes for ' || cast(tenant_no as string) as resume_notes, 'summary ' || cast(tenant_no as string) as summary,
  case when tenant_no = 1 then null else split('agent1,agent' || cast(tenant_no as string), ',') end as agents_active
from (select distinct cast(ts as date) as session_date, user_id % 3 as tenant_no from events) z""",
    "connectors": """
select 'c' || cast(n_nationkey as string) as connector_id, 't' || cast(n_nationkey % 3 as string) as tenant_id, n_name as display_name,
  case n_nationkey % 3 when 0 then 'critical' when 1 then 'standard' else 'enhancement' end as criticality, n_nationkey % 7 <> 6 as active,
  n_nationkey % 9 = 8 as is_blocked, case when n_nationkey % 2 = 0 then null else 'policy' end as block_reason,
  case when n_nationkey % 5 = 0 then null else split('platform-t' || cast(n_nationkey % 2 as string) || ',console', ',') end as platform_availability,
  case n_nationkey % 4 when 0 then 'connected' when 1 then 'blocked' when 2 then 'unknown' else null end as probe_status,
  case n_regionkey when 0 then 'storage' when 1 then 'mail' else 'calendar' end as category, 'agent' || cast(n_nationkey % 12 as string) as agent_primary,
  case when n_nationkey % 6 = 5 then null else 'ask the owner' end as fallback_behavior, cast(null as timestamp) as last_probed_at
from nation""",
    "session_status": """
select session_id, 'c' || cast(connector_no as string) as connector_id, tenant_id,
  case (session_id + connector_no) % 4 when 1 then 'connected' when 2 then 'blocked' else 'unavailable' end as probe_result, false as fallback_active,
  'platform-' || tenant_id as platform, case when connector_no % 3 = 0 then null else 'seen ' || cast(connector_no as string) end as probe_note,
  cast('2024-05-01 08:00:00' as timestamp) as probed_at
from (select distinct s.id as session_id, s.tenant_id, e.user_id % 25 as connector_no
  from events e join sessions s on s.session_date = cast(e.ts as date) and s.tenant_id = 't' || cast(e.user_id % 3 as string) where e.event_type = 'error') z""",

    # --- retrieval evaluation ---------------------------------------------------
    "eval_cases": """
select 'case-' || cast(id as string) as case_id, tenant_id, regexp_extract(summary_text, '^([^ ]+ [^ ]+ [^ ]+)', 1) as query_text,
  'fn_search_semantic' as target_function, id % 90 <> 0 as active,
  '[{"source_table":"' || source_table || '","source_id":"' || case when id % 4 = 0 then 'none' else source_id end || '"}]' as expected_sources
from semantic_index""",
    "eval_cases_documents": """
select 'doc-case-' || cast(id as string) as case_id, tenant_id, regexp_extract(content, '^([^ ]+ [^ ]+ [^ ]+)', 1) as query_text,
  'fn_search_documents' as target_function, true as active,
  '[{"source_name":"' || source_name || '","chunk_index":' || cast(chunk_index as string) || '}]' as expected_sources
from document_chunks where chunk_index = 0""",
    "search_queries": """
select 'q' || cast(d.doc_id as string) as qid, 't' || cast(d.doc_id % 3 as string) as tenant_id,
  regexp_extract(d.text, '^([^ ]+ [^ ]+ [^ ]+)', 1) as query_text, e.embedding as query_vector
from documents d left join embeddings e on e.vec_id = d.doc_id and d.doc_id % 4 <> 1""",
    # --- content, files -----------------------------------------------------------
    "content_staging": """
select page_id as id, url as title, case page_id % 3 when 0 then 'article' when 1 then 'post' else 'email' end as content_type,
  case page_id % 5 when 0 then 'draft' when 1 then 'staged' when 2 then 'approved' when 3 then 'published' else 'archived' end as status,
  case when page_id % 2 = 0 then null else url end as file_path, 'agent' || cast(page_id % 12 as string) as assigned_to,
  case when page_id % 4 = 0 then null else page_id + 1 end as research_id, cast(page_id % 120 as int) as session_id,
  case when page_id % 3 = 0 then null else 'page-' || cast(page_id as string) end as target_page_id,
  cast('2024-04-' || lpad(cast(1 + page_id % 28 as string), 2, '0') || ' 08:00:00' as timestamp) as created_at,
  case when page_id % 5 = 3 then cast('2024-05-' || lpad(cast(1 + page_id % 28 as string), 2, '0') || ' 08:00:00' as timestamp) end as published_at
from pages""",
    "research": """
select page_id as id, url as topic, html as summary, case page_id % 3 when 0 then 'active' when 1 then 'archived' else 'superseded' end as status,
  'agent' || cast(page_id % 12 as string) as collected_by,
  case when page_id % 3 = 2 then page_id + 1 else null end as superseded_by, cast(page_id % 120 as int) as session_id,
  case when page_id % 4 = 1 then null else split('tag' || cast(page_id % 7 as string) || ',web', ',') end as tags,
  cast('2024-04-' || lpad(cast(1 + page_id % 28 as string), 2, '0') || ' 08:00:00' as timestamp) as created_at
from pages""",
    "file_registry": """
select page_id as id, url as file_path, 'cat' || cast(page_id % 6 as string) as category, page_id % 2 = 0 as conversion_required from pages""",
    "factory_config": """
select case when n_nationkey = 3 then 'openai_embedding_model' else 'key' || cast(n_nationkey as string) end as key,
  '"' || n_name || '"' as value, case when n_nationkey % 4 = 3 then 'embedding' else 'general' end as category,
  't' || cast(n_nationkey % 3 as string) as tenant_id,
  case when n_nationkey % 2 = 0 then 'note ' || n_name end as notes, cast('2024-03-01 12:00:00' as timestamp) as updated_at,
  'agent' || cast(n_nationkey % 4 as string) as updated_by
from nation""",
    "factory_lanes": """
select r_name as lane, 't0' as tenant_id, split('agent' || cast(r_regionkey as string) || ',agent9', ',') as owner_agents, r_regionkey % 2 = 0 as parallel_eligible,
  'agent' || cast(r_regionkey + 1 as string) as reviewer_agent, case when r_regionkey = 3 then null else split('disk,' || r_name, ',') end as exclusive_resources,
  'lane ' || r_name as notes
from region""",
    # --- profiles -----------------------------------------------------------------
    "profile": """
select 'agent' || cast(s_suppkey as string) as agent_name, s_name as callsign, case when s_suppkey % 2 = 0 then 'closed' else 'standalone' end as factory_type,
  'active' as status, s_suppkey as current_version
from supplier""",
    "profile_version": """
select s_suppkey as id, 'agent' || cast(s_suppkey as string) as agent_name, 1 as version, case when s_suppkey % 4 = 0 then null else s_name end as role,
  's ' || cast(s_nationkey as string) as one_liner, case when s_suppkey % 3 = 0 then null else s_name end as summary, split('go,run', ',') as trigger_phrases,
  case when s_suppkey % 5 = 0 then null else 'sig' || cast(s_suppkey as string) end as identity_signature,
  case when s_suppkey % 2 = 0 then null else s_suppkey end as identity_version,
  case s_suppkey % 4 when 0 then 'draft' when 1 then 'approved' when 2 then 'lost' else null end as review_status
from supplier""",
    "profile_bible": """
select s_suppkey as id, s_suppkey as version_id, case when s_suppkey % 3 = 1 then null else s_name || ' arc' end as archetype, 'back ' || s_name as backstory,
  case when s_suppkey % 2 = 1 then null else 'calm' end as personality, 'deep' as character_depth, 'dry' as humor, cast(null as string) as seriousness_boundary,
  'grew' as evolution_history, split('kind,exact', ',') as traits, case when s_suppkey % 2 = 0 then '*' end as emoji
from supplier where s_nationkey <> 3""",
    "profile_voice": """
select s_suppkey as id, s_suppkey as version_id, 'Hello' as opening_convention, case when s_suppkey % 3 = 0 then null else 'plain' end as register,
  'even' as voice_texture, split('a1,a2', ',') as voice_anchors, split('l1,l2', ',') as sample_lines, split('never', ',') as forbidden_phrasings, 'none' as emoji_policy
from supplier where s_nationkey <> 4""",
    "profile_lane": """
select s_suppkey as id, s_suppkey as version_id, 'nation ' || cast(s_nationkey as string) as primary_domain, split('plan,build', ',') as does, split('sell', ',') as does_not,
  '{"to":"agent' || cast(s_nationkey as string) || '","n":' || cast(s_nationkey as string) || '}' as handoffs, case when s_suppkey % 2 = 0 then 'hush' end as suppression_rules
from supplier where s_nationkey <> 5""",
    "profile_archetype": """
select p_partkey as id, cast(floor(p_partkey / 20) as int) as version_id, p_brand || ' ' || cast(p_partkey as string) as layer, p_type as archetype_name,
  case when p_partkey % 4 = 0 then null else p_name end as description, p_partkey % 7 as sort_order
from part""",
    "profile_dimension": """
select p_partkey as id, cast(floor(p_partkey / 20) as int) as version_id, p_name || ' ' || cast(p_partkey as string) as dimension, p_brand as content, p_partkey % 5 as sort_order
from part""",
    "profile_strength": """
select p_partkey as id, cast(floor(p_partkey / 20) as int) as version_id, p_name || ' ' || cast(p_partkey as string) as strength,
  case when p_partkey % 6 = 0 then null else p_type end as description, p_size as sort_order
from part""",
    "profile_tool": """
select p_partkey as id, cast(floor(p_partkey / 20) as int) as version_id, 'tool' || cast(p_partkey as string) as tool_name,
  case when p_partkey % 3 = 0 then null else p_brand end as purpose, p_size as sort_order
from part""",
    "profile_build": """
select s_suppkey as id, 'agent' || cast(s_suppkey as string) as agent_name, s_suppkey as version_id, 'sig' || cast(s_suppkey % 7 as string) as identity_signature,
  case when s_suppkey % 2 = 0 then 'gpt' else 'roster_card' end as target_type
from supplier""",
    "profile_asset": """
select p_partkey as id, 'agent' || cast(cast(floor(p_partkey / 18) as int) as string) as agent_name, case p_partkey % 4 when 0 then 'icon' when 1 then 'badge' when 2 then 'poster' else 'thumbnail' end as asset_type,
  case when p_partkey % 5 = 0 then null else p_brand end as variant, p_name as path
from part""",
    "profile_export_target": """
select s_suppkey as id, 'agent' || cast(s_suppkey as string) as agent_name, case when s_suppkey % 2 = 0 then 'gpt' else 'l2_agent' end as target_type,
  case s_suppkey % 3 when 0 then 'pending' when 1 then 'published' else 'gone' end as status, s_suppkey + 1 as generated_from_version
from supplier""",
    "profile_drift_check": """
select p_partkey as id, 'agent' || cast(cast(floor(p_partkey / 20) as int) as string) as agent_name, cast(floor(p_partkey / 19) as int) as version_id,
  cast(floor(p_partkey / 21) as int) as export_target_id, case p_partkey % 4 when 0 then 'pass' when 1 then 'warn' when 2 then 'fail' else 'skipped' end as result
from part""",
    "profile_eval_criteria": """
select p_partkey as id, 'agent' || cast(cast(floor(p_partkey / 20) as int) as string) as agent_name, p_brand as criterion, p_name as assertion,
  case when p_partkey % 2 = 0 then 'blocker' else 'warn' end as severity
from part""",
    "profile_provenance": """
select p_partkey as id, 'agent' || cast(cast(floor(p_partkey / 20) as int) as string) as agent_name, case when p_partkey % 3 = 0 then null else cast(floor(p_partkey / 18) as int) end as version_id, p_name as source_path
from part""",
    # --- logs and registers ---------------------------------------------------------
    "agent_memory": "select conv_id * 1000 + turn as id, role as agent_name, 'note' as memory_type, 'turn ' || cast(turn as string) as title, text as content from conversations",
    "brand_assets": "select page_id as id, url as rel_path, url as filename, length(html) as bytes, 't' || cast(page_id % 3 as string) as tenant_id from pages",
    "signature_log": "select event_id as id, cast(ts as date) as log_date, 'agent' || cast(user_id % 20 as string) as agent_name, cast(user_id as int) as new_sig from events",
    "process_changelog": "select event_id as id, 't' || cast(user_id % 3 as string) as tenant_id, ts as changed_at, event_type as change_type, props as details from events",
    "sample_suite": """
select event_id as id, 'agent' || cast(user_id % 20 as string) as agent_name, 't' || cast(user_id % 3 as string) as factory_tenant,
  case event_type when 'click' then 'gold' when 'view' then 'silver' when 'error' then 'tin' else 'bronze' end as quality
from events""",
    "eval_batches": """
select event_id as run_id, 't' || cast(user_id % 3 as string) as tenant_id, case when event_type = 'error' then 'vector_only' when user_id % 2 = 0 then 'hybrid' else 'fts_only' end as embedding_mode
from events where event_type <> 'view'""",
    "eval_results": """
select event_id * 7 as result_id, event_id as run_id, 'case-' || cast(user_id % 100 as string) as case_id, cast(event_id % 11 as int) as top_k,
  case when event_id % 9 = 0 then '{}' else '[]' end as returned_sources, value > 20 as expected_found,
  case when value > 20 then cast(event_id % 10 as int) end as first_match_rank, cast(floor(value) - 3 as int) as latency_ms, ts as created_at
from events""",
}

#: Raw tables that others are left-joined with, and their key.
JOINED = {"embeddings": "vec_id"}

#: Forms of the same rows for Spark: the words of a text are cut out before the join, which moves all that it reads.
SPARK_FORMS = {
    "search_queries": """
select 'q' || cast(d.doc_id as string) as qid, 't' || cast(d.doc_id % 3 as string) as tenant_id, d.query_text, e.embedding as query_vector
from (select doc_id, regexp_extract(text, '^([^ ]+ [^ ]+ [^ ]+)', 1) as query_text from documents) d
left join embeddings e on e.vec_id = d.doc_id and d.doc_id % 4 <> 1""",
}


def closure(names) -> list[str]:
    """Derived tables needed by ``names``, parents first."""
    ordered: list[str] = []

    def visit(name):
        if name in ordered:
            return
        for parent in DERIVED:
            if parent != name and parent in _reads(DERIVED[name]):
                visit(parent)
        ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def _reads(sql: str) -> set[str]:
    """Names that follow ``from`` or ``join`` in a SQL text."""
    return set(re.findall(r"(?:from|join)\s+([a-z_]+)\b", sql))


def with_clause(names) -> str:
    """``a as (...), b as (...)`` for the oracle side."""
    return ",\n".join(f"{n} as ({DERIVED[n]})" for n in closure(names))


def _scan(sf_dir: str, name: str, paths: dict[str, str]) -> str:
    return f"select * from parquet.`{paths.get(name, f'{sf_dir}/{name}.parquet')}`"


def raw(spark: SparkSession, sf_dir: str, name: str, paths: dict[str, str] = {}) -> DataFrame:
    return spark.sql(_scan(sf_dir, name, paths))


def derived(spark: SparkSession, sf_dir: str, name: str, paths: dict[str, str] = {}, unique=frozenset()) -> DataFrame:
    """One derived table over the parquet files of ``sf_dir``, or of ``paths`` for the tables named there.

    Tables in ``unique`` hold each key of ``JOINED`` once.  Grouped by it the planner knows that, too, and leaves out a left
    join whose columns are not asked for, so that no text is moved to meet them.
    """
    needed = closure([name])
    scans = sorted({r for n in needed for r in _reads(DERIVED[n])} & set(RAW_TABLES))
    parts = []
    for r in scans:
        scan = _scan(sf_dir, r, paths)
        if r in unique:
            others = "".join(f", first({c}) as {c}" for c in spark.sql(scan).columns if c != JOINED[r])
            scan = f"select {JOINED[r]}{others} from ({scan}) group by {JOINED[r]}"
        parts.append(f"{r} as ({scan})")
    parts += [f"{n} as ({SPARK_FORMS.get(n, DERIVED[n])})" for n in needed]
    return spark.sql("with " + ",\n".join(parts) + f"\nselect * from {name}")


class Store(dict):
    """Lazy ``table name -> DataFrame`` view of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir
        self.paths: dict[str, str] = {}
        self.single: dict[str, bool] = {}  # joined tables: does each key come once?

    def __missing__(self, name):
        reads = set().union(*(_reads(DERIVED[n]) for n in closure([name]))) if name in DERIVED else {name}
        if "documents" in reads and "documents" not in self.paths:
            self.paths["documents"] = self._dealt("documents")
        if name in DERIVED:
            unique = {r for r in reads & set(JOINED) if self._single(r)}
            self[name] = derived(self.spark, self.sf_dir, name, self.paths, unique)
        else:
            self[name] = raw(self.spark, self.sf_dir, name, self.paths)
        return self[name]

    def _single(self, name: str) -> bool:
        if name not in self.single:
            rows = raw(self.spark, self.sf_dir, name, self.paths)
            self.single[name] = rows.groupBy(JOINED[name]).count().filter("count > 1").isEmpty()
        return self.single[name]

    def _dealt(self, name: str) -> str:
        """Files of a table of texts, as many as tasks run at once at least.

        The test files have one row group, which one task reads.  Fewer files are dealt out once, and not
        after every scan: a query reads the texts for many tables.
        """
        path, tasks = f"{self.sf_dir}/{name}.parquet", self.spark.sparkContext.defaultParallelism
        rows = self.spark.read.parquet(path)
        if len(rows.inputFiles()) >= tasks:
            return path
        dealt = scratch_path(self.spark, name)
        rows.repartition(tasks).write.parquet(dealt)
        return dealt
