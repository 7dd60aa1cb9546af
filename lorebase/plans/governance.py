"""Governance, connector, data-quality and profile queries."""


import datetime

from pyspark.sql import functions as F

from lorebase.operators import connectors, governance, profiles, quality, reports
from lorebase.plans.registry import joined, query
from lorebase.plans.reports import TENANT, report
from lorebase.sources.model import CHECKS, KEYS, REFERENCES

ROSTER = [f"agent{i}" for i in range(12)]

# --- rules ----------------------------------------------------------------------------
_FAN_OUT = f"""fan as (select id, tenant_id, trim(name) as agent_name, rule, rule_type, enforcement, category, applies_to as original_applies_to from (
  select *, unnest(case when applies_to in ('all', 'all-agents') then {ROSTER!r}
    when trim(applies_to, '{{}}') = '' then cast([] as varchar[]) else string_split(trim(applies_to, '{{}}'), ',') end) as name from known_rules) x)"""

report("rules_by_agent", f"with {_FAN_OUT} select * from fan", ["known_rules"], lambda T: governance.rules_by_agent(T, ROSTER))
report(
    "startup_rules",
    r"""select id, enforcement, rule, category, rule_type, lower(trim(name)) as agent, applies_to, tenant_id, updated_at from (
  select *, unnest(regexp_split_to_array(regexp_replace(coalesce(applies_to, ''), '[{}\[\]"]', '', 'g'), '\s*,\s*')) as name
  from known_rules where category = 'startup') x where trim(name) <> ''""",
    ["known_rules"], governance.startup_rules,
)
report(
    "agreement_coverage",
    f"""with {_FAN_OUT}, req as (select tenant_id, agent_name, agreement_version, unnest(required_rule_types) as rule_type from factory_agreements)
select r.agent_name, r.agreement_version, r.rule_type, count(f.id) as rule_count, case when count(f.id) = 0 then 'GAP' else 'COVERED' end as coverage_status
from req r left join fan f on f.rule_type = r.rule_type and f.agent_name = r.agent_name and f.tenant_id = r.tenant_id group by 1, 2, 3""",
    ["known_rules", "factory_agreements"], lambda T: governance.agreement_coverage(T, ROSTER),
)
_MEETS = """(k.applies_to = a.agent_name or k.applies_to in ('all', 'all-agents') or list_contains(string_split(trim(k.applies_to, '{}'), ','), a.agent_name))"""


@query(
    "agreement_status",
    f"""with met as (select a.id, count(k.id) as loaded_rules, list(k.rule_type) as types from factory_agreements a
  left join known_rules k on k.tenant_id = a.tenant_id and {_MEETS} group by a.id),
base as (select a.*, m.loaded_rules, list_filter(a.required_rule_types, lambda t: not list_contains(m.types, t)) as missing from factory_agreements a join met m using (id))
select agent_name, agreement_version, enforcement_model, array_to_string(required_rule_types, '|') as required_rule_types, loaded_rules, tenant_id,
  array_to_string(missing, '|') as missing_rule_types, case when len(missing) = 0 then 'READY' else 'WARN_MISSING_RULE_TYPES' end as status_label from base""",
    ["known_rules", "factory_agreements"],
)
def agreement_status(T):
    return joined(governance.agreement_status(T), "required_rule_types", "missing_rule_types")


@query(
    "halt_rules_by_agent",
    f"""with {_FAN_OUT} select agent_name, tenant_id, count(*) as halt_rule_count, string_agg(cast(id as varchar), '|' order by id) as rule_ids,
  string_agg(distinct category, '|' order by category) as categories from fan where enforcement = 'halt' group by agent_name, tenant_id""",
    ["known_rules"],
)
def halt_rules_by_agent(T):
    return joined(governance.halt_rules_by_agent(T, ROSTER), "rule_ids", "categories")


def _scan_sql(table: str, key: str, texts, keep: str, where: str = "true") -> str:
    hit = " or ".join(f"x.{t} ilike '%' || d.term || '%'" for t in texts)
    return f"""select {keep}, x.tenant_id, string_agg(d.term, '|' order by d.term) as matched_terms, count(*) as hit_count
from {table} x join decommissioned_terms d on d.tenant_id = x.tenant_id and ({hit})
where {where} and not exists (select 1 from decommissioned_term_allowlist a where a.tenant_id = x.tenant_id and a.source_table = '{table}'
  and a.source_id = cast(x.{key} as varchar) and a.term = d.term) group by all"""


_TERMS = ["decommissioned_terms", "decommissioned_term_allowlist"]


@query(
    "retired_terms_in_knowledge",
    _scan_sql("project_knowledge", "id", ["title", "detail"], "x.id, x.knowledge_type, x.title, left(x.detail, 200) as detail_preview"),
    ["project_knowledge", *_TERMS],
)
def retired_terms_in_knowledge(T):
    return joined(governance.knowledge_with_retired_terms(T), "matched_terms")


@query(
    "retired_terms_in_rules",
    _scan_sql("known_rules", "id", ["rule"], "x.id, x.category, left(x.rule, 200) as rule_preview"),
    ["known_rules", *_TERMS],
)
def retired_terms_in_rules(T):
    return joined(governance.rules_with_retired_terms(T), "matched_terms")


_PROCEDURE_SCAN = _scan_sql(
    "sop_registry", "sop_id", ["title", "summary", "full_body"], "x.sop_id, x.title, left(coalesce(x.summary, x.full_body), 200) as preview",
    "x.status not in ('tombstoned', 'deprecated')",
)


@query("retired_terms_in_procedures", _PROCEDURE_SCAN, ["sop_registry", *_TERMS])
def retired_terms_in_procedures(T):
    return joined(governance.procedures_with_retired_terms(T), "matched_terms")


report(
    "retired_term_counts",
    f"""select (select count(*) from ({_scan_sql("known_rules", "id", ["rule"], "x.id")}) r where tenant_id = '{TENANT}') as rules,
  (select count(*) from ({_scan_sql("project_knowledge", "id", ["title", "detail"], "x.id")}) k where tenant_id = '{TENANT}') as knowledge,
  (select count(*) from ({_PROCEDURE_SCAN}) s where tenant_id = '{TENANT}') as sops""",
    ["known_rules", "project_knowledge", "sop_registry", *_TERMS], lambda T: governance.retired_term_counts(T, TENANT),
)
_DEAD = f"""refs as (select id as rule_id, unnest(regexp_extract_all(rule, '(SOP-[0-9]+)', 1)) as sop_ref from known_rules where tenant_id = '{TENANT}'),
dead as (select r.rule_id, r.sop_ref, s.sop_id, s.status from refs r
  left join (select * from sop_registry where tenant_id = '{TENANT}') s on s.sop_id = r.sop_ref or s.title ilike '%' || r.sop_ref || '%'
  where s.sop_id is null or s.status <> 'active')"""
report("dead_references", f"with {_DEAD} select * from dead", ["known_rules", "sop_registry"], lambda T: governance.dead_references(T, TENANT))
report(
    "governance_health",
    f"""with {_DEAD} select (select count(*) from known_rules where tenant_id = '{TENANT}') as active_rule_count, 21 as rule_count_target, 28 as combined_governance_target,
  (select count(*) from known_rules where tenant_id = '{TENANT}' and rule_type = 'sop') as rule_type_sop_count,
  (select count(*) from factory_agreements where tenant_id = '{TENANT}' and list_contains(required_rule_types, 'sop')) as agreement_required_sop_count,
  (select count(*) from sop_registry where tenant_id = '{TENANT}' and status = 'active') as active_sop_count,
  (select count(*) from sop_registry where tenant_id = '{TENANT}' and status = 'active' and (trigger_phrases is null or len(trigger_phrases) = 0)) as missing_sop_trigger_count,
  (select count(*) from dead) as dead_sop_reference_count""",
    ["known_rules", "sop_registry", "factory_agreements"], lambda T: governance.governance_health(T, TENANT),
)

# --- connectors --------------------------------------------------------------------------
_LABEL = """case when coalesce(s.probe_result, 'untested') = 'connected' then 'OK' when coalesce(s.probe_result, 'untested') = 'blocked' then 'BLOCKED'
    when r.criticality = 'critical' then 'CRITICAL-DOWN' when r.criticality = 'standard' then 'DEGRADED' else 'REDUCED' end as status_label"""
_READY = f"""r.connector_id, r.display_name, r.criticality, r.category, r.agent_primary, array_to_string(r.platform_availability, '|') as platform_availability,
  r.fallback_behavior, coalesce(s.probe_result, 'untested') as probe_result, coalesce(s.fallback_active, false) as fallback_active,
  s.probe_note, s.probed_at, {_LABEL}"""


@query(
    "connector_readiness",
    f"""select {_READY} from connectors r left join session_status s on s.tenant_id = r.tenant_id and s.connector_id = r.connector_id
  and s.session_id = (select max(id) from sessions where tenant_id = '{TENANT}') where r.active and r.tenant_id = '{TENANT}'""",
    ["connectors", "session_status", "sessions"],
)
def connector_readiness(T):
    return joined(connectors.readiness(T, TENANT), "platform_availability")


@query(
    "connector_readiness_by_session",
    f"""select s.session_id, f.session_date, f.platform as session_platform, {_READY}
from session_status s join connectors r on r.connector_id = s.connector_id left join sessions f on f.id = s.session_id where r.active""",
    ["connectors", "session_status", "sessions"],
)
def connector_readiness_by_session(T):
    return joined(connectors.readiness_by_session(T), "platform_availability")


_RUN = datetime.datetime(2024, 6, 1)
report(
    "connector_status_seed",
    """with chosen as (select id, coalesce(platform, 'unknown') as platform from sessions order by id desc limit 1)
select c.id as session_id, r.connector_id, 'main' as tenant_id, c.platform,
  case when r.probe_status in ('connected', 'unavailable', 'blocked') then r.probe_status else 'untested' end as probe_result,
  case when r.is_blocked then 'Blocked: ' || coalesce(r.block_reason, 'no reason recorded')
    when r.probe_status is null or r.probe_status not in ('connected', 'unavailable', 'blocked') then 'No prior probe on record' end as probe_note,
  false as fallback_active, timestamp '2024-06-01 00:00:00' as probed_at
from connectors r cross join chosen c where r.active and (r.platform_availability is null or len(r.platform_availability) = 0 or list_contains(r.platform_availability, c.platform))
  and not exists (select 1 from session_status s where s.session_id = c.id and s.connector_id = r.connector_id)""",
    ["connectors", "sessions", "session_status"], lambda T: connectors.session_status_rows(T, run_ts=_RUN),
)

_PROBES = """probes as (select event_id as seq, 'c' || cast(user_id % 30 as varchar) as connector_id, cast(1 + user_id as int) as session_id,
  case event_type when 'error' then 'unavailable' when 'view' then 'blocked' else 'connected' end as result,
  case when event_type <> 'view' then 'event ' || cast(event_id as varchar) end as note from events)"""


def probes(T):
    """Probe results taken from the event stream; some name unknown sessions or connectors."""
    return T["events"].select(
        F.col("event_id").alias("seq"), F.concat(F.lit("c"), (F.col("user_id") % 30).cast("string")).alias("connector_id"),
        (F.col("user_id") + 1).cast("int").alias("session_id"),
        F.when(F.col("event_type") == "error", "unavailable").when(F.col("event_type") == "view", "blocked").otherwise("connected").alias("result"),
        F.when(F.col("event_type") != "view", F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("note"),
    )


report(
    "connector_registry_after_probes",
    f"""with {_PROBES}, last as (select connector_id, arg_max(result, seq) as result from probes group by connector_id)
select r.connector_id, r.tenant_id, coalesce(l.result, r.probe_status) as probe_status,
  case when l.connector_id is not null then timestamp '2024-06-01 00:00:00' end as last_probed_at from connectors r left join last l using (connector_id)""",
    ["connectors"], lambda T: connectors.record_probes(T, probes(T), _RUN)[0].select("connector_id", "tenant_id", "probe_status", "last_probed_at"),
)
report(
    "session_status_after_probes",
    f"""with {_PROBES}, last as (select session_id, connector_id, max_by(struct_pack(result := result, note := note), seq) as p from probes group by session_id, connector_id),
usable as (select * from last l where exists (select 1 from sessions f where f.id = l.session_id)
  or exists (select 1 from session_status s where s.session_id = l.session_id and s.connector_id = l.connector_id))
select coalesce(s.session_id, u.session_id) as session_id, coalesce(s.connector_id, u.connector_id) as connector_id,
  case when s.session_id is null then 'main' else s.tenant_id end as tenant_id,
  case when s.session_id is null then (select coalesce(f.platform, 'unknown') from sessions f where f.id = u.session_id) else s.platform end as platform,
  coalesce(u.p.result, s.probe_result) as probe_result, case when u.session_id is null then s.probe_note else u.p.note end as probe_note,
  false as fallback_active, case when u.session_id is null then s.probed_at else timestamp '2024-06-01 00:00:00' end as probed_at
from session_status s full join usable u on u.session_id = s.session_id and u.connector_id = s.connector_id""",
    ["sessions", "session_status"],
    lambda T: connectors.record_probes(T, probes(T), _RUN)[1],
)

# --- data quality -------------------------------------------------------------------------
report(
    "quality_uniqueness",
    " union all ".join(
        f"""select '{t}' as table_name, '{", ".join(k)}' as key_columns, count(*) as duplicate_keys, cast(coalesce(sum(n - 1), 0) as bigint) as extra_rows
from (select count(*) as n from {t} where {" and ".join(f"{c} is not null" for c in k)} group by {", ".join(k)} having count(*) > 1) z"""
        for t, ks in KEYS.items() for k in ks
    ),
    list(KEYS), quality.uniqueness_audit,
)
report(
    "quality_contested_claims",
    """select tenant_id, resource_type, resource_id, count(*) as active_claims from work_claims where status = 'active' group by 1, 2, 3 having count(*) > 1""",
    ["work_claims"], quality.contested_claims,
)
report(
    "quality_checks",
    " union all ".join(
        f"select '{t}' as table_name, '{name}' as rule_name, count(*) filter (where not ({rule})) as violations from {t}"
        for t, rules in CHECKS.items() for name, rule in rules.items()
    ),
    list(CHECKS), quality.check_audit,
)
report(
    "quality_references",
    " union all ".join(
        f"""select '{r.child}' as child, '{r.column}' as column_name, '{r.parent}' as parent, count(*) as dangling_rows
from {r.child} c where c.{r.column} is not null and not exists (select 1 from {r.parent} p where p.{r.parent_column} = c.{r.column})"""
        for r in REFERENCES
    ),
    sorted({t for r in REFERENCES for t in (r.child, r.parent)}), quality.reference_audit,
)


# Deleting the closed profiles reaches versions, their children and, through the
# versions and export targets, the drift checks.
_GONE = "select agent_name from profile where factory_type = 'closed'"
_GONE_VERSIONS = f"select id from profile_version where agent_name in ({_GONE})"
_BY_VERSION = ["profile_bible", "profile_voice", "profile_lane", "profile_archetype", "profile_dimension", "profile_strength", "profile_tool"]
_PROPAGATED = (
    [("profile", "factory_type <> 'closed'"), ("profile_version", f"agent_name not in ({_GONE})"),
     ("profile_asset", f"agent_name not in ({_GONE})"), ("profile_export_target", f"agent_name not in ({_GONE})"),
     ("profile_provenance", f"agent_name not in ({_GONE}) and (version_id is null or version_id not in ({_GONE_VERSIONS}))"),
     ("profile_drift_check", f"agent_name not in ({_GONE}) and export_target_id not in (select id from profile_export_target where agent_name in ({_GONE}))")]
    + [(t, f"version_id not in ({_GONE_VERSIONS})") for t in _BY_VERSION]
)


@query(
    "delete_propagation",
    " union all ".join(f"select '{t}' as table_name, count(*) as kept from {t} where {c}" for t, c in _PROPAGATED)
    + f""" union all select 'cleared version of a drift check', count(*) from profile_drift_check
where {dict(_PROPAGATED)["profile_drift_check"]} and version_id in ({_GONE_VERSIONS})""",
    [t for t, _ in _PROPAGATED],
)
def delete_propagation(T):
    gone = T["profile"].filter("factory_type = 'closed'").select("agent_name")
    after = quality.propagate_deletes(T, "profile", gone)
    cleared = after["profile_drift_check"].filter("version_id is null").agg(F.count("*").alias("kept")).select(
        F.lit("cleared version of a drift check").alias("table_name"), "kept"
    )
    return quality._union(
        [after[n].agg(F.count("*").alias("kept")).select(F.lit(n).alias("table_name"), "kept") for n, _ in _PROPAGATED] + [cleared]
    )


# --- profiles --------------------------------------------------------------------------------
_PROFILE = [
    "profile", "profile_version", "profile_bible", "profile_voice", "profile_lane",
    "profile_archetype", "profile_dimension", "profile_strength", "profile_tool", "profile_build",
]


_PROFILE_JOIN = """from profile_version pv left join profile_bible b on b.version_id = pv.id
left join profile_voice v on v.version_id = pv.id left join profile_lane l on l.version_id = pv.id"""

_SIGNATURES = f"""signed as (select pv.id as version_id, pv.agent_name, md5(
  coalesce('V|' || coalesce(pv.role, '~') || '|' || coalesce(pv.one_liner, '~') || '|' || coalesce(pv.summary, '~')
    || '|' || array_to_string(pv.trigger_phrases, '#'), '')
  || chr(30) || coalesce('B|' || coalesce(b.archetype, '~') || '|' || coalesce(b.backstory, '~') || '|' || coalesce(b.personality, '~')
    || '|' || coalesce(b.character_depth, '~') || '|' || coalesce(b.humor, '~') || '|' || coalesce(b.seriousness_boundary, '~')
    || '|' || coalesce(b.evolution_history, '~') || '|' || array_to_string(b.traits, '#') || '|' || coalesce(b.emoji, '~'), '')
  || chr(30) || coalesce('VC|' || coalesce(v.opening_convention, '~') || '|' || coalesce(v.register, '~') || '|' || coalesce(v.voice_texture, '~')
    || '|' || array_to_string(v.voice_anchors, '#') || '|' || array_to_string(v.sample_lines, '#')
    || '|' || array_to_string(v.forbidden_phrasings, '#') || '|' || coalesce(v.emoji_policy, '~'), '')
  || chr(30) || coalesce('L|' || coalesce(l.primary_domain, '~') || '|' || array_to_string(l.does, '#') || '|' || array_to_string(l.does_not, '#')
    || '|' || '{{"n": ' || json_extract_string(l.handoffs, '$.n') || ', "to": "' || json_extract_string(l.handoffs, '$.to') || '"}}'
    || '|' || coalesce(l.suppression_rules, '~'), '')
  || chr(30) || coalesce((select string_agg('A|' || layer || '|' || archetype_name || '|' || coalesce(description, '~'), '||' order by sort_order, layer)
    from profile_archetype x where x.version_id = pv.id), '')
  || chr(30) || coalesce((select string_agg('D|' || dimension || '|' || content, '||' order by sort_order, dimension)
    from profile_dimension x where x.version_id = pv.id), '')
  || chr(30) || coalesce((select string_agg('S|' || strength || '|' || coalesce(description, '~'), '||' order by sort_order, strength)
    from profile_strength x where x.version_id = pv.id), '')) as signature {_PROFILE_JOIN})"""

report("profile_signatures", f"with {_SIGNATURES} select * from signed", _PROFILE, profiles.identity_signatures)
report(
    "profile_signature_drift",
    f"""with {_SIGNATURES} select s.version_id, s.agent_name,
  case when p.identity_signature is null then 'UNSIGNED' when p.identity_signature = s.signature then 'CURRENT' else 'DRIFTED' end as stored_state,
  case when b.identity_signature is null then 'NOT_BUILT' when b.identity_signature = s.signature then 'CURRENT' else 'OUTDATED' end as build_state
from signed s join profile_version p on p.id = s.version_id left join profile_build b on b.version_id = s.version_id""",
    _PROFILE, profiles.signature_drift,
)


report(
    "profile_documents",
    f"""with gap as (select chr(10) as n, chr(10) || chr(10) as g)
select pv.id as version_id, pv.agent_name,
  '<!-- Generated from the profile record. Do not edit by hand. -->' || n
  || '<!-- agent: ' || p.agent_name || ' | version: ' || pv.version || ' | identity_version: ' || coalesce(cast(identity_version as varchar), '?')
  || ' | identity_signature: ' || coalesce(identity_signature, 'UNSIGNED') || ' -->' || g
  || '# ' || upper(left(p.agent_name, 1)) || lower(substr(p.agent_name, 2)) || coalesce(' — ' || role, '') || g
  || coalesce('> ' || one_liner || g, '')
  || '**Callsign:** ' || callsign || ' | **Factory:** ' || factory_type || ' | **Status:** ' || status || coalesce(' | **Emoji:** ' || emoji, '') || g
  || '## Identity' || g || coalesce(summary, '') || g || coalesce('**Trigger phrases:** ' || array_to_string(trigger_phrases, ', ') || g, '')
  || '## Archetype Hierarchy' || g
  || coalesce((select string_agg('- **' || layer || '** — ' || archetype_name || ': ' || coalesce(description, ''), chr(10) order by sort_order, layer)
      from profile_archetype x where x.version_id = pv.id), '') || g
  || coalesce('> Guardrail: ' || archetype || g, '')
  || '## Character' || g
  || coalesce('**Personality.** ' || personality || g, '') || coalesce('**Backstory.** ' || backstory || g, '')
  || coalesce('**Depth.** ' || character_depth || g, '') || coalesce('**Humor.** ' || humor || g, '')
  || coalesce('**Seriousness boundary.** ' || seriousness_boundary || g, '') || coalesce('**Traits:** ' || array_to_string(traits, ', ') || g, '')
  || '### Character Dimensions' || g
  || coalesce((select string_agg('- **' || dimension || '** — ' || content, chr(10) order by sort_order, dimension)
      from profile_dimension x where x.version_id = pv.id), '') || g
  || '## Voice' || g
  || coalesce('**Opening convention.** ' || opening_convention || g, '') || coalesce('**Register.** ' || register || g, '')
  || coalesce('**Texture.** ' || voice_texture || g, '') || coalesce('**Anchors:** ' || array_to_string(voice_anchors, ' · ') || g, '')
  || coalesce('**Sample lines:**' || g || '> ' || array_to_string(sample_lines, chr(10) || '> ') || g, '')
  || coalesce('**Forbidden:**' || g || '- ' || array_to_string(forbidden_phrasings, chr(10) || '- ') || g, '')
  || coalesce('**Emoji policy.** ' || emoji_policy || g, '')
  || '## Lane' || g
  || coalesce('**Primary domain:** ' || primary_domain || g, '') || coalesce('**Does:** ' || array_to_string(does, ', ') || g, '')
  || coalesce('**Routes away:**' || g || '- ' || array_to_string(does_not, chr(10) || '- ') || g, '')
  || coalesce('**Suppression.** ' || suppression_rules || g, '')
  || '## Strengths' || g
  || coalesce((select string_agg('- **' || strength || '** — ' || coalesce(description, ''), chr(10) order by sort_order, strength)
      from profile_strength x where x.version_id = pv.id), '') || g
  || '## Tools' || g
  || coalesce((select string_agg('- `' || tool_name || '` — ' || coalesce(purpose, ''), chr(10) order by sort_order, tool_name)
      from profile_tool x where x.version_id = pv.id), '') || g
  || '<!-- Platform section: filled by the build, not part of the signature. -->' || n as document
{_PROFILE_JOIN} join profile p on p.agent_name = pv.agent_name cross join gap""",
    _PROFILE, profiles.render_documents,
)


# --- session start ------------------------------------------------------------------------------
_OPEN = "from tasks where status = 'open'"


@query(
    "startup_summary",
    f"""with {_DEAD},
by_category as (select category, count(*) as n {_OPEN} and category is not null group by category),
health as (select 'document_chunks' as tier, count(*) as total, count(embedding) as embedded, count(*) filter (where embedding_stale) as stale,
    count(*) - count(embedding) as unembedded from document_chunks where tenant_id = '{TENANT}'
  union all select 'semantic_index', count(*), count(embedding), count(*) filter (where embedding_stale), count(*) - count(embedding) from semantic_index where tenant_id = '{TENANT}'),
last as (select * from sessions order by id desc limit 1)
select id as last_session_id, session_date, platform, session_type, resume_notes,
  (select '{{' || string_agg('"' || category || '":' || n, ',' order by category) || '}}' from by_category) as open_tasks,
  (select count(*) {_OPEN}) as open_task_total,
  (select '{{' || string_agg('"' || tier || '":{{"total":' || total || ',"embedded":' || embedded || ',"stale":' || stale || ',"unembedded":' || unembedded || '}}', ',' order by tier) || '}}' from health) as embedding_health,
  '{{"rules":' || (select count(*) from ({_scan_sql("known_rules", "id", ["rule"], "x.id")}) r where tenant_id = '{TENANT}')
    || ',"knowledge":' || (select count(*) from ({_scan_sql("project_knowledge", "id", ["title", "detail"], "x.id")}) k where tenant_id = '{TENANT}')
    || ',"sops":' || (select count(*) from ({_PROCEDURE_SCAN}) s where tenant_id = '{TENANT}') || '}}' as decommissioned_terms,
  '{{"active_rule_count":' || (select count(*) from known_rules where tenant_id = '{TENANT}')
    || ',"rule_type_sop_count":' || (select count(*) from known_rules where tenant_id = '{TENANT}' and rule_type = 'sop')
    || ',"active_sop_count":' || (select count(*) from sop_registry where tenant_id = '{TENANT}' and status = 'active')
    || ',"missing_sop_trigger_count":' || (select count(*) from sop_registry where tenant_id = '{TENANT}' and status = 'active' and trigger_phrases is null)
    || ',"rule_count_target":21,"combined_governance_target":28'
    || ',"agreement_required_sop_count":' || (select count(*) from factory_agreements where tenant_id = '{TENANT}' and list_contains(required_rule_types, 'sop'))
    || ',"dead_sop_reference_count":' || (select count(*) from dead) || '}}' as governance_health
from last""",
    ["tasks", "sessions", "semantic_index", "document_chunks", "known_rules", "project_knowledge", "sop_registry", "factory_agreements", *_TERMS],
)
def startup_summary(T):
    return reports.startup_summary(T, TENANT)
