"""Catalog maintenance, keyed writes, telemetry and embedding refresh queries."""

import datetime
import re

from pyspark.sql import functions as F

from lorebase.operators import catalog as rules, embedding, upsert
from lorebase.plans.registry import query, rounded
from lorebase.sources.scratch import scratch_path
from lorebase.streaming.changes import CatalogFeed, apply_changes_stream, record_events

_SOURCES = list(rules.SOURCES)
_STATE = ["tenant_id", "source_table", "source_id", "entity_type", "summary_text", "model_version", "embedding_stale", "authority_tier"]

# --- seeding ---------------------------------------------------------------------
_SEEDS = """
model as (select coalesce((select json_extract_string(value, '$') from factory_config where key = 'openai_embedding_model' order by tenant_id limit 1), 'text-embedding-3-small') as m),
seeds as (
  select tenant_id, 'brand_messaging' as source_table, cast(id as varchar) as source_id, 'brand' as entity_type,
    'Brand ' || coalesce(category, '') || ' (' || coalesce(sub_type, '') || '): ' || coalesce(content, '') as summary_text,
    case when sub_type like 'manifest-%' then 'sacred' else 'canon' end as authority_tier from brand_messaging
  union all select tenant_id, 'project_knowledge', cast(id as varchar), 'knowledge',
    coalesce(knowledge_type, '') || ' - ' || coalesce(title, '') || ': ' || coalesce(detail, ''), 'canon' from project_knowledge
  union all select tenant_id, 'tasks', cast(id as varchar), 'task',
    'Task ' || coalesce(category, '') || ' - ' || coalesce(title, '') || ': ' || coalesce(description, ''), 'operational' from tasks
  union all select tenant_id, 'decisions', cast(id as varchar), 'decision', 'Decision ' || coalesce(title, '') || ': ' || coalesce(decision, ''), 'canon' from decisions
  union all select tenant_id, 'known_rules', cast(id as varchar), 'policy_rule',
    coalesce(category, '') || ' ' || coalesce(rule_type, '') || ' ' || coalesce(applies_to, '') || ' ' || coalesce(enforcement, '') || '. ' || coalesce(rule, ''),
    case when enforcement = 'halt' then 'sacred' else 'canon' end from known_rules
  union all select tenant_id, 'sop_registry', sop_id, 'sop', 'SOP ' || coalesce(sop_id, '') || ' - ' || coalesce(title, '') || ': ' || coalesce(summary, ''), 'canon' from sop_registry
  union all select tenant_id, 'agent_identity', agent_name, 'agent',
    'Agent ' || coalesce(agent_name, '') || ' (' || coalesce(callsign, '') || ', ' || coalesce(primary_domain, '') || '): ' || coalesce(voice_anchor, ''), 'canon' from agent_identity)"""

_STATE_SQL = ", ".join(_STATE)


@query(
    "catalog_seed",
    f"""with {_SEEDS}
select {_STATE_SQL} from semantic_index
union all
select s.tenant_id, s.source_table, s.source_id, s.entity_type, s.summary_text, model.m, true, s.authority_tier
from seeds s cross join model where not exists (select 1 from semantic_index c
  where c.tenant_id = s.tenant_id and c.source_table = s.source_table and c.source_id = s.source_id)""",
    ["semantic_index", "factory_config", *_SOURCES],
)
def catalog_seed(T):
    model = rules.embedding_model(T["factory_config"])
    return rules.seed(T["semantic_index"], {t: T[t] for t in _SOURCES}, model).select(*_STATE)


@query(
    "catalog_authority_tiers",
    f"with {_SEEDS} select source_table, authority_tier, count(*) as n from seeds group by all",
    ["factory_config", *_SOURCES],
)
def catalog_authority_tiers(T):
    rows = rules._union([rules.seed_rows(T[t], t) for t in _SOURCES])
    return rows.groupBy("source_table", "authority_tier").agg(F.count("*").alias("n"))


# --- snapshots compared ------------------------------------------------------------
_DIFF = """
select coalesce(b.id, a.id) as id, case when b.id is null then 'insert' when a.id is null then 'delete' else 'update' end as op
from tasks_before b full join tasks_after a on a.id = b.id
where b.id is null or a.id is null or b.title is distinct from a.title or b.description is distinct from a.description or b.category is distinct from a.category"""


@query("catalog_snapshot_diff", _DIFF, ["tasks_before", "tasks_after"])
def catalog_snapshot_diff(T):
    return rules.diff(T["tasks_before"], T["tasks_after"], ["id"], rules.SOURCES["tasks"].watched)


# The sources a while later: a quarter of the rows has a revised text, an eighth is gone.
_NUMBER = "coalesce(cast(nullif(regexp_replace(source_id, '[^0-9]', '', 'g'), '') as bigint), 0)"
_FLAGGED = f"""flagged as (select s.*, {_NUMBER} % 4 = 1 as revised, {_NUMBER} % 8 = 5 as gone, {_NUMBER} % 8 = 5 and tenant_id = 't0' as again from seeds s)"""
_REVISED_SEEDS = ",\n".join(
    f"{t}_r as (select * replace (coalesce({s.watched[0]}, '') || ' (revised)' as {s.watched[0]}) from {t})" for t, s in rules.SOURCES.items()
) + "," + re.sub(r"\bfrom (\w+)\b(?=\s*(?:\n|\)))", lambda m: f"from {m[1]}_r" if m[1] in rules.SOURCES else m[0], _SEEDS[_SEEDS.index("seeds as") :]).replace("seeds as", "revised_seeds as", 1)


def row_number(key: str):
    """The number in a key."""
    digits = F.regexp_replace(F.col(key).cast("string"), "[^0-9]", "")
    return F.coalesce(F.nullif(digits, F.lit("")).cast("long"), F.lit(0))


def later(T, table: str):
    """A source table after revisions and deletions."""
    key, column = rules.SOURCES[table].key, rules.SOURCES[table].watched[0]
    rows = T[table].filter(row_number(key) % 8 != 5)
    text = F.concat(F.coalesce(column, F.lit("")), F.lit(" (revised)"))
    return rows.withColumn(column, F.when(row_number(key) % 4 == 1, text).otherwise(F.col(column)))


def _marked(T, **options):
    out = rules.mark_all_stale(T["semantic_index"], {table: (T[table], later(T, table)) for table in _SOURCES}, **options)
    return out.select("id", *rules.KEY, "summary_text", "embedding_stale")


_ON_KEY = "c.tenant_id = t.tenant_id and c.source_table = t.source_table and c.source_id = t.source_id"


@query(
    "catalog_mark_stale",
    f"""with {_SEEDS}, {_FLAGGED}
select c.id, c.tenant_id, c.source_table, c.source_id, c.summary_text, c.embedding_stale or coalesce(t.revised and not t.gone, false) as embedding_stale
from semantic_index c left join flagged t on {_ON_KEY}""",
    ["semantic_index", "factory_config", *_SOURCES],
)
def catalog_mark_stale(T):
    return _marked(T)


@query(
    "catalog_mark_stale_rebuilt",
    f"""with {_SEEDS}, {_FLAGGED}, {_REVISED_SEEDS}
select c.id, c.tenant_id, c.source_table, c.source_id, case when t.revised and not t.gone then r.summary_text else c.summary_text end as summary_text,
  c.embedding_stale or coalesce(t.revised and not t.gone, false) as embedding_stale
from semantic_index c left join flagged t on {_ON_KEY}
left join revised_seeds r on r.tenant_id = t.tenant_id and r.source_table = t.source_table and r.source_id = t.source_id""",
    ["semantic_index", "factory_config", *_SOURCES],
)
def catalog_mark_stale_rebuilt(T):
    return _marked(T, rebuild_summary=True)


@query(
    "chunks_mark_stale",
    """select a.id, a.content, a.embedding_stale or b.content is distinct from a.content as embedding_stale
from chunks_after a left join document_chunks b on b.id = a.id""",
    ["document_chunks", "chunks_after"],
)
def chunks_mark_stale(T):
    return rules.mark_chunks_stale(T["document_chunks"], T["chunks_after"]).select("id", "content", "embedding_stale")


@query(
    "catalog_cascade_delete",
    f"""with {_SEEDS}, {_FLAGGED}
select c.id, c.source_table, c.source_id from semantic_index c where not exists (select 1 from flagged t where {_ON_KEY} and t.gone)""",
    ["semantic_index", "factory_config", *_SOURCES],
)
def catalog_cascade_delete(T):
    gone = {t: T[t].filter(row_number(rules.SOURCES[t].key) % 8 == 5) for t in _SOURCES}
    return rules.cascade_delete(T["semantic_index"], gone).select("id", "source_table", "source_id")


@query(
    "catalog_chunk_cleanup",
    "select c.id, c.source_id from chunk_catalog c where exists (select 1 from chunks_after a where a.id = c.id)",
    ["chunk_catalog", "chunks_after"],
)
def catalog_chunk_cleanup(T):
    gone = T["document_chunks"].join(T["chunks_after"].select("id"), "id", "left_anti")
    return rules.cascade_delete(T["chunk_catalog"], {"document_chunks": gone}).select("id", "source_id")


_KEYS_SQL = """
keys as (select tenant_id, 'tasks' as source_table, cast(id as varchar) as source_id, true as is_active from tasks
  union all select tenant_id, 'decisions', cast(id as varchar), true from decisions
  union all select tenant_id, 'brand_messaging', cast(id as varchar), true from brand_messaging
  union all select tenant_id, 'project_knowledge', cast(id as varchar), coalesce(is_active, true) from project_knowledge
  union all select tenant_id, 'known_rules', cast(id as varchar), true from known_rules
  union all select tenant_id, 'sop_registry', sop_id, true from sop_registry
  union all select tenant_id, 'agent_identity', agent_name, true from agent_identity)"""


@query(
    "catalog_uncatalogued",
    f"""with {_KEYS_SQL} select k.tenant_id, k.source_table, k.source_id from keys k where is_active and not exists (
  select 1 from semantic_index c where c.tenant_id = k.tenant_id and c.source_table = k.source_table and c.source_id = k.source_id)""",
    ["semantic_index", *_SOURCES],
)
def catalog_uncatalogued(T):
    return rules.uncatalogued(T, T["semantic_index"])


@query(
    "catalog_orphans",
    f"""with {_KEYS_SQL} select c.id, c.tenant_id, c.source_table, c.source_id from semantic_index c
where not exists (
  select 1 from keys k where c.tenant_id = k.tenant_id and c.source_table = k.source_table and c.source_id = k.source_id)
and not exists (select 1 from document_chunks k where c.source_table = 'document_chunks' and c.tenant_id = coalesce(k.tenant_id, 'main') and c.source_id = cast(k.id as varchar))""",
    ["semantic_index", "document_chunks", *_SOURCES],
)
def catalog_orphans(T):
    return rules.orphans(T, T["semantic_index"])


@query(
    "catalog_chunk_orphans",
    """select c.id, c.tenant_id, c.source_table, c.source_id from semantic_index c where c.source_table = 'document_chunks'
and not exists (select 1 from chunks_after k where c.tenant_id = coalesce(k.tenant_id, 'main') and c.source_id = cast(k.id as varchar))""",
    ["semantic_index", "chunks_after"],
)
def catalog_chunk_orphans(T):
    """Catalog rows of chunks that a later snapshot of the chunks no longer has."""
    held = T["semantic_index"].filter(F.col("source_table") == rules.CHUNK_TABLE)
    keys = rules.catalog_keys(T["chunks_after"], rules.CHUNK_TABLE, "id", "main")
    return held.select(*rules.KEY, "id").join(keys, rules.KEY, "left_anti")


# --- change log ----------------------------------------------------------------------
def changes_of(T, table: str):
    """Change feed of a table: every source row is created, a quarter is revised, half of
    those are deleted, and one tenant's are created again.  Chunks are there from the start."""
    chunks = table == rules.CHUNK_TABLE
    rows = T[table]
    key, column = ("id", "content") if chunks else (rules.SOURCES[table].key, rules.SOURCES[table].watched[0])
    rows = rows.withColumn("number_", row_number(key))
    columns = [c for c in rows.columns if c != "number_"]
    row = F.struct(*columns)
    none = F.lit(None).cast(rows.select(row.alias("r")).schema["r"].dataType)
    text = F.concat(F.coalesce(column, F.lit("")), F.lit(" (revised)")).alias(column)
    after = F.struct(*[text if c == column else F.col(c) for c in columns])

    def change(of, step, op, before, then):
        return of.select((F.col("number_") * 10 + step).alias("seq"), F.lit(op).alias("op"), before.alias("before"), then.alias("after"))

    gone = rows.filter("number_ % 8 = 5")
    out = change(rows.filter("number_ % 4 = 1"), 1, "update", row, after).unionByName(change(gone, 2, "delete", after, none))
    if chunks:
        return out
    return out.unionByName(change(rows, 0, "insert", none, row)).unionByName(change(gone.filter("tenant_id = 't0'"), 3, "insert", none, row))


_FED = [*_SOURCES, rules.CHUNK_TABLE]
_HELD = "c.id is not null and not coalesce(t.gone, false)"
_FOLDED = f"""
with {_SEEDS}, {_FLAGGED}
select coalesce(c.tenant_id, t.tenant_id) as tenant_id, coalesce(c.source_table, t.source_table) as source_table, coalesce(c.source_id, t.source_id) as source_id,
  case when {_HELD} then c.entity_type else t.entity_type end as entity_type,
  case when {_HELD} then c.summary_text else t.summary_text end as summary_text,
  case when {_HELD} then c.model_version else 'text-embedding-3-small' end as model_version,
  case when {_HELD} then c.embedding_stale or coalesce(t.revised, false) else true end as embedding_stale,
  case when {_HELD} then c.authority_tier else t.authority_tier end as authority_tier
from semantic_index c full join flagged t on {_ON_KEY}
where (not coalesce(t.gone, false) or t.again) and not (coalesce(c.source_table, '') = 'document_chunks' and exists (
  select 1 from document_chunks g where g.id % 8 = 5 and cast(g.id as varchar) = c.source_id and g.tenant_id = c.tenant_id))"""


def _log(T):
    return rules._union([rules.log_rows(changes_of(T, t), t) for t in _FED])


@query("catalog_apply_change_log", _FOLDED, ["semantic_index", "factory_config", *_FED])
def catalog_apply_change_log(T):
    return rules.fold(T["semantic_index"], _log(T)).select(*_STATE)


@query(
    "chunks_apply_change_log",
    "select id, embedding_stale or (id % 4 = 1 and id % 8 <> 5) as embedding_stale from document_chunks",
    ["document_chunks"],
)
def chunks_apply_change_log(T):
    log = rules.log_rows(changes_of(T, rules.CHUNK_TABLE), rules.CHUNK_TABLE)
    return rules.flag_chunks(T["document_chunks"], log).select("id", "embedding_stale")


@query("catalog_change_stream", _FOLDED, ["semantic_index", "factory_config", *_FED])
def catalog_change_stream(T):
    """A stream per table, all into one feed at the same time."""
    feed = CatalogFeed(T.spark, scratch_path(T.spark, "catalog"))
    feed.start(T["semantic_index"])
    running = []
    for table in _FED:
        inbox = scratch_path(T.spark, "changes")
        changes_of(T, table).coalesce(3).write.parquet(inbox)  # any order will do
        source = T.spark.readStream.schema(T.spark.read.parquet(inbox).schema).option("maxFilesPerTrigger", 2).parquet(inbox)
        running.append(apply_changes_stream(source, table, feed, scratch_path(T.spark, "progress"), compact_after=9))
    for stream in running:
        stream.awaitTermination()
    return feed.current().select(*_STATE)


# --- keyed writes, telemetry ------------------------------------------------------------
@query(
    "keyed_upsert",
    """select coalesce(a.id, b.id) as id, coalesce(a.title, b.title) as title, coalesce(a.status, b.status) as status, b.owner
from tasks_before b full join tasks_after a on a.id = b.id""",
    ["tasks_before", "tasks_after"],
)
def keyed_upsert(T):
    base = T["tasks_before"].select("id", "title", "status", "owner")
    return upsert.upsert(base, T["tasks_after"].select("id", "title", "status"), ["id"])


@query(
    "keyed_insert_ignore",
    """select id, title, status from tasks_before
union all select id, title, status from tasks_after a where not exists (select 1 from tasks_before b where b.id = a.id)""",
    ["tasks_before", "tasks_after"],
)
def keyed_insert_ignore(T):
    base = T["tasks_before"].select("id", "title", "status")
    return upsert.insert_ignore(base, T["tasks_after"].select("id", "title", "status"), ["id"])


@query(
    "telemetry_append",
    """select id, tenant_id, search_function, used_vector, coalesce(result_ids, '[]') as result_ids, latency_ms, created_at, cast(created_at as date) as dt
from retrieval_events""",
    ["retrieval_events"],
)
def telemetry_append(T):
    path = scratch_path(T.spark, "telemetry")
    record_events(T["retrieval_events"], path)
    return T.spark.read.parquet(path).select(
        "id", "tenant_id", "search_function", "used_vector", "result_ids", "latency_ms", "created_at", "dt"
    )


# --- embedding refresh ---------------------------------------------------------------------
@query(
    "embedding_pending",
    """select 'semantic_index' as tier, tenant_id, id, summary_text as text from semantic_index where embedding is null or embedding_stale
union all select 'document_chunks', tenant_id, id, content from document_chunks where embedding is null or embedding_stale""",
    ["semantic_index", "document_chunks"],
)
def embedding_pending(T):
    one = embedding.pending(T["semantic_index"], "summary_text").select(F.lit("semantic_index").alias("tier"), "*")
    return one.unionByName(embedding.pending(T["document_chunks"], "content").select(F.lit("document_chunks").alias("tier"), "*"))


def _embed_sql(table: str, text: str) -> str:
    return f"""
points as (select id, unnest(regexp_extract_all({text}, '(?s).')) as c from {table} where embedding is null or embedding_stale),
counts as (select id, unicode(c) % 64 as slot, cast(count(*) as double) as n from points group by 1, 2),
vectors as (select id, slot, n / sqrt(sum(n * n) over (partition by id)) as v from counts)"""


@query(
    "embedding_vectors",
    f"with {_embed_sql('semantic_index', 'summary_text')} select id, slot, round(cast(cast(round(v, 8) as float) as double), 5) as v from vectors",
    ["semantic_index"],
)
def embedding_vectors(T):
    waiting = embedding.pending(T["semantic_index"], "summary_text")
    vectors = embedding.embed(waiting, embedding.CodePointEmbedder(), dimensions=64, max_chars=None)
    rows = vectors.select("id", F.posexplode("vector").alias("slot", "v"))
    return rounded(rows.filter("v <> 0"), v=5)


@query(
    "embedding_applied",
    f"""with {_embed_sql('semantic_index', 'summary_text')},
first as (select id, max(cast(cast(round(v, 8) as float) as double)) as peak from vectors group by id)
select c.id, c.tenant_id, case when f.id is null then c.embedding_stale else false end as embedding_stale,
  case when f.id is null then c.model_version else 'model-new' end as model_version,
  case when f.id is null then c.embedded_at else cast('2024-06-01 00:00:00' as timestamp) end as embedded_at,
  round(case when f.id is null then cast(list_max(c.embedding) as double) else f.peak end, 4) as peak
from semantic_index c left join first f on f.id = c.id""",
    ["semantic_index"],
)
def embedding_applied(T):
    out = embedding.refresh(
        T["semantic_index"], "summary_text", embedding.CodePointEmbedder(), "model-new", datetime.datetime(2024, 6, 1),
        dimensions=64, max_chars=None,
    )
    return rounded(
        out.select("id", "tenant_id", "embedding_stale", "model_version", "embedded_at", F.array_max("embedding").alias("peak")),
        peak=4,
    )


@query(
    "embedding_pending_counts",
    """select 'semantic_index' as tier, tenant_id, count(*) filter (where embedding is null or embedding_stale) as pending from semantic_index group by tenant_id
union all select 'document_chunks', tenant_id, count(*) filter (where embedding is null or embedding_stale) from document_chunks group by tenant_id""",
    ["semantic_index", "document_chunks"],
)
def embedding_pending_counts(T):
    return embedding.pending_counts(T)


@query(
    "embedding_dimensions",
    """select 'semantic_index' as tier, cast(len(embedding) as int) as dimensions, count(*) as n from semantic_index where embedding is not null group by 2
union all select 'document_chunks', cast(len(embedding) as int), count(*) from document_chunks where embedding is not null group by 2""",
    ["semantic_index", "document_chunks"],
)
def embedding_dimensions(T):
    def tier(t):
        rows = T[t].filter("embedding is not null").groupBy(F.size("embedding").alias("dimensions"))
        return rows.agg(F.count("*").alias("n")).select(F.lit(t).alias("tier"), "dimensions", "n")

    return tier("semantic_index").unionByName(tier("document_chunks"))
