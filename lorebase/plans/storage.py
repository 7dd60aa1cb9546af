"""Typed scans and stored snapshots."""

from lorebase.operators import snapshots
from lorebase.plans.registry import REGISTRY, query, rounded
from lorebase.plans.reports import TENANT
from lorebase.sources import tables
from lorebase.sources.scratch import scratch_path


def _stored(T, *names, by_tenant=()):
    root = scratch_path(T.spark, "store")
    for name in names:
        tables.store(T[name], root, name, by_tenant=name in by_tenant)
    return root


@query(
    "typed_scan",
    """select id, tenant_id, coalesce(is_active, true) as is_active, knowledge_type, title, detail from project_knowledge""",
    ["project_knowledge"],
)
def typed_scan(T):
    root = _stored(T, "project_knowledge")
    return tables.load(T.spark, root, "project_knowledge")


@query(
    "tenant_scan",
    """select tenant_id, id, source_table, source_id, authority_tier, embedding_stale from semantic_index where tenant_id = 't1'""",
    ["semantic_index"],
)
def tenant_scan(T):
    root = _stored(T, "semantic_index", by_tenant=("semantic_index",))
    rows = tables.tenant(tables.load(T.spark, root, "semantic_index"), "t1")
    return rows.select("tenant_id", "id", "source_table", "source_id", "authority_tier", "embedding_stale")


def _snapshot(name: str, report: str, group: str, columns=None, **decimals):
    """A stored snapshot must hold exactly the rows of its report."""
    sql = REGISTRY[report].sql
    if columns:
        sql = f"select {', '.join(columns)} from ({sql}) r"

    def run(T):
        root = scratch_path(T.spark, "snapshots")
        snapshots.refresh(T, snapshots.GROUPS[group], root, TENANT)
        return rounded(snapshots.read(T.spark, root, name), **decimals)

    query(f"snapshot_{name}", sql)(run)


_snapshot("embedding_health", "embedding_health", "dashboards")
_snapshot("task_dashboard", "task_dashboard", "dashboards")
_snapshot("agent_status", "runs_readiness", "dashboards", l1_score=2, l2_score=2)
_snapshot("system_inventory", "system_inventory", "dashboards")
_snapshot("startup", "startup_summary", "startup", snapshots._STARTUP_COLUMNS)
