"""Stored report snapshots, refreshed as a whole and checked for their grain."""

from pyspark.sql import DataFrame, functions as F

from lorebase.operators import reports, runs
from lorebase.sources.scratch import Snapshots

_STARTUP_COLUMNS = [
    "last_session_id", "session_date", "platform", "session_type", "resume_notes",
    "open_tasks", "open_task_total", "embedding_health", "decommissioned_terms",
]

# name -> (report of store and tenant, grain: columns that must be unique; none = one row)
REPORTS = {
    "task_dashboard": (lambda T, tenant: reports.task_dashboard(T), []),
    "embedding_health": (lambda T, tenant: reports.embedding_health(T), ["tier", "tenant_id"]),
    "agent_status": (runs.readiness, ["agent_name"]),
    "system_inventory": (reports.system_inventory, []),
    "startup": (lambda T, tenant: reports.startup_summary(T, tenant).select(*_STARTUP_COLUMNS), ["last_session_id"]),
}

# What the hourly and the session-start refresh cover.
GROUPS = {
    "dashboards": ["task_dashboard", "embedding_health", "agent_status", "system_inventory"],
    "startup": ["startup", "task_dashboard", "embedding_health"],
}


def check_grain(rows: DataFrame, grain) -> None:
    repeated = rows.groupBy(*grain).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"snapshot has several rows for one {grain or 'snapshot'}: {repeated[0]}")


def refresh(T, names, root: str, tenant: str) -> dict[str, int]:
    """Write a new version of each named snapshot; returns the version numbers.

    A snapshot that breaks its grain is never marked ready: readers keep the old one.
    """
    written = {}
    for name in names:
        report, grain = REPORTS[name]
        store = Snapshots(T.spark, f"{root}/{name}")
        written[name] = store.write(report(T, tenant), check=lambda rows, g=grain: check_grain(rows, g))
    return written


def read(spark, root: str, name: str) -> DataFrame:
    return Snapshots(spark, f"{root}/{name}").read()
