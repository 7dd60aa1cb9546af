"""Connector readiness and the recording of probe results."""

from pyspark.sql import DataFrame, functions as F

from lorebase.functions.columns import latest_per_key
from lorebase.operators.upsert import new_rows, upsert
from lorebase.sources.model import DEFAULT_TENANT

KNOWN_RESULTS = ["connected", "unavailable", "blocked"]  # fixed values
UNTESTED = "untested"
_STATUS_KEY = ["session_id", "connector_id"]


def _label():
    result = F.coalesce("probe_result", F.lit(UNTESTED))
    return (
        F.when(result == "connected", "OK")
        .when(result == "blocked", "BLOCKED")
        .when(F.col("criticality") == "critical", "CRITICAL-DOWN")
        .when(F.col("criticality") == "standard", "DEGRADED")
        .otherwise("REDUCED")
    )


def _readiness_columns():
    return [
        "connector_id", "display_name", "criticality", "category", "agent_primary", "platform_availability", "fallback_behavior",
        F.coalesce("probe_result", F.lit(UNTESTED)).alias("probe_result"),
        F.coalesce("fallback_active", F.lit(False)).alias("fallback_active"),
        "probe_note", "probed_at",
        _label().alias("status_label"),
    ]


def readiness(T, tenant: str) -> DataFrame:
    """Active connectors with their status in the tenant's newest session."""
    mine = F.col("tenant_id") == tenant
    newest = T["sessions"].filter(mine).agg(F.max("id")).scalar()
    status = T["session_status"].filter(mine & (F.col("session_id") == newest)).select(
        "connector_id", "probe_result", "fallback_active", "probe_note", "probed_at"
    )
    return T["connectors"].filter(mine & F.col("active")).join(status, "connector_id", "left").select(*_readiness_columns())


def readiness_by_session(T) -> DataFrame:
    registry = T["connectors"].filter("active").drop("tenant_id")
    sessions = T["sessions"].select(
        F.col("id").alias("session_id"), "session_date", F.col("platform").alias("session_platform")
    )
    return (
        T["session_status"].join(registry, "connector_id").join(sessions, "session_id", "left")
        .select("session_id", "session_date", "session_platform", *_readiness_columns())
    )


def session_status_rows(T, session_id: int | None = None, run_ts=None) -> DataFrame:
    """Status rows that seeding a session adds (default: the session with the largest id).

    As in the source, a row gets the default tenant, whatever the connector's.
    """
    sessions = T["sessions"]
    chosen = F.lit(session_id).cast("int") if session_id is not None else sessions.agg(F.max("id")).scalar()
    platform = sessions.filter(F.col("id") == chosen).agg(F.max("platform")).scalar()
    here = F.coalesce(platform, F.lit("unknown"))
    known = F.coalesce(F.col("probe_status").isin(KNOWN_RESULTS), F.lit(False))
    everywhere = F.col("platform_availability").isNull() | (F.size("platform_availability") == 0)
    rows = T["connectors"].filter("active").withColumns({"platform": here, "session_id": chosen}).filter(
        everywhere | F.array_contains("platform_availability", F.col("platform"))
    )
    seeded = rows.select(
        "session_id", "connector_id", F.lit(DEFAULT_TENANT).alias("tenant_id"), "platform",
        F.when(known, F.col("probe_status")).otherwise(UNTESTED).alias("probe_result"),
        F.when(F.col("is_blocked"), F.concat(F.lit("Blocked: "), F.coalesce("block_reason", F.lit("no reason recorded"))))
        .when(~known, "No prior probe on record").alias("probe_note"),
        F.lit(False).alias("fallback_active"),
        _now(run_ts).alias("probed_at"),
    )
    return new_rows(T["session_status"], seeded, _STATUS_KEY)


def _now(run_ts):
    return F.current_timestamp() if run_ts is None else F.lit(run_ts)


def record_probes(T, probes: DataFrame, run_ts=None) -> tuple[DataFrame, DataFrame]:
    """Apply a batch of probe results: (new connector registry, new session status).

    ``probes``: seq, connector_id, session_id, result, note.  The registry takes
    the last result per connector whatever its tenant, and the time of the run; a status
    row is added only for a known session, with its platform and the default tenant, and
    an existing one is updated and keeps both.
    """
    last = latest_per_key(probes, ["connector_id"], [F.desc("seq")]).select(
        "connector_id", F.col("result").alias("probe_status"), _now(run_ts).alias("last_probed_at")
    )
    known = last.join(T["connectors"].select("connector_id"), "connector_id", "left_semi")
    registry = upsert(T["connectors"], known, ["connector_id"])

    latest = latest_per_key(probes, _STATUS_KEY, [F.desc("seq")])
    sessions = T["sessions"].select(
        F.col("id").alias("session_id"), F.coalesce("platform", F.lit("unknown")).alias("here"), F.lit(True).alias("known_session")
    )
    held = T["session_status"].select(
        *_STATUS_KEY, F.col("platform").alias("held_platform"), F.col("tenant_id").alias("held_tenant"), F.lit(True).alias("held")
    )
    writable = latest.join(sessions, "session_id", "left").join(held, _STATUS_KEY, "left").filter("known_session or held")
    rows = writable.select(
        *_STATUS_KEY,
        F.when(F.col("held"), F.col("held_tenant")).otherwise(DEFAULT_TENANT).alias("tenant_id"),
        F.when(F.col("held"), F.col("held_platform")).otherwise(F.col("here")).alias("platform"),
        F.col("result").alias("probe_result"), F.col("note").alias("probe_note"),
        F.lit(False).alias("fallback_active"), _now(run_ts).alias("probed_at"),
    )
    return registry, upsert(T["session_status"], rows, _STATUS_KEY)
