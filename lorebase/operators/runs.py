"""Reports over evaluation runs."""

from pyspark.sql import DataFrame, Window, functions as F

from lorebase.functions.columns import count_if, latest_per_key, top_per_key

IMPROVEMENT_CEILING = 5  # fixed value: layer-1 scores above it are on another scale


def _newest():
    return [F.desc("run_date"), F.desc("id")]


def _agent():
    return F.lower("agent_name")


def latest_by_agent(T) -> DataFrame:
    last = latest_per_key(T["eval_runs"], ["agent_name"], _newest())
    return last.select("agent_name", "model_tested", "layer", "score", "pass", F.to_date("run_date").alias("last_run"))


def latest_by_agent_and_factory(T) -> DataFrame:
    last = latest_per_key(T["eval_runs"], ["agent_name", "factory_id"], _newest())
    return last.select(
        "agent_name", "factory_id", "factory_tenant", "model_tested", "layer", "score", "pass", "run_mode", "agent_version", "agent_sig",
        F.to_date("run_date").alias("last_run"),
    )


def cross_factory(T) -> DataFrame:
    return latest_by_agent_and_factory(T).groupBy("factory_id", "factory_tenant").agg(
        F.count_distinct("agent_name").alias("agents_tested"),
        F.round(F.avg("score"), 2).alias("avg_score"),
        F.sum(F.when(F.col("pass"), 1).otherwise(0)).alias("passed"),
        F.sum(F.when(~F.col("pass"), 1).otherwise(0)).alias("failed"),
        F.max("last_run").alias("last_run"),
    )


def compliance_trend(T, n: int = 10) -> DataFrame:
    recent = top_per_key(T["eval_runs"], ["agent_name", "factory_id"], _newest(), n, rank="recency")
    return recent.select(
        "agent_name", "factory_id", "layer", F.to_date("run_date").alias("run_date"), "score", "pass",
        "model_tested", "agent_version", "agent_sig", "recency",
    )


def drift(T, bucket: str = "hour") -> DataFrame:
    """Score against the previous run of the same agent and factory.

    The lag is taken inside time buckets; only the first row of a bucket looks
    back, at the last row of the bucket before.  So an agent with very many runs
    is spread over its buckets instead of being sorted in one task.
    """
    keys = ["agent_name", "factory_id"]
    rows = T["eval_runs"].select("id", *keys, "score", "run_date", F.date_trunc(bucket, "run_date").alias("bucket"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("run_date", "id")
    rows = rows.withColumn("place", F.row_number().over(inside)).withColumn("before", F.lag("score").over(inside))

    ends = T["eval_runs"].groupBy(*keys, F.date_trunc(bucket, "run_date").alias("bucket")).agg(
        F.max_by("score", F.struct("run_date", "id")).alias("last_score")
    )
    ends = ends.select(
        *keys, "bucket", F.lag("last_score").over(Window.partitionBy(*keys).orderBy("bucket")).alias("carried")
    )
    previous = F.when(F.col("place") == 1, F.col("carried")).otherwise(F.col("before"))
    return rows.join(ends, [*keys, "bucket"]).select(
        "id", *keys, F.col("score").alias("current_score"), previous.alias("previous_score"),
        (F.col("score") - previous).alias("delta"), F.to_date("run_date").alias("run_date"),
    )


def active_failures(T) -> DataFrame:
    """Failed runs with no later pass of the same agent, tenant and layer.

    "A later pass exists" is "the last pass is later", an equi join.
    """
    runs = T["eval_runs"].withColumn("agent", _agent())
    keys = ["agent", "factory_tenant", "layer"]
    last_pass = runs.filter("pass").groupBy(*keys).agg(F.max("run_date").alias("passed_at"))
    failed = runs.filter("not pass").join(last_pass, keys, "left")
    return failed.filter("passed_at is null or passed_at <= run_date").select(
        F.col("agent").alias("agent_name"), "factory_tenant", "layer", "score", "notes", F.to_date("run_date").alias("run_date")
    )


def history(T) -> DataFrame:
    return T["eval_runs"].select(
        "id", F.to_date("run_date").alias("run_date"), "agent_name", "model_tested", "layer", "score", "pass", "notes"
    )


def layer1_improvement(T) -> DataFrame:
    """Spread of layer-1 scores; ``first_score`` is the lowest, as in the source."""
    rows = T["eval_runs"].filter((F.col("layer") == 1) & (F.col("score") <= IMPROVEMENT_CEILING))
    return rows.groupBy(_agent().alias("agent_name"), "factory_tenant").agg(
        F.count("*").alias("total_l1_runs"),
        F.min("score").alias("first_score"),
        F.max("score").alias("best_score"),
        F.round(F.max("score") - F.min("score"), 2).alias("score_delta"),
        F.bool_or("pass").alias("ever_passed"),
        F.to_date(F.max("run_date")).alias("last_run"),
    ).filter("total_l1_runs > 1")


def _layer(runs: DataFrame, n: int) -> DataFrame:
    last = latest_per_key(runs.filter(F.col("layer") == n), ["agent"], _newest())
    return last.select(
        F.col("agent").alias("agent_name"), F.col("score").alias(f"l{n}_score"), F.col("pass").alias(f"l{n}_pass"),
        F.col("notes").alias(f"l{n}_notes"), F.col("agent_version").alias(f"l{n}_agent_version"),
        F.to_date("run_date").alias(f"l{n}_run_date"),
    )


def _tenant_runs(T, tenant: str) -> DataFrame:
    return T["eval_runs"].filter(F.col("factory_tenant") == tenant).withColumn("agent", _agent())


def readiness(T, tenant: str) -> DataFrame:
    """Latest layer-1 and layer-2 result per agent with a readiness tier."""
    runs = _tenant_runs(T, tenant)
    both = _layer(runs, 1).join(_layer(runs, 2), "agent_name", "full")
    l1, l2 = F.col("l1_pass"), F.col("l2_pass")
    tier = (
        F.when(l1 & l2, "PRODUCTION_READY")
        .when(l1 & l2.isNull(), "L1_PASS_AWAITING_L2")
        .when(~l1, "REWRITE_REQUIRED")
        .when(l1.isNull() & l2.isNull(), "NOT_EVALUATED")
        .otherwise("DEFERRED")
    )
    return both.select(
        "agent_name", "l1_score", "l1_pass", "l2_score", "l2_pass", tier.alias("readiness_tier"), "l1_notes", "l2_notes"
    )


def canonical_readiness(T, tenant: str) -> DataFrame:
    """As :func:`readiness`, but failed layer-2 runs do not count at all."""
    runs = _tenant_runs(T, tenant)
    counted = runs.filter((F.col("layer") != 2) | F.coalesce(F.col("pass"), F.lit(True)))
    both = _layer(counted, 1).join(_layer(counted, 2), "agent_name", "full")
    l1, l2 = F.col("l1_pass"), F.col("l2_pass")
    tier = (
        F.when(l1 & l2, "PRODUCTION_READY")
        .when(l1 & (l2.isNull() | ~l2), "L1_PASS_AWAITING_L2")
        .when(~l1, "REWRITE_REQUIRED")
        .when(l1.isNull(), "NOT_EVALUATED")
        .otherwise("DEFERRED")
    )
    return both.select(
        "agent_name", "l1_score", "l1_pass", "l1_agent_version", "l1_run_date", "l2_score", "l2_pass", "l2_run_date",
        tier.alias("readiness_tier"),
    )


def factory_coverage(T) -> DataFrame:
    def agents(condition):
        return F.count_distinct(F.when(condition, _agent()))

    return T["eval_runs"].groupBy("factory_tenant").agg(
        F.count_distinct(_agent()).alias("agents_tested"),
        agents(F.col("pass")).alias("agents_passed"),
        agents(~F.col("pass")).alias("agents_failed"),
        agents(F.col("pass").isNull()).alias("agents_unscored"),
        F.max("run_date").alias("last_eval"),
    )


#: Logarithm of the registers of a sketch: a standard error of about 1.6 %.
SKETCH_BITS = 12


def agent_sketches(T) -> DataFrame:
    """Mergeable sketches of the distinct agents of each tenant and day: tested, passed, failed and unscored.

    Stored, they are extended by a day without reading the runs of other days.
    """
    def sketch(condition, name):
        return F.hll_sketch_agg(F.when(condition, _agent()), F.lit(SKETCH_BITS)).alias(name)

    return T["eval_runs"].groupBy("factory_tenant", F.to_date("run_date").alias("day")).agg(
        sketch(F.lit(True), "tested"), sketch(F.col("pass"), "passed"), sketch(~F.col("pass"), "failed"),
        sketch(F.col("pass").isNull(), "unscored"), F.max("run_date").alias("last_eval"),
    )


def factory_coverage_estimated(sketches: DataFrame, since=None) -> DataFrame:
    """:func:`factory_coverage` from the sketches of days, all or those from ``since`` on; counts are estimates."""
    days = sketches if since is None else sketches.filter(F.col("day") >= F.lit(since))
    merged = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"agents_{c}")
    return days.groupBy("factory_tenant").agg(*(merged(c) for c in ("tested", "passed", "failed", "unscored")), F.max("last_eval").alias("last_eval"))


def rewrite_queue(T, tenant: str) -> DataFrame:
    unpassed = (F.col("layer") == 1) & ~F.coalesce(F.col("pass"), F.lit(False)) & (F.col("factory_tenant") == tenant)
    return T["eval_runs"].filter(unpassed).select(
        _agent().alias("agent_name"), F.col("score").alias("l1_score"), F.col("notes").alias("reviewer_notes"), "run_date"
    )


def layer2_coverage(T) -> DataFrame:
    def flag(name):
        return F.coalesce(F.get_json_object("criteria_results", f"$.{name}") == "true", F.lit(False))

    # the number 0, not the text "0"
    samples = F.to_json(F.try_variant_get(F.try_parse_json("criteria_results"), "$.evidence_samples", "variant"))
    short = flag("insufficient_evidence") | F.coalesce(samples == "0", F.lit(False))
    return T["eval_runs"].filter("layer = 2").groupBy("factory_tenant").agg(
        F.count_distinct(_agent()).alias("agents_with_l2"),
        F.count("*").alias("total_l2_runs"),
        count_if(F.col("pass")).alias("l2_passes"),
        count_if(F.col("pass").isNull()).alias("unscored"),
        count_if(flag("correction_evidence_found")).alias("correction_evidence_found"),
        count_if(short).alias("insufficient_evidence"),
        F.to_date(F.max("run_date")).alias("last_collection"),
    )
