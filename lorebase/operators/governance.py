"""Rule fan-out, agreement coverage, retired-term scans and dead references."""

from pyspark.sql import DataFrame, functions as F

from lorebase.functions.columns import any_of, count_if, words_of
from lorebase.functions.terms import contained

EVERYONE = ["all", "all-agents"]  # fixed values
# Targets shown next to the counters.
RULE_TARGET = 21
GOVERNANCE_TARGET = 28
PREVIEW = 200

BROADCAST_BYTES = 8 << 20  # patterns sent out in one block, about
AUTOMATON_BYTES = 1 << 20  # terms of one block of automata, which take some forty times as much


def rules_by_agent(T, roster) -> DataFrame:
    """One row per rule and agent it applies to; a rule for everyone gets the roster."""
    everyone = F.array(*[F.lit(a) for a in roster])
    names = F.when(F.col("applies_to").isin(EVERYONE), everyone).otherwise(words_of(F.col("applies_to")))
    return T["known_rules"].select(
        "id", "tenant_id", F.explode(names).alias("name"), "rule", "rule_type", "enforcement", "category",
        F.col("applies_to").alias("original_applies_to"),
    ).select("id", "tenant_id", F.trim("name").alias("agent_name"), "rule", "rule_type", "enforcement", "category", "original_applies_to")


def startup_rules(T) -> DataFrame:
    plain = F.regexp_replace(F.coalesce("applies_to", F.lit("")), r'[{}\[\]"]', "")
    rows = T["known_rules"].filter("category = 'startup'").select(
        "id", "enforcement", "rule", "category", "rule_type", F.explode(F.split(plain, r"\s*,\s*")).alias("name"),
        "applies_to", "tenant_id", "updated_at",
    )
    return rows.withColumn("agent", F.lower(F.trim("name"))).filter("agent <> ''").drop("name")


def agreement_coverage(T, roster) -> DataFrame:
    """Matching rules per agreement and required rule type.

    Rules are counted per agent and type first, so the join carries counts only.
    """
    counts = rules_by_agent(T, roster).groupBy("tenant_id", "agent_name", "rule_type").agg(F.count("*").alias("n"))
    required = T["factory_agreements"].select(
        "tenant_id", "agent_name", "agreement_version", F.explode("required_rule_types").alias("rule_type")
    )
    matched = required.join(counts, ["tenant_id", "agent_name", "rule_type"], "left")
    total = F.coalesce(F.sum("n"), F.lit(0))
    return matched.groupBy("agent_name", "agreement_version", "rule_type").agg(
        total.alias("rule_count"), F.when(total == 0, "GAP").otherwise("COVERED").alias("coverage_status")
    )


def agreement_status(T) -> DataFrame:
    """Loaded rules and missing rule types per agreement.

    Names are compared as written, blanks included; a rule meets an agent by its
    whole audience text or by one element of it, and counts once either way.
    """
    audience = F.col("applies_to")
    rules = T["known_rules"].select("tenant_id", "rule_type", audience, audience.isin(EVERYONE).alias("everyone"))
    direct = rules.filter("not everyone").select(
        "tenant_id", "rule_type",
        F.explode(F.array_distinct(F.concat(F.array("applies_to"), words_of(F.col("applies_to"))))).alias("agent_name"),
    )

    def summed(df, *keys, suffix):
        return df.groupBy(*keys).agg(
            F.count("*").alias(f"n_{suffix}"), F.collect_set("rule_type").alias(f"types_{suffix}")
        )

    agreements = T["factory_agreements"].join(
        summed(direct, "tenant_id", "agent_name", suffix="own"), ["tenant_id", "agent_name"], "left"
    ).join(summed(rules.filter("everyone"), "tenant_id", suffix="all"), "tenant_id", "left")
    none = F.array().cast("array<string>")
    held = F.concat(F.coalesce("types_own", none), F.coalesce("types_all", none))
    rows = agreements.withColumn("held", held).withColumn(
        "missing_rule_types", F.filter("required_rule_types", lambda t: ~F.array_contains("held", t))
    )
    return rows.select(
        "agent_name", "agreement_version", "enforcement_model", "required_rule_types",
        (F.coalesce("n_own", F.lit(0)) + F.coalesce("n_all", F.lit(0))).alias("loaded_rules"), "tenant_id",
        "missing_rule_types",
        F.when(F.size("missing_rule_types") == 0, "READY").otherwise("WARN_MISSING_RULE_TYPES").alias("status_label"),
    )


def halt_rules_by_agent(T, roster) -> DataFrame:
    return rules_by_agent(T, roster).filter("enforcement = 'halt'").groupBy("agent_name", "tenant_id").agg(
        F.count("*").alias("halt_rule_count"),
        F.array_sort(F.collect_list("id")).alias("rule_ids"),
        F.array_sort(F.collect_set("category")).alias("categories"),
    )


def _retired_hits(T, rows: DataFrame, table: str, key: str, texts, keep, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows that contain retired terms of their tenant, minus allowed pairs.

    The terms of a tenant form one automaton, through which a text of any length
    passes once, so the work does not grow with the number of terms and no pair of
    text and term is ever made.  The list is measured first and goes out in as many
    blocks as its bytes need.  Terms with LIKE signs act as patterns; they are tried
    one by one inside the row, and cost nothing where there are none.  An empty term
    is such a pattern too: it is in every text.  The allow list joins last, against
    the few rows with a hit.
    """
    listed = T["decommissioned_terms"].select("tenant_id", "term").distinct().filter("tenant_id is not null and term is not null")
    listed = listed.withColumn("pattern", F.col("term").rlike(r"[%_\\]") | (F.col("term") == ""))
    size = F.octet_length("term") + 32
    plain, patterns = listed.agg(*(
        F.coalesce(F.sum(F.when(F.col("pattern") == of, size)), F.lit(0)) for of in (False, True)
    )).first()
    none = F.array().cast("array<string>")
    met = rows.withColumns({f"_low_{t}": F.lower(t) for t in texts}).withColumns({"_key": F.col(key).cast("string"), "matched": none})

    def blocks(of: bool, n_bytes: int, most: int):
        n = -(-n_bytes // most)
        return [listed.filter((F.col("pattern") == of) & (F.pmod(F.xxhash64("term"), F.lit(n)) == b)) for b in range(n)]

    for mine in blocks(False, plain, min(block_bytes, AUTOMATON_BYTES)):
        sent = mine.select("tenant_id", F.lower("term"), "term").collect()
        hit = contained(T.spark, sent, "tenant_id", [f"_low_{t}" for t in texts])
        met = met.withColumn("matched", F.concat("matched", hit))
    for mine in blocks(True, patterns, block_bytes):
        terms = F.broadcast(mine.groupBy("tenant_id").agg(F.collect_list("term").alias("terms")))
        hit = F.filter("terms", lambda p: F.coalesce(
            any_of([F.ilike(F.col(t), F.concat(F.lit("%"), p, F.lit("%"))) for t in texts]), F.lit(False)
        ))
        met = met.join(terms, "tenant_id", "left").withColumn("matched", F.concat("matched", F.coalesce(hit, none))).drop("terms")
    hits = met.filter(F.size("matched") > 0).select("tenant_id", "_key", *keep, F.array_sort("matched").alias("matched"))
    allowed = T["decommissioned_term_allowlist"].filter(F.col("source_table") == table).groupBy(
        "tenant_id", F.col("source_id").alias("_key")
    ).agg(F.collect_set("term").alias("allowed"))
    left = hits.join(allowed, ["tenant_id", "_key"], "left").withColumn(
        "matched_terms", F.array_except("matched", F.coalesce("allowed", none))
    )
    out = left.filter(F.size("matched_terms") > 0).withColumn("hit_count", F.size("matched_terms").cast("long"))
    return out.drop("_key", "matched", "allowed")


def knowledge_with_retired_terms(T, **options) -> DataFrame:
    preview = F.left("detail", F.lit(PREVIEW)).alias("detail_preview")
    return _retired_hits(
        T, T["project_knowledge"], "project_knowledge", "id", ["title", "detail"], ["id", "knowledge_type", "title", preview], **options
    )


def rules_with_retired_terms(T) -> DataFrame:
    preview = F.left("rule", F.lit(PREVIEW)).alias("rule_preview")
    return _retired_hits(T, T["known_rules"], "known_rules", "id", ["rule"], ["id", "category", preview])


def procedures_with_retired_terms(T) -> DataFrame:
    preview = F.left(F.coalesce("summary", "full_body"), F.lit(PREVIEW)).alias("preview")
    rows = T["sop_registry"].filter("status not in ('tombstoned', 'deprecated')")
    return _retired_hits(T, rows, "sop_registry", "sop_id", ["title", "summary", "full_body"], ["sop_id", "title", preview])


def retired_term_counts(T, tenant: str) -> DataFrame:
    """One row: rows with retired terms in rules, knowledge and procedures."""
    def n(rows):
        return rows.filter(F.col("tenant_id") == tenant).agg(F.count("*")).scalar()

    return T.spark.range(1).select(
        n(rules_with_retired_terms(T)).alias("rules"),
        n(knowledge_with_retired_terms(T)).alias("knowledge"),
        n(procedures_with_retired_terms(T)).alias("sops"),
    )


def dead_references(T, tenant: str) -> DataFrame:
    """Procedure numbers named in rules that lead to no active procedure.

    A reference meets a procedure by its id or as part of its title.  "Part of
    the title" is an equality too: the number in the title, or a prefix of it,
    is the reference.  So both ways are one equi join.
    """
    refs = T["known_rules"].filter(F.col("tenant_id") == tenant).select(
        F.col("id").alias("rule_id"), F.explode(F.regexp_extract_all("rule", F.lit(r"(SOP-[0-9]+)"), F.lit(1))).alias("sop_ref")
    )
    numbers = F.regexp_extract_all(F.upper("title"), F.lit(r"SOP-([0-9]+)"), F.lit(1))
    prefixes = F.flatten(F.transform(numbers, lambda n: F.transform(
        F.sequence(F.lit(1), F.length(n)), lambda i: F.concat(F.lit("SOP-"), F.substring(n, F.lit(1), i))
    )))
    names = F.array_distinct(F.concat(F.array("sop_id"), prefixes))
    registry = T["sop_registry"].filter(F.col("tenant_id") == tenant).select(
        "sop_id", "status", F.explode(names).alias("sop_ref")
    )
    return refs.join(registry, "sop_ref", "left").filter("sop_id is null or status <> 'active'").select(
        "rule_id", "sop_ref", "sop_id", "status"
    )


def governance_health(T, tenant: str) -> DataFrame:
    """One row of counters next to their fixed targets."""
    mine = F.col("tenant_id") == tenant
    rules = T["known_rules"].agg(F.struct(
        count_if(mine).alias("active_rule_count"), count_if(mine & (F.col("rule_type") == "sop")).alias("rule_type_sop_count")
    ).alias("v"))
    active = mine & (F.col("status") == "active")
    untriggered = F.col("trigger_phrases").isNull() | (F.size("trigger_phrases") == 0)
    procedures = T["sop_registry"].agg(F.struct(
        count_if(active).alias("active_sop_count"), count_if(active & untriggered).alias("missing_sop_trigger_count")
    ).alias("v"))
    agreements = T["factory_agreements"].agg(count_if(mine & F.array_contains("required_rule_types", "sop")))
    return T.spark.range(1).select(
        rules.scalar().alias("r"), procedures.scalar().alias("p"),
        F.lit(RULE_TARGET).alias("rule_count_target"), F.lit(GOVERNANCE_TARGET).alias("combined_governance_target"),
        agreements.scalar().alias("agreement_required_sop_count"),
        dead_references(T, tenant).agg(F.count("*")).scalar().alias("dead_sop_reference_count"),
    ).select("r.*", "p.*", "rule_count_target", "combined_governance_target", "agreement_required_sop_count", "dead_sop_reference_count")
