"""Profile assembly: signatures and rendered documents of all versions at once."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lorebase.functions.columns import capitalised, labelled
from lorebase.functions.documents import canonical_json

PART_END = "\u001e"  # fixed value
GAP = "\n\n"


def _ordered_text(rows: DataFrame, order: str, text: Column, separator: str, name: str) -> DataFrame:
    """Child rows of a version as one text, by sort order and ``order``; a NULL line drops out."""
    items = F.array_sort(F.collect_list(F.struct("sort_order", F.col(order).alias("k"), text.alias("text"))))
    return rows.groupBy("version_id").agg(
        F.array_join(F.transform(items, lambda i: i["text"]), separator).alias(name)
    )


def _known(column: str) -> Column:
    """A field of the signature; NULL counts as "~"."""
    return F.coalesce(F.col(column), F.lit("~"))


def _list(column: str) -> Column:
    """A list of the signature; a NULL list makes its whole part NULL."""
    return F.array_join(column, "#")


def _part(tag: str, *values: Column) -> Column:
    return F.concat(F.lit(tag), *[x for v in values for x in (F.lit("|"), v)])


def _joined(rows: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "version_id", "left"), others, rows)


def identity_signatures(T) -> DataFrame:
    """MD5 over version, bible, voice, lane and the three ordered child lists.

    The tags, the order of fields and the separators are fixed values.
    """
    version = T["profile_version"].select(
        F.col("id").alias("version_id"), "agent_name",
        _part("V", _known("role"), _known("one_liner"), _known("summary"), _list("trigger_phrases")).alias("version_part"),
    )
    bible = T["profile_bible"].select(
        "version_id",
        _part(
            "B", _known("archetype"), _known("backstory"), _known("personality"), _known("character_depth"), _known("humor"),
            _known("seriousness_boundary"), _known("evolution_history"), _list("traits"), _known("emoji"),
        ).alias("bible_part"),
    )
    voice = T["profile_voice"].select(
        "version_id",
        _part(
            "VC", _known("opening_convention"), _known("register"), _known("voice_texture"),
            _list("voice_anchors"), _list("sample_lines"), _list("forbidden_phrasings"), _known("emoji_policy"),
        ).alias("voice_part"),
    )
    lane = T["profile_lane"].select(
        "version_id",
        _part(
            "L", _known("primary_domain"), _list("does"), _list("does_not"),
            F.coalesce(canonical_json("handoffs"), F.lit("~")), _known("suppression_rules"),
        ).alias("lane_part"),
    )
    archetypes = _ordered_text(
        T["profile_archetype"], "layer", _part("A", F.col("layer"), F.col("archetype_name"), _known("description")), "||", "archetype_part"
    )
    dimensions = _ordered_text(T["profile_dimension"], "dimension", _part("D", F.col("dimension"), F.col("content")), "||", "dimension_part")
    strengths = _ordered_text(T["profile_strength"], "strength", _part("S", F.col("strength"), _known("description")), "||", "strength_part")
    rows = _joined(version, bible, voice, lane, archetypes, dimensions, strengths)
    parts = ["version_part", "bible_part", "voice_part", "lane_part", "archetype_part", "dimension_part", "strength_part"]
    text = F.concat_ws(PART_END, *[F.coalesce(p, F.lit("")) for p in parts])
    return rows.select("version_id", "agent_name", F.md5(text.cast("binary")).alias("signature"))


def signature_drift(T) -> DataFrame:
    """Stored signature and build records against the recomputed signature."""
    now = identity_signatures(T)
    stored = T["profile_version"].select(F.col("id").alias("version_id"), F.col("identity_signature").alias("stored_signature"))
    builds = T["profile_build"].select("version_id", F.col("identity_signature").alias("build_signature"))
    return now.join(stored, "version_id").join(builds, "version_id", "left").select(
        "version_id", "agent_name",
        F.when(F.col("stored_signature").isNull(), "UNSIGNED")
        .when(F.col("stored_signature") == F.col("signature"), "CURRENT").otherwise("DRIFTED").alias("stored_state"),
        F.when(F.col("build_signature").isNull(), "NOT_BUILT")
        .when(F.col("build_signature") == F.col("signature"), "CURRENT").otherwise("OUTDATED").alias("build_state"),
    )


def _text(column: str) -> Column:
    """A field that may be missing."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _line(*parts) -> Column:
    """Strings and columns as one text; NULL as soon as a column is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _paragraph(label: str, value) -> Column:
    """A labelled paragraph, left out when its value is NULL."""
    return labelled(label, F.col(value) if isinstance(value, str) else value, GAP)


def _header() -> Column:
    identity = F.coalesce(F.col("identity_version").cast("string"), F.lit("?"))
    signature = F.coalesce("identity_signature", F.lit("UNSIGNED"))
    return _line(
        "<!-- Generated from the profile record. Do not edit by hand. -->\n",
        "<!-- agent: ", F.col("agent_name"), " | version: ", F.col("version").cast("string"),
        " | identity_version: ", identity, " | identity_signature: ", signature, " -->" + GAP,
        "# ", capitalised(F.col("agent_name")), labelled(" — ", F.col("role")), GAP,
        labelled("> ", F.col("one_liner"), GAP),
        "**Callsign:** ", F.col("callsign"), " | **Factory:** ", F.col("factory_type"), " | **Status:** ", F.col("status"),
        labelled(" | **Emoji:** ", F.col("emoji")), GAP,
    )


def _body() -> Column:
    """The sections of the document; headings and labels are fixed values."""
    return _line(
        "## Identity" + GAP,
        _text("summary"), GAP,
        _paragraph("**Trigger phrases:** ", F.array_join("trigger_phrases", ", ")),
        "## Archetype Hierarchy" + GAP,
        _text("archetypes"), GAP,
        _paragraph("> Guardrail: ", "archetype"),
        "## Character" + GAP,
        _paragraph("**Personality.** ", "personality"),
        _paragraph("**Backstory.** ", "backstory"),
        _paragraph("**Depth.** ", "character_depth"),
        _paragraph("**Humor.** ", "humor"),
        _paragraph("**Seriousness boundary.** ", "seriousness_boundary"),
        _paragraph("**Traits:** ", F.array_join("traits", ", ")),
        "### Character Dimensions" + GAP,
        _text("dimensions"), GAP,
        "## Voice" + GAP,
        _paragraph("**Opening convention.** ", "opening_convention"),
        _paragraph("**Register.** ", "register"),
        _paragraph("**Texture.** ", "voice_texture"),
        _paragraph("**Anchors:** ", F.array_join("voice_anchors", " · ")),
        _paragraph("**Sample lines:**\n\n> ", F.array_join("sample_lines", "\n> ")),
        _paragraph("**Forbidden:**\n\n- ", F.array_join("forbidden_phrasings", "\n- ")),
        _paragraph("**Emoji policy.** ", "emoji_policy"),
        "## Lane" + GAP,
        _paragraph("**Primary domain:** ", "primary_domain"),
        _paragraph("**Does:** ", F.array_join("does", ", ")),
        _paragraph("**Routes away:**\n\n- ", F.array_join("does_not", "\n- ")),
        _paragraph("**Suppression.** ", "suppression_rules"),
        "## Strengths" + GAP,
        _text("strengths"), GAP,
        "## Tools" + GAP,
        _text("tools"), GAP,
        "<!-- Platform section: filled by the build, not part of the signature. -->\n",
    )


def render_documents(T) -> DataFrame:
    """Markdown text of every version; a NULL in a required place gives a NULL document."""
    rows = T["profile_version"].withColumnRenamed("id", "version_id").join(
        T["profile"].select("agent_name", "callsign", "factory_type", "status"), "agent_name"
    )
    archetype = _line("- **", F.col("layer"), "** — ", F.col("archetype_name"), ": ", _text("description"))
    dimension = _line("- **", F.col("dimension"), "** — ", F.col("content"))
    strength = _line("- **", F.col("strength"), "** — ", _text("description"))
    tool = _line("- `", F.col("tool_name"), "` — ", _text("purpose"))
    rows = _joined(
        rows,
        *[T[table].drop("id", "handoffs") for table in ("profile_bible", "profile_voice", "profile_lane")],
        _ordered_text(T["profile_archetype"], "layer", archetype, "\n", "archetypes"),
        _ordered_text(T["profile_dimension"], "dimension", dimension, "\n", "dimensions"),
        _ordered_text(T["profile_strength"], "strength", strength, "\n", "strengths"),
        _ordered_text(T["profile_tool"], "tool_name", tool, "\n", "tools"),
    )
    return rows.select("version_id", "agent_name", F.concat(_header(), _body()).alias("document"))
