"""Data-quality audits: keys, checks and references, and delete propagation."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lorebase.functions.columns import count_if
from lorebase.sources.model import CHECKS, KEYS, PARTIAL_KEYS, REFERENCES, Reference
from lorebase.sources.scratch import kept


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _value(columns):
    """Some columns as one text, NULL as soon as one is."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(complete, F.to_json(F.array(*[F.col(c).cast("string") for c in columns])))


def uniqueness_audit(T, keys: dict | None = None) -> DataFrame:
    """A row per key: how many of its values occur twice or more, and how many rows are too many.

    A value with a NULL in it equals no other.  A table is read once for all its keys.
    """
    frames = []
    for table, ks in (keys or KEYS).items():
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("key"), _value(k).alias("value")) for i, k in enumerate(ks)])).alias("x")
        values = T[table].select(each).select("x.*").filter("value is not null").groupBy("key", "value").agg(F.count("*").alias("n"))
        found = values.filter("n > 1").groupBy("key").agg(F.count("*").alias("duplicate_keys"), F.sum(F.col("n") - 1).alias("extra_rows"))
        names = T[table].sparkSession.createDataFrame([(i, table, ", ".join(k)) for i, k in enumerate(ks)], "key int, table_name string, key_columns string")
        frames.append(names.join(found, "key", "left").select(
            "table_name", "key_columns", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("duplicate_keys", "extra_rows")]
        ))
    return _union(frames)


def contested_claims(T) -> DataFrame:
    """Resources with more than one active lease."""
    condition, keys = PARTIAL_KEYS["work_claims"]
    return T["work_claims"].filter(condition).groupBy(*keys).agg(F.count("*").alias("active_claims")).filter("active_claims > 1")


def check_audit(T, checks: dict | None = None) -> DataFrame:
    """Violations per rule, one pass per table; NULL violates nothing."""
    frames = []
    for table, rules in (checks or CHECKS).items():
        counts = T[table].agg(*[count_if(~F.expr(rule)).alias(name) for name, rule in rules.items()])
        pairs = F.explode(F.array(*[
            F.struct(F.lit(name).alias("rule_name"), F.col(name).alias("violations")) for name in rules
        ])).alias("r")
        frames.append(counts.select(F.lit(table).alias("table_name"), pairs).select("table_name", "r.*"))
    return _union(frames)


def reference_audit(T, references=None) -> DataFrame:
    """A row per reference: how many child rows have a parent value that does not exist.

    A child is read once for all its references and a parent once for all that point to
    the same column; values are counted before they meet.  NULL needs no parent.
    """
    references = list(references or REFERENCES)
    targets = sorted({(r.parent, r.parent_column) for r in references})
    children = []
    for child in sorted({r.child for r in references}):
        own = [
            F.struct(F.lit(i).alias("ref"), F.lit(targets.index((r.parent, r.parent_column))).alias("target"), F.col(r.column).cast("string").alias("value"))
            for i, r in enumerate(references) if r.child == child
        ]
        rows = T[child].select(F.explode(F.array(*own)).alias("x")).select("x.*").filter("value is not null")
        children.append(rows.groupBy("ref", "target", "value").agg(F.count("*").alias("n")))
    parents = _union([
        T[table].select(F.lit(k).alias("target"), F.col(column).cast("string").alias("value")).filter("value is not null").distinct()
        for k, (table, column) in enumerate(targets)
    ])
    lost = _union(children).join(parents, ["target", "value"], "left_anti").groupBy("ref").agg(F.sum("n").alias("dangling_rows"))
    names = lost.sparkSession.createDataFrame(
        [(i, r.child, r.column, r.parent) for i, r in enumerate(references)], "ref int, child string, column_name string, parent string"
    )
    return names.join(lost, "ref", "left").select(
        "child", "column_name", "parent", F.coalesce("dangling_rows", F.lit(0)).cast("long").alias("dangling_rows")
    )


def propagate_deletes(T, table: str, deleted: DataFrame, references=None) -> dict[str, DataFrame]:
    """Tables after deleting the rows of ``table`` whose keys are in ``deleted``.

    Cascading references delete the children in turn, "null" references clear the column.  A step
    takes up only keys that no step before had, and stores them, so references in a circle come to
    an end when nothing new is reached, and a plan reads stored keys instead of the steps before.  At
    the end each table meets its deleted keys once per key column.  Tables that are not reached are
    not returned.
    """
    references = list(references or REFERENCES)
    gone: dict[str, dict[tuple, DataFrame]] = {}  # deleted keys by table and key columns
    cleared: dict[str, dict[str, DataFrame]] = {}  # deleted parents by table and column
    queue = [(table, deleted)]
    while queue:
        name, keys = queue.pop(0)
        columns, known = tuple(keys.columns), gone.setdefault(name, {})
        before = known.get(columns)
        new = keys.distinct() if before is None else keys.distinct().join(before, list(columns), "left_anti")
        new = kept(new, "frontier")
        known[columns] = new if before is None else before.unionByName(new)
        if before is not None and new.isEmpty():
            continue
        doomed = T[name].join(new, list(columns), "left_semi")
        for r in references:
            if r.parent != name or r.on_delete == "none":
                continue
            parents = doomed.select(F.col(r.parent_column).alias(r.column)).filter(F.col(r.column).isNotNull()).distinct()
            if r.on_delete == "cascade":
                queue.append((r.child, parents))
            else:
                some = cleared.setdefault(r.child, {})
                some[r.column] = some[r.column].unionByName(parents) if r.column in some else parents
    after = {}
    for name in [*gone, *(n for n in cleared if n not in gone)]:
        rows = T[name]
        for columns, keys in gone.get(name, {}).items():
            rows = rows.join(keys, list(columns), "left_anti")
        for column, parents in cleared.get(name, {}).items():
            marked = rows.join(parents.distinct().withColumn("_gone", F.lit(True)), column, "left")
            rows = marked.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns])
        after[name] = rows.select(*T[name].columns)
    return after
