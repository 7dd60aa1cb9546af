"""Keyed writes expressed as joins: the result is the whole new table."""

from pyspark.sql import DataFrame, functions as F

from lorebase.functions.columns import latest_per_key
from lorebase.sources.scratch import kept


def _one_per_key(updates: DataFrame, keys, order) -> DataFrame:
    """The first row of each key in ``order``; without one, in the order of all other columns,
    so that a rerun picks the same row."""
    others = [F.asc_nulls_last(c) for c in updates.columns if c not in keys]
    return latest_per_key(updates, keys, order or others) if order or others else updates.dropDuplicates(list(keys))


def _aligned(df: DataFrame, columns, like: DataFrame) -> DataFrame:
    """Same columns in the same order and type; a column the rows lack is NULL."""
    types = dict(like.dtypes)
    return df.select(
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in columns]
    )


def insert_ignore(target: DataFrame, updates: DataFrame, keys, order=()) -> DataFrame:
    """Add the rows whose key is new; keep the old row on conflict."""
    fresh = new_rows(target, updates, keys, order)
    return target.unionByName(_aligned(fresh, target.columns, target))


def new_rows(target: DataFrame, updates: DataFrame, keys, order=()) -> DataFrame:
    """The rows that :func:`insert_ignore` adds."""
    return _one_per_key(updates, keys, order).join(target.select(*keys), list(keys), "left_anti")


def upsert(target: DataFrame, updates: DataFrame, keys, order=()) -> DataFrame:
    """Replace the columns that the updates carry, add the rows whose key is new.

    The target meets the updates in a left join, which broadcasts a small batch
    instead of shuffling the table; only key columns are compared to find new rows.
    """
    ups = kept(_one_per_key(updates, keys, order), "updates")
    carried = [c for c in ups.columns if c not in keys]
    marked = ups.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in carried], F.lit(True).alias("_hit"))
    joined = target.join(marked, list(keys), "left")

    def pick(c):
        if c in keys or c not in carried:
            return F.col(c)
        return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    types = dict(target.dtypes)
    changed = joined.select(*[pick(c).cast(types[c]).alias(c) for c in target.columns])
    fresh = ups.join(target.select(*keys), list(keys), "left_anti")
    return changed.unionByName(_aligned(fresh, target.columns, target))
