"""Column helpers shared by the operators."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(df: DataFrame, keys, order) -> DataFrame:
    """First row of each key in ``order``; the rank cut runs before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys, order, n: int, rank: str = "rank", parts: int = 1, spread="id") -> DataFrame:
    """First ``n`` rows of each key in ``order``, numbered.

    With ``parts`` above one the rows of a key are first cut to ``n`` in that many parts,
    dealt by the column ``spread``, and then together: no task sorts all rows of a key,
    whether the planner puts a rank limit before the shuffle or not.
    """
    def cut(rows, *by):
        w = Window.partitionBy(*by).orderBy(*order)
        return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)

    if parts == 1:
        return cut(df, *keys)
    dealt = df.withColumn("part_", F.pmod(F.xxhash64(spread), F.lit(parts)))
    return cut(cut(dealt, *keys, "part_").drop(rank, "part_"), *keys)


def same(a, b) -> Column:
    """NULL-safe equality."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.eqNullSafe(b)


def any_of(conditions) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def glue(*parts) -> Column:
    """Concatenate, reading NULL as the empty string; plain strings are literals."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))


def labelled(label: str, value: Column, tail: str = "") -> Column:
    """``label + value + tail``, or the empty string when the value is NULL."""
    return F.coalesce(F.concat(F.lit(label), value, F.lit(tail)), F.lit(""))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def capitalised(text: Column) -> Column:
    """Upper-case the first letter of every run of letters and digits, lower the rest.

    Unlike Spark's ``initcap`` a hyphen or any other sign starts a new word.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(words, F.initcap), "")


def words_of(applies_to: Column) -> Column:
    """Split an audience text such as ``{a,b}`` on commas; empty text gives no element."""
    inner = F.btrim(applies_to, F.lit("{}"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))
