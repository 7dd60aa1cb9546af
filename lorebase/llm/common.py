"""Column helpers of the corpus operators."""

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of anything but these: space and the control characters 9 to 13.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_process(key, make):
    """One ``make()`` per Python process, kept across its tasks.

    Functions reach the executors with the values of their module, so a module's own
    table would be empty again in every task.
    """
    held = sys.__dict__.setdefault("_lorebase_held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text in order; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


#: Shares of the rows that a key of ``spread_join`` may have before its rows are spread.
SHARES = 500


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", least: int = 1) -> DataFrame:
    """``many`` joined with ``one``, which has a row per ``key`` at most; frequent keys go to several tasks.

    ``many`` is a written table, as it is read twice.  At most ``SHARES`` keys can have more than that share
    of its rows; only these keys are broadcast, and their rows in ``one`` are repeated once per share.
    A share has ``least`` rows at least; a table of no more is joined as it is.
    """
    n = many.count()
    share = max(least, n // SHARES)
    if n <= share:
        return many.join(one, key, how)
    often = many.groupBy(key).agg(F.count(F.lit(1)).alias("times_")).filter(F.col("times_") > share)
    often = F.broadcast(often.select(key, F.ceil(F.col("times_") / share).cast("int").alias("shares_")))
    of = F.coalesce("shares_", F.lit(1))
    left = many.join(often, key, "left").withColumn("share_", F.pmod(F.xxhash64(*(c for c in many.columns if c != key)), of).cast("int")).drop("shares_")
    right = one.join(often, key, "left").withColumn("share_", F.explode(F.sequence(F.lit(0), of - 1))).drop("shares_")
    return left.join(right, [key, "share_"], how).drop("share_")


_PARTS = 1 << 40


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(7)), F.lit(_PARTS))


def budgets(sizes: dict, budget: int) -> dict:
    """Parts of ``budget`` for classes of these sizes: equal, and what small ones leave goes to the others."""
    out, left = {}, budget
    for k, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], str(x[0])))):
        out[name] = min(n, max(1, left // (len(sizes) - k)))
        left = max(0, left - out[name])
    return out


@dataclass
class ClassSample:
    """Which rows of each class are sampled, and how many characters of a text at most."""

    rows: dict  # rows of each class in the whole table
    limits: dict  # places below this are taken
    most: dict

    def _of(self, label: Column, values: dict) -> Column:
        return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), label)

    def takes(self, label: Column, key: Column) -> Column:
        return F.coalesce(_place(key) < self._of(label, self.limits), F.lit(False)) if self.limits else F.lit(False)

    def cut(self, label: Column, text: Column) -> Column:
        return F.substring(text, F.lit(1), self._of(label, self.most)) if self.most else text


def class_sample(rows: DataFrame, label: str, key: Column, weight: Column, budget: int, filled: Column | None = None) -> ClassSample:
    """A sample of about ``budget`` units of ``weight``, by ``budgets`` for the classes of all rows.

    A class takes its share of the rows by a hash of ``key``, and at least its row of the smallest
    hash that is ``filled`` (has any weight), so that every class of the table is in the sample.
    """
    filled = weight > 0 if filled is None else filled
    place = _place(key)
    found = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.sum(weight).alias("size"), F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.min(F.when(filled, place)), F.min(place)).alias("first"),
    ).collect()
    sizes = {r[label]: r["size"] or 0 for r in found}
    parts = budgets(sizes, budget)
    limits = {r[label]: _PARTS if parts[r[label]] >= sizes[r[label]] else max(_PARTS * parts[r[label]] // sizes[r[label]], r["first"] + 1) for r in found}
    return ClassSample({r[label]: r["rows"] for r in found}, limits, {k: max(1, n) for k, n in parts.items()})
