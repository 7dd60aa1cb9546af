"""Named queries, each with the SQL that must give the same rows."""

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from lorebase.sources.derived import Store, with_clause


@dataclass
class Query:
    run: Callable
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, tables=()):
    """Register ``fn(T)``; ``sql`` may read the derived ``tables`` and all raw ones."""

    def add(fn):
        def run(spark, sf_dir):
            return fn(Store(spark, sf_dir))

        text = sql
        if sql is not None and tables:
            body = sql.strip()
            lead = f"with {with_clause(tables)}"
            text = f"{lead},\n{body[5:]}" if body[:5].lower() == "with " else f"{lead}\n{body}"
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(run, text)
        return fn

    return add


def rounded(df: DataFrame, **decimals) -> DataFrame:
    """Floating columns at a fixed number of decimals, for comparison."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in decimals.items()})


def joined(df: DataFrame, *columns, sep: str = "|") -> DataFrame:
    """Array columns as delimited text, for comparison."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), sep, "~") for c in columns})
