"""Typed table scans over a folder of Parquet datasets."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorebase.sources.model import DEFAULTS, SCHEMAS


def with_defaults(df: DataFrame, name: str) -> DataFrame:
    """Missing values replaced by the column's default."""
    fills = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.get(name, {}).items() if c in df.columns}
    return df.withColumns(fills) if fills else df


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table with fixed types and defaults filled in; columns a plan does not
    use are never read."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return with_defaults(reader.parquet(f"{root}/{name}"), name)


def tenant(df: DataFrame, name: str) -> DataFrame:
    """Rows of one tenant; prunes folders when the table is partitioned by tenant."""
    return df.filter(F.col("tenant_id") == name)


def store(df: DataFrame, root: str, name: str, by_tenant: bool = False) -> None:
    """Write a table; the two memory tiers are laid out by tenant."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy("tenant_id") if by_tenant else writer).parquet(f"{root}/{name}")
