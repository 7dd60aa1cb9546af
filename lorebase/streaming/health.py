"""Retrieval health and memory usage in event-time windows, for tables and for streams of appended events.

A window's row holds sums and maxima only, so rows of windows add up: to longer windows, and to the
reports over all time (``totals``), which equal those of :mod:`lorebase.operators.reports`.

On a stream, ``delay`` says how late an event may come.  A window changes while such events may
still reach it, and every change is written; after that its state is let go.  What comes later still is not
counted, and ``late_groups`` says whether there was any: ``windowed`` over the stored events gives the
whole result then.  Events without a time are in no window.
"""

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorebase.functions.columns import count_if, latest_per_key


@dataclass(frozen=True)
class Report:
    """Keys of a report, its columns that add up, those of which the largest counts, and what follows from both."""

    keys: tuple
    sums: Callable
    peaks: Callable
    derived: Callable


def _search():
    return F.col("event_type") == "brain_search"


def _average(total, n):
    return F.round((F.col(total) / F.col(n)).cast("decimal(22,4)"), 2)


RETRIEVAL = Report(
    ("tenant_id",),
    lambda: {
        "event_count": F.count("*"), "vector_event_count": count_if(F.col("used_vector")), "fts_only_event_count": count_if(~F.col("used_vector")),
        "latency_sum": F.sum(F.col("latency_ms").cast("decimal(18,0)")), "latency_events": F.count("latency_ms"),
    },
    lambda: {"last_event_at": F.max("created_at")},
    lambda: {"avg_latency_ms": _average("latency_sum", "latency_events")},
)
MEMORY = Report(
    ("tenant_id", "session_id"),
    lambda: {"brain_searches": count_if(_search()), "session_opens": count_if(F.col("event_type") == "session_open")},
    lambda: {"last_brain_search": F.max(F.when(_search(), F.col("created_at")))},
    lambda: {"brain_status": F.when(F.col("brain_searches") == 0, "dark").otherwise("active")},
)


def windowed(events: DataFrame, report: Report, width: str = "1 hour") -> DataFrame:
    """One row per window of ``width`` and key: ``window_start``, ``window_end``, keys, sums and maxima."""
    columns = report.sums() | report.peaks()
    rows = events.groupBy(F.window("created_at", width).alias("w"), *report.keys).agg(*(c.alias(n) for n, c in columns.items()))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *report.keys, *columns)


def with_derived(rows: DataFrame, report: Report) -> DataFrame:
    return rows.withColumns(report.derived())


def totals(windows: DataFrame, report: Report, *by: str) -> DataFrame:
    """The report over all windows, or over those with equal ``by`` columns."""
    kinds = dict(windows.dtypes)
    sums = [F.sum(n).cast(kinds[n]).alias(n) for n in report.sums()]
    return with_derived(windows.groupBy(*by, *report.keys).agg(*sums, *(F.max(n).alias(n) for n in report.peaks())), report)


def health_stream(events: DataFrame, report: Report, root: str, checkpoint: str, width: str = "1 hour", delay: str = "1 day"):
    """Keep the windows of a stream of events under ``root``; returns the running query.

    Each batch writes the windows that it changed to a folder of its own, which a replay of
    the batch overwrites.  State holds the windows of the last ``delay`` only.  Times without a
    zone are read in that of the session, as a watermark needs one.
    """
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp"))
    rows = windowed(timed.withWatermark("created_at", delay), report, width)
    spark = events.sparkSession
    spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(f"{root}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return (
        rows.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stored_windows(spark: SparkSession, root: str, report: Report) -> DataFrame:
    """The newest row of every window that a stream keeps under ``root``."""
    keys = ["window_start", "window_end", *report.keys]
    return latest_per_key(spark.read.parquet(root), keys, [F.desc("batch")]).drop("batch")


def late_groups(query) -> int:
    """Windows of a key, counted once a batch and partition, whose events came too late to be counted.

    Read from the progress that the session keeps (``spark.sql.streaming.numRecentProgressUpdates`` batches).
    """
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
