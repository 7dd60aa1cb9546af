"""Health reports in windows: batch, stream, late events."""

import datetime as dt
import os

from conftest import rows_of
from lorebase.operators import reports
from lorebase.streaming import health

EVENTS = "tenant_id string, used_vector boolean, latency_ms int, created_at timestamp"
LOG = "tenant_id string, session_id string, event_type string, created_at timestamp"


def at(hour, minute=0):
    return dt.datetime(2024, 3, 1) + dt.timedelta(hours=hour, minutes=minute)


def run(spark, tmp_path, schema, report, batches, delay="2 hours"):
    """Each of the batches as a file of its own, in order; the query, and the stored windows."""
    inbox, root = str(tmp_path / "inbox"), str(tmp_path / "windows")
    os.makedirs(inbox, exist_ok=True)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        query = health.health_stream(stream, report, root, str(tmp_path / "progress"), delay=delay)
        query.awaitTermination()
    return query, health.stored_windows(spark, root, report)


def test_late_events_within_the_delay_count(spark, tmp_path):
    batches = [
        [("a", True, 10, at(0, 5)), ("a", False, None, at(0, 59)), ("b", None, 7, at(1))],
        [("a", True, 20, at(3)), ("a", True, 31, at(0, 30)), ("b", False, 8, at(1, 59))],  # an hour comes again
        [("a", True, 1, at(3, 59)), ("c", True, None, at(2))],
    ]
    _, stored = run(spark, tmp_path, EVENTS, health.RETRIEVAL, batches, delay="1 day")
    events = spark.createDataFrame([r for b in batches for r in b], EVENTS)
    assert rows_of(stored) == rows_of(health.windowed(events, health.RETRIEVAL))
    whole = reports.retrieval_health({"retrieval_events": events})
    assert rows_of(health.totals(stored, health.RETRIEVAL), *whole.columns) == rows_of(whole)
    first = stored.filter("tenant_id = 'a'").orderBy("window_start").first()
    assert (first.window_start, first.event_count, first.vector_event_count, first.latency_sum) == (at(0), 3, 2, 41)


def test_events_after_the_delay_are_told(spark, tmp_path):
    batches = [
        [("a", True, 10, at(0, 5)), ("a", True, 10, at(10))],
        [("a", True, 10, at(0, 10)), ("a", True, 10, at(9)), ("a", True, 10, at(11))],  # ten hours late; an hour late
    ]
    query, stored = run(spark, tmp_path, EVENTS, health.RETRIEVAL, batches)
    assert health.late_groups(query) == 1
    assert [(r.window_start, r.event_count) for r in stored.orderBy("window_start").collect()] == [(at(0), 1), (at(9), 1), (at(10), 1), (at(11), 1)]
    events = spark.createDataFrame([r for b in batches for r in b], EVENTS)
    assert health.windowed(events, health.RETRIEVAL).agg({"event_count": "sum"}).first()[0] == 5


def test_memory_usage_adds_up(spark, tmp_path):
    batches = [
        [("a", "s1", "session_open", at(0)), ("a", "s1", "brain_search", at(1)), ("a", "s2", "file_write", at(1))],
        [("a", "s1", "brain_search", at(0, 30)), ("b", "s1", "session_open", at(5)), ("a", None, "brain_search", at(5))],
        [("a", "s2", "task_closed", at(6))],
    ]
    _, stored = run(spark, tmp_path, LOG, health.MEMORY, batches, delay="1 day")
    log = spark.createDataFrame([r for b in batches for r in b], LOG)
    whole = reports.memory_usage({"session_log": log})
    assert rows_of(health.totals(stored, health.MEMORY), *whole.columns) == rows_of(whole)


def test_windows_without_events(spark, tmp_path):
    _, stored = run(spark, tmp_path, EVENTS, health.RETRIEVAL, [[]])
    assert stored.collect() == [] and health.totals(stored, health.RETRIEVAL).collect() == []
    none = spark.createDataFrame([("a", True, 1, None)], EVENTS)
    assert health.windowed(none, health.RETRIEVAL).collect() == []  # an event without a time
