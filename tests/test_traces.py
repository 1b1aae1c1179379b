"""Streams of spans over several batches: files out of order, late rows, state that does not grow, rows that carry only time."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.streaming import traces as T

SCHEMA = "trace_id string, span_id string, parent_span_id string, service_name string, duration_ms long, status string, ts timestamp"
START = datetime(2024, 3, 1)


def span(trace, n, minute, service="a", status="OK", parent=None):
    return (f"t{trace}", f"t{trace}-{n}", parent, service, 10 * n, status, START + timedelta(minutes=minute))


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/arrived"


def test_traces_close_in_order_and_late_spans_are_counted(spark, folder):
    """Twenty traces of three spans over ten files; a span comes a file late, one far too late, one twice."""
    for f in range(10):
        rows = [span(t, n, 60 * f + 5 * n + t % 2, "ab"[n % 2], "ERROR" if n == 2 else "OK") for t in (2 * f, 2 * f + 1) for n in range(3) if not (f < 9 and t == 2 * f and n == 1)]
        rows += [span(2 * (f - 1), 1, 60 * (f - 1) + 5, "b")] if f else []
        rows += [span(3, 9, 61, "late")] if f == 9 else []
        rows += [span(2 * f, 0, 60 * f, "a")]
        put(spark, folder, rows)
    T.close_input(spark, folder, SCHEMA, "2100-01-01")
    stream = T.span_stream(spark, folder, SCHEMA, 1, "2 hours")
    got = T.appended(T.assembled_traces(stream, 90 * 60_000), "traces")
    rows = {r.trace_id: (r.spans, r.errors, r.services, r.duration_ms, (r.started_at - START).seconds // 60) for r in got.rows.collect()}
    assert rows == {f"t{t}": (3, 1, "a,b", 30, 60 * (t // 2) + t % 2) for t in range(20)}
    assert got.late >= 1 and got.batches >= 10
    assert got.most_state < 60  # open traces, and ids that may repeat, of some hours: not of all ten


def test_state_stays_bounded(spark, folder):
    """Twice the input leaves the most state as it was."""
    most = []
    for files in (6, 12):
        path = f"{folder}-{files}"
        for f in range(files):
            put(spark, path, [span(100 * f + t, 0, 60 * f) for t in range(20)])
        T.close_input(spark, path, SCHEMA, "2100-01-01")
        got = T.appended(T.assembled_traces(T.span_stream(spark, path, SCHEMA, 1, "1 hour"), 30 * 60_000), "traces")
        assert got.rows.count() == 20 * files and got.late == 0
        most.append(got.most_state)
    assert most[1] <= most[0] + 20


def test_calls_meet_in_either_order(spark, folder):
    """A child may arrive before its parent; same services, unknown parents and children that begin too late give no call."""
    put(spark, folder, [span(1, 1, 1, "b", "ERROR", "t1-0"), span(2, 0, 0, "a"), span(4, 1, 5, "b", "OK", "gone")])
    put(spark, folder, [span(1, 0, 0, "a"), span(2, 1, 2, "c", "OK", "t2-0"), span(2, 2, 3, "a", "OK", "t2-0"), span(2, 3, 300, "b", "OK", "t2-0")])
    T.close_input(spark, folder, SCHEMA, "2100-01-01")
    read = lambda: T.span_stream(spark, folder, SCHEMA, 1, "6 hours")
    rows = T.appended(T.calls(read(), read(), "1 hour"), "calls").rows
    assert sorted((r.caller, r.callee, r.status) for r in rows.collect()) == [("a", "b", "ERROR"), ("a", "c", "OK")]


def test_arriving_files_keep_every_row(spark, folder):
    rows = [span(i, 0, i) for i in range(200)]
    T.arrive(spark.createDataFrame(rows, SCHEMA), folder, 4)
    back = spark.read.parquet(folder)
    assert back.count() == 200 and back.select(F.input_file_name()).distinct().count() == 4


def test_large_arrivals_are_several_files(spark, folder):
    """Arrivals of several files keep every row, no file holds them all, and all that is open closes."""
    rows = [span(i % 50, i, i) for i in range(2000)]
    per = T.arrive(spark.createDataFrame(rows, SCHEMA), folder, 4, per_file=200)
    assert per == 3
    sizes = [r["count"] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 300
    T.close_input(spark, folder, SCHEMA, "2100-01-01", per)
    got = T.appended(T.assembled_traces(T.span_stream(spark, folder, SCHEMA, per, "20 hours"), 86_400_000), "traces")
    assert got.late == 0 and sorted(r.spans for r in got.rows.collect()) == [40] * 50
