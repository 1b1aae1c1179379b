"""Queries of skein.streaming, each run to the end of what has arrived, over several batches and in append mode."""

from pyspark.sql import functions as F

from skein.plans.registry import query
from skein.storage import scratch_path
from skein.streaming import spans as S
from skein.streaming import traces as T

_SPANS = "trace_id string, span_id string, parent_span_id string, service_name string, duration_ms long, status string, ts timestamp"
#: Files of a run; a row in eight comes a file late, so two files' time is waited for.
_FILES = 5


def _arrived(d):
    """(path, files of an arrival, how long a span may be late) of the spans as files that arrive one after the other, and an end."""
    path = scratch_path(d.spark, "arrived")
    spans = d.spans.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in _SPANS.split(", ")))
    per = T.arrive(spans, path, _FILES)
    T.close_input(d.spark, path, _SPANS, "2100-01-01", per)
    seconds = spans.agg(F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).first()[0] or 0
    return path, per, f"{2 * seconds // _FILES + 60} seconds"


def _stream(d, path, per, late):
    return T.span_stream(d.spark, path, _SPANS, per, late)


@query("T4_streamed_windows", "select date_trunc('hour', ts) window_start, event_type service_name, count(*) spans, count(*) filter (where event_type = 'error') errors from events group by 1, 2")
def _(d):
    return T.appended(S.service_windows(_stream(d, *_arrived(d))), "windows").rows


@query(
    "T1_streamed_sessions",
    "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end new from events), s as (select *, sum(new) over (partition by user_id order by ts) i from g) select user_id, min(ts) session_start, count(*) spans, count(*) filter (where event_type = 'error') errors from s group by user_id, i",
)
def _(d):
    spans = _stream(d, *_arrived(d)).withColumn("user_id", F.split("trace_id", "-")[0].cast("long"))
    return T.appended(S.sessions(spans), "sessions").rows


@query(
    "T1_assembled_traces",
    "select trace_id, count(*) spans, count(*) filter (where status = 'ERROR') errors, string_agg(distinct service_name, ',' order by service_name) services, cast(sum(duration_ms) as bigint) duration_ms, date_trunc('second', min(ts)) started_at, date_trunc('second', max(ts)) ended_at from spans group by trace_id",
    "spans",
)
def _(d):
    whole = lambda c: F.date_trunc("second", c).cast("timestamp_ntz").alias(c)
    rows = T.appended(T.assembled_traces(_stream(d, *_arrived(d)), 86_400_000), "traces").rows
    return rows.select("trace_id", "spans", "errors", "services", "duration_ms", whole("started_at"), whole("ended_at"))


@query(
    "T4_streamed_calls",
    "select p.service_name caller, c.service_name callee, count(*) calls, count(*) filter (where c.status = 'ERROR') errors from spans c join spans p on p.span_id = c.parent_span_id where c.service_name <> p.service_name group by 1, 2",
    "spans",
)
def _(d):
    at = _arrived(d)
    made = T.appended(T.calls(_stream(d, *at), _stream(d, *at), "1 day"), "calls").rows
    return made.groupBy("caller", "callee").agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "ERROR").alias("errors"))
