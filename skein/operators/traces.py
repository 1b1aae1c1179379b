"""Span topology, runtime verification and process mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import operation, plain_path


def service_stats(spans: DataFrame) -> DataFrame:
    return spans.groupBy("service_name").agg(
        F.count("*").alias("spans"), F.count_distinct("trace_id").alias("traces"), F.count_if(F.col("status") == "ERROR").alias("errors"), F.round(F.avg("duration_ms"), 6).alias("avg_duration")
    )


def call_edges(spans: DataFrame) -> DataFrame:
    """(caller, callee, calls, errors): calls between services, from each span and its parent in the same trace."""
    parent = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service_name").alias("caller"))
    both = spans.join(parent, ["trace_id", "parent_span_id"]).where("caller <> service_name")
    return both.groupBy("caller", F.col("service_name").alias("callee")).agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "ERROR").alias("errors"))


def verified_nodes(nodes: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Nodes that spans (operation) name by `key`: id, trace_count, last_seen. Spans are counted before they are joined."""
    seen = spans.groupBy(F.col("operation").alias(key)).agg(F.count("*").alias("trace_count"), F.max("ts").alias("last_seen"))
    return nodes.join(seen, key).select("id", "trace_count", "last_seen")


def task_counts(log: DataFrame, days: int = 90) -> DataFrame:
    """Executions of each activity in the last `days` before the log's end."""
    end = log.agg(F.max("started_at").alias("end"))
    recent = log.join(F.broadcast(end), F.col("started_at") >= F.col("end") - F.make_dt_interval(F.lit(days)))
    return recent.groupBy("activity").agg(F.count("*").alias("executions"))


def rework_rates(log: DataFrame) -> DataFrame:
    """(activity, rate): cases that repeat an activity over its executions, at most one."""
    per = log.groupBy("activity", "case_id").agg(F.count("*").alias("n"))
    rate = F.least(F.lit(1.0), F.count_if(F.col("n") > 1) / F.sum("n"))
    return per.groupBy("activity").agg(F.round(rate, 6).alias("rate"))


def transitions(log: DataFrame) -> DataFrame:
    """The directly-follows graph: (before, after, n) over each case's events by started_at, event_id."""
    order = Window.partitionBy("case_id").orderBy("started_at", "event_id")
    pairs = log.select(F.lag("activity").over(order).alias("before"), F.col("activity").alias("after"))
    return pairs.where("before is not null").groupBy("before", "after").agg(F.count("*").alias("n"))


def runtime_only(observed: DataFrame, defined: DataFrame) -> DataFrame:
    """Observed transitions that no definition has, as flow edges of confidence 0.85."""
    return observed.join(defined.select("before", "after"), ["before", "after"], "left_anti").withColumn("confidence", F.lit(0.85))


def coverage(log: DataFrame, model: DataFrame) -> DataFrame:
    """One row: share of the model's activities that occur (1 for an empty model), and how many occur outside it."""
    both = log.select("activity", F.lit(1).alias("seen"), F.lit(0).alias("modelled")).union(model.select("activity", F.lit(0), F.lit(1)))
    per = both.groupBy("activity").agg(F.max("seen").alias("seen"), F.max("modelled").alias("modelled"))
    share = F.try_divide(F.count_if(F.col("seen") + F.col("modelled") == 2), F.sum("modelled"))
    return per.agg(F.round(F.coalesce(share, F.lit(1.0)), 6).alias("fitness"), F.count_if((F.col("seen") == 1) & (F.col("modelled") == 0)).alias("deviations"))


def ingested(raw: DataFrame) -> DataFrame:
    """Spans as they are stored: status OK unless one is given, epoch milliseconds as a timestamp, one row per span_id (the latest)."""
    spans = raw.withColumn("status", F.coalesce("status", F.lit("OK"))).withColumn("started_at", F.timestamp_millis("started_ms"))
    last = F.row_number().over(Window.partitionBy("span_id").orderBy(F.desc("started_ms"), "status"))
    return spans.withColumn("_r", last).where("_r = 1").drop("_r", "started_ms")


def aligned(spans: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(name, id, n): spans (operation 'METHOD path') counted by name, with the endpoint (id, name) of that name or null. Spans are counted before they join."""
    seen = spans.groupBy(F.concat_ws(" ", F.upper(operation(F.col("operation"))["method"]), plain_path(operation(F.col("operation"))["path"])).alias("name")).agg(F.count("*").alias("n"))
    return seen.join(endpoints, "name", "left").select("name", "id", "n")


#: Scenarios to test by type of node.
SCENARIOS = {"ApiEndpoint": ("success", "bad_request", "forbidden"), "Table": ("insert", "constraint")}


def test_cases(nodes: DataFrame) -> DataFrame:
    """(case_id, node_type): one row per scenario of every node that has some."""
    table = F.create_map(*[x for t, names in SCENARIOS.items() for x in (F.lit(t), F.array(*map(F.lit, names)))])
    made = nodes.select("id", "node_type", F.explode(F.try_element_at(table, F.col("node_type"))).alias("scenario"))
    return made.select(F.concat_ws(":", "id", "scenario").alias("case_id"), "node_type")
