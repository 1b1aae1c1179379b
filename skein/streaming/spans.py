"""Spans as a stream: windowed service statistics and sessions by event time.

Run in append mode (`skein.streaming.traces.appended`) both forget what the watermark has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def service_windows(spans: DataFrame, size: str = "1 hour") -> DataFrame:
    """(window_start, service_name, spans, errors) of tumbling windows."""
    per = spans.groupBy(F.window("ts", size), "service_name").agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "ERROR").alias("errors"))
    return per.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "service_name", "spans", "errors")


def sessions(spans: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, session_start, spans, errors): a user's spans no further apart than `gap`."""
    per = spans.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "ERROR").alias("errors"))
    return per.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "spans", "errors")
