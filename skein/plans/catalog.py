"""Every registered query of the library."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from skein.plans import registry

for _name in ("scan_queries", "stats_queries", "pattern_queries", "diff_queries", "retrieval_queries", "trace_queries", "function_queries", "claim_queries", "resolution_queries", "write_queries", "document_queries", "evaluation_queries", "search_queries", "impact_queries", "stream_queries", "report_queries"):
    import_module(f"skein.plans.{_name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version graph statistics."""
    return registry.QUERIES["A3_version_graph_stats"](spark, sf_dir)
