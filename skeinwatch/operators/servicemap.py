"""Service topology from an edge log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def service_graph(edges: DataFrame, service: str | None = None, since=None) -> DataFrame:
    """source, destination, endpoint, calls, first and last seen, mean latency, errors and error percent, most calls first."""
    held = edges if since is None else edges.where(F.col("created_at") >= F.lit(since))
    if service is not None:
        held = held.where((F.col("source_service") == service) | (F.col("destination_service") == service))
    bad = F.col("error").cast("int")
    return held.groupBy("source_service", "destination_service", "endpoint").agg(
        F.count("*").alias("calls"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.sum(bad).alias("errors"), F.round(F.sum(bad) * 100.0 / F.count("*"), 2).alias("error_percent"),
    ).orderBy(F.desc("calls"), "source_service", "destination_service", "endpoint")
