"""The driver's entry module, and plans that must keep their shape."""

import importlib

import pytest
from pyspark.sql import functions as F

from skeinwatch.functions.timeutil import time_filter
from skeinwatch.plans import registry
from skeinwatch.plans.drift_queries import _SINCE


def test_entry_and_books(spark):
    module = importlib.import_module("__spark_entry__")
    assert module.entry(spark).count() == 4
    assert set(module.oracle_sql()) <= set(module.queries())
    assert set(registry.QUERIES) <= set(module.queries())


@pytest.mark.parametrize(
    "name",
    ["D13_D14_psi_drift", "T5_trace_metrics", "G9_agent_dashboard", "E19_workflow_results", "M1_M2_service_graph"],
)
def test_queries_run_without_python_in_the_plan(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_time_filter_prunes_by_date(spark, tmp_path):
    spark.range(10).select(
        F.lit(_SINCE).alias("start_time"),
        F.to_date(F.lit(_SINCE)).alias("partition_date"),
        "id",
    ).write.partitionBy("partition_date").parquet(str(tmp_path / "t"))
    plan = time_filter(spark.read.parquet(str(tmp_path / "t")), _SINCE, None)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition_date" in plan and "PushedFilters: [IsNotNull(start_time)" in plan
