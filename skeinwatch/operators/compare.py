"""Comparison of evaluation runs, and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwatch.functions.timeutil import after_cursor, opt_filter, time_filter
from skeinwatch.operators.traces import only_in

IMPROVED = 0.01
SCENARIO_TAG = "eval.scenario_id="


def align_runs(base: DataFrame, cand: DataFrame) -> DataFrame:
    """record_id, task_id, base_passed, cand_passed, side (both, baseline, candidate) of the records that both runs have."""
    shared = base.select("record_id").distinct().join(cand.select("record_id"), "record_id", "left_semi")
    a = base.join(shared, "record_id", "left_semi").select("record_id", "task_id", F.col("passed").alias("base_passed"))
    b = cand.join(shared, "record_id", "left_semi").select("record_id", "task_id", F.col("passed").alias("cand_passed"))
    side = F.when(F.col("base_passed").isNull(), "candidate").when(F.col("cand_passed").isNull(), "baseline").otherwise("both")
    return a.join(b, ["record_id", "task_id"], "full_outer").withColumn("side", side)


def compare_records(aligned: DataFrame, threshold: float = 0.05) -> DataFrame:
    """record_id, pass rates on matched tasks, delta, regressed, improved, status changes and one-sided tasks."""
    both = F.col("side") == "both"
    rate = lambda c: F.coalesce(F.avg(F.when(both, F.col(c).cast("double"))), F.lit(0.0))
    held = aligned.groupBy("record_id").agg(
        rate("base_passed").alias("base_rate"),
        rate("cand_passed").alias("cand_rate"),
        F.count_if(both & (F.col("base_passed") != F.col("cand_passed"))).alias("changed"),
        F.count_if(~both).alias("one_sided"),
    )
    delta = F.col("cand_rate") - F.col("base_rate")
    return held.withColumn("delta", delta).withColumn("regressed", delta < -threshold).withColumn("improved", delta > IMPROVED)


def compare_results(base: DataFrame, cand: DataFrame, threshold: float = 0.05) -> DataFrame:
    """One row: records compared, regressed, improved and unchanged, mean rates and mean delta."""
    records = compare_records(align_runs(base, cand), threshold)
    return records.agg(
        F.count("*").alias("records"),
        F.count_if("regressed").alias("regressed"),
        F.count_if("improved").alias("improved"),
        F.count_if(~F.col("regressed") & ~F.col("improved")).alias("unchanged"),
        F.avg("base_rate").alias("base_rate"), F.avg("cand_rate").alias("cand_rate"), F.avg("delta").alias("mean_delta"),
    )


def task_aggregate(aligned: DataFrame) -> DataFrame:
    """task_id, matched, pass rates, fixed and broken over all records."""
    both = aligned.where("side = 'both'")
    return both.groupBy("task_id").agg(
        F.count("*").alias("matched"),
        F.avg(F.col("base_passed").cast("double")).alias("base_rate"),
        F.avg(F.col("cand_passed").cast("double")).alias("cand_rate"),
        F.count_if(~F.col("base_passed") & F.col("cand_passed")).alias("fixed"),
        F.count_if(F.col("base_passed") & ~F.col("cand_passed")).alias("broken"),
    )


def assign_scenarios(records: DataFrame, tag: str = SCENARIO_TAG) -> DataFrame:
    """records with scenario_id, from the first tag that names one; those without are left out."""
    found = F.filter("tags", lambda t: t.startswith(tag))
    return records.where(F.size(found) > 0).withColumn(
        "scenario_id",
        F.substring(F.element_at(found, 1), F.lit(len(tag) + 1), F.length(F.element_at(found, 1))),
    )


def scenario_metrics(workflows: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row: mean pass rate over datasets (alias), scenario pass rate, mean workflow rate, and the mean of all rates.

    workflows: alias, pass_rate; scenarios: scenario_id, passed.
    """
    rates = workflows.groupBy("alias").agg(F.avg("pass_rate").alias("rate"))
    one = scenarios.agg(F.avg(F.col("passed").cast("double")).alias("scenario_rate"))
    kinds = rates.select("rate", F.lit("dataset").alias("kind")).unionByName(
        one.select(F.col("scenario_rate").alias("rate"), F.lit("scenario").alias("kind"))
    ).unionByName(
        workflows.agg(F.avg("pass_rate").alias("rate")).withColumn("kind", F.lit("workflow"))
    )
    of = lambda k: F.avg(F.when(F.col("kind") == k, F.col("rate"))).alias(f"{k}_rate")
    return kinds.agg(of("dataset"), of("scenario"), of("workflow"), F.avg("rate").alias("overall_rate"))


def compare_scenarios(base: DataFrame, cand: DataFrame, threshold: float = 0.05) -> DataFrame:
    """alias, base_rate, cand_rate, delta, status: compared, regressed, new or removed. Runs have alias, record_id, task_id, passed."""
    key = lambda df: df.withColumn("record_id", F.to_json(F.struct("alias", "record_id")))
    records = compare_records(align_runs(key(base), key(cand)), threshold).withColumn("alias", F.get_json_object("record_id", "$.alias"))
    per = records.groupBy("alias").agg(
        F.avg("base_rate").alias("base_rate"),
        F.avg("cand_rate").alias("cand_rate"),
        F.avg("delta").alias("delta"),
    )
    per = per.withColumn("status", F.when(F.col("delta") < -threshold, "regressed").otherwise("compared"))
    new, gone = (only_in(x, y, "alias").withColumn("status", F.lit(s)) for x, y, s in ((cand, base, "new"), (base, cand, "removed")))
    return per.unionByName(new, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)


def pending_records(records: DataFrame, now, max_retries: int = 3) -> DataFrame:
    """All due records below the retry limit, oldest first in order of creation."""
    return records.where((F.col("status") == "pending") & (F.col("scheduled_at") <= F.lit(now)) & (F.col("retry_count") < max_retries))


def list_records(
    records: DataFrame,
    limit: int | None = None,
    cursor: list | None = None,
    direction: str = "next",
    entity_id=None,
    status: str | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Records by entity, status and time [start, end). With a limit: newest first from a (created_at, record_id) cursor
    on, one row more than the page."""
    held = time_filter(opt_filter(records, entity_id=entity_id, status=status), start, end, "created_at")
    if limit is None:
        return held
    held = after_cursor(held, ["created_at", "record_id"], cursor, direction) if cursor else held
    order = F.desc if direction == "next" else F.asc
    return held.orderBy(order("created_at"), order("record_id")).limit(limit + 1)


def join_eval_inputs(records: DataFrame, profiles: DataFrame, spans: DataFrame, max_retries: int = 3) -> DataFrame:
    """attach_spans for the records whose entity has a profile, with the profile's columns; the rest have nothing to run."""
    return attach_spans(records.join(profiles, "entity_id"), spans, max_retries)


def attach_spans(records: DataFrame, spans: DataFrame, max_retries: int = 3) -> DataFrame:
    """records with span_count and status: ready with spans of their trace, else retry, or failed after max_retries."""
    counts = spans.groupBy("trace_id").agg(F.count("*").alias("span_count"))
    held = records.join(counts, "trace_id", "left")
    status = F.when(F.col("span_count").isNotNull(), "ready").when(F.col("retry_count") + 1 >= max_retries, "failed").otherwise("retry")
    return held.withColumn("status", status).withColumn(
        "retry_count",
        F.when(F.col("span_count").isNull(), F.col("retry_count") + 1).otherwise(F.col("retry_count")),
    ).withColumn("span_count", F.coalesce("span_count", F.lit(0)))
