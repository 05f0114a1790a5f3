"""Binned metrics, map sums, route latency and threshold alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwatch.functions.ranked import joined, nearest_ranks, quantile_columns
from skeinwatch.functions.timeutil import after_cursor, opt_filter, time_bin, time_filter


def binned_mean(df: DataFrame, key: str, value: str, minutes: float, ts: str = "created_at") -> DataFrame:
    """key, points: array<struct<bucket, mean>> newest first."""
    inner = df.groupBy(key, time_bin(ts, minutes).alias("bucket")).agg(F.avg(value).alias("mean"))
    return inner.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("bucket", "mean")), asc=False).alias("points"))


def binned_band(df: DataFrame, key: str, value: str, minutes: float, ts: str = "created_at") -> DataFrame:
    """key, bucket, avg, lower and upper: mean and one sample deviation to each side (0 for single values)."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(key, time_bin(ts, minutes).alias("bucket")).agg(
        F.avg(value).alias("avg"),
        (F.avg(value) - sd).alias("lower"),
        (F.avg(value) + sd).alias("upper"),
    )


def binned_pass_rate(df: DataFrame, key: str, value: str, passed: str, minutes: float, ts: str = "created_at") -> DataFrame:
    """binned_band with pass_rate, the share of rows that passed."""
    sd = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(key, time_bin(ts, minutes).alias("bucket")).agg(
        F.avg(value).alias("avg"), (F.avg(value) - sd).alias("lower"), (F.avg(value) + sd).alias("upper"), F.avg(F.col(passed).cast("double")).alias("pass_rate")
    )


def metric_means(df: DataFrame, since, names: list[str] | None = None) -> DataFrame:
    """metric, value: the mean since a time."""
    held = df.where(F.col("created_at") > F.lit(since))
    held = held.where(F.col("metric").isin(list(names))) if names is not None else held
    return held.groupBy("metric").agg(F.avg("value").alias("value"))


def sum_map(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys and one map that sums the maps of counts of each group."""
    sums = df.select(*keys, F.explode(column).alias("__k", "__v")).groupBy(*keys, "__k").agg(F.sum("__v").alias("__v"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v")))).alias(column))


def first_by(value: Column, order: list[Column]) -> Column:
    """The value of the row that comes first by `order` descending, nulls last."""
    return F.max_by(value, F.struct(*order))


def union_lists(column: str) -> Column:
    return F.array_distinct(F.flatten(F.collect_list(column)))


def percentiles(column: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> list[Column]:
    """One aggregate a percentile, named p50 and so on, from a sketch: its rank is off by n / 10,000 at most."""
    return [F.percentile_approx(column, F.lit(q), F.lit(10_000)).cast("double").alias(f"p{q * 100:g}") for q in at]


def exact_percentiles(df: DataFrame, keys: list[str], column: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """keys and a column a percentile, exact and interpolated, whatever the number of different values."""
    return quantile_columns(df, keys, column, {f"p{q * 100:g}": q for q in at})


def with_percentiles(
    df: DataFrame,
    keys: list[str],
    aggs: list[Column],
    column: str,
    at: tuple[float, ...] = (0.5, 0.95, 0.99),
    exact: bool = False,
) -> DataFrame:
    """df by keys with aggs and percentiles of a column, from a sketch in the same aggregation or exact ones beside it."""
    if not exact:
        return df.groupBy(*keys).agg(*aggs, *percentiles(column, at))
    if not keys:
        return with_percentiles(df.withColumn("__one", F.lit(0)), ["__one"], aggs, column, at, True).drop("__one")
    number = df.withColumn(column, F.col(column).cast("double"))
    return joined(df.groupBy(*keys).agg(*aggs), exact_percentiles(number, keys, column, at), keys, "left")


def error_rate(is_error: Column) -> Column:
    return F.avg(is_error.cast("double"))


def distinct_features(df: DataFrame, keys: list[str] = ("entity_id", "feature")) -> DataFrame:
    return df.select(*keys).distinct()


def custom_averages(df: DataFrame, minutes: float, known: list[str]) -> DataFrame:
    """bucket, metric, value: batch means of the metrics that the profile knows."""
    return df.where(F.col("metric").isin(list(known))).groupBy(
        time_bin("created_at", minutes).alias("bucket"),
        "metric",
    ).agg(F.avg("value").alias("value"))


def threshold_alert(value: Column, baseline: Column, kind: Column, delta: Column) -> Column:
    """Whether a value lies above, below or outside its baseline, by the delta if there is one."""
    d = F.coalesce(delta, F.lit(0.0))
    above, below = value > baseline + d, value < baseline - d
    return F.when(kind == "above", above).when(kind == "below", below).when(kind == "outside", above | below)


def threshold_alerts(values: DataFrame, conditions: DataFrame) -> DataFrame:
    """metric, value, baseline, kind, delta, alert; conditions has metric, baseline, kind and delta (may be null)."""
    held = values.join(conditions, "metric")
    return held.withColumn("alert", threshold_alert(F.col("value"), F.col("baseline"), F.col("kind"), F.col("delta")))


def custom_alerts(facts: DataFrame, conditions: DataFrame, since) -> DataFrame:
    """Custom metrics whose mean since the last run breaks their condition."""
    return threshold_alerts(metric_means(facts, since), conditions).where("alert")


def agent_alerts(workflows: DataFrame, condition: DataFrame, since) -> DataFrame:
    """The workflow pass rate since the last run against its condition (metric pass_rate)."""
    held = workflows.where(F.col("created_at") > F.lit(since))
    return threshold_alerts(
        held.select(F.lit("pass_rate").alias("metric"), "pass_rate").groupBy("metric").agg(F.avg("pass_rate").alias("value")),
        condition,
    ).where("alert")


def ok_status(code: Column) -> Column:
    return (code >= 200) & (code < 400)


def route_metrics(df: DataFrame, minutes: float) -> DataFrame:
    """bucket, route_name, p5..p99 (nearest rank of OK latencies), request, error counts, error latency, status codes.

    df: created_at, route_name, latency, status_code. OK is 200 to 399.
    """
    keys = ["bucket", "route_name"]
    held = df.select(
        time_bin("created_at", minutes).alias("bucket"),
        "route_name",
        "latency",
        "status_code",
        ok_status(F.col("status_code")).alias("ok"),
    )
    names = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("__n"))) - 1
    ranked = nearest_ranks(held.where("ok"), keys, "latency", tuple(names.values()), rank)
    quantiles = ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("q") == q, F.col("latency"))).alias(n) for n, q in names.items()))
    counts = held.groupBy(*keys).agg(
        F.count_if("ok").alias("request_count"), F.count_if(~F.col("ok")).alias("error_count"), F.coalesce(
            F.sum(F.when(~F.col("ok"), F.col("latency"))),
            F.lit(0.0),
        ).alias("error_latency")
    )
    return join_status_counts(counts.join(quantiles, keys, "left"), held.groupBy(*keys, "status_code").agg(F.count("*").alias("n")), keys)


def join_status_counts(routes: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """routes with status_codes, a map of the counts in codes (keys, status_code, n)."""
    maps = codes.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status_code", "n")))).alias("status_codes"))
    return routes.join(maps, keys, "left")


def route_metrics_over_time(metrics: DataFrame, minutes: float, since=None) -> DataFrame:
    """route_name and arrays over time of stored route metrics: mean percentiles, summed counts and status codes."""
    held = metrics if since is None else metrics.where(F.col("created_at") > F.lit(since))
    keys = ["route_name", "bucket"]
    held = held.withColumn("bucket", time_bin("created_at", minutes))
    names = ["p5", "p25", "p50", "p95", "p99"]
    sums = held.groupBy(*keys).agg(
        *(F.avg(p).alias(p) for p in names),
        *(F.sum(c).alias(c) for c in ("request_count", "error_count", "error_latency")),
    )
    joined = sums.join(sum_map(held, keys, "status_codes"), keys, "left").withColumn("status_codes", F.to_json("status_codes"))
    points = F.array_sort(F.collect_list(F.struct("bucket", *names, "request_count", "error_count", "error_latency", "status_codes")))
    return joined.groupBy("route_name").agg(points.alias("points"))


def list_alerts(log: DataFrame) -> DataFrame:
    """The latest event of each alert: entity_id, id, alert, active, created_at, updated_at."""
    latest = F.struct("updated_at", "active")
    return log.groupBy("id").agg(
        F.min("created_at").alias("created_at"),
        F.max_by("entity_id", latest).alias("entity_id"),
        F.max_by("alert", latest).alias("alert"),
        F.max_by("active", latest).alias("active"),
        F.max("updated_at").alias("updated_at"),
    )


def write_alerts(alerts: DataFrame, path: str, at: Column) -> None:
    """Append alerts (entity_id, alert: map of strings) to the log under path, as active events of new ids."""
    event = {"id": F.expr("uuid()"), "active": F.lit(True), "created_at": at, "updated_at": at}
    alerts.select("entity_id", "alert", *(c.alias(name) for name, c in event.items())).write.mode("append").parquet(path)


def page_alerts(
    log: DataFrame,
    limit: int = 50,
    cursor: list | None = None,
    direction: str = "next",
    entity_id=None,
    active: bool | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """Alerts as they stand, newest first from a (created_at, id) cursor on; one row more than the page."""
    held = opt_filter(list_alerts(log), entity_id=entity_id, active=active)
    held = time_filter(held, start, end, "created_at")
    held = after_cursor(held, ["created_at", "id"], cursor, direction) if cursor else held
    order = F.desc if direction == "next" else F.asc
    return held.orderBy(order("created_at"), order("id")).limit(limit + 1)


def ack_alerts(log: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """The alert log with an inactive event more for each of the ids."""
    off = list_alerts(log).join(ids, "id", "left_semi").withColumn("active", F.lit(False)).withColumn("updated_at", at)
    return log.unionByName(off)
