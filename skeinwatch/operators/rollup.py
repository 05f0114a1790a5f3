"""Roll-ups that are stored by time bucket and merged later: sums, quantile and distinct-count sketches, trace summaries.

A bucket's row keeps sketches (KLL for quantiles, HLL for distinct counts) in place of its rows, so a day, a model or a total
is read from the buckets without the spans. Merged sketches answer as sketches of all rows do: a quantile's rank is off by at
most RANK_ERROR of the rows (99 % of the time), a distinct count by DISTINCT_ERROR of it (three standard deviations).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwatch.functions.timeutil import time_trunc
from skeinwatch.operators.traces import bucket_stats, match_attributes, merge_summaries, trace_summaries

KLL_K, HLL_K = 400, 12
RANK_ERROR = 2.446 / KLL_K**0.9433
DISTINCT_ERROR = 3 * 1.04 / 2 ** (HLL_K / 2)


def sketched(
    df: DataFrame,
    keys: list[str],
    quantiles: tuple[str, ...] = (),
    distinct: tuple[str, ...] = (),
    unit: str = "hour",
    ts: str = "start_time",
) -> DataFrame:
    """keys, bucket, n, and for each column `<c>_sum` and `<c>_kll` or `<c>_hll`. Nulls count in n only."""
    held = df.groupBy(*keys, time_trunc(ts, unit).alias("bucket"))
    number = {c: F.col(c).cast("double") for c in quantiles}
    return held.agg(
        F.count("*").alias("n"),
        *(F.sum(x).alias(f"{c}_sum") for c, x in number.items()),
        *(F.count(x).alias(f"{c}_count") for c, x in number.items()),
        *(F.kll_sketch_agg_double(x, F.lit(KLL_K)).alias(f"{c}_kll") for c, x in number.items()),
        *(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(HLL_K)).alias(f"{c}_hll") for c in distinct),
    )


def merged(sketches: DataFrame, keys: list[str], unit: str | None = None) -> DataFrame:
    """Stored roll-ups by keys (fewer, or none) and a coarser unit (None: all time); as sketched() gives them, so they merge again."""
    by = [F.col(k) for k in keys] + ([time_trunc("bucket", unit).alias("bucket")] if unit else [])
    aggs = [F.sum("n").alias("n")]
    for c in sketches.columns:
        if c.endswith(("_sum", "_count")):
            aggs.append(F.sum(c).alias(c))
        elif c.endswith("_kll"):
            aggs.append(F.kll_merge_agg_double(c).alias(c))
        elif c.endswith("_hll"):
            aggs.append(F.hll_union_agg(c).alias(c))
    return sketches.groupBy(*by).agg(*aggs)


def answers(sketches: DataFrame, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Sketches read out: `<c>_mean`, `<c>_p50` and so on, `<c>_distinct`; quantiles of no values are null."""
    out = []
    for c in sketches.columns:
        name = c.rpartition("_")[0]
        if c.endswith("_kll"):
            some = F.col(f"{name}_count") > 0
            out += [F.when(some, F.kll_sketch_get_quantile_double(c, F.lit(q))).alias(f"{name}_p{q * 100:g}") for q in at]
        elif c.endswith("_hll"):
            out.append(F.hll_sketch_estimate(c).alias(f"{name}_distinct"))
        elif c.endswith("_sum"):
            out.append((F.col(c) / F.nullif(F.col(f"{name}_count"), F.lit(0))).alias(f"{name}_mean"))
        elif not c.endswith("_count"):
            out.append(F.col(c))
    return sketches.select(*out)


def summary_parts(spans: DataFrame, watched: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """Trace summaries to store, with root_service, and hits: the names of the watched filters that any one span meets in whole."""
    met = [F.when(F.bool_or(match_attributes(pairs)), F.lit(name)) for name, pairs in (watched or {}).items()]
    hits = F.array_compact(F.array(*met)) if met else F.array().cast("array<string>")
    root = F.max(F.when(F.col("parent_span_id").isNull(), F.col("service_name")))
    return trace_summaries(spans, [root.alias("root_service"), hits.alias("hits")])


def summary_metrics(parts: DataFrame, unit: str = "hour", service: str | None = None, hit: str | None = None, exact: bool = False) -> DataFrame:
    """trace_metrics from stored summary_parts of any number of batches, without the spans. hit: the name of a watched filter."""
    whole = merge_summaries(parts)
    whole = whole if service is None else whole.where(F.col("root_service") == service)
    whole = whole if hit is None else whole.where(F.array_contains("hits", hit))
    bad = (F.col("status_code") == 2).cast("int").alias("bad")
    return bucket_stats(whole.select(time_trunc("start_time", unit).alias("bucket"), "duration_ms", bad), exact)
