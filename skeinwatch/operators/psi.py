"""Population stability: binning rules, profiles, distributions, drift, thresholds and alerts.

A profile has a row for each feature and bin: feature, id (from 1), lower, upper, proportion; a value x is in the bin with
lower < x <= upper. Categorical features have bins whose id is the value's code. Everything runs on all features at once
in long form. What reaches the driver is the profile: a row a feature and bin. A profile may have MAX_BINS rows at most
(a categorical column of more values is an error; it is no category for this index).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwatch.functions.ranked import exact_quantiles, nearest_ranks
from skeinwatch.functions.scalars import finite
from skeinwatch.functions.statistics import chi_square_quantile, normal_quantile
from skeinwatch.functions.timeutil import time_bin
from skeinwatch.operators.profile import long_form

EPSILON = 1e-10
MAX_BINS = 100_000
RULES = ("manual", "square_root", "sturges", "rice", "doane", "scott", "terrell_scott", "freedman_diaconis")


def bin_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n, lo, hi, g1 (population skewness), sd (population), q1 and q3 (lower rank): what bin-count rules need."""
    held = long_form(df, columns).where(finite(F.col("value")))
    stats = _width_statistics(df, columns).drop("q1", "q3")
    ranks = nearest_ranks(held, ["feature"], "value", (0.25, 0.75), F.floor(F.col("q") * (F.col("__n") - 1)))
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    return stats.join(ranks.groupBy("feature").agg(at(0.25).alias("q1"), at(0.75).alias("q3")), "feature")


def _width_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """bin_statistics without quartiles, which only one rule asks for: one aggregation."""
    held = long_form(df, columns).where(finite(F.col("value")))
    return held.groupBy("feature").agg(
        F.count("*").alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.skewness("value").alias("g1"),
        F.stddev_pop("value").alias("sd"),
        F.lit(None).cast("double").alias("q1"),
        F.lit(None).cast("double").alias("q3"),
    )


def bin_count(rule: str, manual: int = 10) -> Column:
    """Number of equal-width bins by a rule, from the columns of bin_statistics."""
    n = F.col("n").cast("double")
    span = F.col("hi") - F.col("lo")
    third = F.pow(n, F.lit(1 / 3))
    by_width = lambda w: F.when(w > 0, F.ceil(span / w)).otherwise(1)
    sigma = F.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)))
    rules = {
        "manual": F.lit(manual),
        "square_root": F.ceil(F.sqrt(n)),
        "sturges": F.ceil(F.log2(n)) + 1,
        "rice": F.ceil(2 * third),
        "doane": F.round(1 + F.log2(n) + F.log2(1 + F.abs("g1") / sigma)),
        "scott": by_width(3.49 * F.col("sd") / third),
        "terrell_scott": F.round(F.pow(2 * n, F.lit(1 / 3))),
        "freedman_diaconis": by_width(2 * (F.col("q3") - F.col("q1")) / third),
    }
    if rule not in rules:
        raise ValueError(f"rule must be one of {RULES}")
    return rules[rule].cast("int")


def width_edges(df: DataFrame, columns: list[str], rule: str = "doane", manual: int = 10) -> DataFrame:
    """feature, edges: the inner edges of equal-width bins; fewer than 2 bins is an error."""
    sized = (bin_statistics if rule == "freedman_diaconis" else _width_statistics)(df, columns).withColumn("k", bin_count(rule, manual))
    bad = F.raise_error(F.lit("equal-width binning needs at least 2 bins"))
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    edges = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.col("lo") + i * width)
    return sized.select("feature", F.when(F.col("k") >= 2, edges).otherwise(bad).alias("edges"))


def quantile_edges(df: DataFrame, columns: list[str], n: int = 10, approx: bool = False) -> DataFrame:
    """feature, edges: the inner n-quantiles with linear interpolation (R-7); approx takes the nearest values of a sketch."""
    if n < 2:
        raise ValueError("at least 2 bins are needed")
    held = long_form(df, columns).where(finite(F.col("value")))
    at = tuple(i / n for i in range(1, n))
    if approx:
        return held.groupBy("feature").agg(F.percentile_approx("value", list(at), 100_000).alias("edges"))
    found = exact_quantiles(held, ["feature"], "value", at)
    return found.groupBy("feature").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))), lambda x: x["value"]).alias("edges")
    )


def bin_of(value: Column, edges: list[float]) -> Column:
    """1 + the number of edges below the value, null for values that aren't finite.

    A search by halves: an expression of log2(edges) levels looks up the middle edge of an array that the plan holds once.
    """
    held = F.lit(np.array(sorted(edges), dtype="float64"))
    below, step = F.lit(0), 1 << max(len(edges).bit_length() - 1, 0)
    if len(edges) <= 16:
        below = reduce(Column.__add__, ((value > e).cast("int") for e in edges), F.lit(0))
    else:
        steps = [step >> i for i in range(len(edges).bit_length())]
        reach = lambda at, s: (at + s <= len(edges)) & (F.get(held, at + s - 1) < value)
        below = F.aggregate(F.array(*map(F.lit, steps)), below, lambda at, s: F.when(reach(at, s), at + s).otherwise(at))
    return F.when(finite(value), below + 1).cast("int")


def _counted(df: DataFrame, ids: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """keys, feature, id, count of one id column a feature, all in one pass."""
    return df.select(
        *keys,
        *(c.alias(f) for f, c in ids.items()),
    ).unpivot(list(keys), list(ids), "feature", "id").where(F.col("id").isNotNull()).groupBy(*keys, "feature", "id").agg(F.count("*").alias("count"))


def psi_profile(
    df: DataFrame,
    columns: list[str],
    rule: str = "quantile",
    n: int = 10,
    categorical: list[str] = (),
    approx: bool = False,
) -> DataFrame:
    """feature, id, lower, upper, proportion. Categorical columns hold codes, and a code is its bin's id.

    The edges, a row a feature, are found first.
    """
    numeric = [c for c in columns if c not in categorical]
    ids = {c: F.when(finite(F.col(c).cast("double")), F.col(c).cast("int")) for c in categorical}
    rows = []
    if numeric:
        found = quantile_edges(df, numeric, n, approx) if rule == "quantile" else width_edges(df, numeric, rule, n)
        for r in found.collect():
            edges = sorted(set(r["edges"]))
            ids[r["feature"]] = bin_of(F.col(r["feature"]).cast("double"), edges)
            ends = [float("-inf"), *edges, float("inf")]
            rows += [(r["feature"], i, ends[i - 1], ends[i]) for i in range(1, len(edges) + 2)]
    counts = _counted(df, ids)
    grid = _local(df.sparkSession, [(*r, None) for r in rows]).drop("proportion").join(
        counts.where(~F.col("feature").isin(list(categorical))),
        ["feature", "id"],
        "left",
    )
    if categorical:
        none = F.lit(None).cast("double")
        grid = grid.unionByName(
            counts.where(F.col("feature").isin(list(categorical))).select(
                "feature",
                "id",
                none.alias("lower"),
                none.alias("upper"),
                "count",
            )
        )
    m = F.coalesce("count", F.lit(0))
    return grid.select("feature", "id", "lower", "upper", (m / F.sum(m).over(Window.partitionBy("feature"))).alias("proportion"))


def fixed_profile(profile: DataFrame) -> DataFrame:
    """A profile as a local table: it has a row a bin (MAX_BINS at most), and is computed once."""
    return _local(profile.sparkSession, _bins(profile))


_BIN = ("feature", "id", "lower", "upper", "proportion")


def _bins(profile: DataFrame) -> list[tuple]:
    rows = profile.select(*_BIN).limit(MAX_BINS + 1).collect()
    if len(rows) > MAX_BINS:
        raise ValueError(f"a profile has at most {MAX_BINS} bins")
    return sorted(map(tuple, rows), key=lambda r: r[:2])


def _local(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Bins as a table that the driver holds, so that reading it runs no job."""
    kinds = dict(zip(_BIN, ("string", "int32", "double", "double", "double"), strict=True))
    columns = dict(zip(_BIN, zip(*rows, strict=True), strict=True)) if rows else dict.fromkeys(_BIN, ())
    return spark.createDataFrame(pa.table({n: pa.array(columns[n], k) for n, k in kinds.items()}))


def psi_bin_counts(df: DataFrame, profile: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """keys, feature, id, count: how many finite values fall in each profile bin; every bin of a key has a row."""
    bins: dict[str, list] = {}
    for r in _bins(profile.where(F.col("feature").isin(list(columns)))):
        bins.setdefault(r[0], []).append(dict(zip(_BIN, r, strict=True)))
    ids = {}
    for feature, rows in bins.items():
        value = F.col(feature).cast("double")
        if rows[0]["upper"] is None:
            ids[feature] = F.when(finite(value) & value.isin([r["id"] for r in rows]), value.cast("int"))
        else:
            ids[feature] = bin_of(value, [r["upper"] for r in rows[:-1]])
    counts = _counted(df, ids, list(keys))
    grid = _local(df.sparkSession, [tuple(r.values()) for rows in bins.values() for r in rows]).select("feature", "id")
    seen = counts.select(*keys, "feature").distinct().join(grid, "feature")
    return seen.join(counts, [*keys, "feature", "id"], "left").select(
        *keys,
        "feature",
        "id",
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def bin_proportions(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts (keys, id, count) with the share of each bin in its key's total, without a join."""
    total = F.sum("count").over(Window.partitionBy(*keys))
    return counts.withColumn("total", total).withColumn("observed", F.col("count") / F.col("total"))


def align_bins(profile: DataFrame, observed: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Every profile bin beside the share observed, 0 where there is none."""
    groups = observed.select(*keys, "feature").distinct()
    grid = groups.join(profile.select("feature", "id", "proportion"), "feature")
    return grid.join(
        observed.select(*keys, "feature", "id", "observed"),
        [*keys, "feature", "id"],
        "left",
    ).withColumn("observed", F.coalesce("observed", F.lit(0.0)))


def psi_term(p: Column, q: Column) -> Column:
    """One bin's part of the index: (p - q) ln(p / q), both raised by a small constant."""
    p, q = p + EPSILON, q + EPSILON
    return (p - q) * F.log(p / q)


def psi(aligned: DataFrame, keys: list[str]) -> DataFrame:
    return aligned.groupBy(*keys).agg(F.sum(psi_term(F.col("proportion"), F.col("observed"))).alias("psi"))


def psi_drift(df: DataFrame, profile: DataFrame, columns: list[str], strict_denominator: bool = False) -> DataFrame:
    """feature, psi, n, bins of a sample against a profile; a feature that the profile lacks is an error.

    strict_denominator: shares are of all rows, values that aren't finite included.
    """
    rows = _bins(profile)
    profile, known = _local(profile.sparkSession, rows), {r[0] for r in rows}
    if missing := sorted(set(columns) - known):
        raise ValueError(f"not in the profile: {missing}")
    shares = bin_proportions(psi_bin_counts(df, profile, columns), ["feature"])
    if strict_denominator:
        n = df.count()
        shares = shares.withColumn("observed", F.col("count") / F.lit(n))
    aligned = shares.join(profile.select("feature", "id", "proportion"), ["feature", "id"])
    return aligned.groupBy("feature").agg(
        F.sum(psi_term(F.col("proportion"), F.col("observed"))).alias("psi"),
        F.sum("count").alias("n"),
        F.count("*").alias("bins"),
    )


def psi_distributions(facts: DataFrame, profile: DataFrame, since=None, per_bin: int = 10) -> DataFrame:
    """feature, id, observed, total from psi_drift facts (created_at, feature, bin_id, bin_count) since the last run.

    A feature is left out until it has more than per_bin observations for each of its bins.
    """
    held = facts if since is None else facts.where(F.col("created_at") > F.lit(since))
    counts = held.groupBy("feature", F.col("bin_id").alias("id")).agg(F.sum("bin_count").alias("count"))
    shares = bin_proportions(counts, ["feature"])
    sizes = profile.groupBy("feature").agg(F.count("*").alias("bins"))
    return shares.join(sizes, "feature").where(F.col("total") > per_bin * F.col("bins")).select("feature", "id", "observed", "total")


def psi_over_time(facts: DataFrame, profile: DataFrame, minutes: float, min_obs: int = 100) -> DataFrame:
    """feature, bucket (null: overall), psi, total: buckets and the whole interval with more than min_obs observations."""
    binned = facts.groupBy(
        "feature",
        time_bin("created_at", minutes).alias("bucket"),
        F.col("bin_id").alias("id"),
    ).agg(F.sum("bin_count").alias("count"))
    overall = binned.groupBy("feature", "id").agg(F.sum("count").alias("count")).withColumn("bucket", F.lit(None).cast("timestamp"))
    shares = bin_proportions(binned.unionByName(overall), ["feature", "bucket"]).where(F.col("total") > min_obs)
    grid = shares.select("feature", "bucket", "total").distinct().join(profile.select("feature", "id", "proportion"), "feature")
    seen = shares.select(F.col("feature").alias("f"), F.col("bucket").alias("b"), F.col("id").alias("i"), "observed")
    on = (F.col("feature") == F.col("f")) & F.col("bucket").eqNullSafe(F.col("b")) & (F.col("id") == F.col("i"))
    aligned = grid.join(seen, on, "left").withColumn("observed", F.coalesce("observed", F.lit(0.0)))
    return aligned.groupBy("feature", "bucket").agg(
        F.sum(psi_term(F.col("proportion"), F.col("observed"))).alias("psi"),
        F.first("total").alias("total"),
    )


def normal_threshold(bins: Column, n: Column, alpha: float = 0.05) -> Column:
    """Mean of the index under no drift and z times its deviation, by the normal approximation."""
    return (bins - 1) / n + F.lit(normal_quantile(1 - alpha)) * F.sqrt(2 * (bins - 1)) / n


def chi_square_threshold(
    df: DataFrame,
    bins: str = "bins",
    n: str = "n",
    alpha: float = 0.05,
    profile: DataFrame | None = None,
) -> DataFrame:
    """df with threshold: the chi-square quantile of bins - 1 degrees over n. One quantile a distinct number of bins.

    The numbers of bins are read from the profile if it is given (a fixed one costs no job), else by running df.
    """
    known = df.select(bins) if profile is None else profile.groupBy("feature").agg(F.count("*").alias(bins)).select(bins)
    sizes = [r[0] for r in known.distinct().collect()]
    table = F.create_map(
        *(x for b in sizes for x in (F.lit(b), F.lit(chi_square_quantile(1 - alpha, b - 1) if b > 1 else 0.0)))
    ) if sizes else F.lit(None)
    return df.withColumn("threshold", (table[F.col(bins)] if sizes else F.lit(None).cast("double")) / F.col(n))


def psi_alerts(
    drift: DataFrame,
    method: str = "chi_square",
    alpha: float = 0.05,
    fixed: float = 0.25,
    features: list[str] | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """drift (feature, psi, n, bins) with threshold and alert, for the monitored features; profile as of chi_square_threshold."""
    held = drift if features is None else drift.where(F.col("feature").isin(list(features)))
    if method == "chi_square":
        held = chi_square_threshold(held, alpha=alpha, profile=profile)
    elif method == "normal":
        held = held.withColumn("threshold", normal_threshold(F.col("bins"), F.col("n"), alpha))
    elif method == "fixed":
        held = held.withColumn("threshold", F.lit(float(fixed)))
    else:
        raise ValueError("method must be chi_square, normal or fixed")
    return held.withColumn("alert", F.col("psi") > F.col("threshold"))
