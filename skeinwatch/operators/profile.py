"""Data profiles: one aggregation for all numeric columns, long-form counts for strings and histograms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwatch.functions.ranked import nearest_ranks, numbered
from skeinwatch.functions.scalars import finite

QUANTILES = (0.25, 0.5, 0.75, 0.99)


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, value: one row a cell of the named columns."""
    return df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n, mean, stddev, min, max (NaN skipped by both ends), distinct and distinct_fraction."""
    held = long_form(df, columns).where(F.col("value").isNotNull())
    number = F.when(~F.isnan("value"), F.col("value"))
    return held.groupBy("feature").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("stddev"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.count_distinct("value").alias("distinct"), (F.count_distinct("value") / F.count("*")).alias("distinct_fraction"),
    )


def profile_wide(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same statistics without the distinct counts, as one row: a single pass whatever the number of columns."""
    stats = []
    for c in columns:
        x = F.col(c).cast("double")
        number = F.when(~F.isnan(x), x)
        stats += [
            F.avg(x).alias(f"{c}_mean"),
            F.stddev_samp(x).alias(f"{c}_stddev"),
            F.min(number).alias(f"{c}_min"),
            F.max(number).alias(f"{c}_max"),
        ]
    return df.agg(*stats)


def rank_quantiles(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = QUANTILES, approx: bool = False) -> DataFrame:
    """feature, q, value: quantiles by nearest rank (round(q (n - 1))); none of a feature with a cell that isn't finite."""
    held = long_form(df, columns)
    if approx:
        best = F.percentile_approx("value", [float(q) for q in quantiles], 10_000)
        got = held.groupBy("feature").agg(best.alias("v")).select("feature", F.posexplode("v").alias("i", "value"))
        qs = F.array(*map(F.lit, quantiles))
        return got.select("feature", F.element_at(qs, F.col("i") + 1).alias("q"), "value")
    clean = held.groupBy("feature").agg(F.min(finite(F.col("value"))).alias("__clean")).where("__clean").select("feature")
    rank = F.floor(F.col("q") * (F.col("__n") - 1) + 0.5)
    return nearest_ranks(held.where(finite(F.col("value"))), ["feature"], "value", tuple(quantiles), rank).join(F.broadcast(clean), "feature")


def histogram(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """feature, bin, left_edge, count: equal-width bins between min and max, the last one closed; empty bins included.

    The ends, a row a column, go to every task: no column's values are gathered in one.
    """
    held = long_form(df, columns).where(finite(F.col("value")))
    ends = held.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = held.join(F.broadcast(ends), "feature").groupBy("feature", at.alias("bin")).agg(F.count("*").alias("count"))
    grid = ends.select("feature", "lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["feature", "bin"], "left").select(
        "feature",
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("left_edge"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def profile_string(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n, distinct, distinct_percent, shortest, longest, mean and (upper) median length in characters."""
    held = df.select(columns).unpivot([], columns, "feature", "value").where(F.col("value").isNotNull())
    size = F.char_length("value")
    sized = held.groupBy("feature", size.alias("length")).agg(F.count("*").alias("m"))
    order = Window.partitionBy("feature").orderBy("length")
    median = sized.withColumn("upto", F.sum("m").over(order)).withColumn("all", F.sum("m").over(Window.partitionBy("feature")))
    median = median.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("feature").agg(F.min("length").alias("median_length"))
    rest = held.groupBy("feature").agg(
        F.count("*").alias("n"),
        F.count_distinct("value").alias("distinct"),
        (F.count_distinct("value") * 100.0 / F.count("*")).alias("distinct_percent"),
        F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.avg(size).alias("mean_length"),
    )
    return rest.join(median, "feature")


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, value, count, percent of rows."""
    held = df.select(columns).unpivot([], columns, "feature", "value").where(F.col("value").isNotNull())
    counts = held.groupBy("feature", "value").agg(F.count("*").alias("count"))
    return counts.withColumn("percent", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy("feature")))


#: Columns up to which correlations are one aggregation; beyond, blocks of BLOCK columns are multiplied in the tasks.
WIDE, BLOCK, MOST_COLUMNS = 16, 64, 2048
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "bad")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature_a, feature_b, corr: Pearson's coefficient of every pair, over the rows in which neither is null; null where a
    column doesn't vary in them."""
    if len(columns) > WIDE:
        return _wide_correlations(df, columns)
    pairs = [(a, b) for a in columns for b in columns]
    def coefficient(a: str, b: str) -> Column:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        deviations = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
        return F.try_divide(F.covar_pop(x, y), deviations)  # corr() itself fails on a constant column

    one = df.agg(*(coefficient(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    named = lambda i, a, b: F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("corr"))
    rows = F.array(*(named(i, a, b) for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(rows))


def _wide_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlations by a blocked Gram matrix: each task multiplies its rows' blocks of columns and keeps one sum a block
    pair (k * k * 56 bytes at most in all), and the tasks' sums are added in two steps. Values are taken from the columns'
    means, so that large offsets lose no digits."""
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"at most {MOST_COLUMNS} columns can be correlated at once")
    numbers = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    sure = lambda c: F.when(finite(F.col(c)), F.col(c))
    shift = np.array([x or 0.0 for x in numbers.agg(*(F.avg(sure(c)) for c in numbers.columns)).first()])  # a number a column
    starts = range(0, len(columns), BLOCK)
    spans = [(a, b) for a in starts for b in starts if a <= b]

    def products(batches):
        sums = {}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
            null = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns])
            odd = ~np.isfinite(x) & ~null
            m, z, o = (~null).astype(float), np.where(null | odd, 0.0, x), odd.astype(float)
            for a, b in spans:
                i, j = slice(a, a + BLOCK), slice(b, b + BLOCK)
                mi, mj, xi, xj = m[:, i].T, m[:, j], z[:, i].T, z[:, j]
                part = np.stack([mi @ mj, xi @ mj, mi @ xj, (xi * xi) @ mj, mi @ (xj * xj), xi @ xj, o[:, i].T @ mj + mi @ o[:, j]])
                sums[a, b] = sums[a, b] + part if (a, b) in sums else part
        for (a, b), part in sums.items():
            yield pa.RecordBatch.from_pydict({"a": [a], "b": [b], "part": [part.tobytes()]}, schema)

    def added(table):
        whole = sum(np.frombuffer(p.as_py()) for p in table["part"])
        return pa.table({"a": table["a"][:1], "b": table["b"][:1], "part": [whole.tobytes()]}, schema=schema)

    def named(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = row["a"], row["b"]
                ni, nj = min(BLOCK, len(columns) - a), min(BLOCK, len(columns) - b)
                n, sx, sy, sxx, syy, sxy, bad = np.frombuffer(row["part"]).reshape(len(_SUMS), ni, nj)
                with np.errstate(all="ignore"):
                    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
                    # what rounding leaves of a constant column is no variance
                    vx = np.where(vx <= n * (1e-14 * shift[a : a + ni, None]) ** 2, 0.0, vx)
                    vy = np.where(vy <= n * (1e-14 * shift[None, b : b + nj]) ** 2, 0.0, vy)
                    r = (sxy - sx * sy / n) / np.sqrt(vx * vy)
                r = np.where(bad > 0, np.nan, r)
                first, second = np.repeat(columns[a : a + ni], nj), np.tile(columns[b : b + nj], ni)
                flat, few = r.ravel(), ((n == 0) | ((vx * vy == 0) & (bad == 0))).ravel()
                for x, y in ((first, second), (second, first)) if a != b else ((first, second),):
                    yield pa.RecordBatch.from_arrays([pa.array(x.tolist()), pa.array(y.tolist()), pa.array(flat, mask=few)], ["feature_a", "feature_b", "corr"])

    schema, ddl = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.binary())]), "a long, b long, part binary"
    tasks = numbers.coalesce(max(2, df.sparkSession.sparkContext.defaultParallelism))
    parts = tasks.mapInArrow(products, ddl).withColumn("__s", F.pmod(F.spark_partition_id(), F.lit(16)))
    some = parts.groupBy("a", "b", "__s").applyInArrow(lambda t: added(t.select(["a", "b", "part"])), ddl)
    return some.groupBy("a", "b").applyInArrow(added, ddl).mapInArrow(named, "feature_a string, feature_b string, corr double")


def category_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, value, code: the distinct values of each column in order, numbered from 0."""
    values = df.select(columns).unpivot([], columns, "feature", "value").where(F.col("value").isNotNull()).distinct()
    return numbered(values, ["value"], "code", ["feature"])


def ordinal_encode(df: DataFrame, columns: list[str], codes: DataFrame | None = None) -> DataFrame:
    """df with the named columns as codes; a value that codes don't have gets the number of codes."""
    codes = codes if codes is not None else category_codes(df, columns)
    sizes = {r["feature"]: r["k"] for r in codes.groupBy("feature").agg(F.count("*").alias("k")).collect()}  # a row a feature
    for c in columns:
        own = codes.where(F.col("feature") == c).select(F.col("value").alias(c), F.col("code").alias("__code"))
        df = df.join(own, c, "left").withColumn(c, F.coalesce("__code", F.lit(sizes.get(c, 0))).cast("int")).drop("__code")
    return df


def profile(df: DataFrame, numeric: list[str], strings: list[str], bins: int = 20) -> DataFrame:
    """feature, kind, numeric stats, string stats, histogram, correlations (other feature: coefficient): one row a feature.

    Strings take part in the correlations by their ordinal codes.
    """
    every = [*numeric, *strings]
    coded = ordinal_encode(df.select(*every), strings) if strings else df
    pairs = correlations(coded, every).where("feature_a <> feature_b").groupBy(F.col("feature_a").alias("feature"))
    pairs = pairs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature_b", "corr")))).alias("correlations"))
    nums = profile_numeric(df, numeric).select(
        "feature",
        F.struct("n", "mean", "stddev", "min", "max", "distinct", "distinct_fraction").alias("numeric"),
    )
    bars = histogram(df, numeric, bins).groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("bin", "left_edge", "count"))).alias("histogram")
    )
    words = profile_string(df, strings).select(
        "feature",
        F.struct("n", "distinct", "distinct_percent", "min_length", "max_length", "mean_length", "median_length").alias("string"),
    )
    left = nums.join(bars, "feature", "left").withColumn("kind", F.lit("numeric"))
    rows = left.unionByName(words.withColumn("kind", F.lit("string")), allowMissingColumns=True)
    return rows.join(pairs, "feature", "left").select("feature", "kind", "numeric", "histogram", "string", "correlations")
