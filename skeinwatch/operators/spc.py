"""Statistical process control: ordered chunks, control limits, zones, rules and trends.

Samples are long form: feature, seq (their order, numbered without gaps), value. Rules are windows over a feature's
samples in blocks of seq, each with the last rows of the block before, so that a feature of billions of samples is no
single task's sort; profiles and sample means of raw rows number rows by range partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwatch.functions.ranked import numbered as numbered

RULE = "8 16 4 8 2 4 1 1"
TREND = 7
BLOCK = 100_000  # samples of a feature that one window takes


def sample_size(rows: int) -> int:
    """Rows a chunk, by the number of rows."""
    for limit, size in ((1_000, 25), (10_000, 100), (100_000, 1_000), (1_000_000, 10_000)):
        if rows < limit:
            return size
    return 100_000


def chunk_id(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """df with chunk: rows in order, n to a chunk."""
    return numbered(df, order).withColumn("chunk", F.floor(F.col("seq") / n).cast("long"))


def chunk_means(df: DataFrame, columns: list[str], n: int, order: list[str]) -> DataFrame:
    """feature, chunk, mean, sd (sample) of each run of n rows."""
    chunks = chunk_id(df.select(*dict.fromkeys([*order, *columns])), n, order)
    aggs = [a for i, c in enumerate(columns) for a in (F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"))]
    wide = chunks.groupBy("chunk").agg(*aggs)
    rows = F.array(
        *(F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd")) for i, c in enumerate(columns))
    )
    return wide.select("chunk", F.inline(rows)).select("feature", "chunk", "mean", "sd")


def spc_profile(df: DataFrame, columns: list[str], order: list[str], n: int | None = None) -> DataFrame:
    """feature, center and the limits of one to three sigma: the mean of chunk means, sigma as the mean chunk deviation over c4."""
    n = n or sample_size(df.count())
    c4 = (4 * n - 4) / (4 * n - 3)
    means = chunk_means(df, columns, n, order)
    held = means.groupBy("feature").agg(F.avg("mean").alias("center"), (F.avg("sd") / c4).alias("__s"))
    limits = [
        f for k,
        name in ((1, "one"), (2, "two"), (3, "three")) for f in (
            (F.col("center") + k * F.col("__s")).alias(f"{name}_ucl"),
            (F.col("center") - k * F.col("__s")).alias(f"{name}_lcl"),
        )
    ]
    return held.select("feature", "center", *limits)


def spc_samples(df: DataFrame, columns: list[str], n: int, order: list[str]) -> DataFrame:
    """feature, seq, value: means of each run of n rows of serving data."""
    return chunk_means(df, columns, n, order).select("feature", F.col("chunk").alias("seq"), F.col("mean").alias("value"))


def spc_zone(value: Column) -> Column:
    """The side of the centre (1 or -1) times one more than the limits reached on that side.

    A value exactly on the centre or on a third limit is 0, and so is one that isn't a number or has no limits.
    """
    side = F.signum(value - F.col("center"))
    reached = [
        F.when(side > 0, value >= F.col(f"{k}_ucl")).otherwise(value <= F.col(f"{k}_lcl")).cast("int") for k in ("one", "two", "three")
    ]
    outermost = (value == F.col("three_ucl")) | (value == F.col("three_lcl"))
    zone = F.when(outermost | F.isnan(value), 0).otherwise(side * (1 + reduce(Column.__add__, reached)))
    return F.coalesce(zone, F.lit(0)).cast("int")


def spc_drift(samples: DataFrame, profile: DataFrame) -> DataFrame:
    """feature, seq, value, zone."""
    return samples.join(profile, "feature").select("feature", "seq", "value", spc_zone(F.col("value")).alias("zone"))


def align_lengths(df: DataFrame, key: str = "feature", order: str = "created_at") -> DataFrame:
    """The newest rows of each key, as many as the shortest key has; seq counts from the newest."""
    shortest = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).first()["n"] or 0
    newest = numbered(df, [F.desc(order), F.desc("value")], "seq", [key])
    return newest.withColumn("seq", (F.col("seq") + 1).cast("int")).where(F.col("seq") <= shortest)


def spc_recent(df: DataFrame, since, features: list[str]) -> DataFrame:
    """feature, seq, value: monitored features' samples since a time, cut to one length, newest first."""
    held = df.where((F.col("created_at") > F.lit(since)) & F.col("feature").isin(list(features)))
    return align_lengths(held).select("feature", "seq", "value")


def _series() -> Window:
    return Window.partitionBy("feature", "__block").orderBy("seq")


def _blocked(drift: DataFrame, reach: int) -> DataFrame:
    """drift by blocks of seq; the last `reach` rows of a block also lead in the next one, marked by __lead."""
    size = max(BLOCK, reach)
    own = F.floor(F.col("seq") / size)
    both = F.when(F.pmod("seq", F.lit(size)) >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    return drift.withColumn("__block", F.explode(both)).withColumn("__lead", F.col("__block") != own)


def _steps(drift: DataFrame, reach: int) -> DataFrame:
    """drift by blocks with the turn and the direction from the sample before; reach: how far back the tests look."""
    before = F.lag("zone").over(_series())
    held = _blocked(drift, reach)
    return held.withColumn("__turn", F.when(F.col("zone") != before, 1).otherwise(0)).withColumn("__step", F.signum(F.col("zone") - before))


def _run(test: Column, n: int) -> Column:
    """Whether the test holds for each of the last n samples."""
    return F.sum(F.when(test, 1).otherwise(0)).over(_series().rowsBetween(-(n - 1), 0)) == n


def _consecutive(n: int, zone: int) -> Column:
    return (F.abs("zone") == zone) & (_run(F.col("zone") >= zone, n) | _run(F.col("zone") <= -zone, n))


def _alternating(n: int, zone: int) -> Column:
    turns = _run(F.col("__turn") == 1, n - 1) if n > 1 else F.lit(True)
    return (F.abs("zone") == zone) & _run(F.abs("zone") >= zone, n) & turns


def _trend(n: int) -> Column:
    return _run(F.col("__step") == 1, n - 1) | _run(F.col("__step") == -1, n - 1)


def _hits(drift: DataFrame, hit: Column, reach: int) -> DataFrame:
    return _steps(drift, reach).withColumn("__hit", hit).where("__hit and not __lead").drop(
        "__hit",
        "__turn",
        "__step",
        "__block",
        "__lead",
    )


def consecutive_hits(drift: DataFrame, n: int, zone: int) -> DataFrame:
    """Rows exactly at +-zone whose last n zones (itself included) are all at it or beyond, on one side."""
    return _hits(drift, _consecutive(n, zone), n)


def alternating_hits(drift: DataFrame, n: int, zone: int) -> DataFrame:
    """Rows exactly at +-zone whose last n zones are all at it or beyond, each different from the one before."""
    return _hits(drift, _alternating(n, zone), n)


def trend_hits(drift: DataFrame, n: int = TREND) -> DataFrame:
    """Rows that end a run of n samples whose steps all go up or all go down."""
    return _hits(drift, _trend(n), n)


def parse_rule(rule: str) -> list[int]:
    parts = [int(x) for x in rule.split(" ")]
    if len(parts) != 8:
        raise ValueError("a rule has 8 numbers: consecutive and alternating for each zone")
    return parts


def spc_rules(drift: DataFrame, rule: str = RULE, zones: tuple[int, ...] = (1, 2, 3, 4), trend: bool = True) -> DataFrame:
    """feature, zone, kind: the distinct alerts of each feature. Zone 4 is out of bounds; a trend has zone 0."""
    parts, tests = parse_rule(rule), []
    alert = lambda hit, zone, kind: F.when(hit, F.struct(F.lit(zone).alias("zone"), F.lit(kind).alias("kind")))
    for zone in zones:
        for n, kind, hit in ((parts[2 * zone - 2], "consecutive", _consecutive), (parts[2 * zone - 1], "alternating", _alternating)):
            if n > 0:
                tests.append(alert(hit(n, zone), zone, "out_of_bounds" if zone == 4 else kind))
    if trend:
        tests.append(alert(_trend(TREND), 0, "trend"))
    none = F.lit(None).cast("struct<zone:int,kind:string>")
    found = _steps(drift, max([TREND, *parts])).select("feature", "__lead", F.array_compact(F.array(none, *tests)).alias("__alerts"))
    return found.where("not __lead").select("feature", F.inline("__alerts")).distinct()


def spc_alerts(samples: DataFrame, profile: DataFrame, rule: str = RULE, zones: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    return spc_rules(spc_drift(samples, profile), rule, zones)
