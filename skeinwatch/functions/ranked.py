"""Row numbers and exact quantiles of tables of any size, never by one sort.

Numbers: rows are dealt to partitions by range, written once with their partition's number and their place in it, and counted
by partition; the counts of the partitions before give each its offset. Quantiles: a sketch brackets them, and only what lies
in a bracket is sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwatch.functions.shared import written


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a and b by keys, nulls meeting nulls; the keys are a's."""
    named = b.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return a.join(named, on, how).drop(*(f"__k{i}" for i in range(len(keys))))


def _before(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, __part, __before from keys, __part, __rows: a row a partition and key."""
    upto = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__before", F.coalesce(F.sum("__rows").over(upto), F.lit(0)))


def numbered(df: DataFrame, order: list[str | Column], name: str = "seq", keys: list[str] = ()) -> DataFrame:
    """df with its rows numbered from 0 in the given order, within each combination of keys if there are any.

    Rows that are equal in keys and order are told apart by an id of their own, so that any number of them is dealt to many
    partitions. A row's place in its sorted partition is written with it; adding what lies in the partitions before needs
    no further sort.
    """
    keys = list(keys)
    by = [*keys, *order, "__tie"]
    own = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie")
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # its lower 33 bits count a partition's rows
    held = written(own.select("*", F.spark_partition_id().alias("__part"), at.alias("__at")), "ranges")
    sizes = held.groupBy(*keys, "__part").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    offsets = _before(sizes, keys).drop("__rows")
    made = joined(held, offsets, [*keys, "__part"])
    return made.withColumn(name, F.col("__at") - F.col("__first") + F.col("__before")).drop("__part", "__at", "__first", "__before")


#: A sketch's rank is off by at most n / ACCURACY; a bracket reaches WIDTH of all ranks to each side, five times that. Keys
#: of at most SMALL values are bracketed as a whole.
ACCURACY, WIDTH, SMALL = 10_000, 0.0005, 5_000
#: Sketches of up to so many keys go to every task, so that no key's rows are gathered in one; of more keys, rows meet by key.
FEW_KEYS = 10_000


def _picked(df: DataFrame, keys: list[str], value: str, quantiles: tuple[float, ...], ranks: Column) -> DataFrame:
    """keys, __n, q, r, value: what stands at each asked rank (from 0) of a key's values in order, nulls left out.

    ranks: an array of ranks, from q and __n, a key's number of values. A sketch brackets each quantile in one pass; a second one
    counts what lies between brackets and the equal values within them, before any shuffle. What is sorted of a key is
    WIDTH * 2 of its different values a quantile. A rank outside its bracket, which the sketch's bound rules out, is an error.
    """
    kind = dict(df.dtypes)[value]
    plain = F.nanvl(F.col(value), F.lit(float("inf"))) if kind in ("double", "float") else F.col(value)
    at = sorted(set(map(float, quantiles)))
    ends = [e for q in at for e in (max(q - WIDTH, 0.0), min(q + WIDTH, 1.0))]
    held = df.where(F.col(value).isNotNull())
    sketches = held.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx(plain, ends, ACCURACY).alias("__e"))
    whole, none = F.col("__n") <= SMALL, F.lit(None).cast(kind)

    def bracket(i: int, q: float) -> Column:
        lo, hi = F.col("__e")[2 * i], F.col("__e")[2 * i + 1]
        open_hi = whole | F.lit(q + WIDTH >= 1) | (hi == F.lit(float("inf")) if kind in ("double", "float") else F.lit(False))
        return F.struct(F.when(whole | F.lit(q - WIDTH <= 0), none).otherwise(lo).alias("lo"), F.when(open_hi, none).otherwise(hi).alias("hi"))

    sketches = written(sketches.select(*keys, "__n", F.array(*(bracket(i, q) for i, q in enumerate(at))).alias("__in")), "brackets")
    few = sketches.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    rows = joined(held.select(*keys, value), F.broadcast(sketches) if few else sketches, keys)
    v = F.col(value)
    holds = lambda b: (b["lo"].isNull() | (v >= b["lo"])) & (b["hi"].isNull() | (v <= b["hi"]))
    behind = lambda b: F.coalesce(b["hi"] < v, F.lit(False))
    if len(at) <= 32:  # compiled code
        each = [F.col("__in")[i] for i in range(len(at))]
        inside, past = reduce(Column.__or__, map(holds, each)), reduce(Column.__add__, (behind(b).cast("int") for b in each))
    else:
        inside, past = F.exists("__in", holds), F.size(F.filter("__in", behind))
    cells = rows.select(*keys, "__n", value, F.when(inside, v).alias("__cell"), F.when(~inside, past).alias("__gap"))
    cells = cells.groupBy(*keys, "__n", "__cell", "__gap").agg(F.count("*").alias("__m"), F.min(value).alias("__v"))
    cells = cells.withColumn("__upto", F.sum("__m").over(Window.partitionBy(*keys).orderBy("__v")))
    each = cells.select(*keys, "__n", "__cell", "__m", "__upto", F.explode(F.array(*map(F.lit, at))).alias("q"))
    each = each.withColumn("r", F.explode(ranks)).where((F.col("r") < F.col("__upto")) & (F.col("r") >= F.col("__upto") - F.col("__m")))
    sure = F.when(F.col("__cell").isNotNull(), F.col("__cell")).otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast(kind))
    return each.select(*keys, "__n", "q", "r", sure.alias(value))


def nearest_ranks(df: DataFrame, keys: list[str], value: str, quantiles: tuple[float, ...], rank: Column) -> DataFrame:
    """keys, q, value: the value at a rank for each quantile. rank: an expression of q and the number of values __n."""
    return _picked(df, keys, value, quantiles, F.array(rank.cast("long"))).select(*keys, "q", value)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: tuple[float, ...]) -> DataFrame:
    """keys, q, value: exact quantiles with linear interpolation between the two nearest values (R-7)."""
    place = F.col("q") * (F.col("__n") - 1)
    found = _picked(df, keys, value, quantiles, F.array_distinct(F.array(F.floor(place).cast("long"), F.ceil(place).cast("long"))))
    lo, hi, at = F.min_by(value, "r"), F.max_by(value, "r"), F.min("__at")
    between = (F.ceil(at) - at) * lo + (at - F.floor(at)) * hi
    found = found.withColumn("__at", place).groupBy(*keys, "q")
    # equal neighbours are what lies between them: their weighted sum may round away from both
    return found.agg(F.when((F.floor(at) == at) | (lo == hi), lo).otherwise(between).alias(value))


def quantile_columns(df: DataFrame, keys: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """keys and a column for each named exact quantile."""
    found = exact_quantiles(df, keys, value, tuple(dict.fromkeys(names.values())))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("q") == float(q), F.col(value))).alias(n) for n, q in names.items()))
