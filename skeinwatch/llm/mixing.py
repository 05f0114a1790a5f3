"""Temperature mixing of sources to target weights, in DataFrame functions only.

A source's weight is its token share raised to an exponent, normalised: 1 keeps the shares, 0 makes all sources equal.
The exponent is bisected (each round tries a grid of exponents in one aggregation) to the flattest mix whose entropy
doesn't exceed a target or whose repetition of any source doesn't exceed a limit. The weights are then realised under a
token budget: a source's documents fall into blocks by hash, an epoch is a permutation of its blocks, and a source takes
whole epochs and then the first blocks of one more permutation while they fit its share of the budget.

Without a budget, the least one is taken that gives every source a whole epoch, so that no document is left out.
Tokens are words plus one; null and empty texts have one. A null source is a source of its own. Repeated rows count each.
Blocks of one doc_id stay together (rows without one are a block together).

The blocks of the partial epoch are a prefix of one order of the source's blocks, so one cut-off a source states the whole
choice; it is found from sums by slice of the order, then by block in the slice that the budget ends in, so that no source
is sorted in one task. A document's epochs follow from its own row and its source's row of the plan: no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwatch.llm.common import scratch, word_count, written

BLOCK_TOKENS = 10_000
REPETITION = 2.0
#: Plans of at most this many sources (some 100 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000
_GRID, _ROUNDS = 16, 8
_SLICE_BITS = 8


def n_tokens() -> Column:
    return word_count(F.col("text")) + 1


def source_totals(docs: DataFrame) -> DataFrame:
    """source, tokens, docs; needs n_tokens."""
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def _mixes(totals: DataFrame, exponents: list[float]) -> DataFrame:
    """exponent, entropy (bits) and spread, the ratio of the most to the least repeated source."""
    total = totals.agg(F.sum("tokens")).first()[0]
    shares = totals.select((F.col("tokens") / F.lit(total)).alias("p"))
    tried = shares.select("p", F.explode(F.array(*map(F.lit, exponents))).alias("exponent")).withColumn("w", F.pow("p", "exponent"))
    sums = tried.groupBy("exponent").agg(
        F.sum("w").alias("z"),
        F.sum(F.col("w") * F.log2("w")).alias("wl"),
        F.max(F.col("w") / F.col("p")).alias("hi"),
        F.min(F.col("w") / F.col("p")).alias("lo"),
    )
    entropy = F.log2("z") - F.col("wl") / F.col("z")
    return sums.select(
        "exponent",
        entropy.alias("entropy"),
        (F.col("hi") / F.col("lo")).alias("spread"),
        (F.col("hi") / F.col("z")).alias("most"),
    )


def solve_exponent(totals: DataFrame, repetition: float | None = None, entropy: float | None = None, budget: float | None = None) -> float:
    """The least exponent in 0..1 that keeps the repetition limit, or an entropy (bits) of at most the target."""
    if (repetition is None) == (entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    lo, hi = 0.0, 1.0
    for _ in range(_ROUNDS):
        grid = [lo + (hi - lo) * i / _GRID for i in range(_GRID + 1)]
        rows = {r["exponent"]: r for r in _mixes(totals, grid).collect()}

        def kept(x: float, rows=rows) -> bool:
            r = rows.get(x)
            if r is None:
                return True
            if entropy is not None:
                return r["entropy"] <= entropy
            return (r["spread"] if budget is None else r["most"] * budget / whole) <= repetition

        first = next((i for i, x in enumerate(grid) if kept(x)), None)
        if first is None:
            return hi  # not even the plain shares keep it
        if first == 0:
            return lo
        lo, hi = grid[first - 1], grid[first]
    return hi


def mix_plan(totals: DataFrame, exponent: float, budget: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """source, tokens, docs, weight, target (tokens of the mix), epochs, blocks."""
    weighted = totals.withColumn("__w", F.pow(F.col("tokens").cast("double"), F.lit(exponent)))
    z, keep = weighted.agg(F.sum("__w"), F.max(F.col("tokens") / F.col("__w"))).first()
    size = F.lit(float(budget if budget is not None else (keep or 0) * (z or 0)))
    weight = F.col("__w") / F.lit(z)
    target = F.round(weight * size, 3)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long")
    epochs = (target / F.col("tokens")).alias("epochs")
    return weighted.select("source", "tokens", "docs", weight.alias("weight"), target.alias("target"), epochs, blocks.alias("blocks"))


def _order(epoch: Column, seed: int) -> Column:
    """A block's place (63 bits) in an epoch's permutation: a hash that no two epochs share."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, F.col("source"), F.col("block")), 1)


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks"))


def with_source(df: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """df with its source's row of plan, null sources too."""
    named = plan.withColumnRenamed("source", "__s")
    named = F.broadcast(named) if sources <= BROADCAST_SOURCES else named
    return df.join(named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def cut_offs(sized: DataFrame, plan: DataFrame, sources: int, seed: int) -> DataFrame:
    """plan with full (whole epochs), cut_o and cut_block: the last block that the partial epoch takes, in its order.

    sized has doc_id, source, n_tokens.
    """
    full = F.floor(F.col("target") / F.col("tokens") + 1e-12).cast("int")
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("full") * F.col("tokens"))
    full = plan.withColumn("full", full).withColumn("rest", rest)
    blocks = with_source(sized, full.select("source", "full", "rest", "blocks"), sources).withColumn("block", _block(seed))
    blocks = blocks.groupBy("source", "full", "rest", "block").agg(F.sum("n_tokens").alias("size")).withColumn("o", _order(F.col("full"), seed))
    blocks = written(blocks.withColumn("slice", F.shiftright("o", 63 - _SLICE_BITS)), "blocks")

    slices = blocks.groupBy("source", "rest", "slice").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("slice")) - F.col("size")
    slices = slices.withColumn("before", before).where(
        (F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))
    )
    edge = slices.select(F.col("source").alias("__s"), F.col("slice").alias("edge"), "before")
    inner = blocks.join(edge, F.col("source").eqNullSafe(F.col("__s")) & (F.col("slice") == F.col("edge"))).drop("__s")
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("o", "block"))
    taken = inner.withColumn("upto", upto).where(F.col("upto") <= F.col("rest"))
    last = taken.groupBy("source").agg(F.max(F.struct("o", "block")).alias("last"))

    found = edge.join(last.withColumnRenamed("source", "__l"), F.col("__s").eqNullSafe(F.col("__l")), "left").drop("__l")
    ends = full.join(found, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    start = F.shiftleft(F.col("edge"), 63 - _SLICE_BITS)  # of the edge slice: no block of it is taken
    every = F.lit(2**63 - 1)  # no edge: the rest takes all blocks
    cut_o = F.when(F.col("edge").isNull(), every).otherwise(F.coalesce(F.col("last")["o"], start))
    cut_block = F.when(F.col("edge").isNull(), every).otherwise(F.coalesce(F.col("last")["block"], F.lit(-1).cast("long")))
    return ends.select(*full.columns, cut_o.alias("cut_o"), cut_block.alias("cut_block")).drop("rest")


def dealt(df: DataFrame, plan: DataFrame, sources: int, seed: int) -> DataFrame:
    """df (doc_id, source and any other columns), a row for each epoch, with weight, epoch, block and position."""
    rows = with_source(df, plan.select("source", "weight", "epochs", "blocks", "full", "cut_o", "cut_block"), sources)
    rows = rows.withColumn("block", _block(seed)).withColumn("__o", _order(F.col("full"), seed))
    more = (F.col("__o") < F.col("cut_o")) | ((F.col("__o") == F.col("cut_o")) & (F.col("block") <= F.col("cut_block")))
    last = F.col("full") - F.when(more, 0).otherwise(1)
    epochs = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("epoch", F.explode(epochs))
    place = F.shiftrightunsigned(_order(F.col("epoch"), seed), 10).cast("double") / F.lit(float(1 << 53))
    position = F.least(F.lit(1.0), (F.col("epoch") + place) / F.col("epochs"))
    return rows.withColumn("position", position).drop("__o", "blocks", "epochs", "full", "cut_o", "cut_block")


def planned(
    docs: DataFrame,
    repetition: float | None = REPETITION,
    entropy: float | None = None,
    budget: float | None = None,
    seed: int = 17,
    block_tokens: int = BLOCK_TOKENS,
    length: Column | None = None,
) -> tuple[DataFrame, DataFrame, int]:
    """The documents' sizes (doc_id, source, n_tokens), written; the plan with cut-offs, written; its number of sources."""
    size = length if length is not None else n_tokens()
    with scratch(docs.sparkSession):
        slim = written(docs.select("doc_id", "source", size.alias("n_tokens")), "sizes", keep=True)
        totals = written(source_totals(slim), "totals")
        exponent = solve_exponent(totals, repetition, entropy, budget)
        plan = written(mix_plan(totals, exponent, budget, block_tokens), "plan")
        sources = plan.count()
        return slim, written(cut_offs(slim, plan, sources, seed), "cut-offs", keep=True), sources


def mixed(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """docs, a row for each epoch that takes it, with n_tokens, weight, epoch, block and position; options as of planned.

    Ordered by position (0..1), every source is spread evenly over the mix, epoch after epoch. Columns of docs with these
    or the plan's names are replaced.
    """
    slim, plan, sources = planned(docs, seed=seed, **options)
    size = options.get("length")
    own = docs.withColumn("n_tokens", n_tokens() if size is None else size)
    return dealt(own.drop(*plan.drop("source").columns, "epoch", "block", "position"), plan, sources, seed)


def mixed_sizes(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """doc_id, source, n_tokens, weight, epoch, block, position: mixed without the other columns, in one pass over texts."""
    slim, plan, sources = planned(docs, seed=seed, **options)
    return dealt(slim, plan, sources, seed)
