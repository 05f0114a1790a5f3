"""Connected components of an edge table by alternating large-star and small-star steps, all in DataFrame joins.

Each step is a grouped minimum (combined before its shuffle) and a join of the edges with it, so that a node with very
many edges is no single task's work beyond what adaptive execution splits. The edge table is written after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from skeinwatch.llm.common import scratch, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("__m")).select("src", F.least("src", "__m").alias("__m"))
    far = both.where(F.col("dst") > F.col("src")).join(least, "src")
    return far.select(F.col("dst").alias("src"), F.col("__m").alias("dst")).where(F.col("src") != F.col("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = down.groupBy("src").agg(F.min("dst").alias("__m"))
    moved = down.join(least, "src").where(F.col("dst") != F.col("__m")).select(F.col("dst").alias("src"), F.col("__m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("__m").alias("dst"))).distinct()


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and a digest that are observed as they are written."""
    seen = Observation()
    digest = F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))
    held = written(edges.observe(seen, F.count("*").alias("n"), digest.alias("digest")), "edges")
    return held, (seen.get["n"], seen.get["digest"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has an edge to another one.

    edges: src and dst of one orderable type; nulls and loops are left out, repeats and both directions are the same.
    """
    with scratch(edges.sparkSession):
        now = edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        now, state = _counted(now.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
        for _ in range(max_rounds):
            if not state[0]:
                break
            before = state
            now, state = _counted(_small_star(_large_star(now)))
            if state == before:
                break
        else:
            raise RuntimeError("components did not settle")
        own = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
        return written(now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(own), "components", keep=True)
