"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, block by block, in each pass; nothing but histograms leaves a block. A query's
score range is cut into bins; the summed histogram tells the bin that holds its kth score, which becomes the next range,
until the kth score itself is known. A last pass keeps the scores above it and, of those equal to it, the smallest ids.

Scores are integer inner products of floor(scale * x), in doubles while every partial sum is below 2^53, else in exact
Python integers (a score beyond a long is set to the nearest long). Vectors that are null, empty or hold null or
non-finite components take no part; queries meet rows of their own length only. Repeated rows (same id and vector) count
once; an id with several vectors is a candidate with each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwatch.llm.common import written
from skeinwatch.llm.vectors import first_found, gathered, merged, packed, unpacked, whole

BINS = 256
ROWS = 4096  # of a block of rows
QUERIES = 1024  # of a block of queries
FAN = 64  # histograms of a query block that are summed in one task
HELD = 64 << 20  # bytes of histograms that a task holds before it passes them on
_STATE = "qb long, dim int, n int, ids binary, data binary, lo binary, width binary, need binary"


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    bound = float(np.abs(queries).sum(axis=1).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if bound < 2**53:
        return (queries @ rows.T).astype(np.int64)
    whole_ = [[int(x) for x in row] for row in rows]
    out = [[sum(int(a) * b for a, b in zip(q, r, strict=True)) for r in whole_] for q in queries]
    return np.array([[max(-(2**63) + 1, min(2**63 - 1, x)) for x in row] for row in out], dtype=np.int64)


def _i64(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def _pairs(blocks: DataFrame, states: DataFrame, groups: int) -> DataFrame:
    """Each block of rows beside each block of queries of its length: query blocks are dealt to all groups of blocks."""
    dealt = states.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return blocks.alias("r").hint("merge").join(
        dealt.alias("q"),
        (F.col("r.group") == F.col("q.group")) & (F.col("r.dim") == F.col("q.dim")),
    ).select(
        F.col("r.dim").alias("dim"), F.col("r.ids").alias("rids"), F.col("r.data").alias("rdata"), "q.qb", F.col("q.ids").alias("qids"), F.col("q.data").alias("qdata"), "lo", "width", "need"
    )


def _columns(batch: pa.RecordBatch):
    return zip(
        *(batch.column(name).to_pylist() for name in ("dim", "rids", "rdata", "qb", "qids", "qdata", "lo", "width", "need")),
        strict=True,
    )


def _histograms(pairs: DataFrame) -> DataFrame:
    """qb, hist: the summed counts (queries x (BINS + 1), the last for scores above the range), at most FAN rows a query block."""

    def work(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % FAN
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, rids, rdata, qb, qids, qdata, lo, width, _ in _columns(batch):
                q, qv = unpacked(qids, qdata, dim)
                r, rv = unpacked(rids, rdata, dim)
                s = _scores(qv, rv)
                lo_, width_ = _i64(lo)[:, None], _i64(width)[:, None]
                over = (s.view(np.uint64) - lo_.view(np.uint64)) // width_.view(np.uint64)  # exact for s >= lo, however far
                at = np.where(s < lo_, -1, np.minimum(over, BINS).astype(np.int64))
                at[q[:, None] == r[None, :]] = -1
                row, col = np.nonzero(at >= 0)
                hist = np.bincount(row * (BINS + 1) + at[row, col], minlength=len(q) * (BINS + 1))
                held[qb] = held[qb] + hist if qb in held else hist
                if sum(x.nbytes for x in held.values()) > HELD:
                    yield emit(held, part)
                    held = {}
        if held:
            yield emit(held, part)

    def emit(held, part):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(held), pa.int64()),
                pa.array([part] * len(held), pa.int32()),
                pa.array([x.astype(np.int64).tobytes() for x in held.values()], pa.binary()),
            ],
            names=["qb", "part", "hist"],
        )

    def add(key, rows):
        return pd.DataFrame({"qb": [key[0]], "hist": [sum(map(_i64, rows["hist"])).tobytes()]})

    return pairs.mapInArrow(work, "qb long, part int, hist binary").groupBy("qb", "part").applyInPandas(add, "qb long, hist binary")


def _refined(states: DataFrame, hists: DataFrame) -> DataFrame:
    """Each query's range cut to the bin that holds its kth score; need becomes the rank within it."""

    def step(key, state, parts):
        if not len(state):
            return state
        one = state.iloc[0].copy()
        n = int(one["n"])
        hist = np.zeros(n * (BINS + 1), dtype=np.int64)
        for part in parts["hist"]:
            hist += _i64(part)
        hist = hist.reshape(n, BINS + 1)
        lo, width, need = (_i64(one[x]).copy() for x in ("lo", "width", "need"))
        above = hist[:, BINS]
        down = np.cumsum(hist[:, BINS - 1 :: -1], axis=1) + above[:, None]  # scores in this bin or a higher one
        enough = down >= need[:, None]
        found = enough.any(axis=1)  # else there are fewer than k rows: all of them stay
        bin_ = BINS - 1 - enough.argmax(axis=1)
        lo = np.where(found, lo + bin_ * width, lo)
        width = np.where(found, np.maximum(1, -(-width // BINS)), 0)
        one["lo"], one["width"], one["need"] = lo.tobytes(), np.maximum(width, 1).tobytes(), need.tobytes()
        one["open"] = bool((found & (_i64(state.iloc[0]["width"]) > 1)).any())
        return one.to_frame().T[[x.split()[0] for x in _STATE.split(", ")] + ["open"]]

    return states.drop("open").groupBy("qb").cogroup(hists.groupBy("qb")).applyInPandas(step, _STATE + ", open boolean")


def _kept(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, found: each task's best scores at or above the kth, ties by id, k at most a query."""

    def scores(batches):
        for batch in batches:
            for dim, rids, rdata, _, qids, qdata, lo, _, _ in _columns(batch):
                q, qv = unpacked(qids, qdata, dim)
                r, rv = unpacked(rids, rdata, dim)
                s = _scores(qv, rv)
                row, col = np.nonzero((s >= _i64(lo)[:, None]) & (q[:, None] != r[None, :]))
                yield merged([(q[row], -s[row, col], r[col])], k)

    work = lambda batches: gathered(scores(batches), k, ("query_id", "vec_id"))
    return pairs.mapInArrow(work, "query_id long, found array<struct<minus:long,vec_id:long>>")


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to the smaller id.

    vectors and queries have vec_id and embedding; a query isn't its own candidate.
    """
    spark = vectors.sparkSession

    def ready(df):
        v = F.transform(
            "embedding",
            lambda x: F.when(
                F.abs(x) < 2.0**50,
                F.floor(F.lit(scale) * x.cast("double")).cast("double"),
            ).otherwise(F.lit(scale) * x.cast("double")),
        )
        return df.where(
            F.col("vec_id").isNotNull() & whole(F.col("embedding"))
        ).select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).distinct()

    rows = written(packed(ready(vectors), ROWS), "blocks")
    most, n_blocks = rows.agg(F.sum("n"), F.count("*")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not n_blocks:
        return spark.createDataFrame([], result)
    groups = max(1, math.ceil(n_blocks / 2))
    blocks = rows.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    norms = ready(vectors).select(
        F.size("v").alias("dim"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("s"),
    ).groupBy("dim").agg(F.sqrt(F.max("s")).alias("far"))

    def first(batches):
        for batch in batches:
            out = []
            for dim, n, ids, data, far in zip(*(batch.column(x).to_pylist() for x in ("dim", "n", "ids", "data", "far")), strict=True):
                _, v = unpacked(ids, data, dim)
                reach = np.sqrt((v * v).sum(axis=1)) * far * (1 + 1e-9) + 2
                wide = reach >= 2.0**61  # such queries start from all longs
                reach = np.where(wide, 0, reach).astype(np.int64)
                lo = np.where(wide, -(2**63) + 1, -reach)
                width = np.where(wide, 2**64 // BINS, np.maximum(1, -(-(2 * reach + 1) // BINS)))
                out.append((0, dim, n, ids, data, lo.tobytes(), width.tobytes(), np.full(n, k, np.int64).tobytes(), True))
            names = [x.split()[0] for x in _STATE.split(", ")] + ["open"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    asked = packed(ready(queries), QUERIES).join(norms, "dim").mapInArrow(first, _STATE + ", open boolean")
    states = written(asked.withColumn("qb", F.xxhash64("ids")), "queries")
    for _ in range(12):
        if states.where("open").isEmpty():
            break
        states = written(_refined(states, _histograms(_pairs(blocks, states, groups))), "queries")
    merged = _kept(_pairs(blocks, states, groups), k).groupBy("query_id").agg(first_found(k).alias("found"))
    return merged.select("query_id", F.posexplode("found").alias("at", "x")).select(
        "query_id",
        (F.col("at") + 1).alias("rank"),
        F.col("x.vec_id").alias("vec_id"),
        (-F.col("x.minus")).alias("score"),
    )
