"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample (SAMPLE vectors, drawn by hash): each node splits its part of the sample at the
median of a random direction. Every vector is then routed to one leaf of each tree. A query walks all trees through one
priority queue, ordered by the squared distance to a node (directions in a tree are nearly orthogonal, so the squares of
the margins crossed add up), until it has taken as many leaves as the calibration says; the candidates in those leaves are
scored exactly in double precision and merged.

Equal vectors are one point of the index: its 21 smallest ids stand for all its copies, since no list of 20 can hold
more. For inner products a component is added that brings every indexed vector to the same length, so that the largest
product is the nearest point. The number of leaves is calibrated on the sample against brute force for a recall target;
leaves that outgrow LEAF_ROWS are scored in several parts, all of them (no bucket is capped).

Vectors that are null, empty, zero or hold null or non-finite components take no part; queries meet vectors of their own
length only. The FORESTS most frequent lengths have a forest each; rarer ones are one leaf a length, scored exactly. Ties
go to the smaller id. Repeated rows (same id and vector) count once. Components are to be below 1e150 in size, so that scores
are finite; products that underflow are zero and tie.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skeinwatch.llm.common import sliced, written
from skeinwatch.llm.vectors import first_found, gathered, matrix, merged, nonzero, whole

SAMPLE = 20_000
TREES = 8
LEAVES, LEAF_MEAN = 64, 1024  # a tree has the larger of LEAVES and rows / LEAF_MEAN leaves, with 16 vectors of the sample in each at least
LEAF_ROWS = 4096
PROBES = 256  # queries scored together against one leaf
HELD = 32 << 20  # bytes of vectors that a task packs by leaf before it passes them on
RECALL = 0.95
FORESTS = 8  # lengths of vectors, the most frequent ones, that have a forest


class Forest:
    """The trees as flat arrays: node i splits at normals[i] . x < cuts[i]; children below zero are leaves, -1 - leaf."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaves: int = LEAVES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.normals, self.cuts, self.children, self.roots, self.leaves = [], [], [], [], 0
        depth = max(0, int(math.log2(max(1, min(leaves, len(sample) // 16)))))
        for _ in range(trees):
            self.roots.append(self._grow(sample, depth, rng))
        self.normals = np.array(self.normals).reshape(-1, sample.shape[1])
        self.cuts, self.children = np.array(self.cuts), np.array(self.children, dtype=np.int64).reshape(-1, 2)

    def _grow(self, part: np.ndarray, depth: int, rng) -> int:
        if depth == 0 or len(part) < 2:
            self.leaves += 1
            return -self.leaves
        a, b = part[rng.choice(len(part), 2, replace=False)]
        normal = a - b if np.abs(a - b).max() > 1e-12 else rng.standard_normal(part.shape[1])
        normal = normal / np.linalg.norm(normal)
        along = part @ normal
        cut = float(np.median(along))
        at = len(self.cuts)
        self.normals.append(normal)
        self.cuts.append(cut)
        self.children.append([0, 0])
        self.children[at] = [self._grow(part[along < cut], depth - 1, rng), self._grow(part[along >= cut], depth - 1, rng)]
        return at

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """points x trees: the leaf of each point in each tree."""
        out = np.empty((len(points), len(self.roots)), dtype=np.int64)
        if not len(self.cuts):
            return out.__iadd__(0) if not len(points) else np.tile(-1 - np.array(self.roots), (len(points), 1))
        right = points @ self.normals.T >= self.cuts
        row = np.arange(len(points))
        for t, root in enumerate(self.roots):
            node = np.full(len(points), root, dtype=np.int64)
            while (inner := node >= 0).any():
                node[inner] = self.children[node[inner], right[row[inner], node[inner]].astype(np.int64)]
            out[:, t] = -1 - node
        return out

    def nearest_leaves(self, query: np.ndarray, count: int) -> list[int]:
        """The first leaves that a walk through the shared priority queue takes."""
        margins = (self.normals @ query - self.cuts).tolist() if len(self.cuts) else []
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        found: list[int] = []
        while queue and len(found) < count:
            distance, node = heapq.heappop(queue)
            while node >= 0:
                margin = margins[node]
                near, far = (1, 0) if margin >= 0 else (0, 1)
                heapq.heappush(queue, (distance + margin * margin, int(self.children[node, far])))
                node = int(self.children[node, near])
            found.append(-1 - node)
        return found


def calibrated(forest: Forest, sample: np.ndarray, plain: np.ndarray, k: int, target: float = RECALL, tests: int = 100) -> int:
    """How many leaves a query must take so that the mean recall of the sample's own top k reaches the target."""
    if len(sample) <= k + 1:
        return forest.leaves
    at = np.linspace(0, len(sample) - 1, min(tests, len(sample))).astype(int)
    leaf = forest.leaf_of(sample)
    seen = np.zeros(forest.leaves + 1)
    for i in at:
        scores = plain @ plain[i]
        scores[i] = -np.inf
        best = np.argpartition(-scores, k)[:k]
        query = _asked(plain[i])
        place = np.full(forest.leaves, forest.leaves)
        order = forest.nearest_leaves(query, forest.leaves)
        place[order] = np.arange(len(order))
        first = place[leaf[best]].min(axis=1)
        seen[1:] += np.cumsum(np.bincount(first, minlength=forest.leaves + 1)[: forest.leaves]) / k
    return int(np.argmax(seen / len(at) >= min(target, 1.0 - 1e-9))) or forest.leaves


def _lifted(points: np.ndarray, longest: float) -> np.ndarray:
    """Points scaled to at most length 1, with the component that makes it 1."""
    x = points / longest
    return np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))])


def _asked(query: np.ndarray) -> np.ndarray:
    """A query at length 1, on the side of the lifted points. Scaled first: squares of tiny or huge numbers leave the range."""
    x = query / np.abs(query).max()
    return np.append(x / np.linalg.norm(x), 0.0)


def candidates(points: np.ndarray, queries: np.ndarray, k: int = 20, recall: float = RECALL) -> tuple[int, int]:
    """(scored, different): pairs that `nearest` scores for these queries if fitted on these points; pairs of different rows."""
    longest = float(np.linalg.norm(points, axis=1).max()) * (1 + 1e-12)
    lifted = _lifted(points, longest)
    forest = Forest(lifted, TREES, max(LEAVES, len(points) // LEAF_MEAN))
    take, leaf = calibrated(forest, lifted, points, k, recall), forest.leaf_of(lifted)
    scored = different = 0
    for q in queries:
        met = np.isin(leaf, forest.nearest_leaves(_asked(q), take))
        scored, different = scored + int(met.sum()), different + int(met.any(axis=1).sum())
    return scored, different


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    trees: int = TREES,
    sample_rows: int = SAMPLE,
    recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, vec_id, score: k rows of largest inner product found for each query, itself left out.

    vectors and queries have vec_id and embedding; queries are rows of vectors.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"

    def valid(df):
        e = F.col("embedding")
        v = F.transform(e, lambda x: x.cast("double") + F.lit(0.0))
        return df.where(F.col("vec_id").isNotNull() & whole(e)).where(nonzero(e)).select(
            F.col("vec_id").cast("long").alias("vec_id"),
            v.alias("v"),
        )

    counts = valid(vectors).groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(FORESTS + 1).collect()
    if not counts:
        return spark.createDataFrame([], result)
    common, kind = [r["dim"] for r in counts[:FORESTS]], vectors.schema["embedding"].dataType
    of = lambda df, test: valid(df.where(test(F.size("embedding"))))
    tests = [(lambda size, n=n: size == n) for n in common]
    found = [_nearest(of(vectors, t), of(queries, t), kind, k, trees, sample_rows, recall) for t in tests]
    if len(counts) > FORESTS:
        rare = lambda size: ~size.isin(common)
        found.append(_nearest(of(vectors, rare), of(queries, rare), kind, k))
    return reduce(DataFrame.unionByName, found)


def _fitted(points: DataFrame, k: int, trees: int, sample_rows: int, recall: float) -> tuple[Forest, float, int]:
    """The forest, the greatest length of a vector, and how many leaves a query takes."""
    largest = F.array_max(F.transform("v", F.abs))  # squares of tiny or huge numbers leave the range
    scaled = points.select("v", largest.alias("m"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("m")) * (x / F.col("m")))
    n, longest = scaled.agg(F.count("*"), F.max(F.col("m") * F.sqrt(squares))).first()
    share = F.lit(min(1.0, 1.1 * sample_rows / n) * (1 << 30))
    drawn = points.select("v", F.xxhash64("rep").alias("__h")).where(F.pmod(F.col("__h"), F.lit(1 << 30)) < share)
    plain = np.array([r["v"] for r in drawn.orderBy("__h").limit(sample_rows).select("v").collect()])
    plain = plain if len(plain) else np.array([r["v"] for r in points.orderBy("rep").limit(1).collect()])
    lifted = _lifted(plain, longest * (1 + 1e-12))
    forest = Forest(lifted, trees, max(LEAVES, n // LEAF_MEAN))
    return forest, longest, calibrated(forest, lifted, plain, k, recall)


def _nearest(
    rows: DataFrame,
    queries: DataFrame,
    kind: T.ArrayType,
    k: int,
    trees: int = 0,
    sample_rows: int = 0,
    recall: float = 1.0,
) -> DataFrame:
    """nearest for ready vectors (vec_id, v): of one length by a forest, or without trees of several, each of them one leaf."""
    spark = rows.sparkSession
    points = written(rows.groupBy("v").agg(F.min("vec_id").alias("rep")), "points")
    copies = rows.distinct().join(points, "v").select("rep", "vec_id")
    copies = copies.withColumn(
        "__n",
        F.row_number().over(Window.partitionBy("rep").orderBy("vec_id")),
    ).where(F.col("__n") <= k + 1).select("rep", "vec_id")
    asked = written(queries.distinct().join(points, "v").select("vec_id", "rep"), "asked")

    forest, longest, take = _fitted(points, k, trees, sample_rows, recall) if trees else (None, 0.0, 0)
    held = np.dtype(np.float32 if kind.elementType.typeName() == "float" else np.float64)  # exact

    def blocks(leaves_of):
        """leaf, n, ids, data: the vectors of a partition (id, v) by leaf, packed; at most HELD bytes wait in a task."""

        def flush(waiting):
            leaf, at, ids, data = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(leaf, kind="stable")
            leaf, at = leaf[order], at[order]
            begins = np.flatnonzero(np.diff(leaf, prepend=leaf[0] - 1))
            groups = np.split(at, begins[1:])
            sizes, packed = pa.array([len(g) for g in groups], pa.int32()), lambda x: pa.array(
                [x[g].tobytes() for g in groups],
                pa.binary(),
            )
            return pa.RecordBatch.from_arrays(
                [pa.array(leaf[begins]), sizes, packed(ids), packed(data)],
                names=["leaf", "n", "ids", "data"],
            )

        def work(batches):
            waiting: dict[int, list] = {}
            size = 0
            for batch in sliced(batches, 2048):
                lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(lengths).tolist():
                    part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                    own, rows_ = matrix(part.column(1)), waiting.setdefault(dim, [])
                    leaf, at = leaves_of(own)
                    seen = sum(len(x[2]) for x in rows_)
                    rows_.append((leaf, at + seen, part.column(0).to_numpy(zero_copy_only=False), own.astype(held)))
                    size += len(leaf) * dim * held.itemsize
                if size > HELD:
                    yield from map(flush, waiting.values())
                    waiting, size = {}, 0
            yield from map(flush, waiting.values())

        return work

    def alone(own):
        return np.full(len(own), -1 - own.shape[1]), np.arange(len(own))

    def members_of(own):
        if forest is None:
            return alone(own)
        leaves = forest.leaf_of(_lifted(own, longest * (1 + 1e-12)))
        return leaves.reshape(-1), np.repeat(np.arange(len(own)), leaves.shape[1])

    def probes_of(own):
        if forest is None:
            return alone(own)
        found = [forest.nearest_leaves(_asked(q), take) for q in own]
        return np.array([y for x in found for y in x], dtype=np.int64), np.repeat(np.arange(len(own)), [len(x) for x in found])

    def parts(df, size):
        """leaf, ids, data: lists of blocks, of about `size` rows together, dealt by hash."""
        sizes = df.groupBy("leaf").agg(F.ceil(F.sum("n") / size).cast("int").alias("__parts"))
        dealt = df.join(sizes, "leaf").withColumn("__part", F.pmod(F.xxhash64("ids"), F.col("__parts")))
        return dealt.groupBy("leaf", "__part").agg(F.collect_list("ids").alias("ids"), F.collect_list("data").alias("data"))

    block = "leaf long, n int, ids binary, data binary"
    members = parts(points.select("rep", "v").mapInArrow(blocks(members_of), block), LEAF_ROWS)
    wanted = asked.select("rep").distinct().join(points, "rep").select("rep", "v").repartition(
        spark.sparkContext.defaultParallelism * 2,
        "rep",
    )
    probes = parts(written(wanted.mapInArrow(blocks(probes_of), block), "probes"), PROBES)

    def unpacked(ids, data):
        own = np.frombuffer(b"".join(ids.as_py()), dtype=np.int64)
        return own, np.frombuffer(b"".join(data.as_py()), dtype=held).astype(np.float64).reshape(len(own), -1)

    def rerank(batches):
        def scores():
            for batch in batches:
                for i in range(batch.num_rows):
                    q, qv = unpacked(batch.column(0)[i], batch.column(1)[i])
                    r, rv = unpacked(batch.column(2)[i], batch.column(3)[i])
                    for a in range(0, len(q), PROBES):  # a part may hold more, where few blocks are large
                        yield from best_of(q[a : a + PROBES], qv[a : a + PROBES], r, rv, k + 1)

        return gathered(scores(), k + 1)

    met = probes.select(
        "leaf",
        F.col("ids").alias("q"),
        F.col("data").alias("qv"),
    ).hint("merge").join(members, "leaf").select("q", "qv", "ids", "data")
    scored = met.mapInArrow(rerank, "q long, found array<struct<minus:double,rep:long>>")
    best = scored.groupBy("q").agg(first_found(k + 1).alias("found"))  # a point is met in several trees
    pairs = asked.join(best, F.col("rep") == F.col("q")).select(F.col("vec_id").alias("query_id"), F.explode("found").alias("x"))
    pairs = pairs.select("query_id", F.col("x.rep").alias("rep"), (-F.col("x.minus")).alias("score"))
    near = pairs.join(copies, "rep").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(q: np.ndarray, qv: np.ndarray, r: np.ndarray, rv: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, minus the score, row) of at least the k best rows of each query, all ties of the kth among them.

    A matrix product finds those within rounding of the kth; their scores are the same sums wherever a pair meets.
    """
    s = qv @ rv.T
    margin = 1e-13 * qv.shape[1] * np.linalg.norm(qv, axis=1) * np.linalg.norm(rv, axis=1).max(initial=0)
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - margin if s.shape[1] > k else np.full(len(q), -np.inf)
    row, col = np.nonzero(s >= least[:, None])
    out = []
    for a in range(0, len(row), 20_000):
        i, j = row[a : a + 20_000], col[a : a + 20_000]
        out.append(merged([(q[i], -(rv[j] * qv[i]).sum(axis=1), r[j])], k))
    return out
