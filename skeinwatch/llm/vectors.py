"""Vectors as tables: what counts as a vector, and rows packed into bounded binary blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwatch.llm.common import bound


def whole(embedding: Column) -> Column:
    """True if a vector isn't null or empty and has neither null nor non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad, F.lit(False))


def nonzero(embedding: Column) -> Column:
    return F.exists(embedding, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """(dim, n, ids, data): consecutive rows (id long, v array<double>) of a partition, at most `rows` a block, by length.

    ids and data are little-endian longs and doubles, so a block costs its tasks rows x (dim + 1) x 8 bytes.
    """

    def work(batches):
        held: dict[int, list] = {}

        def flush(dim):
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([dim], pa.int32()),
                    pa.array([len(ids)], pa.int32()),
                    pa.array([ids.tobytes()], pa.binary()),
                    pa.array([data.tobytes()], pa.binary()),
                ],
                names=["dim", "n", "ids", "data"],
            )

        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                ids, vectors_ = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                lengths = vectors_.value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == dim)
                    own = matrix(vectors_.take(pa.array(at)))
                    if sum(len(x[0]) for x in held.get(dim, ())) + len(at) > rows:
                        yield flush(dim)
                    held.setdefault(dim, []).append((ids[at], own))
        for dim in list(held):
            yield flush(dim)

    return vectors.select("id", "v").mapInArrow(work, "dim int, n int, ids binary, data binary")


def unpacked(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(data, dtype=np.float64).reshape(-1, dim)


#: Scores that a task holds before it merges them.
MERGED = 500_000


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best different rows of each query: smallest minus first, then smallest row."""
    q, minus, r = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((r, minus, q))
    q, minus, r = q[order], minus[order], r[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1]) | (minus[1:] != minus[:-1])
    q, minus, r = q[new], minus[new], r[new]
    begins = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.zeros(0, np.int64)
    kept = np.arange(len(q)) - np.repeat(begins, np.diff(begins, append=len(q))) < k
    return q[kept], minus[kept], r[kept]


def listed(q: np.ndarray, minus: np.ndarray, r: np.ndarray, names: tuple[str, str] = ("q", "rep")) -> pa.RecordBatch:
    """Merged rows as one list a query: the query's column and found, of (minus, row); names: of query and row."""
    begins = np.flatnonzero(np.diff(q, prepend=q[0] - 1)) if len(q) else np.zeros(0, np.int64)
    found = pa.StructArray.from_arrays([pa.array(minus), pa.array(r)], names=["minus", names[1]])
    lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(q)).astype(np.int32)), found)
    return pa.RecordBatch.from_arrays([pa.array(q[begins]), lists], names=[names[0], "found"])


def gathered(parts, k: int, names: tuple[str, str] = ("q", "rep")):
    """Record batches of listed rows, from (query, minus, row) arrays: merged in the task, so that a query has few lists."""
    waiting, size = [], 0
    for part in parts:
        waiting.append(part)
        size += len(part[0])
        if size > MERGED:
            waiting = [merged(waiting, k)]
            size = len(waiting[0][0])
            if size > MERGED // 2:
                yield listed(*waiting[0], names)
                waiting, size = [], 0
    if waiting:
        yield listed(*merged(waiting, k), names)


def first_found(k: int) -> Column:
    """Of all lists `found` of a group, the k first different rows. One list a task and query is what a group has."""
    every = F.array_sort(F.flatten(F.collect_list("found")))
    different = bound(every, lambda e: F.filter(e, lambda x, i: (i == 0) | (x != F.get(e, i - 1))))
    return F.slice(different, 1, k)
