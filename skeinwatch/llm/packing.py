"""Packing into optimal length buckets.

The global histogram of sequence lengths goes through dynamic programming that chooses the bucket bounds with the least
padding. Each sequence is padded to its bucket's bound, and batches of at most token_budget padded tokens form inside
each bucket.

Lengths are a vocabulary's tokens (a rank file's path) plus one end token, and each piece then carries the span of text
that its tokens cover; without a vocabulary they are words plus one, or a given length column. Null and empty texts are
sequences of one token. Documents over max_len are cut into pieces of max_len tokens, none is dropped. The histogram has at most max_len
rows, whatever the corpus. Places within a bucket are numbered part by part: parts are hash slices of about part_rows
rows, and each is offset by the counts of those before it, so that no bucket is sorted in one task. Repeated rows are
packed each; rows of equal hash and id are ordered by piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwatch.llm.common import sliced, word_count, written
from skeinwatch.llm.token_counts import token_spans

MAX_LEN = 2048
BUCKETS = 8
TOKEN_BUDGET = 65_536
PART_ROWS = 20_000


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The bucket bounds (the largest length is one) that minimise the sum of counts x (bound - length).

    best[j] is the least cost of the first j lengths; each further bucket ends at length j and begins after some i < j.
    The choice of i never falls as j grows, so each round is divided and conquered. Ties take the smaller i.
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.float64)[order]
    n = len(x)
    if not n:
        return []
    total, mass = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    cost = lambda i, j: x[j - 1] * (total[j] - total[i]) - (mass[j] - mass[i])  # noqa: E731  of one bucket of lengths i..j-1
    best = np.concatenate([[0.0], cost(0, np.arange(1, n + 1))])
    choices = []
    for _ in range(min(buckets, n) - 1):
        now, choice = best.copy(), np.zeros(n + 1, dtype=np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            all_ = best[i] + cost(i, j)
            at = int(all_.argmin())
            now[j], choice[j] = all_[at], i[at]
            todo += [(lo, j - 1, a, int(i[at])), (j + 1, hi, int(i[at]), b)]
        choices.append(choice)
        best = now
    bounds, j = [], n
    for choice in reversed(choices):
        bounds.append(int(x[j - 1]))
        j = int(choice[j])
        if j == 0:
            break
    if j:
        bounds.append(int(x[j - 1]))
    return sorted(set(bounds))


def pieces(docs: DataFrame, max_len: int, length: Column | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens: each document cut into runs of max_len tokens."""
    n = F.greatest(
        F.coalesce(length, F.lit(0)).cast("long"),
        F.lit(1).cast("long"),
    ) if length is not None else word_count(F.col("text")) + 1
    sized = docs.select("doc_id", n.alias("__n"))
    cut = sized.select("doc_id", "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / max_len))).alias("piece"))
    start = F.col("piece") * max_len
    return cut.select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        start.alias("start"),
        F.least(F.lit(max_len).cast("long"), F.col("__n") - start).cast("int").alias("n_tokens"),
    )


def encoded_pieces(docs: DataFrame, max_len: int, vocabulary: str) -> DataFrame:
    """doc_id, piece, start, n_tokens, text_start, text_end: runs of max_len tokens of the encoded whole text and one end
    token, with the code points that they cover. A character whose bytes fall into two pieces is in the spans of both."""

    def cut(batches):
        for batch in sliced(batches):
            at, columns = [], [[] for _ in range(5)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                starts, ends = token_spans(text, vocabulary) if text else (np.zeros(0, np.int64),) * 2
                n = len(starts)
                first = np.arange(0, n + 1, max_len)
                stop = np.minimum(first + max_len, n + 1)
                a = np.append(starts, ends[-1:] if n else [0])[first]
                z = np.append(ends, ends[-1:] if n else [0])[np.maximum(np.minimum(stop, n) - 1, 0)]
                at.append(np.full(len(first), i))
                for column, values in zip(columns, (np.arange(len(first)), first, stop - first, a, np.maximum(a, z)), strict=True):
                    column.append(values)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
            kinds = (np.int32, np.int64, np.int32, np.int32, np.int32)
            ids = batch.column(0).take(pa.array(np.concatenate(at) if at else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v.astype(k)) for v, k in zip(flat, kinds, strict=True))], names=names)

    schema = docs.select("doc_id").schema
    for name, kind in (
        ("piece", "integer"),
        ("start", "long"),
        ("n_tokens", "integer"),
        ("text_start", "integer"),
        ("text_end", "integer"),
    ):
        schema = schema.add(name, kind)
    names = schema.names
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack(
    docs: DataFrame,
    max_len: int = MAX_LEN,
    buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
    length: Column | None = None,
    part_rows: int = PART_ROWS,
    vocabulary: str | None = None,
) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket_len, batch, slot: every piece's bucket, batch within it and place in that.

    With a vocabulary also text_start and text_end, what a reader of the batch cuts from the document's text.
    """
    if token_budget < max_len:
        raise ValueError("token_budget holds no sequence of max_len")
    cut = encoded_pieces(docs, max_len, vocabulary) if vocabulary else pieces(docs, max_len, length)
    own = cut.columns
    cut = written(cut, "pieces")
    histogram = cut.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").collect()
    sizes, counts = np.array([r["n_tokens"] for r in histogram], dtype=np.int64), np.array([r["n"] for r in histogram], dtype=np.int64)
    bounds = optimal_bounds(sizes, counts, buckets) or [max_len]
    bucket = F.lit(bounds[-1])
    parts = F.lit(1)
    for i, bound in reversed(list(enumerate(bounds))):
        held = int(counts[(sizes <= bound) & (sizes > (bounds[i - 1] if i else 0))].sum())
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound)).otherwise(bucket)
        parts = F.when(F.col("n_tokens") <= bound, F.lit(max(1, -(-held // part_rows)))).otherwise(parts)
    draw = F.xxhash64("doc_id", "piece")
    dealt = cut.select("*", bucket.cast("int").alias("bucket_len"), draw.alias("__draw"), F.pmod(draw, parts).cast("int").alias("__part"))
    sums = dealt.groupBy("bucket_len", "__part").agg(F.count("*").alias("__rows"))
    before = Window.partitionBy("bucket_len").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sums.select("bucket_len", "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")), "offsets")
    order = Window.partitionBy("bucket_len", "__part").orderBy("__draw", "doc_id", "piece")
    seq = F.col("__before") + F.row_number().over(order) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len")))
    placed = dealt.join(offsets, ["bucket_len", "__part"]).withColumn("__seq", seq)
    batch, slot = F.floor(F.col("__seq") / room).cast("long"), F.pmod("__seq", room).cast("int")
    return placed.select(*own, "bucket_len", batch.alias("batch"), slot.alias("slot"))
