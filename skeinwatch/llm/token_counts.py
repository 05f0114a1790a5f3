"""Token counts by offset-mapped attribution.

A whole document is encoded once. Each token's span in code points is joined to the document's sections (their spans
sorted, the join a binary search on both borders), and a token that crosses a border is allocated by a named rule:

* `first`: to the section that holds the token's first code point;
* `majority`: to the section that holds most of its code points, the earlier one in a tie;
* `split`: to each section in proportion to the code points there (fractional counts).

A token of part of a character (byte-level vocabularies have such) spans the whole character. Sections are given in a
column of spans, or are the text's lines, each with its line end. Tokens that lie in no section count as `n_outside`.
Null and empty texts have no tokens and, by lines, no sections. Overlapping sections are an error.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwatch.llm.common import sliced

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "majority", "split")
SECTION = T.ArrayType(
    T.StructType(
        [
            T.StructField("section", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("n_tokens", T.DoubleType()),
        ]
    )
)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str = PATTERN):
    """The tokenizer in a rank file, and each token id's length in bytes."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    sizes[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def token_spans(text: str, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one code point of each token of a text."""
    tokens, sizes = encoder(path)
    ends = np.cumsum(sizes[np.array(tokens.encode_ordinary(text), dtype=np.int64)])
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    if text.isascii():
        return starts, ends
    point = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80)
    return point[starts] - 1, point[ends - 1]


def line_spans(text: str) -> np.ndarray:
    """Spans that tile the text: lines, each with its line feed."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    spans = np.stack([np.concatenate([[0], ends[:-1]]), ends], axis=1)
    return spans[spans[:, 1] > spans[:, 0]]


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section (sorted, disjoint spans), and how many tokens cross a border of sections."""
    count = np.zeros(len(sections))
    if not len(sections) or not len(starts):
        return count, 0
    lo, hi = sections[:, 0], sections[:, 1]
    a = np.searchsorted(hi, starts, side="right")  # the first section that ends after the token's start
    b = np.searchsorted(lo, ends, side="left") - 1  # the last that begins before its end
    whole = (a == b) & (lo[np.minimum(a, len(lo) - 1)] <= starts) & (ends <= hi[np.maximum(b, 0)])
    count += np.bincount(a[whole], minlength=len(sections))
    crossing = np.flatnonzero(~whole & (a <= b))
    for t in crossing:
        own = np.arange(a[t], b[t] + 1)
        shared = np.minimum(ends[t], hi[own]) - np.maximum(starts[t], lo[own])
        if rule == "split":
            count[own] += shared / (ends[t] - starts[t])
        elif rule == "majority":
            count[own[shared.argmax()]] += 1
        elif lo[a[t]] <= starts[t]:
            count[a[t]] += 1
    return count, len(crossing)


def token_counts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sections: Column | None = None,
    rule: str = "first",
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """key, n_tokens, n_crossing, n_outside and, for each section in order, its span and tokens.

    sections: array<struct<start:int,end:int>> of code points; without it, the text's lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    given = sections is not None
    schema = docs.select(F.col(key)).schema.add("n_tokens", "long").add("n_crossing", "long").add("n_outside", "double").add("sections", SECTION)
    inner = pa.list_(pa.struct([("section", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.float64())]))

    def count(batches):
        for batch in sliced(batches):
            totals, crossed, outside, sizes, rows = [], [], [], [0], []
            spans = batch.column(2).to_pylist() if given else None
            for i, text_ in enumerate(batch.column(1).to_pylist()):
                text_ = text_ or ""
                starts, ends = token_spans(text_, vocabulary) if text_ else (np.zeros(0, np.int64),) * 2
                own = np.array(
                    sorted((s["start"], s["end"]) for s in spans[i] or () if s and s["end"] > s["start"]),
                    dtype=np.int64,
                ).reshape(-1, 2) if given else line_spans(text_)
                if (own[1:, 0] < own[:-1, 1]).any():
                    raise ValueError("sections overlap")
                got, n = attribute(starts, ends, own, rule)
                totals.append(len(starts))
                crossed.append(n)
                outside.append(len(starts) - float(got.sum()))
                sizes.append(sizes[-1] + len(own))
                rows.append(np.column_stack([np.arange(len(own)), own, got]))
            flat = np.concatenate(rows) if rows else np.zeros((0, 4))
            parts = [pa.array(flat[:, j].astype(kind)) for j, kind in enumerate((np.int32, np.int32, np.int32, np.float64))]
            nested = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(inner.value_type)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(crossed, pa.int64()), pa.array(outside, pa.float64()), nested],
                names=schema.names,
            )

    columns = [F.col(key), F.col(text).alias("__text")] + ([sections.alias("__sections")] if given else [])
    return docs.select(*columns).mapInArrow(count, schema)
