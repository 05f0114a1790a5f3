"""Scalar expressions over spans, payloads and JSON; all native columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and patterns that results must agree on.
MAX_PATH, MAX_SEGMENTS, MAX_ENDPOINT = 512, 32, 256
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
INTEGER = r"^\d+$"
TRACEPARENT = r"(?i)^[0-9a-f]{2}-([0-9a-f]{32})-[0-9a-f]{16}-[0-9a-f]{2}$"


def anchored(pattern: str) -> str:
    """A pattern whose final `$` is the very end of the text (Java's lets a line feed follow), with Unicode digits."""
    return "(?dU)" + (pattern[:-1] + r"\z" if pattern.endswith("$") else pattern)


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))


def only_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(Column.__and__, (finite(F.col(c)) for c in columns)))


def sample_records(df: DataFrame, ratio: float, key: str) -> DataFrame:
    """A share of the records, the same ones on each run: by a hash of the key."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(round(ratio * 1_000_000)))


def search_blob() -> Column:
    """Pipe-bounded search text of a span: service, name, scope, status, attributes as key=value, event names."""
    attributes = F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    parts = F.concat(
        F.array(F.col("service_name"), F.col("span_name"), F.coalesce("scope_name", F.lit("")), F.coalesce("status_message", F.lit(""))),
        F.coalesce(attributes, F.array().cast("array<string>")),
        F.coalesce(F.transform("events", lambda e: e["name"]), F.array().cast("array<string>")),
    )
    return F.concat(F.lit("|"), F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "|"), F.lit("|"))


def normalized_filter(text: str) -> str:
    """`key:value` as `key=value`; URLs (`://`) stay as they are."""
    return text if "://" in text else text.replace(":", "=", 1)


def match_attr(blob: Column, filters: list[str]) -> Column:
    """True if the search text holds any of the filters."""
    return reduce(Column.__or__, (F.contains(blob, F.lit(normalized_filter(f))) for f in filters), F.lit(False))


def match_attributes(filters: list[tuple[str, str]], match_all: bool = True) -> Column:
    """All (or any) of the key-value pairs are attributes of the span."""
    tests = [F.coalesce(F.col("attributes")[k] == v, F.lit(False)) for k, v in filters]
    return reduce(Column.__and__ if match_all else Column.__or__, tests) if tests else F.lit(match_all)


def json_path(path: str) -> str:
    """`a.b[0].c` as a variant path; too long or malformed paths are an error."""
    if len(path) > MAX_PATH:
        raise ValueError(f"a path has at most {MAX_PATH} characters")
    segments = re.findall(r"[^.\[\]]+|\[\d+\]", path)
    if not segments or len(segments) > MAX_SEGMENTS:
        raise ValueError(f"a path has 1 to {MAX_SEGMENTS} segments: {path!r}")
    if re.sub(r"[^.\[\]]+|\[\d+\]|\.", "", path):
        raise ValueError(f"malformed path: {path!r}")
    quote = lambda s: "['" + s.replace("'", "\\'") + "']"
    return "$" + "".join(s if s.startswith("[") else (f".{s}" if re.fullmatch(r"[A-Za-z_]\w*", s) else quote(s)) for s in segments)


def normalize_endpoint(path: Column) -> Column:
    """UUID or all-digit path segments become {id}; at most 256 characters."""
    parts = F.transform(
        F.split(path, "/"),
        lambda s: F.when(s.rlike(anchored(UUID)) | s.rlike(anchored(INTEGER)), F.lit("{id}")).otherwise(s),
    )
    return F.substring(F.array_join(parts, "/"), 1, MAX_ENDPOINT)


def traceparent_trace_id(header: Column) -> Column:
    """The trace id of a W3C traceparent header, in either case, blanks around it allowed; null for anything else."""
    bare = F.regexp_replace(header, r"(?U)^\s+|\s+\z", "")
    found = F.regexp_extract(bare, anchored(TRACEPARENT), 1)
    return F.when(found != "", found)


def infer_fields(body: Column) -> Column:
    """map<field, type> of a JSON object; null for anything else."""
    parsed = F.try_parse_json(body)
    fields = F.from_json(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), body), "map<string,variant>")
    kind = lambda v: F.schema_of_variant(v)

    def named(_, v):
        k = F.coalesce(kind(v), F.lit("VOID"))
        return (
            F.when(k == "BOOLEAN", "boolean")
            .when(k == "STRING", "string")
            .when(k.startswith("ARRAY"), "array")
            .when(k.startswith("OBJECT"), "object")
            .when(k == "VOID", "null")
            .otherwise("number")
        )

    return F.transform_values(fields, named)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null if lengths differ or one is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms != 0), dot(a, b) / norms)
