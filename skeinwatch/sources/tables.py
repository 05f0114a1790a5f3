"""Fact tables, trace tables, registered datasets, archival and maintenance over Parquet."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwatch.functions.shared import scratch, written

RESERVED = ("created_at", "partition_date", "batch_id")
MAX_DEPTH = 32
PREVIEW = 1000
_HOURLY = ("year", "month", "day", "hour")


def write_facts(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Append facts partitioned by year, month, day and hour."""
    parts = {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)}
    df.withColumns(parts).write.mode("append").partitionBy(*_HOURLY).option("compression", "zstd").parquet(path)


def read_facts(spark: SparkSession, path: str, start: datetime, end: datetime, ts: str = "created_at") -> DataFrame:
    """Facts with start <= ts < end; bounds on the day's partition columns let the scan skip folders."""
    day = F.make_date("year", "month", "day")
    last = (end - timedelta(microseconds=1)).date()
    years = F.col("year").between(start.year, last.year)
    held = spark.read.parquet(path).where(years & (day >= F.lit(start.date())) & (day <= F.lit(last)))
    return held.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end))).drop(*_HOURLY)


def write_trace_table(
    df: DataFrame,
    path: str,
    ts: str = "start_time",
    bloom: tuple[str, ...] = ("trace_id",),
    distinct: int = 20_000,
) -> None:
    """Append spans, summaries or dispatch rows by date of their start, with bloom filters on the columns looked up.

    distinct: about how many different values a file holds of them, which sizes the filters.
    """
    out = df.withColumn("partition_date", F.to_date(ts)).write.mode("append").partitionBy("partition_date").option("compression", "zstd")
    for column in bloom:
        if column in df.columns:
            out = out.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
                f"parquet.bloom.filter.expected.ndv#{column}",
                str(distinct),
            )
    out.parquet(path)


#: The record types of monitoring messages and their fields.
RECORDS = {
    "spc": "created_at timestamp, entity_id int, feature string, value double",
    "psi": "created_at timestamp, entity_id int, feature string, bin_id int, bin_count long",
    "custom": "created_at timestamp, entity_id int, metric string, value double",
    "route": "created_at timestamp, entity_id int, route_name string, latency double, status_code int",
}


def classified(df: DataFrame, column: str = "value") -> DataFrame:
    """kind, text and a struct a record type of {"type": ..., "record": {...}} messages, each parsed once.

    kind is the record type, whose struct is filled, or `bad` for what can't be read: no JSON, another type, a record of
    other fields' types, without a time or an entity. Malformed messages never fail the query.
    """
    text = F.col(column).cast("string")
    envelope = F.from_json(text, "type string, record string")
    held = df.select(text.alias("text"), envelope["type"].alias("__type"), envelope["record"].alias("__record"))
    corrupt = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    read = {k: F.from_json("__record", f"{ddl}, _corrupt_record string", corrupt) for k, ddl in RECORDS.items()}
    held = held.withColumns({k: F.when(F.col("__type") == k, parsed) for k, parsed in read.items()})
    good = [F.col(k)["_corrupt_record"].isNull() & F.col(k)["created_at"].isNotNull() & F.col(k)["entity_id"].isNotNull() for k in RECORDS]
    kind = F.when(reduce(Column.__or__, good), F.col("__type")).otherwise("bad")
    return held.select(kind.alias("kind"), "text", *(F.col(k).dropFields("_corrupt_record").alias(k) for k in RECORDS))


def parse_messages(df: DataFrame, column: str = "value", bad_records: bool = True) -> dict[str, DataFrame]:
    """Each record type's rows of classified messages; `bad` holds what can't be read, as text. Batch or streaming."""
    held = classified(df, column)
    out = {kind: held.where(F.col("kind") == kind).select(f"{kind}.*") for kind in RECORDS}
    if bad_records:
        out["bad"] = held.where(F.col("kind") == "bad").select("text")
    return out


# Registered datasets.


def struct_of(schema: dict) -> T.StructType:
    """A JSON Schema of an object as a StructType; nullability from `required`. Unsupported forms are errors."""
    return _struct(schema, schema.get("$defs", schema.get("definitions", {})), 0)


def _struct(schema: dict, defs: dict, depth: int) -> T.StructType:
    if depth > MAX_DEPTH:
        raise ValueError("schema is nested too deep")
    if "properties" not in schema:
        raise ValueError("free-form objects aren't supported")
    needed = set(schema.get("required", ()))
    fields = []
    for name, sub in schema["properties"].items():
        kind, optional = _type(sub, defs, depth + 1)
        fields.append(T.StructField(name, kind, optional or name not in needed, {"enum": json.dumps(sub["enum"])} if "enum" in sub else {}))
    return T.StructType(fields)


def _type(sub: dict, defs: dict, depth: int) -> tuple[T.DataType, bool]:
    if depth > MAX_DEPTH:
        raise ValueError("schema is nested too deep")
    if "$ref" in sub:
        return _type(defs[sub["$ref"].rpartition("/")[2]], defs, depth + 1)
    if options := sub.get("anyOf") or sub.get("oneOf"):
        kept = [o for o in options if o.get("type") != "null"]
        if len(kept) != 1:
            raise ValueError("unions of several types aren't supported")
        return _type(kept[0], defs, depth + 1)[0], len(kept) < len(options)
    if "enum" in sub:
        return T.StringType(), False
    simple = {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "null": T.StringType()}
    kind = sub.get("type")
    if kind == "string":
        return {"date-time": T.TimestampType(), "date": T.DateType()}.get(sub.get("format"), T.StringType()), False
    if kind in simple:
        return simple[kind], kind == "null"
    if kind == "array":
        item, optional = _type(sub["items"], defs, depth + 1)
        return T.ArrayType(item, optional), False
    if kind == "object":
        return _struct(sub, defs, depth + 1), False
    raise ValueError(f"unsupported schema: {sub}")


def fingerprint(schema: T.StructType) -> str:
    """A digest of names, types and nullability that doesn't depend on the order of fields."""

    def form(t: T.DataType):
        if isinstance(t, T.StructType):
            return sorted([f.name, form(f.dataType), f.nullable] for f in t.fields)
        if isinstance(t, T.ArrayType):
            return ["array", form(t.elementType), t.containsNull]
        return t.simpleString()

    return hashlib.sha256(json.dumps(form(schema)).encode()).hexdigest()


def parse_dataset(rows: DataFrame, schema: T.StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON rows typed by the schema, and the rows that break it (text): bad JSON, wrong types, missing required, enums."""
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields] + [T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(column, loose, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    held = rows.withColumn("__r", parsed)
    bad = F.col("__r._corrupt").isNotNull() | F.col("__r").isNull()
    for f in schema.fields:
        value = F.col("__r")[f.name]
        if not f.nullable:
            bad = bad | value.isNull()
        if "enum" in f.metadata:
            bad = bad | (value.isNotNull() & ~value.isin(*json.loads(f.metadata["enum"])))
    bad = F.coalesce(bad, F.lit(True))
    return held.where(~bad).select(
        *(F.col("__r")[f.name].alias(f.name) for f in schema.fields)
    ), held.where(bad).select(F.col(column).alias("text"))


def namespace(text: str) -> list[str]:
    parts = text.split(".")
    if len(parts) != 3 or not all(re.fullmatch(r"[A-Za-z_]\w*", p) for p in parts):
        raise ValueError("a namespace is catalog.schema.table")
    return parts


def append_dataset(
    rows: DataFrame,
    root: str,
    ns: str,
    json_schema: dict,
    column: str = "value",
    partition_by: tuple[str, ...] = (),
    expected: str | None = None,
) -> DataFrame:
    """Append JSON rows to a dataset; returns the rejected rows. expected: the fingerprint that the table was made with."""
    schema = struct_of(json_schema)
    if taken := set(RESERVED) & set(schema.names):
        raise ValueError(f"reserved names: {sorted(taken)}")
    if expected is not None and fingerprint(schema) != expected:
        raise ValueError("schema fingerprint differs from the table's")
    good, bad = parse_dataset(rows, schema, column)
    now = F.current_timestamp()
    out = good.withColumns({"created_at": now, "partition_date": F.to_date(now), "batch_id": F.lit(uuid.uuid4().hex)})
    out.write.mode("append").partitionBy("partition_date", *partition_by).option("compression", "zstd").parquet("/".join([root, *namespace(ns)]))
    return bad


def is_read_only(spark: SparkSession, sql: str) -> bool:
    """Whether a text is exactly one query by Spark's own parser: no command and no statement that writes, at any depth."""
    jvm = spark._jvm
    kinds = [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{n}") for n in ("Command", "ParsedStatement")]
    try:
        todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    except ParseException:
        return False
    while todo:
        plan = todo.pop()
        if any(k.isInstance(plan) for k in kinds) or "ExecuteImmediate" in plan.nodeName():
            return False
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return True


def query(spark: SparkSession, sql: str, max_rows: int = 10_000) -> tuple[DataFrame, bool]:
    """At most max_rows rows of one read-only SELECT over temp views, and whether there are more."""
    if not is_read_only(spark, sql):
        raise ValueError("exactly one SELECT is allowed")
    held = written(spark.sql(sql.strip().rstrip(";")).limit(max_rows + 1), "query")  # max_rows + 1 rows; the statement runs once
    return held.limit(max_rows), held.count() > max_rows


def preview(df: DataFrame, n: int = PREVIEW) -> DataFrame:
    return df.limit(min(n, PREVIEW))


# Archival and maintenance.


def entity_ranges(df: DataFrame, cutoff: datetime) -> DataFrame:
    """entity_id, first and last time, rows of what is older than the cutoff."""
    return df.where(F.col("created_at") < F.lit(cutoff)).groupBy("entity_id").agg(
        F.min("created_at").alias("begin"),
        F.max("created_at").alias("end"),
        F.count("*").alias("rows"),
    )


def archive(live: DataFrame, cutoff: datetime) -> tuple[DataFrame, DataFrame]:
    """(rows to archive, rows that remain)."""
    old = F.col("created_at") < F.lit(cutoff)
    return live.where(old), live.where(~F.coalesce(old, F.lit(False)))


def write_archive(live: DataFrame, path: str, cutoff: datetime) -> DataFrame:
    """Append the live rows from before the cutoff to the archive at path, but those archived before; live marked `archived`.

    live may hold `archived` from an earlier run. Its store keeps or deletes the marked rows as it likes.
    """
    done = F.coalesce(F.col("archived"), F.lit(False)) if "archived" in live.columns else F.lit(False)
    write_facts(archive(live.where(~done).drop("archived"), cutoff)[0], path)
    return live.withColumn("archived", done | F.coalesce(F.col("created_at") < F.lit(cutoff), F.lit(False)))


def union_live_archive(live: DataFrame, archived: DataFrame) -> DataFrame:
    """Rows of both by column name; a column that one lacks is null there. Nothing is aggregated before the union."""
    return live.unionByName(archived, allowMissingColumns=True)


def read_hybrid(live: DataFrame, archived: DataFrame, start: datetime, end: datetime, cutoff: datetime) -> DataFrame:
    """Rows of [start, end): live ones from the cutoff on, archived ones before it, united before any aggregation."""
    ts = F.col("created_at")
    inside = (ts >= F.lit(start)) & (ts < F.lit(end))
    if cutoff <= start:
        return live.where(inside)
    old = archived.where(inside & (ts < F.lit(cutoff)))
    return old if end <= cutoff else union_live_archive(live.where(inside & (ts >= F.lit(cutoff))), old)


def expire(df: DataFrame, cutoff: date, column: str = "partition_date") -> DataFrame:
    """What stays of a table when date partitions before the cutoff go."""
    return df.where(F.col(column) >= F.lit(cutoff))


def drop_partitions(spark: SparkSession, path: str, cutoff: date, column: str = "partition_date") -> list[str]:
    """Delete the date partitions before the cutoff of the Parquet table at path; gives the dates. Files stay unread."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(folder):
        found = re.fullmatch(rf"{column}=(\d{{4}}-\d{{2}}-\d{{2}})", status.getPath().getName())
        if found and date.fromisoformat(found[1]) < cutoff:
            fs.delete(status.getPath(), True)
            gone.append(found[1])
    return sorted(gone)


#: Rows that one task sorts for a rewrite, about: more rows make more ranges.
SORTED_ROWS = 2_000_000


def compacted(df: DataFrame, columns: tuple[str, ...] = ("start_time", "service_name"), files: int | None = None) -> DataFrame:
    """df clustered by range for a rewrite into larger files: `files` of them, or more where these held over SORTED_ROWS rows.

    With files given, df is run twice more, for its number of rows and for its ranges: it should be written.
    """
    if not files:
        return df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return df.repartitionByRange(max(files, -(-df.count() // SORTED_ROWS)), *columns).sortWithinPartitions(*columns)


def compact(
    df: DataFrame,
    path: str,
    columns: tuple[str, ...] = ("start_time", "service_name"),
    files: int | None = None,
    max_rows: int = 5_000_000,
) -> None:
    """Write df clustered to path, which must be new: a table can't be rewritten into the folder that it is read from.

    df is written first, so that counting its rows and finding its ranges don't run it again.
    """
    with scratch(df.sparkSession):
        out = compacted(written(df, "uncompacted") if files else df, columns, files).write.mode("errorifexists")
        out.option("maxRecordsPerFile", max_rows).option("compression", "zstd").parquet(path)


SCENARIO = "collection_id string, scenario_id string, query string, expected string, tags array<string>, tasks string"


def write_scenarios(df: DataFrame, path: str) -> None:
    """Append scenarios, a folder a collection."""
    df.write.mode("append").partitionBy("collection_id").option("compression", "zstd").parquet(path)


def read_scenarios(spark: SparkSession, path: str, collection_id: str | None = None, form: str = "parquet") -> DataFrame:
    """Scenarios of a store (parquet), or of a JSON list (json) or JSON lines (jsonl) file."""
    if form == "parquet":
        held = spark.read.parquet(path)
    elif form in ("json", "jsonl"):
        held = spark.read.schema(SCENARIO).option("multiLine", form == "json").json(path)
    else:
        raise ValueError("form must be parquet, json or jsonl")
    return held if collection_id is None else held.where(F.col("collection_id") == collection_id)
