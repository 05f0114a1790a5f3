"""Trace analytics over spans and per-trace summaries.

Spans have trace_id, span_id, parent_span_id, service_name, span_name, start_time, end_time, status_code (2 is an error),
status_message, attributes map, events, entity_ids and queue_ids where extracted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skeinwatch.functions.ranked import numbered
from skeinwatch.functions.scalars import anchored, match_attr, match_attributes
from skeinwatch.functions.shared import written
from skeinwatch.functions.timeutil import after_cursor, opt_filter, time_filter, time_trunc
from skeinwatch.operators.metrics import error_rate, exact_percentiles, first_by, percentiles, union_lists

# The status of an error, and the form of ids in attributes.
ERROR = 2
UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
ENTITY_PREFIX, QUEUE_KEY = "monitor.entity", "monitor.queue.record"
MAX_SPANS = 100_000


def millis(start: Column, end: Column) -> Column:
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("long")


def trace_summaries(spans: DataFrame, extra: list[Column] = ()) -> DataFrame:
    """One row a trace: the root's metadata (of the first span where no root is known), times, counts and the last error's message.

    extra: more aggregates of a trace's spans.
    """
    root = F.col("parent_span_id").isNull()
    first = F.struct(F.when(root, 0).otherwise(1), "start_time", "span_id")
    bad = F.col("status_code") == ERROR
    return spans.groupBy("trace_id").agg(
        F.min_by("service_name", first).alias("service_name"),
        F.coalesce(F.min_by(F.when(root, F.col("span_name")), first), F.lit("")).alias("root_operation"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        millis(F.min("start_time"), F.max("end_time")).alias("duration_ms"),
        F.coalesce(F.max(F.when(bad, F.lit(ERROR))), F.min_by("status_code", first)).alias("status_code"),
        F.max_by(F.when(bad, F.col("status_message")), F.when(bad, F.struct("start_time", "span_id"))).alias("status_message"),
        F.count("*").alias("span_count"), F.count_if(bad).alias("error_count"),
        *extra,
    )


def merge_summaries(parts: DataFrame) -> DataFrame:
    """Partial summaries of a trace as one: earliest start, latest end, sums; metadata of the part with most spans."""
    early = -F.unix_micros("start_time")  # ties go to the part that starts first
    most = [F.col("span_count"), F.col("end_time"), early.alias("early")]
    worst = [F.col("status_code"), F.col("span_count"), early.alias("early")]
    aggs = [
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        millis(F.min("start_time"), F.max("end_time")).alias("duration_ms"),
        F.max("status_code").alias("status_code"), F.sum("span_count").alias("span_count"), F.sum("error_count").alias("error_count"),
        first_by(F.col("service_name"), most).alias("service_name"),
        first_by(F.col("root_operation"), most).alias("root_operation"),
        first_by(F.col("status_message"), worst).alias("status_message"),
    ]
    aggs += [union_lists(c).alias(c) for c in ("entity_ids", "queue_ids", "hits") if c in parts.columns]
    aggs += [F.max("root_service").alias("root_service")] if "root_service" in parts.columns else []
    return parts.groupBy("trace_id").agg(*aggs)


def merge_trace_parts(parts: DataFrame) -> DataFrame:
    """Conflict-merge of partial rows: a part with a root operation gives the metadata, a part with an error its message."""
    rooted = F.col("root_operation") != ""
    latest = F.struct(F.when(rooted, 1).otherwise(0), "end_time", "span_count")
    failed = F.struct(F.col("status_code"), F.col("end_time"))
    return parts.groupBy("trace_id").agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.sum("span_count").alias("span_count"),
        F.sum("error_count").alias("error_count"),
        F.max("status_code").alias("status_code"),
        F.max_by("service_name", latest).alias("service_name"),
        F.max_by("root_operation", latest).alias("root_operation"),
        F.max_by("status_message", failed).alias("status_message"),
    )


def _depth_first(ids: list, parents: list) -> Iterator[tuple[int, list]]:
    """Each span's index and path, depth first, of one trace's spans, which come by start time; spans that no root leads to
    come last, on a path of themselves. The path is one list that changes from span to span: copy what must stay."""
    children: dict = {}
    for i, parent in enumerate(parents):
        children.setdefault(parent, []).append(i)
    seen, path = set(), []
    stack = [(i, 0) for i in reversed(children.get(None, []))]
    while stack:
        i, depth = stack.pop()
        if i in seen:
            continue
        seen.add(i)
        del path[depth:]
        path.append(ids[i])
        yield i, path
        stack += [(j, depth + 1) for j in reversed(children.get(ids[i], ()))]
    for i in range(len(ids)):
        if i not in seen:
            yield i, [ids[i]]


#: Path elements that a task holds before it passes them on.
HELD_PATHS = 1_000_000


def span_tree(spans: DataFrame, max_spans: int = MAX_SPANS, paths: bool = True) -> DataFrame:
    """trace_id, span_id, depth, span_order (depth first, children by start time), path (unless not asked) and root_span_id.

    Spans that no root leads to come last at depth 0, with a path of themselves; without any root the first span is the
    root. Ties of start time go to the smaller span id. A trace of up to max_spans spans is one row's work, and many traces
    share a batch, whose paths are passed on by HELD_PATHS elements; larger traces are placed by joins (joined_tree), so that none is gathered in one task.
    """
    large = written(spans.groupBy("trace_id").agg(F.count("*").alias("n")).where(F.col("n") > max_spans).select("trace_id"), "large-traces")
    if large.isEmpty():
        return _gathered_tree(spans, paths=paths)
    small = _gathered_tree(spans.join(large, "trace_id", "left_anti"), paths=paths)
    placed = joined_tree(spans.join(large, "trace_id", "left_semi"))
    return small.unionByName(placed if paths else placed.drop("path"))


def _tree_rows(batches, kinds: list[pa.Field], page: tuple[int, int] | None, paths: bool):
    """Record batches of placed spans, with HELD_PATHS path elements and one path more at most in each."""
    out: list[list] = [[] for _ in kinds]
    held = 0

    def made():
        return pa.RecordBatch.from_arrays([pa.array(v, k.type) for v, k in zip(out, kinds, strict=True)], names=[k.name for k in kinds])

    for batch in batches:
        for trace, ids, parents in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            root = ids[next((i for i, p in enumerate(parents) if p is None), 0)]
            for order, (i, path) in enumerate(_depth_first(ids, parents)):
                if page and order < page[0]:
                    continue
                if page and order >= page[0] + page[1]:
                    break
                row = (trace, ids[i], len(path) - 1, order, root, *([path.copy()] if paths else []))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                held += len(path) if paths else 1
                if held >= HELD_PATHS:
                    yield made()
                    out, held = [[] for _ in kinds], 0
    if out[0]:
        yield made()


def _gathered_tree(spans: DataFrame, page: tuple[int, int] | None = None, paths: bool = True) -> DataFrame:
    sid = spans.schema["span_id"].dataType
    fields = [spans.schema["trace_id"], T.StructField("span_id", sid), T.StructField("depth", T.IntegerType()), T.StructField("span_order", T.IntegerType())]
    fields += [T.StructField("root_span_id", sid)] + ([T.StructField("path", T.ArrayType(sid))] if paths else [])
    rows = F.array_sort(F.collect_list(F.struct("start_time", "span_id", "parent_span_id")))
    held = spans.groupBy("trace_id").agg(rows.alias("rows")).select(
        "trace_id",
        F.transform("rows", lambda r: r["span_id"]).alias("ids"),
        F.transform("rows", lambda r: r["parent_span_id"]).alias("parents"),
    )

    def walk(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        kind, trace = first.schema.field("ids").type.value_type, first.schema.field("trace_id").type
        types = [trace, kind, pa.int32(), pa.int32(), kind] + ([pa.list_(kind)] if paths else [])
        kinds = [pa.field(f.name, t) for f, t in zip(fields, types, strict=True)]
        yield from _tree_rows(chain([first], batches), kinds, page, paths)

    made = held.mapInArrow(walk, T.StructType(fields))
    return made.select("trace_id", "span_id", "depth", "span_order", *(["path"] if paths else []), "root_span_id")


def span_page(spans: DataFrame, first: int = 0, size: int = 100, paths: bool = False) -> DataFrame:
    """span_tree's rows of each trace from place `first` on, `size` of them at most, without paths unless asked.

    No path is built but those of the page, so a trace as deep as it has spans costs memory for its spans only.
    """
    return _gathered_tree(spans, (first, size), paths)


def joined_tree(spans: DataFrame) -> DataFrame:
    """span_tree by joins alone, for traces of any size: each round doubles how far up every span's path reaches.

    Paths are what the result holds, so a deep trace costs as much as it returns. Rows that repeat a span id share the
    place of the first of them.
    """
    key = F.struct("start_time", "span_id")
    first = F.min(F.struct(F.col("parent_span_id").isNotNull(), "start_time", "parent_span_id"))
    nodes = spans.groupBy("trace_id", "span_id").agg(first.alias("f"), F.count("*").alias("copies"))
    nodes = nodes.select(
        "trace_id",
        "span_id",
        F.col("f")["start_time"].alias("start_time"),
        F.col("f")["parent_span_id"].alias("parent"),
        "copies",
    )
    nodes = written(nodes, "spans")
    above = nodes.select(F.col("trace_id").alias("__t"), F.col("span_id").alias("__s"))
    held = nodes.join(above, (F.col("trace_id") == F.col("__t")) & (F.col("parent") == F.col("__s")), "left")
    rooted = F.when(F.col("parent").isNull(), True).when(F.col("__s").isNull(), False)
    kept = ["trace_id", "span_id", "start_time", "copies"]
    state = written(held.select(*kept, F.col("__s").alias("up"), F.array(key).alias("keys"), rooted.alias("rooted")), "paths")
    left = None
    while (now := state.where("up is not null").count()) and now != left:  # what no round settles hangs on a cycle
        left = now
        above = state.select(
            F.col("trace_id").alias("__t"),
            F.col("span_id").alias("__s"),
            F.col("up").alias("__up"),
            F.col("keys").alias("__k"),
            F.col("rooted").alias("__r"),
        )
        met = state.where("up is not null").join(above, (F.col("trace_id") == F.col("__t")) & (F.col("up") == F.col("__s")))
        moved = met.select(*kept, F.col("__up").alias("up"), F.concat("__k", "keys").alias("keys"), F.col("__r").alias("rooted"))
        state = written(state.where("up is null").unionByName(moved), "paths")
    on_path = F.col("up").isNull() & F.coalesce("rooted", F.lit(False))
    placed = state.select(
        "trace_id",
        "copies",
        "span_id",
        (~on_path).alias("__off"),
        F.when(on_path, F.col("keys")).otherwise(F.array(key)).alias("keys"),
    )
    roots = placed.groupBy("trace_id").agg(
        F.min(F.struct("__off", F.element_at("keys", 1).alias("k")))["k"]["span_id"].alias("root_span_id")
    )
    rows = placed.withColumn("__c", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("__c", "copies")
    rows = numbered(rows, ["__off", "keys", "span_id"], "span_order", ["trace_id"]).join(roots, "trace_id")
    path = F.transform("keys", lambda k: k["span_id"])
    return rows.select(
        "trace_id",
        "span_id",
        (F.size("keys") - 1).alias("depth"),
        F.col("span_order").cast("int").alias("span_order"),
        path.alias("path"),
        "root_span_id",
    )


def span_depths(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, depth by joins alone: no grouped Python, for traces of any size and depth.

    Each round doubles the reach of every span's ancestor pointer, so a chain of n spans takes log2 n rounds. Spans that no
    root leads to have depth 0. Rows that repeat a span id are placed as the first of them (roots first, then by time).
    """
    first = F.min(F.struct(F.col("parent_span_id").isNotNull(), "start_time", "parent_span_id"))
    nodes = written(
        spans.groupBy("trace_id", "span_id").agg(first["parent_span_id"].alias("parent"), F.count("*").alias("copies")),
        "spans",
    )
    above = nodes.select(F.col("trace_id").alias("__t"), F.col("span_id").alias("__s"))
    held = nodes.join(above, (F.col("trace_id") == F.col("__t")) & (F.col("parent") == F.col("__s")), "left")
    rooted = F.when(F.col("parent").isNull(), True).when(F.col("__s").isNull(), False)
    state = written(
        held.select(
            "trace_id",
            "span_id",
            "copies",
            F.col("__s").alias("up"),
            F.when(F.col("__s").isNull(), 0).otherwise(1).alias("depth"),
            rooted.alias("rooted"),
        ),
        "depths",
    )
    left = None
    while (now := state.where("up is not null").count()) and now != left:  # what no round settles hangs on a cycle
        left = now
        above = state.select(
            F.col("trace_id").alias("__t"),
            F.col("span_id").alias("__s"),
            F.col("up").alias("__up"),
            F.col("depth").alias("__d"),
            F.col("rooted").alias("__r"),
        )
        met = state.where("up is not null").join(above, (F.col("trace_id") == F.col("__t")) & (F.col("up") == F.col("__s")))
        # Pointers on a cycle never end, so their distances are kept from overflowing.
        moved = met.select(
            "trace_id",
            "span_id",
            "copies",
            F.col("__up").alias("up"),
            F.least(F.col("depth").cast("long") + F.col("__d"), F.lit(2**31 - 1)).cast("int").alias("depth"),
            F.col("__r").alias("rooted"),
        )
        state = written(state.where("up is null").unionByName(moved), "depths")
    depth = F.when(F.col("up").isNull() & F.col("rooted"), F.col("depth")).otherwise(0)
    return state.select(
        "trace_id",
        "span_id",
        depth.alias("depth"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("__c"),
    ).drop("__c")


def get_spans(spans: DataFrame, trace_ids: list | None = None, service: str | None = None, start=None, end=None) -> DataFrame:
    held = opt_filter(time_filter(spans, start, end), service_name=service)
    return held if trace_ids is None else with_ids(held, trace_ids)


def spans_for_entity(spans: DataFrame, summaries: DataFrame, uid: str) -> DataFrame:
    """Spans of traces that carry the entity."""
    return spans.join(distinct_ids(summaries.where(has_entity(uid))), "trace_id", "left_semi")


def has_entity(uid: str, column: str = "entity_ids") -> Column:
    return F.array_contains(column, uid)


def distinct_ids(df: DataFrame) -> DataFrame:
    return df.select("trace_id").distinct()


def traces_with_attr(summaries: DataFrame, spans: DataFrame, filters: list[str]) -> DataFrame:
    """Summaries of traces with a span whose search text holds any filter."""
    return summaries.join(distinct_ids(spans.where(match_attr(F.col("search_blob"), filters))), "trace_id", "left_semi")


def traces_near_attr(summaries: DataFrame, spans: DataFrame, filters: list[tuple[str, str]], slack_minutes: int = 60) -> DataFrame:
    """Summaries with a matching span of the trace that starts within the slack around the trace's start."""
    hits = spans.where(match_attributes(filters)).select(F.col("trace_id").alias("__t"), F.col("start_time").alias("__s"))
    slack = F.make_dt_interval(mins=F.lit(slack_minutes))
    near = (F.col("trace_id") == F.col("__t")) & (
        F.col("__s") >= F.col("start_time") - slack
    ) & (F.col("__s") <= F.col("start_time") + slack)
    return summaries.join(hits, near, "left_semi")


def with_ids(df: DataFrame, ids: list[str] | DataFrame, column: str = "trace_id", most: int = 200) -> DataFrame:
    """Rows whose id is among ids: text (hexadecimal for a binary column, in either case) or values of the column's type.

    A list of up to `most` is a filter in the plan. A longer one, or a table with a column of the same name, is a semi join
    behind the bounds of its ids, which reach the scan and skip row groups; no list of literals is made.
    """
    binary = dict(df.dtypes)[column] == "binary"
    if not isinstance(ids, DataFrame):
        if len(ids) <= most:
            return df.where(F.col(column).isin([bytes.fromhex(i) for i in ids] if binary and ids and isinstance(ids[0], str) else list(ids)))
        ids = df.sparkSession.createDataFrame(pa.table({column: pa.array(list(ids))}))
    wanted = ids.select(F.unhex(column).alias(column)) if binary and dict(ids.dtypes)[column] == "string" else ids.select(column)
    wanted = wanted.select(F.col(column).cast(df.schema[column].dataType)).where(F.col(column).isNotNull())
    lo, hi = wanted.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return df.where(F.lit(False))
    return df.where(F.col(column).between(F.lit(lo), F.lit(hi))).join(wanted, column, "left_semi")


def trace_filters(
    summaries: DataFrame,
    service: str | None = None,
    has_errors: bool | None = None,
    status_code: int | None = None,
    entity: str | None = None,
    queue: str | None = None,
    trace_ids: list | DataFrame | None = None,
) -> DataFrame:
    held = opt_filter(summaries, service_name=service, status_code=status_code)
    if has_errors is not None:
        held = held.where((F.col("error_count") > 0) if has_errors else (F.col("error_count") == 0))
    if entity is not None:
        held = held.where(has_entity(entity))
    if queue is not None:
        held = held.where(has_entity(queue, "queue_ids"))
    return held if trace_ids is None else with_ids(held, trace_ids)


def list_traces(parts: DataFrame, limit: int = 50, cursor: list | None = None, direction: str = "next", **filters) -> DataFrame:
    """Merged summaries, filtered, newest first, from a (start_time, trace_id) cursor on; one row more than the page."""
    held = trace_filters(merge_summaries(parts), **filters)
    held = after_cursor(held, ["start_time", "trace_id"], cursor, direction) if cursor else held
    order = [F.desc, F.desc] if direction == "next" else [F.asc, F.asc]
    return held.orderBy(order[0]("start_time"), order[1]("trace_id")).limit(limit + 1)


def spans_of_latest(parts: DataFrame, spans: DataFrame, **filters) -> DataFrame:
    """The span tree of the newest trace that passes the filters."""
    newest = trace_filters(merge_summaries(parts), **filters).orderBy(F.desc("start_time"), F.desc("trace_id")).limit(1)
    return span_tree(spans.join(newest.select("trace_id"), "trace_id", "left_semi"))


def trace_metrics(
    spans: DataFrame,
    unit: str = "hour",
    service: str | None = None,
    filters: list[tuple[str, str]] = (),
    entity: str | None = None,
    summaries: DataFrame | None = None,
    exact: bool = False,
) -> DataFrame:
    """bucket, trace_count, avg_duration_ms, p50, p95, p99, error_rate of traces.

    The service is that of the trace's root span; attribute filters ask for any one span of the trace. Both fold into
    the one aggregation per trace.
    """
    if entity is not None:
        spans = spans_for_entity(spans, summaries, entity)
    keep = [F.lit(True).alias("__a"), F.lit(True).alias("__b")]
    if service is not None:
        keep[0] = F.max(F.when(F.col("parent_span_id").isNull(), F.col("service_name") == service)).alias("__a")
    if filters:
        keep[1] = F.bool_or(match_attributes(list(filters))).alias("__b")
    per = spans.groupBy("trace_id").agg(
        F.min("start_time").alias("start"),
        millis(F.min("start_time"), F.max("end_time")).alias("duration_ms"),
        F.max((F.col("status_code") == ERROR).cast("int")).alias("bad"),
        *(k for k in keep if service or filters),
    )
    per = per.where("__a and __b") if service or filters else per
    return bucket_stats(per.select(time_trunc("start", unit).alias("bucket"), "duration_ms", "bad"), exact)


def bucket_stats(per: DataFrame, exact: bool) -> DataFrame:
    """trace_count, avg_duration_ms, percentiles and error_rate by bucket of a row a trace: bucket, duration_ms, bad."""
    stats = [F.count("*").alias("trace_count"), F.avg("duration_ms").alias("avg_duration_ms"), error_rate(F.col("bad")).alias("error_rate")]
    if not exact:
        return per.groupBy("bucket").agg(*stats, *percentiles("duration_ms"))
    per = written(per.select("bucket", F.col("duration_ms").cast("double").alias("duration_ms"), "bad"), "traces")
    return per.groupBy("bucket").agg(*stats).join(exact_percentiles(per, ["bucket"], "duration_ms"), "bucket")


def root_service_filter(spans: DataFrame, service: str) -> DataFrame:
    """trace_id of traces whose root span has the service."""
    return spans.groupBy("trace_id").agg(
        F.max(F.when(F.col("parent_span_id").isNull(), F.col("service_name"))).alias("root_service")
    ).where(F.col("root_service") == service).select("trace_id")


def entities_by_tags(tags: DataFrame, filters: list[tuple[str, str]], match_all: bool = True) -> DataFrame:
    """entity_id of entities with all (or any) of the key-value tags."""
    hit = tags.where(reduce(Column.__or__, ((F.col("key") == k) & (F.col("value") == v) for k, v in filters)))
    found = hit.groupBy("entity_id").agg(F.count_distinct("key").alias("n"))
    return found.where(F.col("n") >= (len({k for k, _ in filters}) if match_all else 1)).select("entity_id")


def spans_by_tags(
    spans: DataFrame,
    links: DataFrame,
    tags: DataFrame,
    filters: list[tuple[str, str]],
    match_all: bool = True,
    service: str | None = None,
) -> DataFrame:
    """Spans of traces linked (trace_id, entity_id) to entities found by tags."""
    traces = links.join(entities_by_tags(tags, filters, match_all), "entity_id", "left_semi").select("trace_id").distinct()
    return opt_filter(spans.join(traces, "trace_id", "left_semi"), service_name=service)


def traces_by_entity(summaries: DataFrame, links: DataFrame, entity, limit: int = 50) -> DataFrame:
    held = summaries.join(links.where(F.col("entity_id") == entity).select("trace_id"), "trace_id", "left_semi")
    return held.orderBy(F.desc("start_time"), F.desc("trace_id")).limit(limit)


def traces_by_entities(summaries: DataFrame, links: DataFrame, entities: list, match_all: bool = False) -> DataFrame:
    """Summaries of traces linked to any (or all) of the entities, with the sorted list of those matched."""
    hit = links.where(F.col("entity_id").isin(list(entities))).groupBy("trace_id").agg(
        F.array_sort(F.collect_set("entity_id")).alias("matched")
    )
    hit = hit.where(F.size("matched") == len(set(entities))) if match_all else hit
    return summaries.join(hit, "trace_id")


def extract_ids(spans: DataFrame, entity_prefix: str = ENTITY_PREFIX, queue_key: str = QUEUE_KEY) -> DataFrame:
    """spans with entity_ids, queue_ids and owned_ids: ids in the attributes of the span and of its events.

    An attribute map that also names a queue record owns its entities. Values that aren't UUIDs are left out.
    """
    maps = F.concat(
        F.array("attributes"),
        F.coalesce(F.transform("events", lambda e: e["attributes"]), F.array().cast("array<map<string,string>>")),
    )
    maps = F.filter(maps, lambda m: m.isNotNull())
    valid = lambda v: v.rlike(anchored(UUID))
    entities = lambda m: F.filter(F.map_values(F.map_filter(m, lambda k, v: k.startswith(entity_prefix))), valid)
    queues = lambda m: F.filter(F.map_values(F.map_filter(m, lambda k, v: k == queue_key)), valid)
    found = F.transform(maps, lambda m: F.struct(entities(m).alias("e"), queues(m).alias("q")))  # each map is read once
    flat = lambda name, held: F.array_distinct(F.flatten(F.transform(held, lambda x: x[name])))
    held = F.col("__found")
    return spans.withColumn("__found", found).withColumns({
        "entity_ids": flat("e", held),
        "queue_ids": flat("q", held),
        "owned_ids": flat("e", F.filter(held, lambda x: F.size(x["q"]) > 0)),
    }).drop("__found")


def unowned_entities() -> Column:
    return F.array_except("entity_ids", "owned_ids")


def dispatch_events(traces: DataFrame) -> DataFrame:
    """trace_id, entity_id, start_time, event: ack for entities owned by a queue record, candidate for the rest."""
    rows = F.concat(
        F.transform("owned_ids", lambda e: F.struct(e.alias("entity_id"), F.lit("ack").alias("event"))),
        F.transform(unowned_entities(), lambda e: F.struct(e.alias("entity_id"), F.lit("candidate").alias("event"))),
    )
    return traces.select("trace_id", "start_time", F.inline(rows))


def pending_dispatch(log: DataFrame, since=None, limit: int | None = None) -> DataFrame:
    """trace_id, entity_id, start_time of pairs with a candidate and no ack, newest first."""
    held = log if since is None else log.where(F.col("start_time") >= F.lit(since))
    pairs = held.groupBy("trace_id", "entity_id").agg(
        F.min("start_time").alias("start_time"),
        F.bool_or(F.col("event") == "candidate").alias("c"),
        F.bool_or(F.col("event") == "ack").alias("a"),
    )
    found = pairs.where("c and not a").select("trace_id", "entity_id", "start_time")
    return found if limit is None else found.orderBy(F.desc("start_time"), F.desc("trace_id"), F.desc("entity_id")).limit(limit)


def trace_has_entity(links: DataFrame, trace_id, entity) -> bool:
    return not links.where((F.col("trace_id") == trace_id) & (F.col("entity_id") == entity)).limit(1).isEmpty()


def traces_have_entities(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """pairs (trace_id, entity_id) with linked: whether the trace belongs to the entity, for all pairs at once."""
    known = links.select("trace_id", "entity_id").distinct().withColumn("linked", F.lit(True))
    return pairs.join(known, ["trace_id", "entity_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def synth_eval_records(pending: DataFrame, profiles: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records to evaluate for pending traces whose entity has a trace profile, less those that exist; and the acks of all."""
    fit = pending.join(profiles.where("has_trace_tasks").select("entity_id"), "entity_id", "left_semi")
    fresh = fit.join(existing.select("trace_id", "entity_id"), ["trace_id", "entity_id"], "left_anti")
    records = fresh.select(
        F.concat_ws("-", "trace_id", "entity_id").alias("record_id"),
        "trace_id",
        "entity_id",
        F.col("start_time").alias("created_at"),
        F.lit("pending").alias("status"),
    )
    return records, fit.select("trace_id", "entity_id", "start_time", F.lit("ack").alias("event"))


def lookup(df: DataFrame, **equal) -> DataFrame:
    """Baggage or tag rows of a trace or entity."""
    return opt_filter(df, **equal)


def dedup_insert(rows: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Rows to append so that each key is in the target once."""
    return rows.dropDuplicates(key).join(target.select(*key), key, "left_anti")


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_anti")
