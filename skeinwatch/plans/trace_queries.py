"""Trace, join, filter, paging and service map queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from skeinwatch.functions import scalars
from skeinwatch.functions.shared import new_folder, written
from skeinwatch.functions.timeutil import after_cursor, opt_filter, time_filter, time_trunc, top_k
from skeinwatch.operators import rollup, servicemap, traces
from skeinwatch.plans import views
from skeinwatch.plans.book import Book, rounded, stamp
from skeinwatch.plans.views import with_views
from skeinwatch.sources import tables
from skeinwatch.streaming import streams

BOOK = Book()
query = BOOK.query
_SPANS = with_views("ranked", "spans")
_SUMS = with_views("ranked", "spans", "parts", "summaries")
_FROM, _TO = datetime(1996, 1, 1), datetime(1997, 1, 1)
_HOT = "trace_id IN (SELECT trace_id FROM spans WHERE flag = 'R' AND qty = 30)"


@query("F1_F2_F3_filters", f"""{_SPANS} SELECT span_id FROM spans
  WHERE start_time >= TIMESTAMP '1996-01-01' AND start_time < TIMESTAMP '1997-01-01' AND service_name = 'svc3'""")
def filters(spark, sf):
    held = views.spans(spark, sf).withColumn("partition_date", F.to_date("start_time"))
    return opt_filter(time_filter(held, _FROM, _TO), service_name="svc3", span_name=None).select("span_id")


@query("F4_F5_search_blob", f"""{_SPANS} SELECT span_id, '|' || concat_ws('|', service_name, span_name, 'scope', status_message, 'flag=' || flag, 'line=' || line,
  'qty=' || qty) || '|' AS blob FROM spans WHERE qty = 3 OR qty = 4 OR service_name = 'svc1'""")
def search_blob(spark, sf):
    held = views.spans(spark, sf).withColumn("blob", scalars.search_blob())
    return held.where(scalars.match_attr(F.col("blob"), ["|qty:3|", "|qty=4|", "|svc1|"])).select("span_id", "blob")


@query("F6_match_attributes", f"{_SPANS} SELECT span_id FROM spans WHERE flag = 'A' AND line = 'F'")
def match_attributes(spark, sf):
    return views.spans(spark, sf).where(scalars.match_attributes([("flag", "A"), ("line", "F")])).select("span_id")


@query("F7_F8_F9_trace_filters", f"{_SUMS} SELECT trace_id FROM summaries WHERE entity = 'cust3' AND error_count > 0 AND status_code = 2")
def trace_filters(spark, sf):
    return traces.trace_filters(
        traces.merge_summaries(views.parts(spark, sf)),
        entity="cust3",
        has_errors=True,
        status_code=2,
    ).select("trace_id")


@query("F10_W9_after_cursor", f"""{_SUMS} SELECT trace_id, {stamp('start_time')} FROM summaries WHERE (start_time, trace_id) < (TIMESTAMP '1997-01-01', 500)
  ORDER BY summaries.start_time DESC, trace_id DESC LIMIT 51""")
def cursor(spark, sf):
    held = traces.merge_summaries(views.parts(spark, sf))
    page = after_cursor(held, ["start_time", "trace_id"], [_TO, 500]).orderBy(F.desc("start_time"), F.desc("trace_id")).limit(51)
    return rounded(page.select("trace_id", "start_time"))


@query("F12_json_path", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_path(spark, sf):
    held = views.table(spark, sf, "events")
    return held.select("event_id", F.try_variant_get(F.parse_json("props"), scalars.json_path("k"), "long").alias("k"))


_SUMMARY = "trace_id, {a}, {b}, duration_ms, status_code, span_count, error_count, service_name, root_operation".format(
    a=stamp("start_time"),
    b=stamp("end_time"),
)


@query("T2_trace_summaries", f"""{_SPANS} SELECT trace_id, {stamp("min(start_time)", "start_time")}, {stamp("max(end_time)", "end_time")},
  epoch_ms(max(end_time)) - epoch_ms(min(start_time)) AS duration_ms, CASE WHEN bool_or(status_code = 2) THEN 2 ELSE 1 END AS status_code,
  count(*) AS span_count, count(*) FILTER (status_code = 2) AS error_count, arg_min(service_name, rk) AS service_name, arg_min(span_name,
    rk) AS root_operation, arg_max(status_message, rk) FILTER (status_code = 2) AS status_message FROM spans GROUP BY trace_id""")
def trace_summaries(spark, sf):
    return rounded(traces.trace_summaries(views.spans(spark, sf)))


@query("T6_A8_A9_merge_summaries", f"{_SUMS} SELECT {_SUMMARY}, entity FROM summaries")
def merge_summaries(spark, sf):
    held = traces.merge_summaries(views.parts(spark, sf)).withColumn("entity", F.element_at("entity_ids", 1))
    return rounded(held.drop("entity_ids", "queue_ids", "status_message"))


@query("A17_merge_trace_parts", f"""{with_views("ranked", "spans", "parts")}
  SELECT trace_id, {stamp("min(start_time)", "start_time")}, {stamp("max(end_time)", "end_time")}, sum(span_count)::BIGINT AS span_count,
  sum(error_count)::BIGINT AS error_count, max(status_code) AS status_code,
  arg_max(service_name, root_operation <> '') AS service_name, max(root_operation) AS root_operation FROM parts GROUP BY trace_id""")
def merge_trace_parts(spark, sf):
    return rounded(traces.merge_trace_parts(views.parts(spark, sf)).drop("status_message"))


@query(
    "A18_dedup_insert",
    "SELECT count(DISTINCT user_id) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')",
)
def dedup_insert(spark, sf):
    e = views.table(spark, sf, "events").select("user_id", "event_type")
    return traces.dedup_insert(e, e.where("event_type = 'error'"), ["user_id"]).agg(F.count("*").alias("n"))


_WALK = """, tree AS (SELECT trace_id, span_id, 0 AS depth, [start_time, make_timestamp(span_id)] AS path, [span_id] AS ids FROM spans
  WHERE parent_span_id IS NULL
  UNION ALL SELECT s.trace_id, s.span_id, t.depth + 1, list_concat(t.path, [s.start_time, make_timestamp(s.span_id)]), list_append(t.ids,
    s.span_id) FROM spans s JOIN tree t ON s.trace_id = t.trace_id AND s.parent_span_id = t.span_id)"""


@query("T3_W1_span_tree", f"""{_SPANS.replace('WITH ', 'WITH RECURSIVE ', 1)}{_WALK} SELECT trace_id, span_id, depth, (row_number() OVER (PARTITION BY trace_id
  ORDER BY path) - 1)::INTEGER AS span_order, array_to_string(ids, '/') AS path, ids[1] AS root_span_id FROM tree""")
def span_tree(spark, sf):
    return traces.span_tree(views.spans(spark, sf)).withColumn("path", F.array_join("path", "/"))


@query("T3_span_depths", f"{_SPANS.replace('WITH ', 'WITH RECURSIVE ', 1)}{_WALK} SELECT trace_id, span_id, depth FROM tree")
def span_depths(spark, sf):
    return traces.span_depths(views.spans(spark, sf))


@query("T4_get_spans", f"{_SPANS} SELECT trace_id, span_id FROM spans WHERE trace_id IN (1, 7, 32, 100, 1000) OR FALSE")
def get_spans(spark, sf):
    return traces.get_spans(views.spans(spark, sf), [1, 7, 32, 100, 1000]).select("trace_id", "span_id")


_METRICS = """count(*) AS trace_count, round(avg(d), 6) AS avg_duration_ms, round(quantile_cont(d, 0.5::DOUBLE), 6) AS p50,
  round(quantile_cont(d, 0.95::DOUBLE), 6) AS p95, round(quantile_cont(d, 0.99::DOUBLE), 6) AS p99, round(avg(bad), 6) AS error_rate"""
_PER = """per AS (SELECT trace_id, min(start_time) AS s, (epoch_ms(max(end_time)) - epoch_ms(min(start_time)))::DOUBLE AS d,
  max((status_code = 2)::INTEGER) AS bad, arg_min(service_name, rk) AS root, bool_or(flag = 'R' AND line = 'F') AS hit FROM spans
  GROUP BY trace_id)"""


@query("T5_trace_metrics", f"""{_SPANS}, {_PER} SELECT {stamp('date_trunc(' + chr(39) + 'month' + chr(39) + ', s)', 'bucket')}, {_METRICS} FROM per
  GROUP BY date_trunc('month', s)""")
def trace_metrics(spark, sf):
    return rounded(traces.trace_metrics(views.spans(spark, sf), "month", exact=True))


@query("T5_A14_J11_trace_metrics_filtered", f"""{_SPANS}, {_PER} SELECT {stamp('date_trunc(' + chr(39) + 'year' + chr(39) + ', s)', 'bucket')}, {_METRICS} FROM per
  WHERE root = 'svc2' AND hit GROUP BY date_trunc('year', s)""")
def trace_metrics_filtered(spark, sf):
    return rounded(traces.trace_metrics(views.spans(spark, sf), "year", service="svc2", filters=[("flag", "R"), ("line", "F")], exact=True))


@query("T5_summary_metrics", f"""{_SPANS}, {_PER} SELECT {stamp('date_trunc(' + chr(39) + 'year' + chr(39) + ', s)', 'bucket')}, {_METRICS} FROM per
  WHERE root = 'svc2' AND hit GROUP BY date_trunc('year', s)""")
def summary_metrics(spark, sf):
    """The filtered trace metrics from stored summaries of two batches of spans that share traces."""
    path, spans = new_folder(spark, "summaries"), views.spans(spark, sf)
    for half in (spans.where("rk % 2 = 0"), spans.where("rk % 2 = 1")):
        rollup.summary_parts(half, {"red": [("flag", "R"), ("line", "F")]}).write.mode("append").parquet(path)
    return rounded(rollup.summary_metrics(spark.read.parquet(path), "year", "svc2", "red", exact=True))


@query("J4_spans_for_entity", f"{_SPANS} SELECT span_id FROM spans WHERE entity = 'cust4'")
def spans_for_entity(spark, sf):
    return traces.spans_for_entity(views.spans(spark, sf), views.parts(spark, sf), "cust4").select("span_id")


@query("J5_U4_traces_with_attr", f"{_SUMS} SELECT trace_id FROM summaries WHERE trace_id IN (SELECT trace_id FROM spans WHERE qty = 30)")
def traces_with_attr(spark, sf):
    spans = views.spans(spark, sf).withColumn("search_blob", scalars.search_blob())
    return traces.traces_with_attr(traces.merge_summaries(views.parts(spark, sf)), spans, ["qty:30|"]).select("trace_id")


@query(
    "J6_J7_T9_spans_by_tags",
    f"{_SPANS} SELECT span_id FROM spans WHERE right(entity, 1)::INTEGER % 2 = 1 AND right(entity, 1)::INTEGER % 3 = 0",
)
def spans_by_tags(spark, sf):
    return traces.spans_by_tags(
        views.spans(spark, sf),
        views.links(spark, sf),
        views.tags(spark, sf),
        [("tier", "1"), ("zone", "0")],
    ).select("span_id")


@query(
    "J7_entities_by_any_tag",
    f"{_SPANS} SELECT DISTINCT entity AS entity_id FROM spans WHERE right(entity, 1)::INTEGER % 2 = 1 OR right(entity, 1)::INTEGER % 3 = 0",
)
def entities_by_any_tag(spark, sf):
    return traces.entities_by_tags(views.tags(spark, sf), [("tier", "1"), ("zone", "0")], match_all=False)


@query(
    "J8_traces_by_entity",
    f"{_SUMS} SELECT trace_id FROM summaries WHERE entity = 'cust2' ORDER BY start_time DESC, trace_id DESC LIMIT 20",
)
def traces_by_entity(spark, sf):
    return traces.traces_by_entity(traces.merge_summaries(views.parts(spark, sf)), views.links(spark, sf), "cust2", 20).select("trace_id")


@query("J9_T8_traces_by_entities", f"{_SUMS} SELECT trace_id, entity AS matched FROM summaries WHERE entity IN ('cust2', 'cust5')")
def traces_by_entities(spark, sf):
    held = traces.traces_by_entities(traces.merge_summaries(views.parts(spark, sf)), views.links(spark, sf), ["cust2", "cust5"])
    return held.select("trace_id", F.array_join("matched", ",").alias("matched"))


@query("J10_traces_near_attr", f"{_SUMS} SELECT trace_id FROM summaries WHERE {_HOT}")
def traces_near_attr(spark, sf):
    return traces.traces_near_attr(
        traces.merge_summaries(views.parts(spark, sf)),
        views.spans(spark, sf),
        [("flag", "R"), ("qty", "30")],
    ).select("trace_id")


@query("J11_root_service", f"{_SPANS} SELECT trace_id FROM spans WHERE rk = 1 AND service_name = 'svc5'")
def root_service(spark, sf):
    return traces.root_service_filter(views.spans(spark, sf), "svc5")


@query("J13_T7_spans_of_latest", f"""{_SUMS} SELECT span_id FROM spans WHERE trace_id = (SELECT trace_id FROM summaries WHERE error_count > 0
  ORDER BY start_time DESC, trace_id DESC LIMIT 1)""")
def spans_of_latest(spark, sf):
    return traces.spans_of_latest(views.parts(spark, sf), views.spans(spark, sf), has_errors=True).select("span_id")


@query("W8_top_k", f"{_SPANS} SELECT span_id FROM spans ORDER BY duration_ms DESC, span_id LIMIT 25")
def topk(spark, sf):
    return top_k(views.spans(spark, sf), [F.desc("duration_ms"), F.asc("span_id")], 25).select("span_id")


def _uuid(n):
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))


def _tagged(spark, sf):
    """Spans whose attributes name their customer, and a queue record for one flag."""
    more = F.create_map(
        F.lit(traces.ENTITY_PREFIX + ".uid"),
        _uuid(F.substring("entity", 5, 9)),
        F.lit(traces.QUEUE_KEY),
        F.when(F.col("attributes")["flag"] == "A", _uuid(F.col("span_id"))),
    )
    return views.spans(spark, sf).withColumn("attributes", F.map_concat("attributes", F.map_filter(more, lambda k, v: v.isNotNull())))


@query("T10_U2_extract_ids", f"""{_SPANS} SELECT span_id, '00000000-0000-4000-8000-' || lpad(entity[5:], 12, '0') AS entities, CASE
  WHEN flag = 'A' THEN '00000000-0000-4000-8000-' || lpad(span_id::VARCHAR, 12, '0') ELSE '' END AS queues, CASE
  WHEN flag = 'A' THEN 0 ELSE 1 END AS unowned FROM spans""")
def extract_ids(spark, sf):
    held = traces.extract_ids(_tagged(spark, sf))
    return held.select(
        "span_id",
        F.array_join("entity_ids", ",").alias("entities"),
        F.array_join("queue_ids", ",").alias("queues"),
        F.size(traces.unowned_entities()).alias("unowned"),
    )


def _log(spark, sf):
    per = traces.extract_ids(_tagged(spark, sf)).groupBy("trace_id").agg(
        F.min("start_time").alias("start_time"),
        *(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("entity_ids", "owned_ids")),
    )
    return traces.dispatch_events(per)


_LOG = """log AS (SELECT trace_id, '00000000-0000-4000-8000-' || lpad(any_value(entity)[5:], 12, '0') AS entity_id, min(start_time) AS start_time,
  CASE WHEN bool_or(flag = 'A') THEN 'ack' ELSE 'candidate' END AS event FROM spans GROUP BY trace_id)"""


@query("T11_dispatch_events", f"{_SPANS}, {_LOG} SELECT trace_id, entity_id, {stamp('start_time')}, event FROM log")
def dispatch_events(spark, sf):
    return rounded(_log(spark, sf))


@query("T12_pending_dispatch", f"{_SPANS}, {_LOG} SELECT trace_id, entity_id, {stamp('start_time')} FROM log WHERE event = 'candidate'")
def pending_dispatch(spark, sf):
    return rounded(traces.pending_dispatch(_log(spark, sf)))


@query("T13_traces_have_entities", f"""{_SPANS}, known AS (SELECT DISTINCT trace_id, entity FROM spans)
  SELECT o_orderkey AS trace_id, 'cust' || (o_custkey % 7) AS entity_id, k.entity IS NOT NULL AS linked FROM orders LEFT
  JOIN known k ON k.trace_id = o_orderkey AND k.entity = 'cust' || (o_custkey % 7)""")
def traces_have_entities(spark, sf):
    pairs = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("trace_id"),
        F.concat(F.lit("cust"), F.col("o_custkey") % 7).alias("entity_id"),
    )
    return traces.traces_have_entities(pairs, views.links(spark, sf))


@query("F14_spans_by_tags_of_service", f"""{_SPANS} SELECT span_id FROM spans
  WHERE (right(entity, 1)::INTEGER % 2 = 1 OR right(entity, 1)::INTEGER % 3 = 0) AND service_name = 'svc4'""")
def spans_by_tags_of_service(spark, sf):
    held = traces.spans_by_tags(
        views.spans(spark, sf),
        views.links(spark, sf),
        views.tags(spark, sf),
        [("tier", "1"), ("zone", "0")],
        match_all=False,
        service="svc4",
    )
    return held.select("span_id")


@query("T6_list_traces", f"""{_SUMS} SELECT trace_id, {stamp('start_time')}, error_count FROM summaries
  WHERE service_name = 'svc2' AND error_count > 0 AND entity = 'cust3' AND (start_time, trace_id) > (TIMESTAMP '1994-01-01', 7)
ORDER BY summaries.start_time, trace_id LIMIT 31""")
def list_traces(spark, sf):
    page = traces.list_traces(
        views.parts(spark, sf),
        30,
        [datetime(1994, 1, 1), 7],
        "previous",
        service="svc2",
        has_errors=True,
        entity="cust3",
    )
    return rounded(page.select("trace_id", "start_time", "error_count"))


@query("R2_late_parts", f"""{_SPANS} SELECT trace_id, {stamp("min(start_time)", "start_time")}, {stamp("max(end_time)", "end_time")},
  count(*) AS span_count, count(*) FILTER (status_code = 2) AS error_count,
  count(DISTINCT start_time < TIMESTAMP '1996-01-01') AS parts
    FROM (SELECT trace_id, start_time + to_hours(24 * (rk % 3)::INTEGER) AS start_time,
    end_time + to_hours(24 * (rk % 3)::INTEGER) AS end_time, status_code FROM spans) GROUP BY trace_id""")
def late_parts(spark, sf):
    """Spans that come late make parts of their own, and merging gives the summary of all."""
    later = F.make_dt_interval(F.col("rk") % 3)
    held = views.spans(spark, sf).withColumn("start_time", F.col("start_time") + later).withColumn("end_time", F.col("end_time") + later)
    parts = streams.summary_parts(held, _FROM)
    counts = parts.groupBy("trace_id").agg(F.count("*").alias("parts"))
    merged = traces.merge_summaries(parts).select("trace_id", "start_time", "end_time", "span_count", "error_count")
    return rounded(merged.join(counts, "trace_id"))


@query("T13_T15_lookup", f"{_SPANS} SELECT count(*) AS n FROM (SELECT DISTINCT trace_id, entity FROM spans) WHERE entity = 'cust1'")
def lookup(spark, sf):
    return traces.lookup(views.links(spark, sf), entity_id="cust1").agg(F.count("*").alias("n"))


@query("T14_synth_records", f"""{_SPANS}, {_LOG} SELECT trace_id || '-' || entity_id AS record_id, trace_id, 'pending' AS status FROM log
  WHERE event = 'candidate' AND right(entity_id, 1)::INTEGER % 2 = 0 AND trace_id % 3 > 0""")
def synth_records(spark, sf):
    log = written(_log(spark, sf), "log")  # read three times
    profiles = log.select("entity_id").distinct().withColumn("has_trace_tasks", F.substring("entity_id", 36, 1).cast("int") % 2 == 0)
    existing = log.where(F.col("trace_id") % 3 == 0)
    return traces.synth_eval_records(traces.pending_dispatch(log), profiles, existing)[0].select("record_id", "trace_id", "status")


@query("U1_union", f"""SELECT l_returnflag, count(*) AS n, count(l_tax) FILTER (l_shipdate < TIMESTAMP '{views.CUT}') AS taxed FROM lineitem
  GROUP BY l_returnflag""")
def union(spark, sf):
    held = tables.union_live_archive(views.serve(spark, sf).drop("l_tax"), views.base(spark, sf))
    return held.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("l_tax").alias("taxed"))


@query(
    "U3_only_in",
    f"{with_views('base', 'serve')} SELECT DISTINCT l_orderkey FROM serve WHERE l_orderkey NOT IN (SELECT l_orderkey FROM base)",
)
def only_in(spark, sf):
    return traces.only_in(views.serve(spark, sf), views.base(spark, sf), "l_orderkey")


@query(
    "A2_time_trunc",
    "SELECT " + stamp("date_trunc('hour', ts)", "bucket") + ", count(*) AS n FROM events GROUP BY date_trunc('hour', ts)",
)
def trunc(spark, sf):
    return rounded(views.metric(spark, sf).groupBy(time_trunc("created_at", "hour").alias("bucket")).agg(F.count("*").alias("n")))


@query("W5_count_sequence", f"""{_SPANS}, n AS (SELECT trace_id, list(span_name ORDER BY rk) AS names FROM spans GROUP BY trace_id)
  SELECT trace_id, len(list_filter(range(1, len(names)), lambda i: names[i] = 'op1' AND names[i + 1] = 'op2'))::INTEGER AS n FROM n""")
def sequence(spark, sf):
    from skeinwatch.operators.evaluate import count_sequence

    names = F.transform(F.array_sort(F.collect_list(F.struct("rk", "span_name"))), lambda r: r["span_name"])
    return views.spans(spark, sf).groupBy("trace_id").agg(names.alias("names")).select(
        "trace_id",
        count_sequence(F.col("names"), ["op1", "op2"]).alias("n"),
    )


_GRAPH = f"""{with_views('edges')} SELECT source_service, destination_service, endpoint, count(*) AS calls, {stamp('min(created_at)', 'first_seen')},
  {stamp('max(created_at)', 'last_seen')}, round(avg(latency_ms), 6) AS avg_latency_ms, sum(error::INTEGER)::BIGINT AS errors,
  round(sum(error::INTEGER) * 100.0 / count(*), 2)::DOUBLE AS error_percent FROM edges"""


@query("M1_M2_service_graph", f"{_GRAPH} GROUP BY ALL")
def service_graph(spark, sf):
    held = views.edges(spark, sf).withColumn("endpoint", scalars.normalize_endpoint(F.col("path")))
    return rounded(servicemap.service_graph(held).withColumn("error_percent", F.col("error_percent").cast("double")))


@query(
    "M1_service_graph_of",
    f"{_GRAPH} WHERE (source_service = 'n3' OR destination_service = 'n3') AND created_at >= TIMESTAMP '1996-01-01' GROUP BY ALL",
)
def service_graph_of(spark, sf):
    held = views.edges(spark, sf).withColumn("endpoint", scalars.normalize_endpoint(F.col("path")))
    return rounded(servicemap.service_graph(held, "n3", _FROM).withColumn("error_percent", F.col("error_percent").cast("double")))


@query(
    "M3_traceparent",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN lpad(to_hex(event_id)::VARCHAR, 32, '0') END AS trace_id FROM events".replace(
        "to_hex(event_id)",
        "lower(to_hex(event_id))",
    ),
)
def traceparent(spark, sf):
    hexed = F.lower(F.hex("event_id"))
    header = F.when(
        F.col("event_id") % 2 == 0,
        F.concat(F.lit("00-"), F.lpad(hexed, 32, "0"), F.lit("-"), F.lpad(hexed, 16, "0"), F.lit("-01")),
    ).otherwise(F.concat(F.lit("zz-"), hexed))
    return views.table(spark, sf, "events").select("event_id", scalars.traceparent_trace_id(header).alias("trace_id"))


@query("M3_traceparent_forms", f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN lpad(lower(to_hex(event_id)), 32, '0')
  WHEN 1 THEN lpad(to_hex(event_id), 32, '0') WHEN 2 THEN lpad(lower(to_hex(event_id)), 32, '0') END AS trace_id FROM events""")
def traceparent_forms(spark, sf):
    """Headers as they are, in capitals, with blanks around, with more behind, with a line feed inside, and empty."""
    hexed = F.lower(F.hex("event_id"))
    plain = F.concat(F.lit("00-"), F.lpad(hexed, 32, "0"), F.lit("-"), F.lpad(hexed, 16, "0"), F.lit("-01"))
    forms = F.array(
        plain,
        F.upper(plain),
        F.concat(F.lit(" \t"), plain, F.lit("\n")),
        F.concat(plain, F.lit("junk")),
        F.concat(F.lit("x\n"), plain),
        F.lit(""),
    )
    header = F.element_at(forms, (F.col("event_id") % 6 + 1).cast("int"))
    return views.table(spark, sf, "events").select("event_id", scalars.traceparent_trace_id(header).alias("trace_id"))


@query("M4_infer_fields", "SELECT event_id, 'k=number,t=string' AS fields FROM events")
def infer_fields(spark, sf):
    body = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("t")))
    fields = F.array_sort(F.transform(F.map_entries(scalars.infer_fields(body)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return views.table(spark, sf, "events").select("event_id", F.array_join(fields, ",").alias("fields"))

