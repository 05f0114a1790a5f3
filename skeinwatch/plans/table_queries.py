"""Source, dataset and streaming queries over the provided tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from skeinwatch.functions.shared import new_folder
from skeinwatch.plans import views
from skeinwatch.plans.book import Book, rounded, stamp
from skeinwatch.plans.views import with_views
from skeinwatch.sources import tables
from skeinwatch.streaming import outbox, samples, streams

BOOK = Book()
query = BOOK.query
_CUT = datetime(2024, 1, 10)


@query("S1_S2_facts", f"""{with_views('metric')} SELECT metric, count(*) AS n, round(sum(value), 4) AS total FROM metric
  WHERE created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-10' GROUP BY metric""")
def facts(spark, sf):
    path = new_folder(spark)
    tables.write_facts(views.metric(spark, sf).repartition(F.to_date("created_at")), path)
    held = tables.read_facts(spark, path, datetime(2024, 1, 3), _CUT)
    return rounded(held.groupBy("metric").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("S3_trace_table", f"""{with_views('ranked', 'spans')} SELECT service_name, count(*) AS n FROM spans WHERE start_time::DATE = DATE '1996-03-03'
  GROUP BY service_name""")
def trace_table(spark, sf):
    path = new_folder(spark)
    tables.write_trace_table(views.spans(spark, sf).drop("events").repartition(F.to_date("start_time")), path, distinct=500)
    return spark.read.parquet(path).where(
        F.col("partition_date") == F.lit(date(1996, 3, 3))
    ).groupBy("service_name").agg(F.count("*").alias("n"))


def _messages(spark, sf):
    m = views.metric(spark, sf)
    record = F.to_json(
        F.struct(
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"),
            F.col("user_id").cast("int").alias("entity_id"),
            "metric",
            "value",
        )
    )
    good = F.concat(F.lit('{"type":"custom","record":'), record, F.lit("}"))
    return m.select(
        F.when(F.col("k") % 7 == 0, F.lit("{broken")).when(
            F.col("k") % 7 == 1,
            F.lit('{"type":"other","record":{}}'),
        ).otherwise(good).alias("value")
    )


@query("S4_S5_parse_messages", f"""{with_views('metric')} SELECT metric AS kind, count(*) AS n FROM metric WHERE k % 7 > 1 GROUP BY metric UNION ALL SELECT 'bad', count(*)
  FROM metric WHERE k % 7 <= 1""")
def parse_messages(spark, sf):
    out = tables.parse_messages(_messages(spark, sf))
    good = out["custom"].groupBy(F.col("metric").alias("kind")).agg(F.count("*").alias("n"))
    return good.unionByName(out["bad"].agg(F.count("*").alias("n")).select(F.lit("bad").alias("kind"), "n"))


_SCHEMA = {
    "properties": {
        "item_id": {"type": "integer"},
        "text": {"type": "string"},
        "note": {"anyOf": [{"type": "string"}, {"type": "null"}]},
        "kind": {"enum": ["even", "odd"]},
    },
    "required": ["item_id", "text", "kind"],
}


@query(
    "S6_append_dataset",
    "SELECT item_id, length(text) AS n, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM benchmark WHERE item_id % 5 > 0",
)
def append_dataset(spark, sf):
    kind = F.when(F.col("item_id") % 5 == 0, "wrong").when(F.col("item_id") % 2 == 0, "even").otherwise("odd")
    rows = views.table(spark, sf, "benchmark").select(F.to_json(F.struct("item_id", "text", kind.alias("kind"))).alias("value"))
    root = new_folder(spark)
    tables.append_dataset(rows, root, "main.eval.items", _SCHEMA, expected=tables.fingerprint(tables.struct_of(_SCHEMA)))
    return spark.read.parquet(f"{root}/main/eval/items").select("item_id", F.length("text").cast("long").alias("n"), "kind")


@query("S7_J15_sql", "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def sql(spark, sf):
    for name in ("lineitem", "orders"):
        views.table(spark, sf, name).createOrReplaceTempView(f"ds_{name}")
    return tables.query(
        spark,
        "SELECT o_orderpriority, count(*) AS n FROM ds_lineitem JOIN ds_orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
        100,
    )[0]


@query("S8_archive", f"""{with_views('metric')} SELECT user_id AS entity_id, {stamp('min(created_at)', '"begin"')},
  {stamp('max(created_at)', '"end"')}, count(*) AS "rows" FROM metric WHERE created_at < TIMESTAMP '2024-01-10' GROUP BY user_id""")
def archive(spark, sf):
    old, _ = tables.archive(views.metric(spark, sf).withColumnRenamed("user_id", "entity_id"), _CUT)
    return rounded(tables.entity_ranges(old, _CUT))


@query("S8_write_archive", f"""{with_views('metric')} SELECT metric, count(*) FILTER (created_at < TIMESTAMP '2024-01-10') AS archived,
  count(*) FILTER (created_at < TIMESTAMP '2024-01-10') AS marked, count(*) FILTER (created_at >= TIMESTAMP '2024-01-10') AS live
  FROM metric GROUP BY metric""")
def write_archive(spark, sf):
    """Archived in two runs: the second leaves what the first has written."""
    path = new_folder(spark)
    live = views.metric(spark, sf).repartition(F.to_date("created_at"))
    marked = tables.write_archive(live, path, datetime(2024, 1, 6))
    marked = tables.write_archive(marked, path, _CUT)
    kept = spark.read.parquet(path).groupBy("metric").agg(F.count("*").alias("archived"))
    rest = marked.groupBy("metric").agg(F.count_if("archived").alias("marked"), F.count_if(~F.col("archived")).alias("live"))
    return rest.join(kept, "metric", "left").withColumn("archived", F.coalesce("archived", F.lit(0)))


@query(
    "S10_drop_partitions",
    "SELECT strftime(ts::DATE, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts::DATE >= DATE '2024-01-10' GROUP BY ts::DATE",
)
def drop_partitions(spark, sf):
    path = new_folder(spark)
    tables.write_trace_table(views.metric(spark, sf).repartition(F.to_date("created_at")), path, "created_at")
    tables.drop_partitions(spark, path, date(2024, 1, 10))
    return spark.read.parquet(path).groupBy(F.date_format("partition_date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("S9_U1_read_hybrid", f"""{with_views('metric')} SELECT metric, count(*) AS n FROM metric
  WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20' GROUP BY metric""")
def read_hybrid(spark, sf):
    old, live = tables.archive(views.metric(spark, sf), _CUT)
    return tables.read_hybrid(live, old, datetime(2024, 1, 5), datetime(2024, 1, 20), _CUT).groupBy("metric").agg(F.count("*").alias("n"))


@query("S10_expire", "SELECT count(*) AS n FROM events WHERE ts::DATE >= DATE '2024-01-10'")
def expire(spark, sf):
    return tables.expire(
        views.metric(spark, sf).withColumn("partition_date", F.to_date("created_at")),
        date(2024, 1, 10),
    ).agg(F.count("*").alias("n"))


@query("S11_compact", f"{with_views('ranked', 'spans')} SELECT service_name, count(*) AS n FROM spans GROUP BY service_name")
def compact(spark, sf):
    path = new_folder(spark)
    tables.compact(views.spans(spark, sf).drop("events"), path, files=4)
    return spark.read.parquet(path).groupBy("service_name").agg(F.count("*").alias("n"))


@query("E39_scenarios", "SELECT item_id::VARCHAR AS scenario_id, text AS query FROM benchmark WHERE item_id % 4 = 1")
def scenarios(spark, sf):
    path = new_folder(spark)
    held = views.table(spark, sf, "benchmark").select(
        F.concat(F.lit("c"), F.col("item_id") % 4).alias("collection_id"),
        F.col("item_id").cast("string").alias("scenario_id"),
        F.col("text").alias("query"),
    )
    tables.write_scenarios(held, path)
    return tables.read_scenarios(spark, path, "c1").select("scenario_id", "query")


# Streams: a table read as a stream to its end must give what the batch gives.


def _streamed(spark, sf, table, shape, mode="append", kind="parquet"):
    """The rows that a streaming query over a table writes by the time it has read it all."""
    path, source = new_folder(spark), f"{sf}/{table}.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(
        source if _is_folder(spark, source) else f"{sf}/{table}.parque*"
    )
    out = shape(stream)
    run = out.writeStream.format(kind).outputMode(mode).option("checkpointLocation", f"{path}/check").option("path", f"{path}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def _is_folder(spark, path: str) -> bool:
    return not any(f.rstrip("/").endswith(path.rsplit("/", 1)[-1]) for f in spark.read.parquet(path).inputFiles())


def _events(stream):
    return stream.select(
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("metric"),
        "value",
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


@query("T1_R1_R2_trace_sessions", f"""WITH e AS (SELECT user_id AS trace_id, event_id, ts, event_type, CASE
  WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id
  ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS g FROM e),
x AS (SELECT trace_id, min(ts) AS start_time, max(ts) AS last, count(*) AS span_count, count(*) FILTER (event_type = 'error') AS error_count
  FROM s GROUP BY trace_id, g)
SELECT trace_id, {stamp("start_time")}, {stamp("last + INTERVAL 1 SECOND", "end_time")}, span_count, error_count FROM x
  WHERE last + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""")
def trace_sessions(spark, sf):
    def shape(stream):
        e = _events(stream)
        spans = e.select(
            F.col("user_id").alias("trace_id"),
            F.col("event_id").alias("span_id"),
            F.when(F.col("k") % 2 > 0, F.col("event_id") - 1).alias("parent_span_id"),
            F.col("metric").alias("service_name"),
            F.col("metric").alias("span_name"),
            F.col("created_at").alias("start_time"),
            (F.col("created_at") + F.make_dt_interval(secs=F.lit(1.0))).alias("end_time"),
            F.when(F.col("metric") == "error", 2).otherwise(1).alias("status_code"),
            F.when(F.col("metric") == "error", "bad").alias("status_message"),
        )
        return streams.trace_sessions(spans, "1 hour", "2 hours")

    return rounded(_streamed(spark, sf, "events", shape).select("trace_id", "start_time", "end_time", "span_count", "error_count"))


@query("R3_spc_samples_stream", """WITH r AS (SELECT event_type AS feature, value, row_number() OVER (PARTITION BY event_type
  ORDER BY ts, value) - 1 AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT feature, n // 25 AS seq, round(avg(value), 6) AS value FROM r WHERE n // 25 < c // 25 GROUP BY feature, n // 25""")
def spc_samples_stream(spark, sf):
    path, source = new_folder(spark), f"{sf}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source if _is_folder(spark, source) else f"{sf}/events.parque*")
    samples.sample_stream(_events(stream).withColumnRenamed("metric", "feature"), 25, path, f"{path}/check").awaitTermination()
    return rounded(samples.read_samples(spark, path, 25))


@query("R4_metric_windows", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS b, event_type AS metric,
  count(*) AS n FROM events GROUP BY ALL), e AS (SELECT max(ts) AS m FROM events)
SELECT strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS bucket, metric, n FROM w, e WHERE b + INTERVAL 1 HOUR <= m - INTERVAL 2 HOUR""")
def metric_windows(spark, sf):
    held = _streamed(spark, sf, "events", lambda s: streams.metric_windows(_events(s), "1 hour", "2 hours"))
    return rounded(held.select("bucket", "metric", "n"))


@query("R4_psi_windows", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS b, event_type AS feature, CASE
  WHEN value > 40 THEN 3 WHEN value > 10 THEN 2 ELSE 1 END AS bin_id, count(*) AS bin_count FROM events
  WHERE event_type IN ('view', 'click') GROUP BY ALL),
e AS (SELECT max(ts) AS m FROM events WHERE event_type IN ('view', 'click'))
  SELECT strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS bucket, feature, bin_id, bin_count FROM w, e
  WHERE b + INTERVAL 1 HOUR <= m - INTERVAL 2 HOUR""")
def psi_windows(spark, sf):
    edges = {"view": [10.0, 40.0], "click": [10.0, 40.0]}
    return rounded(
        _streamed(
            spark,
            sf,
            "events",
            lambda s: streams.psi_count_windows(_events(s).withColumnRenamed("metric", "feature"), edges, "1 hour", "2 hours"),
        )
    )


_RANKS = (5, 25, 50, 95, 99)


@query("R4_route_windows", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS b, event_type AS route_name,
  count(*) FILTER (event_id % 10 > 0) AS request_count, count(*) FILTER (event_id % 10 = 0) AS error_count,
  round(coalesce(sum(value) FILTER (event_id % 10 = 0), 0), 6) AS error_latency,
  {', '.join(f"round(quantile_disc(value, {q / 100}) FILTER (event_id % 10 > 0), 6) AS p{q}" for q in _RANKS)} FROM events GROUP BY ALL),
e AS (SELECT max(ts) AS m FROM events)
  SELECT strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS bucket, route_name, request_count, error_count, error_latency, p5, p25, p50, p95, p99 FROM w, e
  WHERE b + INTERVAL 1 HOUR <= m - INTERVAL 2 HOUR""")
def route_windows(spark, sf):
    def shape(stream):
        routes = _events(stream).select(
            "created_at",
            F.col("metric").alias("route_name"),
            F.col("value").alias("latency"),
            F.when(F.col("event_id") % 10 == 0, 500).otherwise(200).alias("status_code"),
        )
        return streams.route_windows(routes, "1 hour", "2 hours")

    return rounded(_streamed(spark, sf, "events", shape).select("bucket", "route_name", "request_count", "error_count", "error_latency", *(f"p{q}" for q in _RANKS)))


@query("R5_dedup_stream", "SELECT count(*) AS n FROM events")
def dedup_stream(spark, sf):
    """Every event comes twice, and goes on once."""
    twice = lambda s: _events(s).withColumn("__copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("__copy")
    return _streamed(spark, sf, "events", lambda s: streams.dedup_stream(twice(s), ["event_id"], "created_at")).agg(F.count("*").alias("n"))


@query("R6_outbox_stream", """SELECT count(*) AS n FROM (SELECT user_id, event_id % 3 AS e FROM events GROUP BY ALL
  HAVING bool_or(event_type <> 'error') AND NOT bool_or(event_type = 'error'))""")
def outbox_stream(spark, sf):
    path, source = new_folder(spark), f"{sf}/events.parquet"
    log = spark.readStream.schema(spark.read.parquet(source).schema).parquet(
        source if _is_folder(spark, source) else f"{sf}/events.parque*"
    )
    events = log.select(
        F.col("user_id").alias("trace_id"),
        (F.col("event_id") % 3).alias("entity_id"),
        F.col("ts").cast("timestamp").alias("start_time"),
        F.when(F.col("event_type") == "error", "ack").otherwise("candidate").alias("event"),
    )
    outbox.pending_dispatch_stream(events, path, f"{path}/check").awaitTermination()
    outbox.compact(spark, path)
    return outbox.read_pending(spark, path).agg(F.count("*").alias("n"))
