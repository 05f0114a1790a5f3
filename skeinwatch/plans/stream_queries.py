"""Streams of the provided tables read to their end, which must give what the definition gives over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinwatch.functions.shared import new_folder
from skeinwatch.operators import traces
from skeinwatch.plans import views
from skeinwatch.plans.book import Book, rounded, stamp
from skeinwatch.streaming import ingest, streams

BOOK = Book()
query = BOOK.query


def _read(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _finished(made, path):
    """What a stream has written when it has read all there is."""
    run = made.writeStream.format("parquet").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()
    return made.sparkSession.read.schema(made.schema).parquet(f"{path}/out")


def _all_messages(spark, sf):
    """Messages of the four record types by event_id, every seventh one broken in one of three ways."""
    e = views.table(spark, sf, "events")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at")
    entity, kind = F.col("user_id").cast("int").alias("entity_id"), F.col("event_id") % 4
    fields = {
        "spc": [F.col("event_type").alias("feature"), F.col("value")],
        "psi": [F.col("event_type").alias("feature"), F.floor(F.col("value") / 10).cast("int").alias("bin_id"), F.lit(1).alias("bin_count")],
        "custom": [F.col("event_type").alias("metric"), F.col("value")],
        "route": [F.col("event_type").alias("route_name"), F.col("value").alias("latency"), F.lit(200).alias("status_code")],
    }
    made = F.lit(None).cast("string")
    for i, (name, own) in enumerate(fields.items()):
        record = F.to_json(F.struct(at, entity, *own))
        made = F.when(kind == i, F.concat(F.lit(f'{{"type":"{name}","record":'), record, F.lit("}"))).otherwise(made)
    broken = F.when(F.col("event_id") % 3 == 0, "{broken").when(F.col("event_id") % 3 == 1, '{"type":"other","record":{}}').otherwise('{"type":"spc","record":{"value":"x"}}')
    return e.select(F.when(F.col("event_id") % 7 == 0, broken).otherwise(made).alias("value"))


@query("S4_S5_ingest_stream", """SELECT CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE ['spc', 'psi', 'custom', 'route'][event_id % 4 + 1] END AS kind,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS name, count(*) AS n,
  round(sum(CASE WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 4 = 1 THEN floor(value / 10) ELSE value END), 4) AS total FROM events GROUP BY ALL""")
def ingest_stream(spark, sf):
    """All four record types and broken messages, routed by one stream to five tables."""
    path = new_folder(spark, "ingest")
    _all_messages(spark, sf).write.parquet(f"{path}/in")
    ingest.ingest_stream(_read(spark, f"{path}/in"), f"{path}/out", f"{path}/check").awaitTermination()
    names = {"spc": ("feature", "value"), "psi": ("feature", "bin_id"), "custom": ("metric", "value"), "route": ("route_name", "latency")}
    out = ingest.read_ingested(spark, f"{path}/out", "bad").select(F.lit("bad").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("value"))
    for kind, (name, value) in names.items():
        held = ingest.read_ingested(spark, f"{path}/out", kind)
        out = out.unionByName(held.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(value).cast("double").alias("value")))
    return rounded(out.groupBy("kind", "name").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("E41_waiting_stream", """WITH n AS (SELECT o_orderkey, o_orderdate, count(l_orderkey) AS c FROM orders LEFT JOIN lineitem
  ON l_orderkey = o_orderkey AND l_suppkey % 7 = 1 AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY GROUP BY ALL),
w AS (SELECT least(max(o_orderdate), (SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey % 7 = 1)) - INTERVAL 1 DAY AS upto FROM orders)
SELECT o_orderkey AS record_id, c AS span_count, CASE WHEN c > 0 THEN 'ready' WHEN o_orderkey % 4 + 1 >= 3 THEN 'failed' ELSE 'retry' END AS status,
  (CASE WHEN c > 0 THEN o_orderkey % 4 ELSE o_orderkey % 4 + 1 END)::BIGINT AS retry_count FROM n, w WHERE o_orderdate + INTERVAL 60 DAY < upto""")
def waiting_stream(spark, sf):
    """Orders as records, their lines as spans that start within 60 days; both as streams."""
    path = new_folder(spark, "waiting")
    views.table(spark, sf, "orders").select("o_orderkey", "o_orderdate").write.parquet(f"{path}/records")
    views.table(spark, sf, "lineitem").where("l_suppkey % 7 = 1").select("l_orderkey", "l_shipdate").write.parquet(f"{path}/spans")
    key = F.col("o_orderkey")
    records = _read(spark, f"{path}/records").select(
        key.alias("record_id"), key.alias("trace_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"), (key % 4).alias("retry_count"),
    )
    spans = _read(spark, f"{path}/spans").select(F.col("l_orderkey").alias("trace_id"), F.col("l_shipdate").cast("timestamp").alias("start_time"))
    made = streams.waiting_records(records, spans, "60 days", "1 day")
    return _finished(made, path).select("record_id", "span_count", "status", "retry_count")


def _event_spans(held):
    return held.select(
        F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"),
        F.when(F.col("event_id") % 2 > 0, F.col("event_id") - 1).alias("parent_span_id"),
        F.col("event_type").alias("service_name"), F.col("event_type").alias("span_name"),
        F.col("ts").cast("timestamp").alias("start_time"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 SECOND")).alias("end_time"),
        F.when(F.col("event_type") == "error", 2).otherwise(1).alias("status_code"), F.when(F.col("event_type") == "error", "bad").alias("status_message"),
    )


_WHOLE = f"""SELECT user_id AS trace_id, {stamp("min(ts)", "start_time")}, {stamp("max(ts) + INTERVAL 1 SECOND", "end_time")},
  count(*) AS span_count, count(*) FILTER (event_type = 'error') AS error_count FROM events"""


@query("T1_running_summaries", f"""{_WHOLE} GROUP BY user_id
  HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 2 HOUR""")
def running_summaries(spark, sf):
    """Each user's events as a trace, flushed after an hour of quiet; the stream's parts are merged on read."""
    path = new_folder(spark, "running")
    views.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type").write.parquet(f"{path}/in")
    made = streams.running_summaries(_event_spans(_read(spark, f"{path}/in")), 3600, "2 hours")
    merged = traces.merge_summaries(_finished(made, path))
    return rounded(merged.select("trace_id", "start_time", "end_time", "span_count", "error_count"))


@query("R2_late_stream", f"""WITH high AS (SELECT max(ts) AS h FROM events WHERE event_id % 3 > 0), late AS (SELECT user_id, count(*) AS n FROM events, high
  WHERE event_id % 3 = 0 AND ts < h - INTERVAL 1 HOUR GROUP BY user_id)
SELECT w.*, coalesce(n, 0)::BIGINT AS late_spans FROM ({_WHOLE} GROUP BY user_id) w LEFT JOIN late ON user_id = trace_id""")
def late_stream(spark, sf):
    """A third of all events come in a second batch, most of them behind the first one's watermark."""
    path, e = new_folder(spark, "late"), views.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    for batch in (e.where("event_id % 3 > 0"), e.where("event_id % 3 = 0")):
        batch.write.mode("append").parquet(f"{path}/in")
        ingest.summary_stream(_event_spans(_read(spark, f"{path}/in")), f"{path}/out", f"{path}/check", "1 hour").awaitTermination()
    late = ingest.read_parts(spark, f"{path}/out").groupBy("trace_id").agg(F.sum(F.when(F.col("late"), F.col("span_count")).otherwise(0)).alias("late_spans"))
    merged = ingest.read_summaries(spark, f"{path}/out").select("trace_id", "start_time", "end_time", "span_count", "error_count")
    return rounded(merged.join(late, "trace_id"))
