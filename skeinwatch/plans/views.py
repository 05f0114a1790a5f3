"""Views that shape the provided tables into samples, metrics, spans, GenAI spans, edges and records, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUT = "1998-05-24"
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAGS = ["l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit(CUT).cast("timestamp"))


def serve(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit(CUT).cast("timestamp"))


def metric(spark, sf_dir):
    """created_at, metric, value, event_id."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("metric"),
        "value",
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def samples(spark, sf_dir):
    """feature, created_at, event_id, value."""
    return metric(spark, sf_dir).withColumnRenamed("metric", "feature")


def routes(spark, sf_dir):
    """created_at, route_name, latency, status_code."""
    return metric(spark, sf_dir).select(
        "created_at",
        F.col("metric").alias("route_name"),
        F.col("value").alias("latency"),
        F.when(F.col("k") % 10 == 0, 500).otherwise(200).alias("status_code"),
    )


def psi_facts(spark, sf_dir):
    """created_at, feature, bin_id, bin_count: quantity in bins of ten, dealt by ship date."""
    held = table(spark, sf_dir, "lineitem")
    return held.select(
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.lit("l_quantity").alias("feature"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("bin_id"),
        F.lit(1).cast("long").alias("bin_count"),
    )


def even_profile(spark):
    """Five even bins of quantity."""
    return spark.range(1, 6).select(
        F.lit("l_quantity").alias("feature"),
        F.col("id").cast("int").alias("id"),
        F.lit(0.2).alias("proportion"),
    )


#: Line items in a partition of spans, about: a larger table makes more partitions.
DEALT_ROWS = 500_000


def dealt(lines: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line items dealt by order to partitions of about DEALT_ROWS rows, and orders to be merged with them rather than sent whole
    to every task, so that what a task holds doesn't grow with the tables; up to twice as many rows stay as they are."""
    rows = lines.count()
    if rows <= 2 * DEALT_ROWS:
        return lines, orders
    n = max(-(-rows // DEALT_ROWS), int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return lines.repartition(n, "l_orderkey"), orders.hint("merge")


def spans(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    lines, orders = dealt(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))
    held = lines.withColumn("rk", F.row_number().over(order)).join(
        orders,
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("rk") * 1_000_000
    key = F.col("l_orderkey") * 100
    return held.select(
        F.col("l_orderkey").alias("trace_id"),
        (key + F.col("rk")).alias("span_id"),
        F.when(F.col("rk") > 1, key + F.floor(F.col("rk") / 2)).alias("parent_span_id"),
        F.concat(F.lit("svc"), F.col("l_suppkey") % 7).alias("service_name"),
        F.concat(F.lit("op"), F.col("l_partkey") % 5).alias("span_name"),
        F.timestamp_micros(start).alias("start_time"),
        F.timestamp_micros(start + (F.col("l_quantity") * 1_000_000).cast("long")).alias("end_time"),
        (F.col("l_quantity") * 1000).cast("long").alias("duration_ms"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("status_code"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("err"), F.col("l_linenumber"))).alias("status_message"),
        F.lit("scope").alias("scope_name"),
        F.create_map(
            F.lit("flag"),
            F.col("l_returnflag"),
            F.lit("line"),
            F.col("l_linestatus"),
            F.lit("qty"),
            F.col("l_quantity").cast("int").cast("string"),
        ).alias("attributes"),
        F.array().cast("array<struct<name:string,attributes:map<string,string>>>").alias("events"),
        F.concat(F.lit("cust"), F.col("o_custkey") % 10).alias("entity"),
        "rk",
    )


def parts(spark, sf_dir):
    """Two partial summaries a trace: spans of odd and of even rank."""
    held = spans(spark, sf_dir)
    half = held.groupBy("trace_id", F.col("rk") % 2)
    root = F.col("parent_span_id").isNull()
    return half.agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.max("status_code").alias("status_code"),
        F.count("*").alias("span_count"),
        F.count_if(F.col("status_code") == 2).alias("error_count"),
        F.min_by("service_name", "rk").alias("service_name"),
        F.coalesce(F.max(F.when(root, F.col("span_name"))), F.lit("")).alias("root_operation"),
        F.max("status_message").alias("status_message"),
        F.array_distinct(F.collect_list("entity")).alias("entity_ids"), F.array().cast("array<string>").alias("queue_ids"),
    ).drop("(rk % 2)")


def links(spark, sf_dir):
    return spans(spark, sf_dir).select("trace_id", F.col("entity").alias("entity_id")).distinct()


def tags(spark, sf_dir):
    """entity_id, key, value of ten customers' groups."""
    held = spark.range(10).select(
        F.concat(F.lit("cust"), "id").alias("entity_id"),
        F.explode(
            F.map_from_arrays(
                F.array(F.lit("tier"), F.lit("zone")),
                F.array((F.col("id") % 2).cast("string"), (F.col("id") % 3).cast("string")),
            )
        ).alias("key", "value"),
    )
    return held.join(links(spark, sf_dir).select("entity_id").distinct(), "entity_id", "left_semi")


def genai(spark, sf_dir):
    """Conversation turns as generic spans with GenAI attributes."""
    c = table(spark, sf_dir, "conversations")
    words = F.size(F.split("text", " "))
    op = F.element_at(F.array(F.lit("chat"), F.lit("invoke_agent"), F.lit("execute_tool")), (F.col("turn") % 3 + 1).cast("int"))
    start = F.lit(1_700_000_000_000_000) + (F.col("conv_id") * 600 + F.col("turn") * 7) * 1_000_000
    pairs = {
        "gen_ai.operation.name": op,
        "gen_ai.provider.name": F.concat(F.lit("prov"), F.col("conv_id") % 2),
        "gen_ai.request.model": F.concat(F.lit("model"), F.col("conv_id") % 3),
        "gen_ai.conversation.id": F.col("conv_id").cast("string"),
        "gen_ai.usage.input_tokens": words.cast("string"),
        "gen_ai.usage.output_tokens": F.length("text").cast("string"),
        "gen_ai.agent.name": F.when(F.col("turn") % 3 == 1, F.concat(F.lit("agent"), F.col("conv_id") % 4)),
        "gen_ai.tool.name": F.when(F.col("turn") % 3 == 2, F.concat(F.lit("tool"), F.col("conv_id") % 5)),
        "error.type": F.when(words % 11 == 0, F.concat(F.lit("e"), words % 3)),
        "gen_ai.response.finish_reasons": F.lit('["stop"]'),
    }
    attributes = F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    return c.select(
        F.col("conv_id").alias("trace_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("span_id"),
        F.timestamp_micros(start).alias("start_time"),
        words.cast("long").alias("duration_ms"),
        F.lit(1).alias("status_code"),
        attributes.alias("attributes"),
        F.array().cast("array<struct<name:string,attributes:map<string,string>>>").alias("events"),
    )


def edges(spark, sf_dir):
    li, o, s, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "customer"))
    held = li.join(
        o,
        F.col("l_orderkey") == F.col("o_orderkey"),
    ).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return held.select(
        F.concat(F.lit("n"), F.col("c_nationkey")).alias("source_service"),
        F.concat(F.lit("n"), F.col("s_nationkey")).alias("destination_service"),
        F.concat(F.lit("/orders/"), F.col("l_orderkey"), F.lit("/items/"), F.col("l_linenumber")).alias("path"),
        F.col("l_quantity").alias("latency_ms"),
        (F.col("l_returnflag") == "R").alias("error"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def records(spark, sf_dir):
    """record_id, context (variant): documents and their labels as JSON, with all words of the text."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    words = F.split(F.regexp_replace("text", "\n", " "), " ")
    body = F.struct(
        "lang",
        "source",
        "n_chars",
        "quality",
        F.struct(F.col("doc_id").alias("id"), (F.col("doc_id") % 7 == 0).alias("flag")).alias("meta"),
        words.alias("words"),
    )
    return d.select(
        F.col("doc_id").alias("record_id"),
        F.parse_json(F.to_json(body, {"ignoreNullFields": "false"})).alias("context"),
        "lang",
        "source",
    )


#: DuckDB: common table expressions of the same views.
SQL = {
    "base": f"base AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}')",
    "serve": f"serve AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}')",
    "long_base": """long_base AS (SELECT feature, value::DOUBLE AS value
  FROM (UNPIVOT (SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount,
  l_tax::DOUBLE AS l_tax FROM base) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value))""",
    "long_all": """long_all AS (SELECT feature, value::DOUBLE AS value
  FROM (UNPIVOT (SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount,
  l_tax::DOUBLE AS l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value))""",
    "long_serve": """long_serve AS (SELECT feature, value::DOUBLE AS value
  FROM (UNPIVOT (SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount,
  l_tax::DOUBLE AS l_tax FROM serve) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value))""",
    "metric": "metric AS (SELECT ts AS created_at, event_type AS metric, value, event_id, user_id, (props::JSON->>'k')::INTEGER AS k FROM events)",
    "routes": """routes AS (SELECT created_at, metric AS route_name, value AS latency, CASE WHEN k % 10 = 0 THEN 500 ELSE 200 END AS status_code
  FROM metric)""",
    "facts": "facts AS (SELECT l_shipdate AS created_at, 'l_quantity' AS feature, ceil(l_quantity / 10)::INTEGER AS bin_id FROM lineitem)",
    "ranked": """ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rk FROM lineitem)""",
    "spans": """spans AS (SELECT l_orderkey AS trace_id, l_orderkey * 100 + rk AS span_id, CASE
  WHEN rk > 1 THEN l_orderkey * 100 + rk // 2 END AS parent_span_id,
  'svc' || (l_suppkey % 7) AS service_name, 'op' || (l_partkey % 5) AS span_name, o_orderdate + to_seconds(rk) AS start_time,
    o_orderdate + to_seconds(rk + l_quantity::BIGINT) AS end_time,
  (l_quantity * 1000)::BIGINT AS duration_ms, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS status_code, CASE
    WHEN l_returnflag = 'R' THEN 'err' || l_linenumber END AS status_message,
  l_returnflag AS flag, l_linestatus AS line, l_quantity::INTEGER AS qty, 'cust' || (o_custkey % 10) AS entity, rk FROM ranked
    JOIN orders ON l_orderkey = o_orderkey)""",
    "parts": """parts AS (SELECT trace_id, min(start_time) AS start_time, max(end_time) AS end_time, max(status_code) AS status_code,
  count(*) AS span_count, count(*) FILTER (status_code = 2) AS error_count,
  arg_min(service_name, rk) AS service_name, coalesce(max(CASE
    WHEN parent_span_id IS NULL THEN span_name END), '') AS root_operation, max(status_message) AS status_message, any_value(entity) AS entity
    FROM spans GROUP BY trace_id, rk % 2)""",
    "summaries": """summaries AS (SELECT trace_id, min(start_time) AS start_time, max(end_time) AS end_time,
  epoch_ms(max(end_time)) - epoch_ms(min(start_time)) AS duration_ms, max(status_code) AS status_code,
  sum(span_count)::BIGINT AS span_count,
  sum(error_count)::BIGINT AS error_count, arg_max(service_name, (span_count, end_time, -epoch_us(start_time))) AS service_name,
    arg_max(root_operation, (span_count, end_time, -epoch_us(start_time))) AS root_operation, max(entity) AS entity FROM parts
    GROUP BY trace_id)""",
    "genai": """genai AS (SELECT conv_id AS trace_id, conv_id * 1000 + turn AS span_id,
  make_timestamp(1700000000000000 + (conv_id * 600 + turn * 7) * 1000000) AS start_time, len(string_split(text,
  ' '))::BIGINT AS duration_ms, 1 AS status_code,
  ['chat', 'invoke_agent', 'execute_tool'][turn % 3 + 1] AS operation, 'prov' || (conv_id % 2) AS provider,
    'model' || (conv_id % 3) AS model, conv_id::VARCHAR AS conversation_id, len(string_split(text, ' '))::BIGINT AS input_tokens,
    length(text)::BIGINT AS output_tokens,
  CASE WHEN turn % 3 = 1 THEN 'agent' || (conv_id % 4) END AS agent_name, CASE
    WHEN turn % 3 = 2 THEN 'tool' || (conv_id % 5) END AS tool_name, CASE
    WHEN len(string_split(text, ' ')) % 11 = 0 THEN 'e' || (len(string_split(text, ' ')) % 3) END AS error_type FROM conversations)""",
    "edges": """edges AS (SELECT 'n' || c_nationkey AS source_service, 'n' || s_nationkey AS destination_service,
  '/orders/{id}/items/{id}' AS endpoint, l_quantity AS latency_ms, l_returnflag = 'R' AS error, o_orderdate AS created_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)""",
    "recs": """recs AS (SELECT d.doc_id AS record_id, d.lang, d.source, d.n_chars, l.quality, d.doc_id % 7 = 0 AS flag, string_split(replace(d.text,
  chr(10), ' '), ' ') AS words FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "whole_recs": "whole_recs AS (SELECT doc_id AS record_id, string_split(replace(text, chr(10), ' '), ' ') AS words FROM documents)",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
