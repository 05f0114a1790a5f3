"""GenAI dashboard queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from skeinwatch.operators import genai
from skeinwatch.plans import views
from skeinwatch.plans.book import Book, rounded, stamp
from skeinwatch.plans.views import with_views

BOOK = Book()
query = BOOK.query
_G = with_views("genai")
_HOUR = "date_trunc('hour', start_time)"
_ERROR = "round(avg((error_type IS NOT NULL)::INTEGER), 6) AS error_rate"
_TOKENS = "sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens"
_CACHE = "0::BIGINT AS cache_creation_tokens, 0::BIGINT AS cache_read_tokens"


def _spans(spark, sf):
    return genai.extract_genai(views.genai(spark, sf))


@query("G1_extract_genai", f"""{_G} SELECT span_id, operation, provider, model AS request_model, conversation_id, input_tokens, output_tokens, agent_name, tool_name,
  error_type, 'stop' AS finish_reason FROM genai""")
def extract(spark, sf):
    return _spans(spark, sf).select(
        "span_id",
        "operation",
        "provider",
        "request_model",
        "conversation_id",
        "input_tokens",
        "output_tokens",
        "agent_name",
        "tool_name",
        "error_type",
        F.array_join("finish_reasons", ",").alias("finish_reason"),
    )


@query(
    "G2_token_metrics",
    f"{_G} SELECT {stamp(_HOUR, 'bucket')}, {_TOKENS}, {_CACHE}, count(*) AS span_count, {_ERROR} FROM genai GROUP BY {_HOUR}",
)
def token_metrics(spark, sf):
    return rounded(genai.token_metrics(_spans(spark, sf)))


@query("G3_operation_breakdown", f"""{_G} SELECT operation, provider, count(*) AS span_count, round(avg(duration_ms), 6) AS avg_duration_ms, {_TOKENS}, {_ERROR} FROM genai
  GROUP BY operation, provider""")
def operation_breakdown(spark, sf):
    return rounded(genai.operation_breakdown(_spans(spark, sf)))


_P = "round(quantile_cont(duration_ms::DOUBLE, 0.5::DOUBLE), 6) AS p50, round(quantile_cont(duration_ms::DOUBLE, 0.95::DOUBLE), 6) AS p95"


@query(
    "G4_model_usage",
    f"{_G} SELECT model, provider, count(*) AS span_count, {_TOKENS}, {_P}, {_ERROR} FROM genai GROUP BY model, provider",
)
def model_usage(spark, sf):
    return rounded(genai.model_usage(_spans(spark, sf), exact=True))


@query("G5_agent_activity", f"""{_G} SELECT agent_name, conversation_id, count(*) AS span_count, {_TOKENS}, {stamp('max(start_time)', 'last_seen')} FROM genai
  WHERE operation = 'invoke_agent' OR agent_name IS NOT NULL GROUP BY agent_name, conversation_id""")
def agent_activity(spark, sf):
    return rounded(genai.agent_activity(_spans(spark, sf)).drop("agent_id"))


@query("G6_tool_activity", f"""{_G} SELECT tool_name, count(*) AS call_count, round(avg(duration_ms), 6) AS avg_duration_ms, {_ERROR} FROM genai
  WHERE tool_name IS NOT NULL GROUP BY tool_name""")
def tool_activity(spark, sf):
    return rounded(genai.tool_activity(_spans(spark, sf)).drop("tool_type"))


@query("G7_error_breakdown", f"{_G} SELECT error_type, count(*) AS count FROM genai WHERE error_type IS NOT NULL GROUP BY error_type")
def error_breakdown(spark, sf):
    return genai.error_breakdown(_spans(spark, sf))


@query("G8_F3_genai_spans", f"""{_G} SELECT span_id FROM genai WHERE model = 'model1' AND operation = 'chat' AND start_time >= TIMESTAMP '2023-11-14 23:00:00'
  ORDER BY start_time DESC, span_id LIMIT 100""")
def genai_spans(spark, sf):
    return genai.genai_spans(_spans(spark, sf), 100, model="model1", operation="chat", start=datetime(2023, 11, 14, 23)).select("span_id")


@query("G8_conversation_spans", f"{_G} SELECT span_id FROM genai WHERE conversation_id = '3' ORDER BY start_time, span_id LIMIT 1000")
def conversation_spans(spark, sf):
    return genai.conversation_spans(_spans(spark, sf), "3").select("span_id")


_DASH = f"""count(*) AS span_count, {_ERROR}, round(avg(duration_ms), 6) AS avg_duration_ms, {_P},
  round(quantile_cont(duration_ms::DOUBLE, 0.99::DOUBLE), 6) AS p99, {_TOKENS}, {_CACHE}"""


@query("G9_agent_dashboard", f"{_G} SELECT {stamp(_HOUR, 'bucket')}, {_DASH} FROM genai GROUP BY {_HOUR}")
def agent_dashboard(spark, sf):
    return rounded(genai.agent_dashboard(_spans(spark, sf), exact=True))


@query("G9_dashboard_summary", f"{_G} SELECT {_DASH} FROM genai")
def dashboard_summary(spark, sf):
    return rounded(genai.dashboard_summary(_spans(spark, sf), exact=True))


@query("G9_cost_by_model", f"""{_G} SELECT model, count(*) AS span_count, {_TOKENS}, {_CACHE}, round(CASE model
  WHEN 'model0' THEN sum(input_tokens) * 3.0 + sum(output_tokens) * 15.0
  WHEN 'model1' THEN sum(input_tokens) * 0.5 + sum(output_tokens) * 1.5 END / 1000000, 6)::DOUBLE AS cost FROM genai GROUP BY model""")
def cost_by_model(spark, sf):
    pricing = spark.range(2).select(
        F.concat(F.lit("model"), "id").alias("model"),
        F.when(F.col("id") == 0, 3.0).otherwise(0.5).alias("input_price"),
        F.when(F.col("id") == 0, 15.0).otherwise(1.5).alias("output_price"),
    )
    return rounded(genai.cost_by_model(_spans(spark, sf), pricing))


@query(
    "G10_A12_unique_counts",
    f"{_G} SELECT count(DISTINCT agent_name) AS agents, count(DISTINCT conversation_id) AS conversations FROM genai",
)
def unique_counts(spark, sf):
    return genai.agent_unique_counts(_spans(spark, sf), exact=True)


@query("G11_tool_timeseries", f"""{_G} SELECT {stamp(_HOUR, 'bucket')}, tool_name, count(*) AS call_count, round(avg(duration_ms), 6) AS avg_duration_ms, {_ERROR}
  FROM genai WHERE tool_name IS NOT NULL GROUP BY {_HOUR}, tool_name""")
def tool_timeseries(spark, sf):
    return rounded(genai.tool_timeseries(_spans(spark, sf)))


@query("A16_weighted_mean", f"""{_G} SELECT model AS request_model, round(avg(duration_ms), 6) AS avg_duration_ms, count(*)::BIGINT AS span_count FROM genai
  GROUP BY model""")
def weighted_mean(spark, sf):
    per = _spans(spark, sf).groupBy("request_model", "provider", "operation").agg(
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.count("*").alias("span_count"),
    )
    return rounded(genai.weighted_mean(per, ["request_model"], "avg_duration_ms", "span_count"))
