"""GenAI spans projected from generic spans, and the dashboards over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwatch.functions.timeutil import opt_filter, time_filter, time_trunc
from skeinwatch.operators.metrics import error_rate, with_percentiles

MAX_SPANS, MAX_CONVERSATION = 10_000, 1_000
AGENT_OPERATIONS = ("invoke_agent", "create_agent")
_TEXT = {
    "operation": "gen_ai.operation.name",
    "provider": "gen_ai.provider.name",
    "request_model": "gen_ai.request.model",
    "response_model": "gen_ai.response.model",
    "conversation_id": "gen_ai.conversation.id",
    "agent_name": "gen_ai.agent.name",
    "agent_id": "gen_ai.agent.id",
    "tool_name": "gen_ai.tool.name",
    "tool_type": "gen_ai.tool.type",
    "error_type": "error.type",
}
_NUMBER = {
    "input_tokens": "gen_ai.usage.input_tokens", "output_tokens": "gen_ai.usage.output_tokens",
    "cache_creation_tokens": "gen_ai.usage.cache_creation.input_tokens", "cache_read_tokens": "gen_ai.usage.cache_read.input_tokens",
}


def _attribute(key: str) -> Column:
    """An attribute of the span, else of the first of its events that has it."""
    held = F.filter("events", lambda e: e["attributes"][key].isNotNull())
    return F.coalesce(F.col("attributes")[key], F.when(F.size(held) > 0, F.element_at(held, 1)["attributes"][key]))


def extract_genai(spans: DataFrame) -> DataFrame:
    """Typed columns of the spans that name a GenAI operation.

    Numbers may be given as strings; finish reasons as a JSON list or a plain string; attributes the span lacks may come
    from its events; evaluation events become JSON (those without a name are left out).
    """
    if "events" not in spans.columns:
        spans = spans.withColumn("events", F.array().cast("array<struct<name:string,attributes:map<string,string>>>"))
    held = spans.where(_attribute(_TEXT["operation"]).isNotNull())
    text = {name: _attribute(key) for name, key in _TEXT.items()}
    number = {name: _attribute(key).try_cast("double").cast("long") for name, key in _NUMBER.items()}
    reasons = _attribute("gen_ai.response.finish_reasons")
    listed = F.coalesce(
        F.when(reasons.startswith("["), F.from_json(reasons, "array<string>")),
        F.when(reasons.isNotNull(), F.array(reasons)),
    )
    scored = F.filter("events", lambda e: (e["name"] == "gen_ai.evaluation.result") & e["attributes"]["gen_ai.evaluation.name"].isNotNull())
    evaluations = F.to_json(
        F.transform(
            scored,
            lambda e: F.struct(
                e["attributes"]["gen_ai.evaluation.name"].alias("name"),
                e["attributes"]["gen_ai.evaluation.score.value"].try_cast("double").alias("score"),
                e["attributes"]["gen_ai.evaluation.score.label"].alias("label"),
            ),
        )
    )
    return held.withColumns(
        {**text, **number, "finish_reasons": listed, "evaluations": F.when(F.size(scored) > 0, evaluations)}
    ).drop("attributes", "events")


def model_filter(df: DataFrame, model: str | None) -> DataFrame:
    return df if model is None else df.where((F.col("request_model") == model) | (F.col("response_model") == model))


def selected(df: DataFrame, start=None, end=None, model: str | None = None, **equal) -> DataFrame:
    return model_filter(opt_filter(time_filter(df, start, end), **equal), model)


def failed() -> Column:
    return (F.col("status_code") == 2) | F.col("error_type").isNotNull()


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _NUMBER]


def token_metrics(df: DataFrame, unit: str = "hour") -> DataFrame:
    return df.groupBy(time_trunc("start_time", unit).alias("bucket")).agg(
        *_sums(),
        F.count("*").alias("span_count"),
        error_rate(failed()).alias("error_rate"),
    )


def operation_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy("operation", "provider").agg(
        F.count("*").alias("span_count"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        error_rate(failed()).alias("error_rate"),
    )


def model_usage(df: DataFrame, exact: bool = False) -> DataFrame:
    held = df.withColumn("model", F.coalesce("response_model", "request_model")).where(F.col("model").isNotNull())
    aggs = [
        F.count("*").alias("span_count"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        error_rate(failed()).alias("error_rate"),
    ]
    return with_percentiles(held, ["model", "provider"], aggs, "duration_ms", (0.5, 0.95), exact)


def agent_activity(df: DataFrame) -> DataFrame:
    held = df.where(F.col("operation").isin(*AGENT_OPERATIONS) | F.col("agent_name").isNotNull())
    return held.groupBy("agent_name", "agent_id", "conversation_id").agg(
        F.count("*").alias("span_count"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.max("start_time").alias("last_seen"),
    )


def _tools(df: DataFrame) -> DataFrame:
    return df.where((F.col("operation") == "execute_tool") | F.col("tool_name").isNotNull())


def tool_activity(df: DataFrame) -> DataFrame:
    return _tools(df).groupBy("tool_name", "tool_type").agg(
        F.count("*").alias("call_count"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        error_rate(failed()).alias("error_rate"),
    )


def tool_timeseries(df: DataFrame, unit: str = "hour") -> DataFrame:
    return _tools(df).groupBy(time_trunc("start_time", unit).alias("bucket"), "tool_name").agg(
        F.count("*").alias("call_count"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        error_rate(failed()).alias("error_rate"),
    )


def error_breakdown(df: DataFrame) -> DataFrame:
    return df.where(F.col("error_type").isNotNull()).groupBy("error_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "error_type")


def genai_spans(df: DataFrame, limit: int = MAX_SPANS, **filters) -> DataFrame:
    return selected(df, **filters).orderBy(F.desc("start_time"), "span_id").limit(min(limit, MAX_SPANS))


def conversation_spans(df: DataFrame, conversation_id: str, limit: int = MAX_CONVERSATION) -> DataFrame:
    return df.where(F.col("conversation_id") == conversation_id).orderBy("start_time", "span_id").limit(min(limit, MAX_CONVERSATION))


def _dashboard() -> list[Column]:
    return [
        F.count("*").alias("span_count"),
        error_rate(failed()).alias("error_rate"),
        F.avg("duration_ms").alias("avg_duration_ms"),
        *_sums(),
    ]


def agent_dashboard(df: DataFrame, unit: str = "hour", exact: bool = False) -> DataFrame:
    """A row a bucket, over all its spans (percentiles aren't folded from models')."""
    return with_percentiles(df.withColumn("bucket", time_trunc("start_time", unit)), ["bucket"], _dashboard(), "duration_ms", exact=exact)


def dashboard_summary(df: DataFrame, exact: bool = False) -> DataFrame:
    return with_percentiles(df, [], _dashboard(), "duration_ms", exact=exact)


def cost_by_model(df: DataFrame, pricing: DataFrame) -> DataFrame:
    """model, tokens and cost; pricing: model, input_price and output_price per million tokens. Unknown models cost null."""
    used = df.groupBy(
        F.coalesce("response_model", "request_model").alias("model")
    ).agg(F.count("*").alias("span_count"), *_sums()).where(F.col("model").isNotNull())
    cost = (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1_000_000
    return used.join(pricing, "model", "left").withColumn("cost", cost).drop("input_price", "output_price")


def agent_unique_counts(df: DataFrame, exact: bool = False) -> DataFrame:
    count = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(count("agent_name").alias("agents"), count("conversation_id").alias("conversations"))


def weighted_mean(df: DataFrame, keys: list[str], mean: str, weight: str) -> DataFrame:
    """Means of groups as the mean over all their rows."""
    return df.groupBy(*keys).agg((F.sum(F.col(mean) * F.col(weight)) / F.sum(weight)).alias(mean), F.sum(weight).alias(weight))
