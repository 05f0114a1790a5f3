"""Streaming forms: sessions and running summaries of traces, waiting records, windows and deduplication.

All take and give streaming frames (batch frames work too, where no state is kept); delays are watermarks, a parameter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skeinwatch.operators.traces import ERROR, millis, trace_summaries

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def trace_sessions(spans: DataFrame, gap: str = "10 seconds", delay: str = "15 seconds") -> DataFrame:
    """Partial trace summaries: a trace's spans until it is quiet for the gap. Later spans make another part; parts merge on read."""
    root = F.col("parent_span_id").isNull()
    bad = F.col("status_code") == ERROR
    first = F.struct(F.when(root, 0).otherwise(1), "start_time", "span_id")
    held = spans.withWatermark("start_time", delay).groupBy(F.session_window("start_time", gap).alias("__w"), "trace_id")
    return held.agg(
        F.min_by("service_name", first).alias("service_name"),
        F.coalesce(F.min_by(F.when(root, F.col("span_name")), first), F.lit("")).alias("root_operation"),
        F.min("start_time").alias("start"),
        F.max("end_time").alias("end_time"),
        millis(F.min("start_time"), F.max("end_time")).alias("duration_ms"),
        F.max("status_code").alias("status_code"),
        F.max_by(F.when(bad, F.col("status_message")), F.when(bad, F.struct("start_time", "span_id"))).alias("status_message"),
        F.count("*").alias("span_count"),
        F.count_if(bad).alias("error_count"),
    ).drop("__w").withColumnRenamed("start", "start_time")


def waiting_records(
    records: DataFrame,
    spans: DataFrame,
    wait: str = "10 minutes",
    delay: str = "1 minute",
    max_retries: int = 3,
) -> DataFrame:
    """record_id, trace_id, created_at, retry_count, span_count, status of records that wait for spans of their trace.

    A stream-stream left outer join: spans that start within `wait` of the record count. A record comes out once, when the
    watermarks (the later of both streams less the delay) have passed its wait, so state holds no record or span longer.
    Status as attach_spans gives it: ready, retry, or failed after max_retries.
    """
    asked = records.select("record_id", "trace_id", "created_at", "retry_count").withWatermark("created_at", delay)
    seen = spans.select(F.col("trace_id").alias("__trace"), F.col("start_time").alias("__start")).withWatermark("__start", delay)
    upto = F.col("created_at") + F.expr(f"INTERVAL {wait}")
    same = (F.col("trace_id") == F.col("__trace")) & (F.col("__start") >= F.col("created_at")) & (F.col("__start") <= upto)
    held = asked.join(seen, same, "leftOuter").groupBy("created_at", "record_id", "trace_id", "retry_count")
    held = held.agg(F.count("__trace").alias("span_count"))
    tried = F.col("retry_count") + 1
    status = F.when(F.col("span_count") > 0, "ready").when(tried >= max_retries, "failed").otherwise("retry")
    return held.withColumn("status", status).withColumn("retry_count", F.when(F.col("span_count") > 0, F.col("retry_count")).otherwise(tried))


#: A trace's state: its first span (roots before others), bounds in microseconds, counts, and the last error.
_PART = (
    "rank int, first long, span string, service string, root string, status int, start long, stop long, latest long, spans long, errors long, "
    "bad long, bad_span string, message string"
)


def _part_of(spans: Iterator[str]) -> tuple:
    """The part of a trace's spans, each as running_summaries packs it; plain loops, since this runs for each span."""
    first = lo = hi = latest = None
    count, bad, error = 0, 0, (None, None, None)
    for own in spans:
        rank, span, service, name, status, message, start, stop = json.loads(own).values()
        at = (rank, start, span)
        if first is None:
            first, lo, hi, latest = (at, service, name, status), start, stop, start
        elif at < first[0]:
            first = (at, service, name, status)
        lo, hi, latest = min(lo, start), max(hi, stop), max(latest, start)
        if status == ERROR:
            if not bad or (start, span) > error[:2]:
                error = (start, span, message)
            bad += 1
        count += 1
    at, service, name, status = first
    return (*at, service, (name or "") if at[0] == 0 else "", status, lo, hi, latest, count, bad, *error)


def _merged(a: tuple, b: tuple) -> tuple:
    first = min(a[:6], b[:6], key=lambda p: p[:3])
    error = max((p[11:] for p in (a, b) if p[11] is not None), key=lambda e: e[:2], default=(None, None, None))
    return (*first, min(a[6], b[6]), max(a[7], b[7]), max(a[8], b[8]), a[9] + b[9], a[10] + b[10], *error)


class _Running(StatefulProcessor):
    """A trace's summary so far. When the trace has been quiet for the gap, it goes out and its state goes."""

    def __init__(self, gap_ms: int, event_time: bool):
        self.gap_ms, self.event_time = gap_ms, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.part = handle, handle.getValueState("part", _PART)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before, part = self.part.get(), _part_of(row["own"] for row in rows)
        if before is not None:
            part = _merged(tuple(before), part)
        self.part.update(part)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        active = part[8] // 1000 if self.event_time else timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(active + self.gap_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        part = tuple(self.part.get())
        self.part.clear()
        yield Row(trace_id=key[0], **dict(zip((f.split()[0] for f in _PART.split(", ")), part, strict=True)))

    def close(self) -> None:
        pass


def running_summaries(spans: DataFrame, gap: float = 10, delay: str = "15 seconds", event_time: bool = True) -> DataFrame:
    """Partial trace summaries: each trace's running one, sent when the trace has been quiet for `gap` seconds (by the watermark,
    or by the clock), and another one for what comes later. merge_summaries makes the parts whole.

    State is a row a trace that isn't quiet, whatever its number of spans. By event time, spans behind the watermark are
    dropped here: ingest.summary_stream takes those too. Sets the session's state store to RocksDB, which timers need.
    """
    kind = spans.schema["trace_id"].dataType.simpleString()
    spans.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    # Spark hands a row to the state value by value, so what a span has goes as one JSON text, its fields in this order.
    own = F.struct(
        F.when(F.col("parent_span_id").isNull(), 0).otherwise(1).alias("rank"), F.col("span_id").cast("string").alias("span_id"),
        "service_name", "span_name", "status_code", "status_message",
        F.unix_micros("start_time").alias("start"), F.unix_micros("end_time").alias("stop"),
    )
    rows = spans.select("trace_id", "start_time", F.to_json(own, {"ignoreNullFields": "false"}).alias("own")).withWatermark("start_time", delay)
    processor = _Running(int(gap * 1000), event_time)
    mode = "EventTime" if event_time else "ProcessingTime"
    made = rows.groupBy("trace_id").transformWithState(processor, f"trace_id {kind}, {_PART}", "append", mode)
    return made.select(
        "trace_id", F.col("service").alias("service_name"), F.col("root").alias("root_operation"),
        F.timestamp_micros("start").alias("start_time"), F.timestamp_micros("stop").alias("end_time"),
        F.floor((F.col("stop") - F.col("start")) / 1000).cast("long").alias("duration_ms"),
        F.when(F.col("errors") > 0, ERROR).otherwise(F.col("status")).alias("status_code"), F.col("message").alias("status_message"),
        F.col("spans").alias("span_count"), F.col("errors").alias("error_count"),
    )


def route_late(rows: DataFrame, watermark, ts: str = "start_time") -> tuple[DataFrame, DataFrame]:
    """(rows in time, rows that are later than the watermark), for use in foreachBatch."""
    late = F.col(ts) < F.lit(watermark)
    return rows.where(~late), rows.where(late)


def summary_parts(spans: DataFrame, watermark) -> DataFrame:
    """Partial trace summaries of spans in time and, apart from them, of late spans (late: true); T6 merges them on read."""
    return reduce(
        DataFrame.unionByName,
        (
            trace_summaries(part).withColumn("late", F.lit(late)) for late,
            part in zip((False, True), route_late(spans, watermark), strict=True)
        ),
    )


def metric_windows(df: DataFrame, window: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """bucket, metric, value and n: means of custom metrics by tumbling window."""
    held = df.withWatermark("created_at", delay).groupBy(F.window("created_at", window).alias("w"), "metric")
    return held.agg(F.avg("value").alias("value"), F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "metric", "value", "n")


def psi_count_windows(df: DataFrame, edges: dict[str, list[float]], window: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """bucket, feature, bin_id, bin_count of long-form features; edges come from the profile, which is small."""
    arrays = F.create_map(*(x for f, e in edges.items() for x in (F.lit(f), F.array(*map(F.lit, e)))))
    bin_id = (F.size(F.filter(arrays[F.col("feature")], lambda e: F.col("value") > e)) + 1).alias("bin_id")
    held = df.where(F.col("feature").isin(*edges) & ~F.isnan("value")).withWatermark("created_at", delay).groupBy(
        F.window("created_at", window).alias("w"),
        "feature",
        bin_id,
    )
    return held.agg(F.count("*").alias("bin_count")).select(F.col("w.start").alias("bucket"), "feature", "bin_id", "bin_count")


def route_windows(df: DataFrame, window: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """bucket, route_name, request and error counts, percentiles of OK latencies by tumbling window."""
    ok = (F.col("status_code") >= 200) & (F.col("status_code") < 400)
    held = df.withWatermark("created_at", delay).groupBy(F.window("created_at", window).alias("w"), "route_name")
    quantiles = [
        F.percentile_approx(
            F.when(ok, F.col("latency")),
            F.lit(q),
            F.lit(10_000),
        ).alias(f"p{q * 100:g}") for q in (0.05, 0.25, 0.5, 0.95, 0.99)
    ]
    return held.agg(
        F.count_if(ok).alias("request_count"),
        F.count_if(~ok).alias("error_count"),
        F.coalesce(F.sum(F.when(~ok, F.col("latency"))), F.lit(0.0)).alias("error_latency"),
        *quantiles,
    ).select(F.col("w.start").alias("bucket"), "*").drop("w")


def dedup_stream(df: DataFrame, keys: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """Each key once within the delay."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
