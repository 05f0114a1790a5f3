"""Streams with several sinks: monitoring messages into fact tables, and spans into partial trace summaries.

Both keep a ledger of finished batches (ledger.py), so a retried batch replaces its own rows and none is read half written.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwatch.functions.timeutil import time_filter
from skeinwatch.operators.traces import merge_summaries, trace_summaries
from skeinwatch.sources.tables import RECORDS, classified
from skeinwatch.streaming.ledger import finish, finished, read_batches

def ingest_batch(batch: DataFrame, batch_id: int, path: str) -> dict[str, int]:
    """One micro-batch of classified messages into `path/<kind>/batch=<id>`, the number of rows of each kind returned."""
    batch = batch.persist(StorageLevel.DISK_ONLY)
    try:
        counts = {r["kind"]: r["count"] for r in batch.groupBy("kind").count().collect()}  # five rows at most
        for kind, ddl in (*RECORDS.items(), ("bad", "text string")):
            rows = batch.where(F.col("kind") == kind)
            rows = rows.select("text") if kind == "bad" else rows.select(f"{kind}.*").withColumn("day", F.to_date("created_at"))
            out = rows.write.mode("overwrite").option("compression", "zstd")
            (out if kind == "bad" else out.partitionBy("day")).parquet(f"{path}/{kind}/batch={batch_id}")
        finish(batch.sparkSession, path, batch_id, None, counts)
        return counts
    finally:
        batch.unpersist()


def ingest_stream(messages: DataFrame, path: str, checkpoint: str, column: str = "value", **trigger):
    """A query that parses a stream of messages and routes each record to its type's table, what can't be read to `bad`.

    Each batch's progress has the observed metric `ingest` (n_messages, n_bad). trigger: as writeStream.trigger takes.
    """
    held = classified(messages, column).observe("ingest", F.count("*").alias("n_messages"), F.count_if(F.col("kind") == "bad").alias("n_bad"))
    write = held.writeStream.foreachBatch(lambda batch, batch_id: ingest_batch(batch, batch_id, path) and None)
    return write.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_ingested(spark: SparkSession, path: str, kind: str, start=None, end=None) -> DataFrame:
    """The rows of one kind (a record type or `bad`) in finished batches; for records with start <= created_at < end."""
    ddl = "text string" if kind == "bad" else RECORDS[kind] + ", day date"
    held = read_batches(spark, path, kind, ddl).drop("batch")
    return held if kind == "bad" else time_filter(held, start, end, "created_at", "day").drop("day")


def ingest_counts(spark: SparkSession, path: str) -> DataFrame:
    """batch, kind, n of the finished batches."""
    return finished(spark, path).select("batch", F.explode("counts").alias("kind", "n"))


def summary_batch(spans: DataFrame, batch_id: int, path: str, delay: str) -> None:
    """One micro-batch of spans as partial summaries under `path/parts/batch=<id>`; those of spans behind the watermark apart.

    The watermark is the latest start of all batches before this one less the delay, as the ledger has it, so a retried batch
    or a restarted query takes the same one.
    """
    spark = spans.sparkSession
    before = finished(spark, path).where(F.col("batch") < batch_id)
    high = before.agg(F.max("high")).first()[0]
    mark = F.lit(high).cast("timestamp") - F.expr(f"INTERVAL {delay}")
    spans = spans.persist(StorageLevel.DISK_ONLY)
    try:
        late = F.coalesce(F.col("start_time") < mark, F.lit(False))
        parts = [trace_summaries(spans.where(side)).withColumn("late", F.lit(name)) for name, side in ((False, ~late), (True, late))]
        parts[0].unionByName(parts[1]).write.mode("overwrite").parquet(f"{path}/parts/batch={batch_id}")
        seen = spans.agg(F.max("start_time").alias("high"), F.count("*").alias("n"), F.count_if(late).alias("late")).first()
        finish(spark, path, batch_id, max(filter(None, (high, seen["high"])), default=None), {"spans": seen["n"], "late": seen["late"]})
    finally:
        spans.unpersist()


def summary_stream(spans: DataFrame, path: str, checkpoint: str, delay: str = "15 seconds", **trigger):
    """A query that writes each micro-batch's partial trace summaries; late spans make parts of their own, none is dropped."""
    write = spans.writeStream.foreachBatch(lambda batch, batch_id: summary_batch(batch, batch_id, path, delay))
    return write.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The partial summaries of finished batches, with `batch` and `late`."""
    held = spark.read.option("basePath", f"{path}/parts").parquet(f"{path}/parts").withColumn("batch", F.col("batch").cast("long"))
    return held.join(finished(spark, path).select("batch"), "batch", "left_semi")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """One summary a trace, merged from its parts in time and late."""
    return merge_summaries(read_parts(spark, path))
