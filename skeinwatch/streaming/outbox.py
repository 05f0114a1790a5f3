"""The dispatch outbox as a stream without state: each batch logs its own pairs, readers merge, compaction keeps it short."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwatch.streaming.ledger import finish, finished, read_batches


def _merged(pairs: DataFrame) -> DataFrame:
    """A row a pair: flags only ever turn true, and times only widen, so the order of batches doesn't matter."""
    return pairs.groupBy("trace_id", "entity_id").agg(
        F.min("start_time").alias("start_time"), F.max("last_time").alias("last_time"), F.bool_or("c").alias("c"), F.bool_or("a").alias("a")
    )


def log_batch(log: DataFrame, batch_id: int, path: str) -> None:
    pairs = log.select(
        "trace_id", "entity_id", "start_time", F.col("start_time").alias("last_time"),
        (F.col("event") == "candidate").alias("c"), (F.col("event") == "ack").alias("a"),
    )
    _merged(pairs).write.mode("overwrite").parquet(f"{path}/pairs/batch={batch_id}")
    finish(log.sparkSession, path, batch_id)


def pending_dispatch_stream(log: DataFrame, path: str, checkpoint: str, **trigger):
    """A query that appends, for each micro-batch of a dispatch log, one row of each pair in it; a retried batch replaces its own."""
    write = log.writeStream.foreachBatch(lambda batch, batch_id: log_batch(batch, batch_id, path))
    return write.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """The newest and the next newest finished snapshots, by the last batch that they hold."""
    held = finished(spark, f"{path}/snapshots").select("batch").orderBy(F.desc("batch")).limit(2).collect()
    return [r["batch"] for r in held]


def _pairs(spark: SparkSession, path: str) -> DataFrame:
    """Every pair's state: the newest snapshot and the batches after it."""
    newest = _snapshots(spark, path)[:1]
    ddl = spark.read.parquet(f"{path}/snapshots/upto={newest[0]}" if newest else f"{path}/pairs").drop("batch").schema
    text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ddl)
    after = read_batches(spark, path, "pairs", text, newest[0] if newest else None).drop("batch")
    whole = after.unionByName(spark.read.schema(ddl).parquet(f"{path}/snapshots/upto={newest[0]}")) if newest else after
    return _merged(whole)


def read_pending(spark: SparkSession, path: str) -> DataFrame:
    """trace_id, entity_id, start_time of the pairs with a candidate and no ack in finished batches."""
    return _pairs(spark, path).where("c and not a").select("trace_id", "entity_id", "start_time")


def compact(spark: SparkSession, path: str, keep: timedelta | None = None) -> int | None:
    """Write a snapshot of all finished batches, and delete the batches and snapshots that the one before it replaced.

    Readers go by the ledger of snapshots, whose row is written last, and what they may still read stays until the next
    compaction. keep: acked pairs whose last event is older than the latest one less this are forgotten; a candidate that
    comes later still counts as new. Returns the last batch in the snapshot, or None where there is nothing new.
    """
    upto = finished(spark, path).agg(F.max("batch")).first()[0]
    before = _snapshots(spark, path)
    if upto is None or upto in before[:1]:
        return None
    pairs = _pairs(spark, path)
    if keep is not None:
        latest = pairs.agg(F.max("last_time")).first()[0]
        pairs = pairs.where(~F.col("a") | (F.col("last_time") >= F.lit(latest - keep)))
    pairs.write.mode("overwrite").parquet(f"{path}/snapshots/upto={upto}")
    finish(spark, f"{path}/snapshots", upto)
    if before:
        _delete(spark, f"{path}/pairs", "batch", before[0])
        _delete(spark, f"{path}/snapshots", "upto", before[0] - 1)
    return upto


def _delete(spark: SparkSession, folder: str, name: str, upto: int) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(at):
        key, _, value = status.getPath().getName().partition("=")
        if key == name and value.isdigit() and int(value) <= upto:
            fs.delete(status.getPath(), True)
