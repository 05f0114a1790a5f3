"""Means of a fixed number of samples on a stream (control samples), with what is left over carried on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwatch.functions.ranked import joined, numbered
from skeinwatch.functions.shared import scratch
from skeinwatch.streaming.ledger import finish, finished, read_batches

_SLICES = "feature string, seq long, total double, n long"


def sample_batch(rows: DataFrame, batch_id: int, path: str, n: int) -> None:
    """One micro-batch as partial sums of slices of n values, under `path/slices/batch=<id>`.

    Values of a feature are numbered over range partitions, after those that earlier batches hold of it, so no task holds a
    feature, and a slice that two batches share is one sum in each.
    """
    spark = rows.sparkSession
    with scratch(spark):
        own = numbered(rows.where("value is not null").select("feature", "created_at", "value"), ["created_at", "value"], "__n", ["feature"])
        last = finished(spark, path).where(F.col("batch") < batch_id).agg(F.max("batch")).first()[0]
        if last is None:
            before = spark.createDataFrame([], "feature string, held long")
        else:
            before = spark.read.schema("feature string, held long").parquet(f"{path}/held/batch={last}")
        place = F.col("__n") + F.coalesce("held", F.lit(0))
        slices = joined(own, before, ["feature"], "left").groupBy("feature", F.floor(place / n).alias("seq"))
        slices.agg(F.sum("value").alias("total"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/slices/batch={batch_id}")
    more = spark.read.schema(_SLICES).parquet(f"{path}/slices/batch={batch_id}").select("feature", F.col("n").alias("held"))
    held = before.unionByName(more).groupBy("feature").agg(F.sum("held").alias("held"))
    held.write.mode("overwrite").parquet(f"{path}/held/batch={batch_id}")
    finish(spark, path, batch_id)


def sample_stream(rows: DataFrame, n: int, path: str, checkpoint: str, **trigger):
    """A query over feature, created_at, value rows that writes the sums from which read_samples makes means of each n values.

    Values are ordered by time within a micro-batch; those of a later one come after.
    """
    write = rows.writeStream.foreachBatch(lambda batch, batch_id: sample_batch(batch, batch_id, path, n))
    return write.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_samples(spark: SparkSession, path: str, n: int) -> DataFrame:
    """feature, seq, value: the mean of each n values; a slice that isn't full yet isn't there."""
    slices = read_batches(spark, path, "slices", _SLICES)
    whole = slices.groupBy("feature", "seq").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where(F.col("n") == n)
    return whole.select("feature", "seq", (F.col("total") / n).alias("value"))
