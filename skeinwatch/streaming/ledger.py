"""The ledger of a stream's finished micro-batches.

A batch's rows go to folders named by its id, which a retried batch replaces, and its row here is written last: who reads by
the ledger sees a batch in all tables or in none.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEDGER = "batch long, high timestamp, counts map<string,long>"


def finished(spark: SparkSession, path: str) -> DataFrame:
    """batch, high (the latest event time up to it), counts: a row a finished batch."""
    try:
        return spark.read.schema(_LEDGER).option("basePath", f"{path}/ledger").parquet(f"{path}/ledger").select("batch", "high", "counts")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def finish(spark: SparkSession, path: str, batch_id: int, high=None, counts: dict[str, int] | None = None) -> None:
    row = spark.createDataFrame([(high, counts or {})], "high timestamp, counts map<string,long>")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, table: str, ddl: str, after: int | None = None) -> DataFrame:
    """The rows of a table (ddl) in finished batches, those after one only, with `batch`."""
    held = spark.read.schema(f"{ddl}, batch long").option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")
    batches = finished(spark, path).select("batch")
    if after is not None:
        held, batches = held.where(F.col("batch") > after), batches.where(F.col("batch") > after)
    return held.join(F.broadcast(batches) if batches.count() < 100_000 else batches, "batch", "left_semi")
