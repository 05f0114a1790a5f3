"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder on a local master and an error on a cluster."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


def new_folder(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are written within this block are deleted at its end, but those written with keep.

    Nothing that is read after the block may depend on them.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written as Parquet under the shared folder and read back: lineage is cut, later uses don't recompute.

    keep: the table outlives the innermost scratch block.
    """
    path = new_folder(df.sparkSession, name)
    stack = _scopes.__dict__.get("stack", [])
    if len(stack) > keep:
        stack[-1 - keep].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
