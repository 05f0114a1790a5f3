"""A book of queries: name, function and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[name] = f
            if sql is not None:
                self.oracle[name] = sql
            return f

        return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and timestamps as text, so that two engines' results compare as values."""
    made = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            made[name] = F.round(F.col(name).cast("double"), digits) + F.lit(0.0)
        elif kind in ("timestamp", "timestamp_ntz"):
            made[name] = F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.withColumns(made) if made else df


def stamp(expr: str, name: str | None = None) -> str:
    """SQL of a timestamp as the same text."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') AS {name or expr}"
