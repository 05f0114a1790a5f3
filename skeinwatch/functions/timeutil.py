"""Time buckets, time-window filters, keyset cursors and pages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def time_bin(ts: Column | str, minutes: float) -> Column:
    """Start of the bucket of `minutes` (may be fractional) that holds ts; buckets are aligned to 1970-01-01."""
    width = round(minutes * 60_000_000)
    if width <= 0:
        raise ValueError("bucket width must be positive")
    micros = F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width)))


def time_trunc(ts: Column | str, unit: str) -> Column:
    """Start of the calendar unit that holds ts."""
    if unit.lower() not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    return F.date_trunc(unit.lower(), ts)


def time_filter(
    df: DataFrame,
    start: datetime | None,
    end: datetime | None,
    ts: str = "start_time",
    partition: str | None = "partition_date",
) -> DataFrame:
    """Rows with start <= ts < end. The bounds on the date partition are added, since the scan can't infer them."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
        if partition in df.columns:
            df = df.where(F.col(partition) >= F.lit(start.date()))
    if end is not None:
        df = df.where(F.col(ts) < F.lit(end))
        if partition in df.columns:
            df = df.where(F.col(partition) <= F.lit((end - timedelta(microseconds=1)).date()))
    return df


def opt_filter(df: DataFrame, **equal) -> DataFrame:
    """Equality filters; those given as None are left out."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def after_cursor(df: DataFrame, keys: list[str], values: list, direction: str = "next") -> DataFrame:
    """Rows strictly after the cursor in descending key order (`next`), or strictly before it (`previous`)."""
    if direction not in ("next", "previous"):
        raise ValueError("direction must be next or previous")
    beyond = F.lit(False)
    equal = F.lit(True)
    for key, value in zip(keys, values, strict=True):
        column, mark = F.col(key), F.lit(value)
        beyond = beyond | (equal & ((column < mark) if direction == "next" else (column > mark)))
        equal = equal & (column == mark)
    return df.where(beyond)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, keys: list[str], limit: int, cursor: list | None = None, direction: str = "next") -> dict:
    """One page in descending key order: rows (at most limit), has_next, has_previous and the cursors of both ends.

    One row more than the page is read to learn whether there is another page.
    """
    held = after_cursor(df, keys, cursor, direction) if cursor else df
    order = [F.desc(k) for k in keys] if direction == "next" else [F.asc(k) for k in keys]
    rows = held.orderBy(*order).limit(limit + 1).collect()
    more, rows = len(rows) > limit, rows[:limit]
    if direction == "previous":
        rows.reverse()
    ends = [[r[k] for k in keys] for r in (rows[-1:] + rows[:1])]
    return {
        "rows": rows,
        "has_next": more if direction == "next" else bool(cursor),
        "has_previous": bool(cursor) if direction == "next" else more,
        "next_cursor": ends[0] if rows else None,
        "previous_cursor": ends[1] if rows else None,
    }
