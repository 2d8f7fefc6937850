"""Time floors and half-open ranges on TIMESTAMP_NTZ (local wall-clock).

All floors are plain arithmetic, so they stay inside whole-stage codegen, can
be used several times in one projection (unlike ``window``), never introduce a
session time zone, and treat clock changes as wall-clock (rule D14).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_ntz(df: DataFrame, col: str) -> DataFrame:
    """Zoned timestamps become local wall-clock NTZ in the session zone."""
    if not isinstance(df.schema[col].dataType, TimestampNTZType):
        df = df.withColumn(col, F.col(col).cast("timestamp_ntz"))
    return df


def floor_day(col: str | Column) -> Column:
    """Midnight of the day, kept NTZ (``date_trunc`` would return a zoned type)."""
    return _c(col).cast("date").cast("timestamp_ntz")


def floor_minutes(col: str | Column, minutes: int = 15) -> Column:
    """Floor to a ``minutes`` grid that divides the day; NULL stays NULL (D3)."""
    c = _c(col)
    if (24 * 60) % minutes:
        raise ValueError("bucket width must divide a day")
    since_midnight = F.hour(c) * 60 + F.minute(c)
    slot_start = F.floor(since_midnight / F.lit(minutes)).cast("int") * F.lit(minutes)
    return floor_day(c) + F.make_dt_interval(F.lit(0), F.lit(0), slot_start)


def floor_hour(col: str | Column) -> Column:
    return floor_minutes(col, 60)


def slot_of_day(col: str | Column, minutes: int = 15) -> Column:
    c = _c(col)
    return F.floor((F.hour(c) * 60 + F.minute(c)) / F.lit(minutes)).cast("int")


def add_minutes(col: str | Column, minutes) -> Column:
    m = minutes if isinstance(minutes, Column) else F.lit(int(minutes))
    return _c(col) + F.make_dt_interval(F.lit(0), F.lit(0), m)


def _ts_lit(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def half_open(col: str | Column, start=None, end=None) -> Column:
    """``start <= col < end`` (rule D1); either bound may be None."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (_c(col) >= _ts_lit(start))
    if end is not None:
        cond = cond & (_c(col) < _ts_lit(end))
    return cond


def raw_range(df: DataFrame, ts: str, start=None, end=None, lookback_minutes: int = 0) -> DataFrame:
    """Filter on the *raw* timestamp so the predicate reaches the Parquet scan.

    A filter on a derived bucket column is not pushed into the file scan; since
    ``bucket >= a`` equals ``ts >= a`` for any ``a`` on the grid, we translate
    the requested bucket range (plus a lag look-back) to the raw column.
    """
    lo = None
    if start is not None:
        lo = _ts_lit(start)
        if lookback_minutes:
            lo = add_minutes(lo, -int(lookback_minutes))
    return df.where(half_open(ts, lo, end))
