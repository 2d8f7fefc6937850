"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_columns(ts: str) -> dict[str, Column]:
    """Spark ``dayofweek``: 1 = Sunday ... 7 = Saturday (rule D20)."""
    c = F.col(ts)
    dow = F.dayofweek(c)
    return {
        "hour": F.hour(c),
        "minute": F.minute(c),
        "dow": dow,
        "is_weekend": dow.isin(1, 7).cast("int"),
        "slot": ((F.hour(c) * 60 + F.minute(c)) / 15).cast("int"),
        "day_of_month": F.dayofmonth(c),
        "day_of_year": F.dayofyear(c),
    }


def deepar_time_columns(ts: str) -> dict[str, Column]:
    """Time features scaled to [-0.5, 0.5] as the trained DeepAR pipeline declares.

    Fixed conventions of that feature family (values must match):
    minute_of_hour = minute / 59 - 0.5
    hour_of_day    = hour / 23 - 0.5
    day_of_week    = weekday (Monday = 0) / 6 - 0.5
    day_of_month   = (day - 1) / 30 - 0.5
    day_of_year    = (day of year - 1) / 365 - 0.5
    """
    c = F.col(ts)
    monday0 = (F.dayofweek(c) + 5) % 7
    return {
        "minute_of_hour": F.minute(c) / 59.0 - 0.5,
        "hour_of_day": F.hour(c) / 23.0 - 0.5,
        "day_of_week": monday0 / 6.0 - 0.5,
        "day_of_month": (F.dayofmonth(c) - 1) / 30.0 - 0.5,
        "day_of_year": (F.dayofyear(c) - 1) / 365.0 - 0.5,
    }
