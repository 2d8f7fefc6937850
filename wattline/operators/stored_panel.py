"""The panel and its lags from bucketed tables, without a shuffle.

Two layouts of the aggregated series:

- *days*: load and covariates in equal buckets of (item_id, date).  The covariates of a
  series' day are one row, with the weather of its slots in a map, so that weather and
  holidays are one join on the bucket keys.
- *series*: load in buckets of item_id.  A lag by time is the value at exactly so long
  before: a range frame of one point, over a window on the bucket key.  It needs no join,
  and all lags share one pass.

Each is written once per load; the shuffle of the write replaces one in every report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline import SLOT_MINUTES
from wattline.functions.timefn import floor_day, slot_of_day
from wattline.operators.panel import HOLIDAY_COLS, WEATHER_COLS
from wattline.sources.catalog_tables import write_bucketed

DAY_KEYS = ["item_id", "date"]


def store_days(load: DataFrame, table: str, path: str, buckets: int | None = None) -> DataFrame:
    days = load.withColumn("date", floor_day("datetime_15min"))
    return write_bucketed(days, table, DAY_KEYS, [*DAY_KEYS, "datetime_15min"], path, buckets)


def store_covariates(weather15: DataFrame, hol: DataFrame, table: str, path: str, buckets: int | None = None) -> DataFrame:
    """A row per (series, day) that has weather or a holiday row: slot -> weather, and the flags."""
    w = weather15.select("item_id", floor_day("datetime_15min").alias("date"), F.struct(slot_of_day("datetime_15min").alias("slot"), F.struct(*WEATHER_COLS).alias("w")).alias("e"))
    w = w.groupBy(*DAY_KEYS).agg(F.map_from_entries(F.collect_list("e")).alias("weather"))  # at most 96 entries
    return write_bucketed(w.join(hol.select(*DAY_KEYS, *HOLIDAY_COLS), DAY_KEYS, "full_outer"), table, DAY_KEYS, DAY_KEYS, path, buckets)


def panel_from(days: DataFrame, covariates: DataFrame) -> DataFrame:
    """``panel.build_panel`` from the two stored tables: every load row, its slot's weather, flags 0 where there is no holiday row."""
    p = days.join(covariates, DAY_KEYS, "left")
    slot = F.try_element_at("weather", slot_of_day("datetime_15min"))
    out = p.select(*[c for c in days.columns if c != "date"], slot.alias("_w"), *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in HOLIDAY_COLS])
    return out.select(*[c for c in days.columns if c != "date"], *[F.col(f"_w.{c}").alias(c) for c in WEATHER_COLS], *HOLIDAY_COLS)


def store_series(load: DataFrame, table: str, path: str, buckets: int | None = None) -> DataFrame:
    return write_bucketed(load, table, ["item_id"], ["item_id", "datetime_15min"], path, buckets)


def lags_from(series: DataFrame, col: str, lags: dict[str, int], step_minutes: int = SLOT_MINUTES) -> DataFrame:
    """``features.lag_time`` over a stored series: name -> steps, exact in time where slots are missing."""
    def at(steps: int):
        back = f"INTERVAL '{steps * step_minutes}' MINUTE PRECEDING"
        return F.expr(f"max(`{col}`) OVER (PARTITION BY item_id ORDER BY datetime_15min RANGE BETWEEN {back} AND {back})")

    return series.withColumns({name: at(n) for name, n in lags.items()})
