"""Table readers (S1-S3, S8, S9) and the stand-in views of the test tables.

The reference reads four catalog tables: raw readings, hourly weather
forecasts per city, a regional holiday calendar and two small dictionaries.
The generated test data carries none of them, so each reader below defines
the same schema from the given tables (``events``, ``customer``, ``nation``,
``region``).  The derivations are written identically in the oracle SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.timefn import floor_hour, half_open, as_ntz

# Fixed values of the stand-in views (must match the oracle SQL):
# nations 3 and 4 have load but no weather station and no holiday rows;
# the holiday calendar covers the days from 2024-01-01 to the last reading's and
# marks (n_nationkey + day) % 13 == 0 as holiday and == 1 as bridge day.
NO_WEATHER_NATIONS = (3, 4)
HOLIDAY_START = "2024-01-01"
HOLIDAY_MODULUS = 13

WEATHER_RAW_COLS = [
    "temperature_2m_previous_day1",
    "apparent_temperature_previous_day1",
    "relative_humidity_2m_previous_day1",
    "cloud_cover_previous_day1",
    "wind_speed_10m_previous_day1",
    "rain_previous_day1",
    "surface_pressure_previous_day1",
]


#: A source "catalog:db" stands for the tables of a database instead of the files of a folder.
CATALOG = "catalog:"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    if sf_dir.startswith(CATALOG):
        df = spark.table(f"{sf_dir[len(CATALOG):]}.{name}")
    else:
        df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def _dec(col: str):
    """Sum the 2-decimal readings exactly; the result is cast back to double."""
    return F.col(col).cast("decimal(18,2)")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``client_consumption(client_id, datetime_local, community_code, active_kw)``.

    Stand-in: ``events`` joined to its customer's nation.  Only the four
    columns are projected, so the scan reads ``ts, user_id, value`` alone.
    """
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "value"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    nat = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    df = (
        ev.join(cust, ev.user_id == cust.c_custkey)
        .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("user_id").alias("client_id"),
            F.col("ts").alias("datetime_local"),
            F.col("n_name").alias("community_code"),
            F.col("value").alias("active_kw"),
        )
    )
    return as_ntz(df, "datetime_local")


def region_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension admin name -> community code -> climate group.

    ``has_weather`` is false for the regions without a weather station (D9).
    """
    nat = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    reg = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return nat.join(reg, nat.n_regionkey == reg.r_regionkey).select(
        F.col("n_name").alias("admin_name"),
        F.col("n_name").alias("community_code"),
        F.col("r_name").alias("region_group"),
        (~F.col("n_nationkey").isin(*NO_WEATHER_NATIONS)).alias("has_weather"),
    )


def admin_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admin names that have a weather mapping (16 of 18 in the reference)."""
    return region_dim(spark, sf_dir).where("has_weather").drop("has_weather")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly per-station forecasts ``(admin_name, station, date, 7 measures)``.

    Stand-in: one row per (nation, user, hour) from ``view``/``click`` events.
    Means are exact decimal sums divided by counts, then doubles.
    """
    ev = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_type", "value"]).where(
        F.col("event_type").isin("view", "click") & F.col("ts").isNotNull()
    )
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    nat = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]).where(
        ~F.col("n_nationkey").isin(*NO_WEATHER_NATIONS)
    )
    j = (
        ev.join(cust, ev.user_id == cust.c_custkey)
        .join(nat, F.col("c_nationkey") == F.col("n_nationkey"))
        .withColumn("date", floor_hour("ts"))
    )
    view = F.when(F.col("event_type") == "view", _dec("value"))
    click = F.when(F.col("event_type") == "click", _dec("value"))
    d = _dec("value")
    return j.groupBy(F.col("n_name").alias("admin_name"), F.col("user_id").alias("station"), "date").agg(
        F.try_divide(F.sum(view).cast("double"), F.count(view)).alias("temperature_2m_previous_day1"),
        F.try_divide(F.sum(click).cast("double"), F.count(click)).alias("apparent_temperature_previous_day1"),
        F.min(d).cast("double").alias("relative_humidity_2m_previous_day1"),
        F.max(d).cast("double").alias("cloud_cover_previous_day1"),
        F.count(F.lit(1)).cast("double").alias("wind_speed_10m_previous_day1"),
        F.sum(d).cast("double").alias("rain_previous_day1"),
        (F.try_divide(F.sum(d).cast("double"), F.count(d)) + F.lit(1000.0)).alias("surface_pressure_previous_day1"),
    )


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse regional calendar ``(date, community_code, is_holiday, is_bridge)``, to the last reading's day.

    Built by exploding a day sequence per nation row (no cross join).
    """
    nat = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]).where(
        ~F.col("n_nationkey").isin(*NO_WEATHER_NATIONS)
    )
    last = read_table(spark, sf_dir, "events", ["ts"]).agg(F.datediff(F.max("ts"), F.lit(HOLIDAY_START).cast("date")).alias("d")).first()["d"]
    days = nat.withColumn("d", F.explode(F.when(F.lit(last) >= 0, F.sequence(F.lit(0), F.lit(last)))))
    rem = (F.col("n_nationkey") + F.col("d")) % HOLIDAY_MODULUS
    return days.where(rem.isin(0, 1)).select(
        (F.lit(HOLIDAY_START).cast("timestamp_ntz") + F.make_dt_interval(F.col("d"))).alias("date"),
        F.col("n_name").alias("community_code"),
        (rem == 0).alias("is_holiday"),
        (rem == 1).alias("is_bridge"),
    )


def as_of(df: DataFrame, ts: str, cutoff) -> DataFrame:
    """Visibility cutoff (S8): what an interactive user may see, ``ts < cutoff``."""
    return df.where(half_open(ts, None, cutoff))


def preview(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """First ``n`` rows under a total order (S9, L2); ``limit`` is the feature here."""
    return df.orderBy(*order_by).limit(n)
