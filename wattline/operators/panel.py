"""Load aggregation, covariates and the forecasting panel.

Ids: T1-T9, A1-A7, A19-A22, J1, J2, P6, P11-P16, P20.
The panel is keyed ``(item_id, datetime_15min)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline import NATIONAL_ID, SLOT_MINUTES
from wattline.functions.safe import nan_to_null, safe_div
from wattline.functions.timefn import add_minutes, floor_day, floor_minutes
from wattline.operators.dims import map_codes
from wattline.sources.tables import WEATHER_RAW_COLS

# Fixed names of the seven weather covariates (raw -> panel).
WEATHER_RENAME = {
    "temperature_2m_previous_day1": "temp_forecast",
    "apparent_temperature_previous_day1": "apparent_temp_forecast",
    "relative_humidity_2m_previous_day1": "humidity_forecast",
    "cloud_cover_previous_day1": "cloud_cover_forecast",
    "wind_speed_10m_previous_day1": "wind_speed_forecast",
    "rain_previous_day1": "rain_forecast",
    "surface_pressure_previous_day1": "pressure_forecast",
}
WEATHER_COLS = list(WEATHER_RENAME.values())
HOLIDAY_COLS = ["is_holiday", "is_bridge"]
KNOWN_COV_COLS = WEATHER_COLS + HOLIDAY_COLS
GRAINS = ("national", "region", "group")


def with_slot(readings: DataFrame, ts: str = "datetime_local", width: int = SLOT_MINUTES,
              out: str = "datetime_15min") -> DataFrame:
    """Tumbling floor; rows with a NULL timestamp belong to no slot (D3)."""
    return readings.where(F.col(ts).isNotNull()).withColumn(out, floor_minutes(ts, width))


def _grain_key(readings: DataFrame, grain: str, dim: DataFrame | None, unmapped: str):
    if grain == "national":
        return readings, F.lit(NATIONAL_ID)
    if grain == "region":
        return readings, F.col("community_code")
    if grain == "group":
        if dim is None:
            raise ValueError("group grain needs the region dimension")
        return map_codes(readings, dim, "community_code", "region_group", unmapped=unmapped), F.col("region_group")
    raise ValueError(f"unknown grain {grain!r}")


def load_by(readings: DataFrame, grain: str = "region", dim: DataFrame | None = None,
            width: int = SLOT_MINUTES, unmapped: str = "drop") -> DataFrame:
    """A1/A2/A3: load per (series, slot): exact sum and distinct reporting clients.

    Partial sums are combined map-side; the distinct count is planned as
    (slot, series, client) dedup then count, so a hot series is spread over
    its slots rather than landing in one task.
    """
    r, key = _grain_key(readings, grain, dim, unmapped)
    r = with_slot(r, width=width)
    agg = r.groupBy(key.alias("item_id"), "datetime_15min").agg(
        F.sum("active_kw").alias("active_kw"),
        F.countDistinct("client_id").alias("n_clients"),
    )
    return agg.withColumn("avg_kw_per_client", safe_div("active_kw", "n_clients"))


def load_all_grains(readings: DataFrame, dim: DataFrame, width: int = SLOT_MINUTES) -> DataFrame:
    """A4: national, region and group series in one scan with GROUPING SETS."""
    r = with_slot(map_codes(readings, dim, "community_code", "region_group", unmapped="null"), width=width)
    gs = r.groupingSets(
        [["datetime_15min"], ["datetime_15min", "community_code"], ["datetime_15min", "region_group"]],
        "datetime_15min", "community_code", "region_group",
    ).agg(
        F.sum("active_kw").alias("active_kw"),
        F.countDistinct("client_id").alias("n_clients"),
        F.grouping_id().alias("_gid"),
    )
    # grouping_id bits: community_code = 2, region_group = 1 (1 = aggregated away)
    grain = (F.when(F.col("_gid") == 3, "national")
             .when(F.col("_gid") == 1, "region").otherwise("group"))
    item = (F.when(F.col("_gid") == 3, F.lit(NATIONAL_ID))
            .when(F.col("_gid") == 1, F.col("community_code")).otherwise(F.col("region_group")))
    return gs.select(grain.alias("grain"), item.alias("item_id"), "datetime_15min", "active_kw", "n_clients")


def weather_hourly(weather: DataFrame, admins: DataFrame, grain: str = "region") -> DataFrame:
    """Plain mean over all cities of the target grain (D5), NaN skipped.

    Unmapped admin names are dropped (P6).  Output ``(item_id, date, *_forecast)``.
    """
    key = {"region": "community_code", "group": "region_group"}[grain]
    w = map_codes(weather, admins, "admin_name", key, out="item_id", unmapped="drop")
    return w.groupBy("item_id", "date").agg(
        *[F.avg(nan_to_null(c)).alias(WEATHER_RENAME[c]) for c in WEATHER_RAW_COLS]
    )


def upsample_ffill(df: DataFrame, keys: list[str], ts: str, cols: list[str],
                   width: int = SLOT_MINUTES, extend_last: bool = False,
                   source_minutes: int = 60, out_ts: str = "datetime_15min") -> DataFrame:
    """Carry the last existing row forward onto a ``width`` grid.

    Each row is exploded over ``[ts, next_ts)`` of its own series, so gaps of
    any length carry the whole row (a NULL field stays NULL), and the grid ends
    at the last stamp unless ``extend_last``.  One window per series and no
    join; stamps must lie on the grid.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(width))
    last_end = add_minutes(ts, source_minutes - width) if extend_last else F.col(ts)
    nxt = df.withColumn("_next", F.lead(ts).over(w))
    stop = F.coalesce(add_minutes("_next", -width), last_end)
    exploded = nxt.select(*keys, *cols, F.explode(F.sequence(F.col(ts), stop, step)).alias(out_ts))
    return exploded.select(*keys, out_ts, *cols)


def weather_15min(weather: DataFrame, admins: DataFrame, grain: str = "region",
                  extend_last: bool = False) -> DataFrame:
    hourly = weather_hourly(weather, admins, grain)
    return upsample_ffill(hourly, ["item_id"], "date", WEATHER_COLS, extend_last=extend_last)


def holidays_by(hol: DataFrame, grain: str = "region", dim: DataFrame | None = None) -> DataFrame:
    """One row per (series, day); a duplicate cannot multiply load rows (D12);
    a group is on holiday if any member region is (D11)."""
    h = hol.select(
        "community_code", floor_day("date").alias("date"),
        F.col("is_holiday").cast("int").alias("is_holiday"),
        F.col("is_bridge").cast("int").alias("is_bridge"),
    )
    if grain == "group":
        h = map_codes(h, dim, "community_code", "region_group", out="item_id", unmapped="drop")
    else:
        h = h.withColumnRenamed("community_code", "item_id")
    return h.groupBy("item_id", "date").agg(
        F.max("is_holiday").alias("is_holiday"), F.max("is_bridge").alias("is_bridge")
    )


def build_panel(load: DataFrame, weather15: DataFrame | None, hol: DataFrame | None) -> DataFrame:
    """J1 + J2 + P14: left joins keep every load row; missing holiday rows mean 0."""
    p = load
    if weather15 is not None:
        p = p.join(weather15, ["item_id", "datetime_15min"], "left")
    if hol is not None:
        p = (p.withColumn("date", floor_day("datetime_15min"))
             .join(hol, ["item_id", "date"], "left").drop("date"))
        for c in HOLIDAY_COLS:
            p = p.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("int"))
    return p


def panel_for(spark, sf_dir: str, grain: str = "region") -> DataFrame:
    """Convenience: the full panel of the reference at a grain, from the tables."""
    from wattline.sources import tables as t

    dim = t.region_dim(spark, sf_dir)
    load = load_by(t.readings(spark, sf_dir), grain, dim)
    if grain == "national":
        return load
    w15 = weather_15min(t.weather(spark, sf_dir), t.admin_map(spark, sf_dir), grain)
    hol = holidays_by(t.holidays(spark, sf_dir), grain, dim)
    return build_panel(load, w15, hol)


def covariate_audit(panel: DataFrame) -> DataFrame:
    """Rows with any missing weather, their share, holiday and bridge slots."""
    any_null = F.lit(False)
    for c in WEATHER_COLS:
        any_null = any_null | F.col(c).isNull() | F.isnan(F.col(c))
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(any_null.cast("int")).cast("bigint").alias("n_missing_weather"),
        safe_div(F.sum(any_null.cast("int")), F.count(F.lit(1))).alias("missing_share"),
        F.sum("is_holiday").cast("bigint").alias("holiday_slots"),
        F.sum("is_bridge").cast("bigint").alias("bridge_slots"),
    )


def panel_stats(panel: DataFrame, target: str = "active_kw") -> DataFrame:
    """Series count, rows, length median/min/max, date range, NaN share."""
    per = panel.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("len"),
        F.min("datetime_15min").alias("first_ts"),
        F.max("datetime_15min").alias("last_ts"),
        F.sum((F.col(target).isNull() | F.isnan(target)).cast("int")).alias("n_nan"),
    )
    return per.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.sum("len").alias("n_rows"),
        F.median("len").cast("double").alias("median_len"),
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        safe_div(F.sum("n_nan"), F.sum("len")).alias("nan_share"),
    )


def panel_days(panel: DataFrame) -> DataFrame:
    """Distinct days."""
    return panel.select(floor_day("datetime_15min").alias("day")).distinct()


def _steps_from_end(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.col("datetime_15min").desc())
    return panel.withColumn("_k", F.row_number().over(w))


def head_steps(panel: DataFrame, n: int) -> DataFrame:
    """T4: all but the last ``n`` steps of each series."""
    return _steps_from_end(panel).where(F.col("_k") > n).drop("_k")


def tail_steps(panel: DataFrame, n: int) -> DataFrame:
    """T5: the last ``n`` steps of each series."""
    return _steps_from_end(panel).where(F.col("_k") <= n).drop("_k")


def last_known(panel: DataFrame, col: str = "n_clients", before=None) -> DataFrame:
    """Last value per series (optionally strictly before a cut)."""
    p = panel if before is None else panel.where(F.col("datetime_15min") < F.lit(str(before)).cast("timestamp_ntz"))
    return p.groupBy("item_id").agg(
        F.max_by(col, "datetime_15min").alias(f"{col}_last"),
        F.max("datetime_15min").alias("last_ts"),
    )


def regular_grid(panel: DataFrame, cols: list[str], width: int = SLOT_MINUTES,
                 agg: str = "avg", fill: str | None = None) -> DataFrame:
    """Regularise each series to a full grid from its first to its last slot.

    Rows are first averaged (or summed) per slot, then the grid is exploded per
    series (one row per series, no cross join) and left-joined.  ``fill`` is
    the gap policy: None keeps NULL, 'ffill' carries the last value, 'zero'.
    """
    fn = {"avg": F.avg, "sum": F.sum, "max": F.max}[agg]
    slots = panel.withColumn("_s", floor_minutes("datetime_15min", width)).groupBy("item_id", "_s").agg(
        *[fn(c).alias(c) for c in cols]
    ).withColumnRenamed("_s", "datetime_15min")
    bounds = slots.groupBy("item_id").agg(F.min("datetime_15min").alias("a"), F.max("datetime_15min").alias("b"))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(width))
    grid = bounds.select("item_id", F.explode(F.sequence("a", "b", step)).alias("datetime_15min"))
    out = grid.join(slots, ["item_id", "datetime_15min"], "left")
    out = out.withColumn("observed", F.col(cols[0]).isNotNull().cast("int"))
    if fill == "zero":
        out = out.fillna(0, subset=cols)
    elif fill == "ffill":
        w = Window.partitionBy("item_id").orderBy("datetime_15min").rowsBetween(Window.unboundedPreceding, 0)
        for c in cols:
            out = out.withColumn(c, F.last(c, ignorenulls=True).over(w))
    return out
