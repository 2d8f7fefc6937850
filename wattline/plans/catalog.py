"""Registered queries: one Spark plan per operator of the survey, with its DuckDB twin.

Each entry maps ``name -> (fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``.
Double columns are rounded to 6 decimals in both engines so that summation
order cannot change the value hash; everything else is compared exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from wattline.functions.timefn import floor_minutes, raw_range
from wattline.operators import clusters as C
from wattline.operators import evaluate as E
from wattline.operators import features as X
from wattline.operators import forecast as FC
from wattline.operators import panel as P
from wattline.operators import profiles as PR
from wattline.plans import sqlviews as V
from wattline.plans.params import (APPROACH_WINDOWS, AS_OF, ENSEMBLE_WEIGHTS, FC_END, FC_START, HOLDOUT, HORIZON, N_WINDOWS,
                                   PREVIEW_ROWS, PROFILE_END, PROFILE_START, RECENT_DAYS, SUBMITTED_AT, TEAM_NAME)
from wattline.session import ensure_checkpoint_dir
from wattline.sources import sinks as S
from wattline.sources import tables as T

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def snap(c: str, digits: int = 6):
    """``floor(x * 10^d + 0.5) / 10^d``: the same IEEE steps as the oracle SQL, so equal
    inputs give equal outputs even on exact ties (built-in ``round`` differs by engine)."""
    scale = float(10 ** digits)
    x = F.col(c)
    return F.when(F.isnan(x), x).otherwise(F.floor(x * scale + 0.5) / scale)


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    """Snap every double column to ``digits`` decimals (see module doc)."""
    return df.withColumns({f.name: snap(f.name, digits) for f in df.schema.fields
                           if isinstance(f.dataType, (DoubleType, FloatType))})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


# ---------------------------------------------------------------- helpers

def _readings(spark, d):
    return T.readings(spark, d)


def _dim(spark, d):
    return T.region_dim(spark, d)


def _load(spark, d, grain):
    return P.load_by(_readings(spark, d), grain, _dim(spark, d) if grain == "group" else None)


LOAD_COLS = ["item_id", "datetime_15min", "active_kw", "n_clients", "avg_kw_per_client"]
LOAD_DBL = ["active_kw", "avg_kw_per_client"]
WCOLS = P.WEATHER_COLS
PANEL_DBL = LOAD_DBL + WCOLS
FC_LAST_DAY = "2024-01-28"
RESIDUAL_START = "2024-01-17"  # N_WINDOWS days before FC_START


def _w(ctes, body, dbl):
    return V.rounded(V.with_(ctes, body), dbl)


# ---------------------------------------------------------------- T1, A1-A4, P17, P20

for _g in ("national", "region", "group"):
    _ctes = [V.READINGS, V.REGION_DIM, V.load_cte("load", _g)] if _g == "group" else [V.READINGS, V.load_cte("load", _g)]
    query(f"load_{_g}", _w(_ctes, "SELECT * FROM load", LOAD_DBL))(
        (lambda g: lambda spark, d: present(_load(spark, d, g).select(*LOAD_COLS)))(_g))


@query("load_all_grains", _w(
    [V.READINGS, V.REGION_DIM, V.load_cte("ln", "national"), V.load_cte("lr", "region"), V.load_cte("lg", "group")],
    """SELECT 'national' AS grain, item_id, datetime_15min, active_kw, n_clients FROM ln
UNION ALL SELECT 'region', item_id, datetime_15min, active_kw, n_clients FROM lr
UNION ALL SELECT 'group', item_id, datetime_15min, active_kw, n_clients FROM lg""", ["active_kw"]))
def load_all_grains(spark, d):
    return present(P.load_all_grains(_readings(spark, d), _dim(spark, d)))


# ---------------------------------------------------------------- A12, U2, T6, T7, A21

@query("dataset_totals", V.with_([V.READINGS], """SELECT count(*) AS n_rows, count(DISTINCT client_id) AS n_clients,
  min(datetime_local) AS min_dt, max(datetime_local) AS max_dt FROM readings"""))
def dataset_totals(spark, d):
    return PR.dataset_totals(_readings(spark, d))


@query("distinct_clients", V.with_([V.READINGS], "SELECT DISTINCT client_id FROM readings"))
def distinct_clients(spark, d):
    return _readings(spark, d).select("client_id").distinct()


@query("panel_stats", _w([V.READINGS, V.load_cte("load", "region")], """SELECT count(*) AS n_series,
  CAST(sum(len) AS BIGINT) AS n_rows, CAST(median(len) AS DOUBLE) AS median_len, min(len) AS min_len,
  max(len) AS max_len, min(first_ts) AS first_ts, max(last_ts) AS last_ts,
  CAST(sum(n_nan) AS DOUBLE) / sum(len) AS nan_share
FROM (SELECT item_id, count(*) AS len, min(datetime_15min) AS first_ts, max(datetime_15min) AS last_ts,
        CAST(sum(CASE WHEN active_kw IS NULL OR isnan(active_kw) THEN 1 ELSE 0 END) AS INTEGER) AS n_nan
      FROM load GROUP BY 1) s""", ["median_len", "nan_share"]))
def panel_stats(spark, d):
    return present(P.panel_stats(_load(spark, d, "region")))


@query("panel_days", V.with_([V.READINGS, V.load_cte("load", "region")],
                             "SELECT DISTINCT date_trunc('day', datetime_15min) AS day FROM load"))
def panel_days(spark, d):
    return P.panel_days(_load(spark, d, "region"))


# ---------------------------------------------------------------- S2, P6, P18, A5, A6, T2, A7

for _g in ("region", "group"):
    query(f"weather_{_g}_hourly", _w([V.REGION_DIM, V.WEATHER, V.weather_hourly_cte("wh", _g)],
                                     "SELECT * FROM wh", WCOLS))(
        (lambda g: lambda spark, d: present(P.weather_hourly(T.weather(spark, d), T.admin_map(spark, d), g)))(_g))


@query("weather_15min", _w([V.REGION_DIM, V.WEATHER, V.weather_hourly_cte("wh", "region"),
                            V.weather_15min_cte("w15", "wh")], "SELECT * FROM w15", WCOLS))
def weather_15min(spark, d):
    return present(P.weather_15min(T.weather(spark, d), T.admin_map(spark, d), "region"))


@query("holidays_group", V.with_([V.REGION_DIM, V.HOLIDAYS, V.holidays_cte("hol", "group")], "SELECT * FROM hol"))
def holidays_group(spark, d):
    return P.holidays_by(T.holidays(spark, d), "group", _dim(spark, d))


# ---------------------------------------------------------------- J1, J2, P11-P16, T8, T9, A19

for _g in ("region", "group"):
    query(f"panel_{_g}", _w(V.panel_ctes(_g), "SELECT * FROM panel", PANEL_DBL))(
        (lambda g: lambda spark, d: present(P.panel_for(spark, d, g)))(_g))


@query("covariate_audit", _w(V.panel_ctes("region"), f"""SELECT count(*) AS n_rows,
  CAST(sum(CASE WHEN {' OR '.join(f'{c} IS NULL OR isnan({c})' for c in WCOLS)} THEN 1 ELSE 0 END) AS BIGINT) AS n_missing_weather,
  CAST(sum(CASE WHEN {' OR '.join(f'{c} IS NULL OR isnan({c})' for c in WCOLS)} THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS missing_share,
  CAST(sum(is_holiday) AS BIGINT) AS holiday_slots, CAST(sum(is_bridge) AS BIGINT) AS bridge_slots
FROM panel""", ["missing_share"]))
def covariate_audit(spark, d):
    return present(P.covariate_audit(P.panel_for(spark, d, "region")))


# ---------------------------------------------------------------- T3, T4, T5, A22

@query("regular_grid", _w([V.READINGS, V.load_cte("load", "national")], """SELECT g.item_id, g.datetime_15min,
  l.active_kw, CAST(l.active_kw IS NOT NULL AS INTEGER) AS observed
FROM (SELECT item_id, unnest(generate_series(min(datetime_15min), max(datetime_15min), INTERVAL 15 MINUTE)) AS datetime_15min
      FROM load GROUP BY 1) g
LEFT JOIN load l ON g.item_id = l.item_id AND g.datetime_15min = l.datetime_15min""", ["active_kw"]))
def regular_grid(spark, d):
    return present(P.regular_grid(_load(spark, d, "national"), ["active_kw"]))


_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY datetime_15min DESC) AS _k FROM load)"""


@query("head_steps", _w([V.READINGS, V.load_cte("load", "region"), _RANKED],
                        f"SELECT * EXCLUDE (_k) FROM ranked WHERE _k > {HORIZON}", LOAD_DBL))
def head_steps(spark, d):
    return present(P.head_steps(_load(spark, d, "region"), HORIZON))


@query("tail_steps", _w([V.READINGS, V.load_cte("load", "region"), _RANKED],
                        f"SELECT * EXCLUDE (_k) FROM ranked WHERE _k <= {HORIZON}", LOAD_DBL))
def tail_steps(spark, d):
    return present(P.tail_steps(_load(spark, d, "region"), HORIZON))


@query("last_known_clients", V.with_([V.READINGS, V.load_cte("load", "region")], """SELECT item_id,
  arg_max(n_clients, datetime_15min) AS n_clients_last, max(datetime_15min) AS last_ts FROM load GROUP BY 1"""))
def last_known_clients(spark, d):
    return P.last_known(_load(spark, d, "region"))


# ---------------------------------------------------------------- W1, W2, P21, F6, P10, F9

@query("lag_rows", _w([V.READINGS, V.load_cte("load", "national")], """SELECT item_id, datetime_15min, active_kw,
  lag(active_kw, 672) OVER (PARTITION BY item_id ORDER BY datetime_15min) AS lag_7d FROM load""",
                      ["active_kw", "lag_7d"]))
def lag_rows(spark, d):
    l = _load(spark, d, "national").select("item_id", "datetime_15min", "active_kw")
    return present(X.lag_rows(l, "active_kw", {"lag_7d": 672}))


@query("lag_time", _w([V.READINGS, V.load_cte("load", "national")], """SELECT a.item_id, a.datetime_15min,
  a.active_kw, b.active_kw AS lag_7d FROM load a
LEFT JOIN load b ON a.item_id = b.item_id AND b.datetime_15min = a.datetime_15min - INTERVAL 7 DAY""",
                      ["active_kw", "lag_7d"]))
def lag_time(spark, d):
    l = _load(spark, d, "national").select("item_id", "datetime_15min", "active_kw")
    return present(X.lag_time(l, "active_kw", {"lag_7d": 672}))


def _tt_parts():
    """CTEs ending in ``lagged`` and the UNION body of the six target transforms."""
    lags = """lagged AS (
  SELECT l.item_id, l.datetime_15min, l.n_clients, l.active_kw, l.avg_kw_per_client AS pc,
         a.avg_kw_per_client AS t_lag_24h, b.avg_kw_per_client AS t_lag_48h, c.avg_kw_per_client AS t_lag_week,
         (a.avg_kw_per_client + c.avg_kw_per_client) / 2 AS t_lag_dw
  FROM load l
  LEFT JOIN load a ON a.item_id = l.item_id AND a.datetime_15min = l.datetime_15min - INTERVAL 1 DAY
  LEFT JOIN load b ON b.item_id = l.item_id AND b.datetime_15min = l.datetime_15min - INTERVAL 2 DAY
  LEFT JOIN load c ON c.item_id = l.item_id AND c.datetime_15min = l.datetime_15min - INTERVAL 7 DAY)"""
    defs = [("A1_residual_48h", "pc - t_lag_48h", "true"), ("A2_residual_24h", "pc - t_lag_24h", "true"),
            ("A3_residual_weekly", "pc - t_lag_week", "true"), ("A4_residual_dw_avg", "pc - t_lag_dw", "true"),
            ("A5_raw_active_kw", "active_kw", "false"), ("A6_per_client", "pc", "true")]
    body = "\nUNION ALL ".join(
        f"SELECT item_id, datetime_15min, n_clients, '{a}' AS approach, {e} AS target, {r} AS rescale_by_n FROM lagged"
        for a, e, r in defs)
    return [V.READINGS, V.load_cte("load", "region"), lags], \
        f"SELECT * FROM ({body}) u WHERE target IS NOT NULL AND NOT isnan(target)"


def _tt_sql():
    ctes, body = _tt_parts()
    return _w(ctes, body, ["target"])


def _approach_ctes():
    ctes, body = _tt_parts()
    ctes = ctes + [
        f"longt AS (SELECT approach || '#' || item_id AS item_id, approach, datetime_15min, n_clients, target, rescale_by_n FROM ({body}) t)",
        f"""orig AS (SELECT b.item_id, w.wnd, b.last - (w.wnd - 1) * INTERVAL 1 DAY AS origin
  FROM (SELECT item_id, date_trunc('day', max(datetime_15min)) AS last, min(datetime_15min) AS f FROM longt GROUP BY 1) b
  JOIN (SELECT unnest(generate_series(1, {APPROACH_WINDOWS})) AS wnd) w ON b.f < b.last - (w.wnd - 1) * INTERVAL 1 DAY)""",
        V.grid_cte("grid", "orig"), V.hist_mean_cte("hm", "orig", "longt", "target"),
        V.seasonal_pred_cte("p1", "grid", "longt", "hm", 1, "target"), V.seasonal_pred_cte("p7", "grid", "longt", "hm", 7, "target"),
        """pred AS (SELECT 1 AS model, * FROM p1 UNION ALL SELECT 7, * FROM p7)""",
        """bt AS (SELECT p.model, p.item_id, o.wnd, abs(l.target - p.prediction) AS err
  FROM pred p JOIN orig o ON o.item_id = p.item_id AND o.origin = p.origin
  JOIN longt l ON l.item_id = p.item_id AND l.datetime_15min = p.datetime_15min)""",
        """score AS (SELECT item_id, min(m_mae) AS score_val FROM (SELECT model, item_id, avg(w_mae) AS m_mae
  FROM (SELECT model, item_id, wnd, avg(err) AS w_mae FROM bt GROUP BY 1, 2, 3) w GROUP BY 1, 2) m GROUP BY 1)""",
        """lastn AS (SELECT item_id, any_value(approach) AS approach, arg_max(n_clients, datetime_15min) AS n_last,
  bool_or(rescale_by_n) AS rescale FROM longt GROUP BY 1)"""]
    ctes.append("""proxies AS (SELECT l.approach, split_part(s.item_id, '#', 2) AS item_id, l.rescale,
  s.score_val * CASE WHEN l.rescale THEN l.n_last ELSE 1 END AS proxy FROM score s JOIN lastn l ON s.item_id = l.item_id)""")
    return ctes


@query("target_transforms", _tt_sql())
def target_transforms(spark, d):
    return present(X.target_transforms(_load(spark, d, "region")))


@query("calendar_features", _w([V.READINGS, V.load_cte("load", "region")], """SELECT item_id, datetime_15min, active_kw,
  CAST(hour(datetime_15min) AS INTEGER) AS hour, CAST(minute(datetime_15min) AS INTEGER) AS minute,
  CAST(dayofweek(datetime_15min) + 1 AS INTEGER) AS dow,
  CAST(dayofweek(datetime_15min) IN (0, 6) AS INTEGER) AS is_weekend,
  CAST((hour(datetime_15min) * 60 + minute(datetime_15min)) // 15 AS INTEGER) AS slot,
  CAST(dayofmonth(datetime_15min) AS INTEGER) AS day_of_month, CAST(dayofyear(datetime_15min) AS INTEGER) AS day_of_year
FROM load""", ["active_kw"]))
def calendar_features(spark, d):
    l = _load(spark, d, "region").select("item_id", "datetime_15min", "active_kw")
    return present(X.calendar_features(l))


def _deepar_sql():
    lag_cols = ",\n  ".join(f"lag(target_filled, {n}) OVER w AS lag_{n}" for n in X.DEEPAR_LAGS)
    grid = """g AS (SELECT g.item_id, g.datetime_15min, l.active_kw
  FROM (SELECT item_id, unnest(generate_series(min(datetime_15min), max(datetime_15min), INTERVAL 15 MINUTE)) AS datetime_15min
        FROM load GROUP BY 1) g
  LEFT JOIN load l ON g.item_id = l.item_id AND g.datetime_15min = l.datetime_15min),
f AS (SELECT *, CAST(active_kw IS NOT NULL AND NOT isnan(active_kw) AS DOUBLE) AS observed,
             CASE WHEN active_kw IS NOT NULL AND NOT isnan(active_kw) THEN active_kw ELSE 0.0 END AS target_filled
      FROM g)"""
    body = f"""SELECT item_id, datetime_15min, active_kw,
  minute(datetime_15min) / 59.0 - 0.5 AS minute_of_hour, hour(datetime_15min) / 23.0 - 0.5 AS hour_of_day,
  ((dayofweek(datetime_15min) + 6) % 7) / 6.0 - 0.5 AS day_of_week,
  (dayofmonth(datetime_15min) - 1) / 30.0 - 0.5 AS day_of_month, (dayofyear(datetime_15min) - 1) / 365.0 - 0.5 AS day_of_year,
  observed, target_filled, log10(2.0 + row_number() OVER w - 1) AS age,
  {lag_cols}
FROM f WINDOW w AS (PARTITION BY item_id ORDER BY datetime_15min)"""
    dbl = ["active_kw", "minute_of_hour", "hour_of_day", "day_of_week", "day_of_month", "day_of_year",
           "observed", "target_filled", "age"] + [f"lag_{n}" for n in X.DEEPAR_LAGS]
    return _w([V.READINGS, V.load_cte("load", "national"), grid], body, dbl)


@query("deepar_features", _deepar_sql())
def deepar_features(spark, d):
    grid = P.regular_grid(_load(spark, d, "national"), ["active_kw"]).drop("observed")
    return present(X.deepar_features(grid))


# ---------------------------------------------------------------- F1-F5, F17, W4, P1-P4, P24, A13, J6, J7

@query("seasonal_forecast", _w([V.READINGS, V.load_cte("load", "national")], f"""SELECT a.datetime_15min,
  coalesce(b.active_kw, (SELECT avg(active_kw) FROM load WHERE datetime_15min < TIMESTAMP '{FC_START}')) AS prediction
FROM load a LEFT JOIN load b ON b.datetime_15min = a.datetime_15min - INTERVAL 7 DAY
WHERE a.datetime_15min >= TIMESTAMP '{FC_START}' AND a.datetime_15min < TIMESTAMP '{FC_END}'""", ["prediction"]))
def seasonal_forecast(spark, d):
    return present(FC.seasonal_with_mean(_load(spark, d, "national"), FC_START, FC_END))


@query("seasonal_forecast_grid", _w([V.READINGS, V.load_cte("load", "national")], f"""SELECT g.datetime_15min,
  coalesce(b.active_kw, (SELECT avg(active_kw) FROM load WHERE datetime_15min < TIMESTAMP '{FC_START}')) AS prediction
FROM (SELECT unnest(generate_series(TIMESTAMP '{FC_START}', TIMESTAMP '{FC_END}' - INTERVAL 15 MINUTE, INTERVAL 15 MINUTE)) AS datetime_15min) g
LEFT JOIN load b ON b.datetime_15min = g.datetime_15min - INTERVAL 7 DAY""", ["prediction"]))
def seasonal_forecast_grid(spark, d):
    return present(FC.seasonal_grid(_load(spark, d, "national"), FC_START, FC_END))


def _rolling_ctes(season_days: int, panel="load", target="active_kw", name="pred"):
    return [V.origins_cte("orig", panel, FC_START, FC_LAST_DAY), V.grid_cte("grid0", "orig"),
            f"grid AS (SELECT * FROM grid0 WHERE datetime_15min >= TIMESTAMP '{FC_START}' AND datetime_15min < TIMESTAMP '{FC_END}')",
            V.hist_mean_cte("hm", "orig", panel, target),
            V.seasonal_pred_cte(name, "grid", panel, "hm", season_days, target)]


@query("seasonal_naive", _w([V.READINGS, V.load_cte("load", "region")] + _rolling_ctes(1),
                            "SELECT item_id, origin, datetime_15min, prediction FROM pred", ["prediction"]))
def seasonal_naive(spark, d):
    pred = FC.rolling_forecast(FC.SeasonalNaive(96), _load(spark, d, "region"), FC_START, FC_END)
    return present(pred.select("item_id", "origin", "datetime_15min", "prediction"))


@query("rolling_forecast", _w([V.READINGS, V.load_cte("load", "region")] + _rolling_ctes(7),
                              "SELECT item_id, origin, datetime_15min, prediction FROM pred", ["prediction"]))
def rolling_forecast(spark, d):
    pred = FC.rolling_forecast(FC.SeasonalNaive(672), _load(spark, d, "region"), FC_START, FC_END)
    return present(pred.select("item_id", "origin", "datetime_15min", "prediction"))


@query("total_forecast", _w([V.READINGS, V.load_cte("load", "region")] + _rolling_ctes(1),
                            "SELECT datetime_15min, sum(prediction) AS prediction FROM pred GROUP BY 1", ["prediction"]))
def total_forecast(spark, d):
    pred = FC.rolling_forecast(FC.SeasonalNaive(96), _load(spark, d, "region"), FC_START, FC_END)
    return present(FC.contract(FC.to_total(pred), FC_START, FC_END))


@query("per_client_forecast", _w([V.READINGS, V.load_cte("load", "region")] + _rolling_ctes(1, target="avg_kw_per_client") + [
    """lk AS (SELECT o.item_id, o.origin, arg_max(l.n_clients, l.datetime_15min) AS n_last
  FROM orig o JOIN load l ON l.item_id = o.item_id AND l.datetime_15min < o.origin GROUP BY 1, 2)"""],
    """SELECT p.datetime_15min, sum(p.prediction * lk.n_last) AS prediction
FROM pred p JOIN lk ON lk.item_id = p.item_id AND lk.origin = p.origin GROUP BY 1""", ["prediction"]))
def per_client_forecast(spark, d):
    model = FC.SeasonalNaive(96, target="avg_kw_per_client")
    pred = FC.per_client_forecast(model, _load(spark, d, "region"), FC_START, FC_END)
    return present(FC.contract(FC.to_total(pred), FC_START, FC_END))


@query("per_client_forecast_actual", _w([V.READINGS, V.load_cte("load", "region")] + _rolling_ctes(1, target="avg_kw_per_client"),
    """SELECT p.datetime_15min, sum(p.prediction * l.n_clients) AS prediction
FROM pred p LEFT JOIN load l ON l.item_id = p.item_id AND l.datetime_15min = p.datetime_15min GROUP BY 1""", ["prediction"]))
def per_client_forecast_actual(spark, d):
    """Scaled back by the slot's realised client count, as in an evaluation."""
    model = FC.SeasonalNaive(96, target="avg_kw_per_client")
    pred = FC.per_client_forecast(model, _load(spark, d, "region"), FC_START, FC_END, rescale="actual")
    return present(FC.contract(FC.to_total(pred), FC_START, FC_END))


_ENS_SQL_CTES = ([V.READINGS, V.load_cte("load", "region")] + _rolling_ctes(1, name="p1")
                 + [V.seasonal_pred_cte("p7", "grid", "load", "hm", 7)])


@query("ensemble_forecast", _w(_ENS_SQL_CTES, f"""SELECT p1.item_id, p1.origin, p1.datetime_15min,
  {ENSEMBLE_WEIGHTS['SeasonalNaive']} * p1.prediction + {ENSEMBLE_WEIGHTS['SeasonalNaive672']} * p7.prediction AS prediction
FROM p1 JOIN p7 ON p1.item_id = p7.item_id AND p1.origin = p7.origin AND p1.datetime_15min = p7.datetime_15min""",
                               ["prediction"]))
def ensemble_forecast(spark, d):
    ens = FC.WeightedEnsemble([FC.SeasonalNaive(96), FC.SeasonalNaive(672)],
                              [ENSEMBLE_WEIGHTS["SeasonalNaive"], ENSEMBLE_WEIGHTS["SeasonalNaive672"]])
    return present(FC.rolling_forecast(ens, _load(spark, d, "region"), FC_START, FC_END))


# ---------------------------------------------------------------- F14-F16, F20, J4, J5, A14-A18, P23

@query("local_validation", _w([V.READINGS, V.load_cte("load", "national")], f"""SELECT
  avg(abs(act.active_kw - p.prediction)) AS mae, count(*) AS n_matched
FROM (SELECT a.datetime_15min,
        coalesce(b.active_kw, (SELECT avg(active_kw) FROM load WHERE datetime_15min < TIMESTAMP '{FC_START}')) AS prediction
      FROM load a LEFT JOIN load b ON b.datetime_15min = a.datetime_15min - INTERVAL 7 DAY
      WHERE a.datetime_15min >= TIMESTAMP '{FC_START}' AND a.datetime_15min < TIMESTAMP '{FC_END}') p
JOIN (SELECT {V.SLOT} AS datetime_15min, sum(active_kw) AS active_kw FROM readings
      WHERE datetime_local >= TIMESTAMP '{FC_START}' AND datetime_local < TIMESTAMP '{FC_END}' GROUP BY 1) act
  ON p.datetime_15min = act.datetime_15min""", ["mae"]))
def local_validation(spark, d):
    return present(E.local_validation(_readings(spark, d), FC_START, FC_END))


@query("last_day_validation", _w([V.READINGS, V.load_cte("load", "region"), _RANKED,
    f"hist AS (SELECT * EXCLUDE (_k) FROM ranked WHERE _k > {HORIZON})",
    f"val AS (SELECT * EXCLUDE (_k) FROM ranked WHERE _k <= {HORIZON})",
    "orig AS (SELECT item_id, min(datetime_15min) AS origin FROM val GROUP BY 1)",
    "grid AS (SELECT v.item_id, v.datetime_15min, o.origin FROM val v JOIN orig o ON v.item_id = o.item_id)",
    V.hist_mean_cte("hm", "orig", "hist"),
    V.seasonal_pred_cte("pred", "grid", "hist", "hm", 1)],
    """SELECT avg(abs(pt.predicted - act.actual)) AS total_mae, count(*) AS n_steps
FROM (SELECT datetime_15min, sum(prediction) AS predicted FROM pred GROUP BY 1) pt
JOIN (SELECT datetime_15min, sum(active_kw) AS actual FROM val GROUP BY 1) act ON pt.datetime_15min = act.datetime_15min
WHERE pt.predicted IS NOT NULL AND act.actual IS NOT NULL""", ["total_mae"]))
def last_day_validation(spark, d):
    return present(E.last_day_validation(_load(spark, d, "region"), FC.SeasonalNaive(96), HORIZON))


_HOLDOUT_CTES = [V.READINGS, V.load_cte("load", "region"),
                 f"test AS (SELECT * FROM load WHERE datetime_15min >= TIMESTAMP '{HOLDOUT}')",
                 """orig AS (SELECT DISTINCT t.item_id, date_trunc('day', t.datetime_15min) AS origin FROM test t
  JOIN (SELECT item_id, min(datetime_15min) AS f FROM load GROUP BY 1) f ON f.item_id = t.item_id
  WHERE f.f < date_trunc('day', t.datetime_15min))""",
                 V.grid_cte("grid", "orig"), V.hist_mean_cte("hm", "orig", "load"),
                 V.seasonal_pred_cte("pred", "grid", "load", "hm", 1),
                 """slots AS (SELECT pt.datetime_15min, pt.predicted, act.actual, date_trunc('day', pt.datetime_15min) AS date
  FROM (SELECT datetime_15min, sum(prediction) AS predicted FROM pred GROUP BY 1) pt
  JOIN (SELECT datetime_15min, sum(active_kw) AS actual FROM test GROUP BY 1) act ON pt.datetime_15min = act.datetime_15min
  WHERE pt.predicted IS NOT NULL AND act.actual IS NOT NULL)""",
                 """daily AS (SELECT date, avg(abs(predicted - actual)) AS total_MAE_kW, count(*) AS n_steps FROM slots GROUP BY 1)"""]


def _holdout(spark, d):
    return E.holdout_slots(_load(spark, d, "region"), FC.SeasonalNaive(96), HOLDOUT)


@query("holdout_slots", _w(_HOLDOUT_CTES, "SELECT datetime_15min, predicted, actual, date FROM slots",
                           ["predicted", "actual"]))
def holdout_slots(spark, d):
    return present(_holdout(spark, d))


@query("daily_mae", _w(_HOLDOUT_CTES, "SELECT * FROM daily", ["total_MAE_kW"]))
def daily_mae(spark, d):
    return present(E.daily_mae(_holdout(spark, d)))


@query("holdout_summary", _w(_HOLDOUT_CTES, """SELECT count(*) AS days, avg(total_MAE_kW) AS avg_mae,
  median(total_MAE_kW) AS median_mae, min(total_MAE_kW) AS min_mae, max(total_MAE_kW) AS max_mae FROM daily""",
                             ["avg_mae", "median_mae", "min_mae", "max_mae"]))
def holdout_summary(spark, d):
    return present(E.holdout_summary(E.daily_mae(_holdout(spark, d))))


@query("actual_vs_pred", _w([V.READINGS, V.load_cte("load", "region"), V.load_cte("nat", "national")] + _rolling_ctes(1),
                            """SELECT n.datetime_15min, n.active_kw, t.prediction
FROM nat n JOIN (SELECT datetime_15min, sum(prediction) AS prediction FROM pred GROUP BY 1) t
  ON n.datetime_15min = t.datetime_15min""", ["active_kw", "prediction"]))
def actual_vs_pred(spark, d):
    pred = FC.contract(FC.to_total(FC.rolling_forecast(FC.SeasonalNaive(96), _load(spark, d, "region"),
                                                       FC_START, FC_END)), FC_START, FC_END)
    return present(E.actual_vs_pred(pred, _load(spark, d, "national")))


# ---------------------------------------------------------------- F10, F11, A26, A27, S10, P27

def _bt_sql_ctes():
    return [V.READINGS, V.load_cte("load", "region"),
            f"""orig AS (SELECT b.item_id, w.wnd, b.last - (w.wnd - 1) * INTERVAL 1 DAY AS origin
  FROM (SELECT item_id, date_trunc('day', max(datetime_15min)) AS last, min(datetime_15min) AS f FROM load GROUP BY 1) b
  JOIN (SELECT unnest(generate_series(1, {N_WINDOWS})) AS wnd) w ON b.f < b.last - (w.wnd - 1) * INTERVAL 1 DAY)""",
            V.grid_cte("grid", "orig"), V.hist_mean_cte("hm", "orig", "load"),
            V.seasonal_pred_cte("p1", "grid", "load", "hm", 1), V.seasonal_pred_cte("p7", "grid", "load", "hm", 7),
            """bt AS (
  SELECT 'SeasonalNaive' AS model, o.wnd, p.item_id, p.datetime_15min, p.prediction, l.active_kw AS actual
  FROM p1 p JOIN orig o USING (item_id, origin)
  JOIN load l ON l.item_id = p.item_id AND l.datetime_15min = p.datetime_15min
  UNION ALL
  SELECT 'SeasonalNaive672', o.wnd, p.item_id, p.datetime_15min, p.prediction, l.active_kw
  FROM p7 p JOIN orig o USING (item_id, origin)
  JOIN load l ON l.item_id = p.item_id AND l.datetime_15min = p.datetime_15min)""",
            """lb AS (SELECT w.model, -avg(w.w_mae) AS score_val, count(*) AS n_windows, i.n_items
  FROM (SELECT model, wnd, avg(abs(actual - prediction)) AS w_mae FROM bt GROUP BY 1, 2) w
  JOIN (SELECT model, count(DISTINCT item_id) AS n_items FROM bt GROUP BY 1) i ON w.model = i.model
  GROUP BY w.model, i.n_items)"""]


def _bt(spark, d, models=None):
    models = models or [FC.SeasonalNaive(96), FC.SeasonalNaive(672)]
    return E.backtest(_load(spark, d, "region"), models, N_WINDOWS)


@query("backtest_leaderboard", _w(_bt_sql_ctes(), "SELECT * FROM lb", ["score_val"]))
def backtest_leaderboard(spark, d):
    return present(E.leaderboard(_bt(spark, d)))


@query("best_model", _w(_bt_sql_ctes(), """SELECT arg_max(model, score_val) AS best_model, max(score_val) AS score_val
FROM lb""", ["score_val"]))
def best_model(spark, d):
    return present(E.best_model(E.leaderboard(_bt(spark, d))))


@query("regional_bound", _w(_bt_sql_ctes(), "SELECT model, abs(score_val) * n_items AS sum_region_mae FROM lb",
                            ["sum_region_mae"]))
def regional_bound(spark, d):
    return present(E.regional_bound(E.leaderboard(_bt(spark, d))))


@query("metric_log", _w(_bt_sql_ctes(), """SELECT 'val_avg_region_MAE_' || replace(replace(replace(model, ' ', '_'), '[', '_'), ']', '') AS metric,
  abs(score_val) AS value FROM lb
UNION ALL SELECT 'val_sum_region_MAE_' || replace(replace(replace(model, ' ', '_'), '[', '_'), ']', ''),
  abs(score_val) * n_items FROM lb""", ["value"]))
def metric_log(spark, d):
    return present(S.metric_log(E.leaderboard(_bt(spark, d))))


def _quantile_sql():
    """Residuals by a range condition on the origin, not by exploding days."""
    levels = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
    names = [f"q{int(round(lv * 100)):02d}" for lv in levels]
    slot = "CAST((hour({0}) * 60 + minute({0})) // 15 AS INTEGER)"
    out = ", ".join(f"f.prediction + quantile_cont(r.resid, {lv}) AS {n}" for lv, n in zip(levels, names))
    ctes = [V.READINGS, V.load_cte("load", "region"),
            V.origins_cte("orig", "load", RESIDUAL_START, FC_LAST_DAY), V.grid_cte("grid", "orig"), V.hist_mean_cte("hm", "orig", "load"),
            V.seasonal_pred_cte("pred", "grid", "load", "hm", 1),
            """res AS (SELECT p.item_id, p.origin, p.datetime_15min, l.active_kw - p.prediction AS resid
  FROM pred p JOIN load l ON l.item_id = p.item_id AND l.datetime_15min = p.datetime_15min)"""]
    body = f"""SELECT f.item_id, f.origin, f.datetime_15min, f.prediction, {out}
FROM pred f LEFT JOIN res r ON r.item_id = f.item_id AND r.origin < f.origin AND r.origin >= f.origin - INTERVAL {N_WINDOWS} DAY
  AND {slot.format("r.datetime_15min")} = {slot.format("f.datetime_15min")}
WHERE f.datetime_15min >= TIMESTAMP '{FC_START}' AND f.datetime_15min < TIMESTAMP '{FC_END}'
GROUP BY f.item_id, f.origin, f.datetime_15min, f.prediction"""
    return _w(ctes, body, ["prediction"] + names)


@query("quantile_forecast", _quantile_sql())
def quantile_forecast(spark, d):
    return present(E.quantile_forecast(_load(spark, d, "region"), FC.SeasonalNaive(96), FC_START, FC_END, N_WINDOWS))


# ---------------------------------------------------------------- A8-A11, C1, A20, A25, P7, P15, P19, P22, J3

_PROFILE_READ = f"""sample AS (SELECT client_id, community_code, active_kw,
  CAST(hour(datetime_local) AS INTEGER) AS hour, CAST(dayofweek(datetime_local) IN (0, 6) AS INTEGER) AS is_weekend
  FROM readings WHERE datetime_local >= TIMESTAMP '{PROFILE_START}' AND datetime_local < TIMESTAMP '{PROFILE_END}')"""
_EXACT = "sum(CAST(active_kw AS DECIMAL(28,10)))"
_PARTIALS = f"""parts AS (SELECT client_id, community_code, is_weekend, hour,
  {_EXACT} AS sum_kw, sum(active_kw * active_kw) AS sumsq_kw, max(active_kw) AS max_kw, count(active_kw) AS n,
  CAST({_EXACT} AS DOUBLE) / count(active_kw) AS avg_kw, stddev_pop(active_kw) AS std_kw
  FROM sample GROUP BY 1, 2, 3, 4)"""
_STATS = f"""stats AS (
  SELECT r.client_id, r.community_code, s.mean_kw, s.std_kw, s.max_kw
  FROM (SELECT client_id, community_code, row_number() OVER (PARTITION BY client_id ORDER BY count(active_kw) DESC, community_code) AS k
        FROM sample GROUP BY 1, 2) r
  JOIN (SELECT client_id, CAST({_EXACT} AS DOUBLE) / count(active_kw) AS mean_kw, stddev_pop(active_kw) AS std_kw, max(active_kw) AS max_kw
        FROM sample GROUP BY 1) s ON r.client_id = s.client_id
  WHERE r.k = 1)"""
_P95 = "p95 AS (SELECT client_id, quantile_disc(active_kw, 0.95) AS p95_kw FROM sample GROUP BY 1)"
_PIVOT_SRC = """hourly AS (SELECT client_id, 'h' || lpad(CAST(hour AS VARCHAR), 2, '0') || CASE WHEN is_weekend = 1 THEN '_we' ELSE '_wd' END AS col_name,
  CAST(sum(sum_kw) AS DOUBLE) / sum(n) AS avg_kw FROM parts GROUP BY 1, 2)"""
_WIDE = "wide AS (SELECT client_id, " + ", ".join(
    f"coalesce(max(avg_kw) FILTER (WHERE col_name = '{c}'), 0) AS {c}" for c in PR.PIVOT_COLS) + " FROM hourly GROUP BY 1)"
_PROFILE_CTES = [V.READINGS, _PROFILE_READ, _PARTIALS, _STATS, _P95, _PIVOT_SRC, _WIDE,
                 "feats AS (SELECT * FROM stats JOIN p95 USING (client_id) JOIN wide USING (client_id))"]
_FEAT_DBL = ["mean_kw", "std_kw", "max_kw", "p95_kw"] + PR.PIVOT_COLS


def _parts(spark, d):
    return PR.profile_partials(_readings(spark, d), PROFILE_START, PROFILE_END)


@query("profile_partials", _w(_PROFILE_CTES[:3], """SELECT client_id, community_code, is_weekend, hour,
  CAST(sum_kw AS DOUBLE) AS sum_kw, sumsq_kw, max_kw, n, avg_kw, std_kw FROM parts""",
                                 ["avg_kw", "sum_kw", "sumsq_kw", "max_kw", "std_kw"]))
def profile_partials(spark, d):
    p = _parts(spark, d).withColumn("std_kw", F.sqrt(F.try_divide(F.col("m2_kw"), F.col("n"))))
    return present(p.withColumn("sum_kw", F.col("sum_kw").cast("double")).drop("m2_kw"))


@query("client_stats", _w(_PROFILE_CTES[:4], "SELECT * FROM stats", ["mean_kw", "std_kw", "max_kw"]))
def client_stats(spark, d):
    return present(PR.client_stats(_parts(spark, d)))


@query("client_p95", _w([V.READINGS, _PROFILE_READ, _P95], "SELECT * FROM p95", ["p95_kw"]))
def client_p95(spark, d):
    return present(PR.client_p95(_readings(spark, d), PROFILE_START, PROFILE_END))


@query("client_p95_exact", _w([V.READINGS, _PROFILE_READ, _P95], "SELECT * FROM p95", ["p95_kw"]))
def client_p95_exact(spark, d):
    return present(PR.client_p95_exact(_readings(spark, d), PROFILE_START, PROFILE_END))


@query("client_profile_wide", _w(_PROFILE_CTES[:3] + [_PIVOT_SRC, _WIDE], "SELECT * FROM wide", PR.PIVOT_COLS))
def client_profile_wide(spark, d):
    return present(PR.profile_wide(_parts(spark, d)))


def _features(spark, d):
    return PR.client_features(_readings(spark, d), PROFILE_START, PROFILE_END)


@query("client_features", _w(_PROFILE_CTES, "SELECT * FROM feats", _FEAT_DBL))
def client_features(spark, d):
    return present(_features(spark, d))


@query("missing_cells", V.with_(_PROFILE_CTES, "SELECT CAST(sum(" + " + ".join(
    f"CAST({c} IS NULL OR isnan({c}) AS INTEGER)" for c in _FEAT_DBL) + ") AS BIGINT) AS missing_cells, count(*) AS n_rows, "
    "CAST(sum(CASE WHEN " + " OR ".join(f"{c} IS NULL OR isnan({c})" for c in _FEAT_DBL)
    + " OR client_id IS NULL OR community_code IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS rows_complete FROM feats"))
def missing_cells(spark, d):
    return PR.missing_cells(_features(spark, d))


@query("describe_load", _w([V.READINGS], """SELECT count(active_kw) AS count, avg(active_kw) AS mean,
  stddev_samp(active_kw) AS std, min(active_kw) AS min, quantile_cont(active_kw, 0.25) AS p25,
  quantile_cont(active_kw, 0.5) AS p50, quantile_cont(active_kw, 0.75) AS p75, max(active_kw) AS max FROM readings""",
                           ["mean", "std", "min", "p25", "p50", "p75", "max"]))
def describe_load(spark, d):
    return present(PR.describe(_readings(spark, d), "active_kw"))


# ---------------------------------------------------------------- P5, W5, L1, L2, S8, S9

@query("recent_days", _w([V.READINGS, V.load_cte("load", "region")], f"""SELECT * FROM load
WHERE datetime_15min >= (SELECT max(datetime_15min) FROM load) - INTERVAL {RECENT_DAYS} DAY""", LOAD_DBL))
def recent_days(spark, d):
    r = _readings(spark, d)
    last = r.agg(floor_minutes(F.max("datetime_local"))).first()[0]  # one value; map-side partial maxima of one column
    if last is None:
        return present(_load(spark, d, "region"))
    return present(P.load_by(raw_range(r, "datetime_local", last - timedelta(days=RECENT_DAYS)), "region"))


@query("preview", V.with_([V.READINGS], f"""SELECT * FROM readings
ORDER BY datetime_local, client_id, community_code, active_kw LIMIT {PREVIEW_ROWS}"""))
def preview(spark, d):
    return T.preview(_readings(spark, d), ["datetime_local", "client_id", "community_code", "active_kw"], PREVIEW_ROWS)


@query("as_of_cutoff", V.with_([V.READINGS], f"SELECT * FROM readings WHERE datetime_local < TIMESTAMP '{AS_OF}'"))
def as_of_cutoff(spark, d):
    return T.as_of(_readings(spark, d), "datetime_local", AS_OF)


# ---------------------------------------------------------------- A23, A24 on a SQL-definable label

_LABELLED = "lab AS (SELECT *, CAST(client_id % 4 AS INTEGER) AS cluster FROM feats)"


def _labelled(spark, d):
    return _features(spark, d).withColumn("cluster", (F.col("client_id") % 4).cast("int"))


@query("cluster_mix_by_label", _w(_PROFILE_CTES + [_LABELLED], """SELECT community_code, cluster, count(*) AS n,
  count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY community_code) AS pct FROM lab GROUP BY 1, 2""", ["pct"]))
def cluster_mix_by_label(spark, d):
    return present(C.cluster_mix(_labelled(spark, d)))


@query("cluster_spread_by_label", _w(_PROFILE_CTES + [_LABELLED], """SELECT q.cluster, q.q1, q.median, q.q3, q.n,
  min(l.mean_kw) FILTER (WHERE l.mean_kw >= q.q1 - 1.5 * (q.q3 - q.q1)) AS whisker_lo,
  max(l.mean_kw) FILTER (WHERE l.mean_kw <= q.q3 + 1.5 * (q.q3 - q.q1)) AS whisker_hi
FROM (SELECT cluster, quantile_cont(mean_kw, 0.25) AS q1, quantile_cont(mean_kw, 0.5) AS median,
        quantile_cont(mean_kw, 0.75) AS q3, count(mean_kw) AS n FROM lab GROUP BY 1) q
JOIN lab l ON l.cluster = q.cluster GROUP BY q.cluster, q.q1, q.median, q.q3, q.n""",
    ["q1", "median", "q3", "whisker_lo", "whisker_hi"]))
def cluster_spread_by_label(spark, d):
    return present(C.cluster_spread(_labelled(spark, d)))


# ---------------------------------------------------------------- C2-C7 (rows-only: iterative ML)

def _scaled(spark, d):
    return C.scale(_features(spark, d))


@query("cluster_sweep")
def cluster_sweep(spark, d):
    return present(C.sweep_k(_scaled(spark, d)))


@query("client_clusters")
def client_clusters(spark, d):
    return C.fit_clusters(_scaled(spark, d)).select("client_id", "community_code", "mean_kw", "cluster")


@query("cluster_pca")
def cluster_pca(spark, d):
    lab = C.fit_clusters(_scaled(spark, d))
    return present(C.project_2d(lab).select("client_id", "cluster", "pca_x", "pca_y"))


@query("cluster_mix")
def cluster_mix(spark, d):
    return present(C.cluster_mix(C.fit_clusters(_scaled(spark, d))))


@query("cluster_spread")
def cluster_spread(spark, d):
    return present(C.cluster_spread(C.fit_clusters(_scaled(spark, d))))


# ---------------------------------------------------------------- F8, F12, F18, F19 (rows-only: fitted models), F7, S4

def _tree(spark, d):
    from wattline.operators.tree import TreeForecaster
    from wattline.session import cut_lineage

    # the panel is read by the fit, by every lag lookup and by the scoring: materialise it once
    panel = cut_lineage(P.panel_for(spark, d, "region"))
    return panel, TreeForecaster().fit(panel, cutoff=HOLDOUT)


@query("tree_forecast")
def tree_forecast(spark, d):
    panel, model = _tree(spark, d)
    end = "2024-01-31"
    return present(FC.rolling_forecast(model, panel, HOLDOUT, end).select(
        "item_id", "origin", "datetime_15min", "prediction"))


@query("native_importance")
def native_importance(spark, d):
    _, model = _tree(spark, d)
    return present(model.native_importance(spark))


@query("permutation_importance")
def permutation_importance(spark, d):
    from wattline.operators.tree import permutation_importance as pi

    panel, model = _tree(spark, d)
    cutoff = panel.select(F.max("datetime_15min")).scalar() - F.make_dt_interval(F.lit(RECENT_DAYS))
    recent = panel.where(F.col("datetime_15min") >= cutoff)
    feats = ["lag_1d", "lag_2d", "lag_7d"] + P.KNOWN_COV_COLS
    return present(pi(model, panel, recent, feats, repeats=3, seed=0))


_GREEDY_ROUNDS = 10


def _greedy_sql():
    """F12 by a recursive query: a row per round with the picks so far; ties go to the first name."""
    ctes = _bt_sql_ctes()[:-1] + [
        """wide AS (SELECT a.actual, a.prediction AS p1, b.prediction AS p7 FROM bt a
  JOIN bt b ON a.wnd = b.wnd AND a.item_id = b.item_id AND a.datetime_15min = b.datetime_15min
  WHERE a.model = 'SeasonalNaive' AND b.model = 'SeasonalNaive672' AND a.prediction IS NOT NULL AND b.prediction IS NOT NULL AND a.actual IS NOT NULL)""",
        f"""picks AS (SELECT 0 AS r, 0 AS c1, 0 AS c7
  UNION ALL
  SELECT r + 1, c1 + CASE WHEN e1 <= e7 THEN 1 ELSE 0 END, c7 + CASE WHEN e1 <= e7 THEN 0 ELSE 1 END
  FROM (SELECT s.r, s.c1, s.c7, avg(abs(w.actual - (s.c1 * w.p1 + s.c7 * w.p7 + w.p1) / (s.r + 1))) AS e1,
          avg(abs(w.actual - (s.c1 * w.p1 + s.c7 * w.p7 + w.p7) / (s.r + 1))) AS e7
        FROM picks s JOIN wide w ON true WHERE s.r < {_GREEDY_ROUNDS} GROUP BY s.r, s.c1, s.c7) e)"""]
    body = V.with_(ctes, f"""SELECT 'SeasonalNaive' AS model, CAST(c1 AS DOUBLE) / {_GREEDY_ROUNDS} AS weight FROM picks WHERE r = {_GREEDY_ROUNDS}
UNION ALL SELECT 'SeasonalNaive672', CAST(c7 AS DOUBLE) / {_GREEDY_ROUNDS} FROM picks WHERE r = {_GREEDY_ROUNDS}""")
    return V.rounded(body.replace("WITH ", "WITH RECURSIVE ", 1), ["weight"])


@query("ensemble_weights", _greedy_sql())
def ensemble_weights(spark, d):
    return present(E.greedy_weights(_bt(spark, d), rounds=_GREEDY_ROUNDS))


def _approach_models():
    return [FC.SeasonalNaive(96, target="target"), FC.SeasonalNaive(672, target="target")]


@query("approach_comparison", _w(_approach_ctes(), """SELECT approach, spain_total_mae, n_regions, rescale_by_n,
  CAST(row_number() OVER (ORDER BY spain_total_mae, approach) AS INTEGER) AS rank
FROM (SELECT approach, sum(proxy) AS spain_total_mae, count(*) AS n_regions, bool_or(rescale) AS rescale_by_n FROM proxies GROUP BY 1) t""",
                                 ["spain_total_mae"]))
def approach_comparison(spark, d):
    return present(E.approach_comparison(X.target_transforms(_load(spark, d, "region")), APPROACH_WINDOWS, _approach_models()))


@query("best_worst_targets", _w(_approach_ctes(), """SELECT item_id, arg_min(approach, (proxy, approach)) AS best_approach, min(proxy) AS best_mae,
  arg_max(approach, (proxy, approach)) AS worst_approach, max(proxy) AS worst_mae FROM proxies GROUP BY 1""", ["best_mae", "worst_mae"]))
def best_worst_targets(spark, d):
    return present(E.best_worst_targets(E.approach_scores(X.target_transforms(_load(spark, d, "region")), APPROACH_WINDOWS, _approach_models())))


@query("publish_forecast", _w([V.READINGS, V.load_cte("load", "region")] + _rolling_ctes(1),
                              f"""SELECT '{TEAM_NAME}' AS team_name, datetime_15min, sum(prediction) AS prediction,
  TIMESTAMP '{SUBMITTED_AT}' AS submitted_at FROM pred GROUP BY datetime_15min""", ["prediction"]))
def publish_forecast(spark, d):
    """The submission is written, counted on the way, and read back."""
    pred = FC.contract(FC.to_total(FC.rolling_forecast(FC.SeasonalNaive(96), _load(spark, d, "region"),
                                                       FC_START, FC_END)), FC_START, FC_END)
    path = f"{ensure_checkpoint_dir(spark)}/submissions-{uuid.uuid4().hex}"
    S.write_runs(S.publish_forecast(pred, TEAM_NAME, run_id="query", submitted_at=SUBMITTED_AT), path)
    return present(spark.read.parquet(path).drop("run_id").withColumn("submitted_at", F.col("submitted_at").cast("timestamp_ntz")))
