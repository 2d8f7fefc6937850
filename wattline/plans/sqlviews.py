"""DuckDB twins of the stand-in views and shared CTEs used by the oracle SQL."""

from wattline.plans.params import FC_START

READINGS = """readings AS (
  SELECT e.user_id AS client_id, e.ts AS datetime_local, n.n_name AS community_code, e.value AS active_kw
  FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

REGION_DIM = """region_dim AS (
  SELECT n.n_name AS admin_name, n.n_name AS community_code, r.r_name AS region_group,
         n.n_nationkey NOT IN (3, 4) AS has_weather
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""

_DEC = "CAST(e.value AS DECIMAL(18,2))"
WEATHER = f"""weather AS (
  SELECT n.n_name AS admin_name, e.user_id AS station, time_bucket(INTERVAL 1 HOUR, e.ts) AS date,
    CAST(SUM({_DEC}) FILTER (WHERE e.event_type = 'view') AS DOUBLE)
      / NULLIF(COUNT(e.value) FILTER (WHERE e.event_type = 'view'), 0) AS temperature_2m_previous_day1,
    CAST(SUM({_DEC}) FILTER (WHERE e.event_type = 'click') AS DOUBLE)
      / NULLIF(COUNT(e.value) FILTER (WHERE e.event_type = 'click'), 0) AS apparent_temperature_previous_day1,
    CAST(MIN({_DEC}) AS DOUBLE) AS relative_humidity_2m_previous_day1,
    CAST(MAX({_DEC}) AS DOUBLE) AS cloud_cover_previous_day1,
    CAST(COUNT(*) AS DOUBLE) AS wind_speed_10m_previous_day1,
    CAST(SUM({_DEC}) AS DOUBLE) AS rain_previous_day1,
    CAST(SUM({_DEC}) AS DOUBLE) / NULLIF(COUNT(e.value), 0) + 1000.0 AS surface_pressure_previous_day1
  FROM events e JOIN customer c ON e.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  WHERE e.event_type IN ('view', 'click') AND n.n_nationkey NOT IN (3, 4) AND e.ts IS NOT NULL
  GROUP BY 1, 2, 3)"""

HOLIDAYS = """holidays AS (
  SELECT CAST(DATE '2024-01-01' + CAST(t.d AS INTEGER) AS TIMESTAMP) AS date, n.n_name AS community_code,
         (n.n_nationkey + t.d) % 13 = 0 AS is_holiday, (n.n_nationkey + t.d) % 13 = 1 AS is_bridge
  FROM nation n CROSS JOIN (SELECT unnest(generate_series(0, date_diff('day', DATE '2024-01-01', CAST(max(ts) AS DATE)))) AS d FROM events) t
  WHERE n.n_nationkey NOT IN (3, 4) AND (n.n_nationkey + t.d) % 13 IN (0, 1))"""

SLOT = "time_bucket(INTERVAL 15 MINUTE, datetime_local)"


def load_cte(name: str, grain: str) -> str:
    """Load per (series, slot) at a grain; needs ``readings`` (and ``region_dim`` for groups)."""
    if grain == "national":
        key, src = "'Total_Grid'", "readings r"
    elif grain == "region":
        key, src = "r.community_code", "readings r"
    else:
        key, src = "d.region_group", "readings r JOIN region_dim d ON r.community_code = d.community_code"
    return f"""{name} AS (
  SELECT {key} AS item_id, time_bucket(INTERVAL 15 MINUTE, r.datetime_local) AS datetime_15min,
         SUM(r.active_kw) AS active_kw, COUNT(DISTINCT r.client_id) AS n_clients,
         SUM(r.active_kw) / COUNT(DISTINCT r.client_id) AS avg_kw_per_client
  FROM {src} WHERE r.datetime_local IS NOT NULL GROUP BY 1, 2)"""


WEATHER_COLS = ["temp_forecast", "apparent_temp_forecast", "humidity_forecast", "cloud_cover_forecast",
                "wind_speed_forecast", "rain_forecast", "pressure_forecast"]
_RAW = ["temperature_2m_previous_day1", "apparent_temperature_previous_day1",
        "relative_humidity_2m_previous_day1", "cloud_cover_previous_day1", "wind_speed_10m_previous_day1",
        "rain_previous_day1", "surface_pressure_previous_day1"]


def weather_hourly_cte(name: str, grain: str) -> str:
    key = "d.community_code" if grain == "region" else "d.region_group"
    avgs = ",\n         ".join(f"AVG(CASE WHEN isnan(w.{r}) THEN NULL ELSE w.{r} END) AS {c}"
                               for r, c in zip(_RAW, WEATHER_COLS))
    return f"""{name} AS (
  SELECT {key} AS item_id, w.date,
         {avgs}
  FROM weather w JOIN region_dim d ON w.admin_name = d.admin_name AND d.has_weather
  GROUP BY 1, 2)"""


def weather_15min_cte(name: str, hourly: str) -> str:
    cols = ", ".join(f"h.{c}" for c in WEATHER_COLS)
    return f"""{name}_bounds AS (SELECT item_id, min(date) AS a, max(date) AS b FROM {hourly} GROUP BY 1),
{name}_grid AS (SELECT item_id, unnest(generate_series(a, b, INTERVAL 15 MINUTE)) AS datetime_15min FROM {name}_bounds),
{name} AS (
  SELECT g.item_id, g.datetime_15min, {cols}
  FROM {name}_grid g ASOF LEFT JOIN {hourly} h ON g.item_id = h.item_id AND g.datetime_15min >= h.date)"""


def holidays_cte(name: str, grain: str) -> str:
    if grain == "region":
        return f"""{name} AS (
  SELECT community_code AS item_id, date_trunc('day', date) AS date,
         MAX(CAST(is_holiday AS INTEGER)) AS is_holiday, MAX(CAST(is_bridge AS INTEGER)) AS is_bridge
  FROM holidays GROUP BY 1, 2)"""
    return f"""{name} AS (
  SELECT d.region_group AS item_id, date_trunc('day', h.date) AS date,
         MAX(CAST(h.is_holiday AS INTEGER)) AS is_holiday, MAX(CAST(h.is_bridge AS INTEGER)) AS is_bridge
  FROM holidays h JOIN region_dim d ON h.community_code = d.community_code GROUP BY 1, 2)"""


def panel_ctes(grain: str) -> list[str]:
    """CTE list ending in ``panel`` for the region or group grain."""
    return [READINGS, REGION_DIM, WEATHER, HOLIDAYS, load_cte("load", grain),
            weather_hourly_cte("wh", grain), weather_15min_cte("w15", "wh"), holidays_cte("hol", grain),
            f"""panel AS (
  SELECT l.*, {', '.join('w.' + c for c in WEATHER_COLS)},
         CAST(coalesce(h.is_holiday, 0) AS INTEGER) AS is_holiday,
         CAST(coalesce(h.is_bridge, 0) AS INTEGER) AS is_bridge
  FROM load l
  LEFT JOIN w15 w ON l.item_id = w.item_id AND l.datetime_15min = w.datetime_15min
  LEFT JOIN hol h ON l.item_id = h.item_id AND date_trunc('day', l.datetime_15min) = h.date)"""]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def rounded(body: str, cols: list[str], digits: int = 6) -> str:
    """Round the named double columns of ``body``'s result."""
    if not cols:
        return body
    scale = f"{10 ** digits}.0"
    rep = ", ".join(f"floor({c} * {scale} + 0.5) / {scale} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{body}\n) AS q"


def origins_cte(name: str, panel: str, start: str, last_day: str) -> str:
    """(item, origin) for days in [start, last_day] with history before the day."""
    return f"""{name}_days AS (SELECT unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{last_day}', INTERVAL 1 DAY)) AS origin),
{name} AS (
  SELECT f.item_id, d.origin
  FROM (SELECT item_id, min(datetime_15min) AS f FROM {panel} GROUP BY 1) f JOIN {name}_days d ON f.f < d.origin)"""


def grid_cte(name: str, orig: str) -> str:
    return f"""{name} AS (
  SELECT item_id, origin, unnest(generate_series(origin, origin + INTERVAL 1425 MINUTE, INTERVAL 15 MINUTE)) AS datetime_15min
  FROM {orig})"""


def hist_mean_cte(name: str, orig: str, panel: str, target: str = "active_kw") -> str:
    return f"""{name} AS (
  SELECT o.item_id, o.origin,
         CAST(sum(CAST(p.{target} AS DECIMAL(28,10))) AS DOUBLE) / count(p.{target}) AS hist_mean
  FROM {orig} o JOIN {panel} p ON p.item_id = o.item_id AND p.datetime_15min < o.origin GROUP BY 1, 2)"""


def seasonal_pred_cte(name: str, grid: str, panel: str, hm: str, season_days: int,
                      target: str = "active_kw") -> str:
    """Seasonal naive with a whole-day season: source = slot - k seasons, k the smallest landing before the origin."""
    k = f"(CAST(floor(date_diff('minute', g.origin, g.datetime_15min) / {season_days * 1440}) AS INTEGER) + 1)"
    return f"""{name} AS (
  SELECT g.*, coalesce(p.{target}, hm.hist_mean) AS prediction
  FROM {grid} g
  LEFT JOIN {panel} p ON p.item_id = g.item_id AND p.datetime_15min = g.datetime_15min - {k} * INTERVAL {season_days} DAY
  LEFT JOIN {hm} hm ON hm.item_id = g.item_id AND hm.origin = g.origin)"""


__all__ = ["FC_START"]
