"""Registered queries that answer from what was stored: mergeable partials, bucketed and catalog tables, saved models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wattline.operators import evaluate as E
from wattline.operators import feature_chain as CH
from wattline.operators import forecast as FC
from wattline.operators import panel as P
from wattline.operators import partials as PA
from wattline.operators import persist as PE
from wattline.operators import profiles as PR
from wattline.operators import stored_panel as SP
from wattline.operators import tree as TR
from wattline.plans import catalog as K
from wattline.plans import sqlviews as V
from wattline.plans.catalog import present, query
from wattline.plans.params import (AS_OF, ENSEMBLE_WEIGHTS, FC_END, FC_START, HOLDOUT, N_WINDOWS, PROFILE_END, PROFILE_START, RECENT_DAYS,
                                   REFIT_EVERY, SUBMITTED_AT, TEAM_NAME)
from wattline.session import cut_lineage, ensure_checkpoint_dir
from wattline.sources import catalog_tables as CT
from wattline.sources import sinks as S
from wattline.sources import tables as T


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _two_loads(spark, d):
    """The readings as two batches: those before AS_OF but for late ones, and the rest with the late ones."""
    r = T.readings(spark, d).where(F.col("datetime_local").isNotNull())
    first = (F.col("datetime_local") < F.lit(AS_OF).cast("timestamp_ntz")) & (F.col("client_id") % 10 != 0)
    return r.where(first), r.where(~first)


# ---------------------------------------------------------------- A1-A4 from bitmaps, one scan of the readings

@query("load_all_grains_stored", K.REGISTRY["load_all_grains"][1])
def load_all_grains_stored(spark, d):
    """A4: slot partials with client bitmaps are written by one scan; the three grains come from them."""
    store = PA.DayStore(spark, _folder(spark, "slots"))
    store.load(PA.slot_partials(T.readings(spark, d)), "all", "datetime_15min")
    return present(PA.all_grains_from(store.read(), T.region_dim(spark, d)))


@query("clients_per_day", K._w([V.READINGS], """SELECT community_code AS item_id, date_trunc('day', datetime_local) AS day, sum(active_kw) AS active_kw,
  count(*) AS n_rows, count(DISTINCT client_id) AS n_clients FROM readings WHERE datetime_local IS NOT NULL GROUP BY 1, 2""", ["active_kw"]))
def clients_per_day(spark, d):
    """A2 by day, from partials of client numbers that a dictionary gives (ids of any type)."""
    numbers = PA.number_clients(T.read_table(spark, d, "customer", ["c_custkey"]).withColumnRenamed("c_custkey", "client_id"))
    store = PA.DayStore(spark, _folder(spark, "slots"))
    store.load(PA.slot_partials(T.readings(spark, d), numbers), "all", "datetime_15min")
    return present(PA.clients_per_day(store.read()))


# ---------------------------------------------------------------- A2, A8 kept up by two loads

@query("load_region_two_loads", K.REGISTRY["load_region"][1])
def load_region_two_loads(spark, d):
    store = PA.DayStore(spark, _folder(spark, "slots"))
    for i, batch in enumerate(_two_loads(spark, d)):
        store.load(PA.slot_partials(batch), f"load{i}", "datetime_15min")
    return present(PA.load_from(store.read()).select(*K.LOAD_COLS))


@query("profile_partials_two_loads", K.REGISTRY["profile_partials"][1])
def profile_partials_two_loads(spark, d):
    store = PA.DayStore(spark, _folder(spark, "profiles"))
    for i, batch in enumerate(_two_loads(spark, d)):
        store.load(PA.daily_profiles(batch), f"load{i}", "client_id")
    p = PA.merge_profiles(store.read(PROFILE_START, PROFILE_END)).withColumn("std_kw", F.sqrt(F.try_divide(F.col("m2_kw"), F.col("n"))))
    return present(p.withColumn("sum_kw", F.col("sum_kw").cast("double")).drop("m2_kw"))


@query("client_stats_two_loads", K.REGISTRY["client_stats"][1])
def client_stats_two_loads(spark, d):
    """A9 from the merged partials of two loads."""
    store = PA.DayStore(spark, _folder(spark, "profiles"))
    for i, batch in enumerate(_two_loads(spark, d)):
        store.load(PA.daily_profiles(batch), f"load{i}", "client_id")
    return present(PR.client_stats(PA.merge_profiles(store.read(PROFILE_START, PROFILE_END))))


# ---------------------------------------------------------------- A10 from stored sketches

_WINDOWS = {"profile": (PROFILE_START, PROFILE_END), "before_forecast": (AS_OF, FC_START)}


@query("client_p95_windows", K._w([V.READINGS], "\nUNION ALL ".join(
    f"""SELECT '{name}' AS sample, client_id, count(active_kw) AS n, quantile_disc(active_kw, 0.95) AS p95_kw
FROM readings WHERE datetime_local >= TIMESTAMP '{a}' AND datetime_local < TIMESTAMP '{b}' GROUP BY client_id""" for name, (a, b) in _WINDOWS.items()), ["p95_kw"]))
def client_p95_windows(spark, d):
    """Two windows from one stored table of daily sketches (exact for clients of at most SKETCH_K readings)."""
    store = PA.DayStore(spark, _folder(spark, "sketches"))
    store.load(PA.daily_sketches(T.readings(spark, d)), "all", "client_id")
    each = [PA.p95_from(store.read(a, b)).withColumn("sample", F.lit(name)) for name, (a, b) in _WINDOWS.items()]
    return present(each[0].unionByName(each[1]))


# ---------------------------------------------------------------- W2, J1, J2 from bucketed tables

@query("lag_time_stored", K.REGISTRY["lag_time"][1])
def lag_time_stored(spark, d):
    """W2 without a join or a shuffle of its own: a point frame over the bucketed series."""
    name = f"series_{uuid.uuid4().hex}"
    load = P.load_by(T.readings(spark, d), "national").select("item_id", "datetime_15min", "active_kw")
    return present(SP.lags_from(SP.store_series(load, name, _folder(spark, "series")), "active_kw", {"lag_7d": 672}))


@query("panel_region_stored", K.REGISTRY["panel_region"][1])
def panel_region_stored(spark, d):
    """J1, J2 as one join of two tables in equal buckets."""
    name = uuid.uuid4().hex
    days = SP.store_days(P.load_by(T.readings(spark, d), "region"), f"days_{name}", _folder(spark, "days"))
    cov = SP.store_covariates(P.weather_15min(T.weather(spark, d), T.admin_map(spark, d), "region"), P.holidays_by(T.holidays(spark, d), "region"),
                              f"covariates_{name}", _folder(spark, "covariates"))
    return present(SP.panel_from(days, cov))


# ---------------------------------------------------------------- S1, S4, S5 through the catalog

def _catalog(spark, d) -> str:
    name = f"raw_{uuid.uuid4().hex}"
    return CT.register_sources(spark, d, name, _folder(spark, "db"), ["events", "customer", "nation", "region"])


@query("panel_group_catalog", K.REGISTRY["panel_group"][1])
def panel_group_catalog(spark, d):
    """Readings, weather, holidays and dimensions read from catalog tables."""
    return present(P.panel_for(spark, _catalog(spark, d), "group"))


@query("publish_forecast_table", K.REGISTRY["publish_forecast"][1])
def publish_forecast_table(spark, d):
    """Another team's run and this one in one table; this one is published twice and read back."""
    source = _catalog(spark, d)
    pred = FC.contract(FC.to_total(FC.rolling_forecast(FC.SeasonalNaive(96), P.load_by(T.readings(spark, source), "region"), FC_START, FC_END)), FC_START, FC_END)
    rows = S.publish_forecast(pred, TEAM_NAME, submitted_at=SUBMITTED_AT)
    table = f"{source[len(CT.CATALOG):]}.submissions"
    CT.write_run(rows.withColumn("team_name", F.lit("another")).limit(3), table, "another", _folder(spark, "submissions"))
    for _ in range(2):
        CT.write_run(rows, table, "query")
    return present(CT.read_run(spark, table, "query").withColumn("submitted_at", F.col("submitted_at").cast("timestamp_ntz")))


# ---------------------------------------------------------------- F3, F8, F9, F12: saved, loaded, applied

@query("deepar_features_saved", K.REGISTRY["deepar_features"][1])
def deepar_features_saved(spark, d):
    """the declared chain is saved, and a chain loaded from its folder makes the features."""
    path = _folder(spark, "chain")
    CH.save_chain(CH.deepar_chain(), path)
    load = P.load_by(T.readings(spark, d), "national").select("item_id", "datetime_15min", "active_kw")
    return present(CH.load_chain(path).transform(load))


@query("ensemble_forecast_saved", K.REGISTRY["ensemble_forecast"][1])
def ensemble_forecast_saved(spark, d):
    """a saved ensemble, loaded, makes the rolling forecast."""
    path = _folder(spark, "ensemble")
    PE.save_predictor(spark, FC.WeightedEnsemble([FC.SeasonalNaive(96), FC.SeasonalNaive(672)],
                                                 [ENSEMBLE_WEIGHTS["SeasonalNaive"], ENSEMBLE_WEIGHTS["SeasonalNaive672"]]), path)
    return present(FC.rolling_forecast(PE.load_predictor(spark, path), P.load_by(T.readings(spark, d), "region"), FC_START, FC_END))


@query("tree_forecast_saved")
def tree_forecast_saved(spark, d):
    """The tree is fitted once and saved; the loaded one forecasts."""
    panel, path = cut_lineage(P.panel_for(spark, d, "region")), _folder(spark, "tree")
    PE.save_predictor(spark, TR.TreeForecaster().fit(panel, cutoff=HOLDOUT), path)
    return present(FC.rolling_forecast(PE.load_predictor(spark, path), panel, HOLDOUT, "2024-01-31").select("item_id", "origin", "datetime_15min", "prediction"))


# ---------------------------------------------------------------- F10, F11: refits, order, times

def _refit_sql():
    n = "hour({0}) * 60 + minute({0})"
    ctes = K._bt_sql_ctes()
    bt = ctes[-2][:-1] + f"""
  UNION ALL
  SELECT 'SlotMean', o.wnd, g.item_id, g.datetime_15min, coalesce(s.m, h.m), l.active_kw
  FROM grid g JOIN orig o USING (item_id, origin) JOIN gens n ON n.gen = (o.wnd - 1) // {REFIT_EVERY}
  JOIN load l ON l.item_id = g.item_id AND l.datetime_15min = g.datetime_15min
  LEFT JOIN slots s ON s.gen = n.gen AND s.item_id = g.item_id AND s.slot = {n.format("g.datetime_15min")}
  LEFT JOIN whole h ON h.gen = n.gen AND h.item_id = g.item_id)"""
    mean = "CAST(sum(CAST(l.active_kw AS DECIMAL(28,10))) AS DOUBLE) / count(l.active_kw) AS m FROM gens n JOIN load l ON l.datetime_15min < n.cutoff"
    ctes = ctes[:-2] + [f"gens AS (SELECT (wnd - 1) // {REFIT_EVERY} AS gen, min(origin) AS cutoff FROM orig GROUP BY 1)",
                        f"slots AS (SELECT n.gen, l.item_id, {n.format('l.datetime_15min')} AS slot, {mean} GROUP BY 1, 2, 3)",
                        f"whole AS (SELECT n.gen, l.item_id, {mean} GROUP BY 1, 2)", bt, ctes[-1]]
    return K._w(ctes, """SELECT lb.*, CAST(row_number() OVER (ORDER BY score_val DESC, lb.model) AS INTEGER) AS rank, o.fit_order
FROM lb JOIN (VALUES ('SeasonalNaive', 1), ('SeasonalNaive672', 2), ('SlotMean', 3)) o(model, fit_order) ON o.model = lb.model""", ["score_val"])


@query("leaderboard_refit", _refit_sql())
def leaderboard_refit(spark, d):
    """three models, fitted anew every second window where there is something to fit; times are left out of the rows."""
    models = [FC.SeasonalNaive(96), FC.SeasonalNaive(672), FC.SlotMean()]
    bt, times = E.timed_backtest(P.load_by(T.readings(spark, d), "region"), models, N_WINDOWS, refit_every=REFIT_EVERY)
    return present(E.ranked_leaderboard(bt, times).drop("fits", "fit_time", "pred_time"))


@query("leaderboard_tree")
def leaderboard_tree(spark, d):
    """The tree, refitted every second window, beside the seasonal models; with fits and times."""
    models = [FC.SeasonalNaive(96), FC.SlotMean(), TR.TreeForecaster(max_iter=5, max_depth=4)]
    return present(E.ranked_leaderboard(*E.timed_backtest(P.panel_for(spark, d, "region"), models, N_WINDOWS, refit_every=REFIT_EVERY)))


# ---------------------------------------------------------------- F18 on a fixed scorer

SCORER = {"lag_1d": 0.4, "lag_2d": 0.1, "lag_7d": 0.3, "temp_forecast": 0.25, "is_holiday": 3.0}
_REPEATS = 3


def _importance_sql():
    x = {"lag_1d": "a.active_kw", "lag_2d": "b.active_kw", "lag_7d": "c.active_kw", "temp_forecast": "p.temp_forecast", "is_holiday": "p.is_holiday"}
    given = ", ".join(f"CASE WHEN {v} IS NULL OR isnan(CAST({v} AS DOUBLE)) THEN 0 ELSE {v} END AS {c}" for c, v in x.items())
    lag = "LEFT JOIN panel {0} ON {0}.item_id = p.item_id AND {0}.datetime_15min = p.datetime_15min - INTERVAL {1} DAY"
    score = " + ".join(f"{w} * {c}" for c, w in SCORER.items())
    ctes = V.panel_ctes("region") + [
        f"""feats AS (SELECT p.item_id, p.datetime_15min, p.active_kw, {given} FROM panel p
  {lag.format("a", 1)} {lag.format("b", 2)} {lag.format("c", 7)}
  WHERE p.datetime_15min >= (SELECT max(datetime_15min) FROM panel) - INTERVAL {RECENT_DAYS} DAY)""",
        f"base AS (SELECT *, {score} AS s, row_number() OVER (PARTITION BY item_id ORDER BY datetime_15min) AS i FROM feats)",
        f"""perm AS (SELECT r.r, b.*, row_number() OVER (PARTITION BY r.r, item_id
    ORDER BY md5(item_id || '|' || CAST(datetime_15min AS VARCHAR) || '|' || CAST(r.r AS VARCHAR)), datetime_15min) AS k
  FROM base b CROSS JOIN (SELECT unnest(range({_REPEATS})) AS r) r)""",
        "moved AS (" + "\nUNION ALL ".join(f"""SELECT '{c}' AS feature, m.r, avg(abs(b.active_kw - (b.s + {w} * (m.{c} - b.{c})))) AS mae
  FROM base b JOIN perm m ON m.item_id = b.item_id AND m.k = b.i GROUP BY m.r""" for c, w in SCORER.items()) + ")"]
    return K._w(ctes, """SELECT feature, avg(d) AS importance, stddev_samp(d) AS stddev, count(*) AS n
FROM (SELECT feature, mae - (SELECT avg(abs(active_kw - s)) FROM base) AS d FROM moved) q GROUP BY feature""", ["importance", "stddev"])


@query("permutation_importance_linear", _importance_sql())
def permutation_importance_linear(spark, d):
    panel = cut_lineage(P.panel_for(spark, d, "region"))
    cutoff = panel.select(F.max("datetime_15min")).scalar() - F.make_dt_interval(F.lit(RECENT_DAYS))
    return present(TR.permutation_importance(TR.LinearScorer(SCORER), panel, panel.where(F.col("datetime_15min") >= cutoff), list(SCORER), _REPEATS))
