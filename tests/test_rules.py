"""Semantics rules on hand-made rows (FIXTURES §4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattline.operators import features as X
from wattline.operators import forecast as FC
from wattline.operators import panel as P
from wattline.operators import profiles as PR

T = dt.datetime
RSCHEMA = "client_id long, datetime_local timestamp_ntz, community_code string, active_kw double"


def readings(spark, rows):
    return spark.createDataFrame(rows, RSCHEMA)


def test_slot_borders_half_open(spark):  # D1, D2
    r = readings(spark, [(1, T(2024, 1, 1, 0, 14, 59, 999999), "A", 1.0), (1, T(2024, 1, 1, 0, 15), "A", 2.0)])
    out = P.load_by(r, "region").orderBy("datetime_15min").collect()
    assert [o.datetime_15min for o in out] == [T(2024, 1, 1, 0, 0), T(2024, 1, 1, 0, 15)]


def test_null_timestamp_in_no_slot(spark):  # D3
    r = readings(spark, [(1, None, "A", 5.0), (1, T(2024, 1, 1, 1), "A", 1.0)])
    assert P.load_by(r, "national").agg(F.sum("active_kw")).first()[0] == 1.0


def test_two_readings_one_client(spark):  # D4
    r = readings(spark, [(1, T(2024, 1, 1, 0, 1), "A", 1.0), (1, T(2024, 1, 1, 0, 2), "A", 2.0)])
    row = P.load_by(r, "region").first()
    assert (row.active_kw, row.n_clients) == (3.0, 1)


def test_zero_clients_division_is_null(spark):  # D23
    df = spark.createDataFrame([(1.0, 0)], "a double, n long")
    from wattline.functions.safe import safe_div

    assert df.select(safe_div("a", "n")).first()[0] is None


def _weather(spark, rows):
    cols = ["admin_name", "station", "date"] + list(P.WEATHER_RENAME)
    return spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c == 'admin_name' else 'long' if c == 'station' else 'timestamp_ntz' if c == 'date' else 'double'}" for c in cols))


def _admins(spark):
    return spark.createDataFrame([("a1", "R1", "G"), ("a2", "R2", "G")], "admin_name string, community_code string, region_group string")


def test_group_mean_over_all_cities(spark):  # D5
    h = T(2024, 1, 1)
    rows = [("a1", 1, h, 10.0, *[0.0] * 6)] + [("a2", i, h, 20.0, *[0.0] * 6) for i in (2, 3, 4)]
    out = P.weather_hourly(_weather(spark, rows), _admins(spark), "group").first()
    assert out.temp_forecast == pytest.approx(17.5)


def test_nan_skipped(spark):  # D6
    h = T(2024, 1, 1)
    rows = [("a1", 1, h, float("nan"), *[0.0] * 6), ("a1", 2, h, 4.0, *[0.0] * 6)]
    assert P.weather_hourly(_weather(spark, rows), _admins(spark), "region").first().temp_forecast == 4.0


def test_ffill_gap_and_end(spark):  # D7, D8
    rows = [("R1", T(2024, 1, 1, 0), 1.0), ("R1", T(2024, 1, 1, 1), None), ("R1", T(2024, 1, 1, 4), 3.0)]
    df = spark.createDataFrame(rows, "item_id string, date timestamp_ntz, v double")
    out = {r.datetime_15min: r.v for r in P.upsample_ffill(df, ["item_id"], "date", ["v"]).collect()}
    assert out[T(2024, 1, 1, 0, 45)] == 1.0
    assert out[T(2024, 1, 1, 1, 0)] is None and out[T(2024, 1, 1, 3, 45)] is None
    assert out[T(2024, 1, 1, 4, 0)] == 3.0 and T(2024, 1, 1, 4, 15) not in out
    ext = P.upsample_ffill(df, ["item_id"], "date", ["v"], extend_last=True)
    assert ext.where(F.col("datetime_15min") == T(2024, 1, 1, 4, 45)).count() == 1


def test_holidays_missing_any_and_duplicates(spark):  # D10, D11, D12
    load = spark.createDataFrame([("G", T(2024, 1, 1, 0)), ("G", T(2024, 1, 2, 0)), ("R1", T(2024, 1, 1, 0))],
                                 "item_id string, datetime_15min timestamp_ntz").withColumn("active_kw", F.lit(1.0))
    hol = spark.createDataFrame([(T(2024, 1, 1), "R1", True, False), (T(2024, 1, 1), "R1", True, False),
                                 (T(2024, 1, 1), "R2", False, False)],
                                "date timestamp_ntz, community_code string, is_holiday boolean, is_bridge boolean")
    dim = spark.createDataFrame([("R1", "G"), ("R2", "G"), ("R3", "G")], "community_code string, region_group string")
    g = P.build_panel(load.where("item_id = 'G'"), None, P.holidays_by(hol, "group", dim))
    flags = {r.datetime_15min: r.is_holiday for r in g.collect()}
    assert flags == {T(2024, 1, 1): 1, T(2024, 1, 2): 0}
    r = P.build_panel(load.where("item_id = 'R1'"), None, P.holidays_by(hol, "region"))
    assert r.count() == 1


def test_row_lag_vs_time_lag_with_gap(spark):  # D13
    base = T(2024, 1, 1)
    rows = [("S", base + dt.timedelta(minutes=15 * i), float(i)) for i in range(673 + 96) if i != 700]
    df = spark.createDataFrame(rows, "item_id string, datetime_15min timestamp_ntz, y double")
    probe = base + dt.timedelta(minutes=15 * 750)
    byrow = X.lag_rows(df, "y", {"l": 672}).where(F.col("datetime_15min") == probe).first().l
    bytime = X.lag_time(df, "y", {"l": 672}).where(F.col("datetime_15min") == probe).first().l
    assert bytime == 750 - 672 and byrow != bytime


def test_forecast_ignores_rows_at_or_after_origin(spark):  # D17
    base = T(2024, 1, 1)
    rows = [("S", base + dt.timedelta(minutes=15 * i), float(i % 96)) for i in range(96 * 10)]
    df = spark.createDataFrame(rows, "item_id string, datetime_15min timestamp_ntz, active_kw double")
    changed = df.withColumn("active_kw", F.when(F.col("datetime_15min") >= T(2024, 1, 8), F.lit(1e9)).otherwise(F.col("active_kw")))
    m = FC.SeasonalNaive(96)
    a = FC.rolling_forecast(m, df, "2024-01-08", "2024-01-09").orderBy("datetime_15min").collect()
    b = FC.rolling_forecast(m, changed, "2024-01-08", "2024-01-09").orderBy("datetime_15min").collect()
    assert len(a) == 96 and [x.prediction for x in a] == [x.prediction for x in b]


def test_no_history_no_rows(spark):  # F3
    df = spark.createDataFrame([("S", T(2024, 1, 5), 1.0)], "item_id string, datetime_15min timestamp_ntz, active_kw double")
    assert FC.rolling_forecast(FC.SeasonalNaive(96), df, "2024-01-01", "2024-01-05").count() == 0


def test_rescale_by_last_known_clients(spark):  # D18
    rows = [("S", T(2024, 1, 1, 23, 45), 10.0, 10), ("S", T(2024, 1, 2, 0, 0), 12.0, 12)]
    df = spark.createDataFrame(rows, "item_id string, datetime_15min timestamp_ntz, avg_kw_per_client double, n_clients long")
    m = FC.SeasonalNaive(96, target="avg_kw_per_client")
    out = FC.per_client_forecast(m, df, "2024-01-02", "2024-01-03").where(
        F.col("datetime_15min") == T(2024, 1, 2, 0, 0)).first()
    assert out.prediction == pytest.approx(10.0 * 10)  # hist mean 10 x last known 10 clients


def test_constant_client_std_zero(spark):  # D19
    r = readings(spark, [(1, T(2024, 1, 1, h), "A", 3.3) for h in range(24)])
    s = PR.client_stats(PR.profile_partials(r)).first()
    assert s.std_kw == 0.0


def test_sunday_is_weekend(spark):  # D20
    r = readings(spark, [(1, T(2024, 1, 7, 10), "A", 1.0)])
    p = PR.profile_partials(r).first()
    assert p.is_weekend == 1


def test_client_in_two_regions_stable(spark):  # A9
    r = readings(spark, [(1, T(2024, 1, 1, 1), "B", 1.0), (1, T(2024, 1, 1, 2), "A", 1.0)])
    assert PR.client_stats(PR.profile_partials(r)).first().community_code == "A"


def test_unknown_code_dropped_or_labelled(spark):  # D25
    from wattline.operators.dims import map_codes

    r = readings(spark, [(1, T(2024, 1, 1), "ZZ", 1.0)])
    dim = spark.createDataFrame([("A", "G")], "community_code string, region_group string")
    assert map_codes(r, dim, "community_code", "region_group").count() == 0
    assert map_codes(r, dim, "community_code", "region_group", unmapped="label").first().region_group == "unmapped"


def test_sum_of_regions_equals_national(spark):
    from paths import SF01
    from wattline.sources import tables as TB

    r = TB.readings(spark, SF01)
    nat = P.load_by(r, "national").agg(F.sum("active_kw")).first()[0]
    reg = P.load_by(r, "region").agg(F.sum("active_kw")).first()[0]
    assert nat == pytest.approx(reg)


def test_left_joins_keep_row_count(spark):
    from paths import SF01

    load = P.load_by(__import__("wattline.sources.tables", fromlist=["x"]).readings(spark, SF01), "region")
    assert P.panel_for(spark, SF01, "region").count() == load.count()


def _wavy(spark, days=20, items=("S",)):
    base = T(2024, 1, 1)
    rows = [(s, base + dt.timedelta(minutes=15 * i), float((i * 7 + 13 * k) % 96) + i // 96, 5 + k)
            for k, s in enumerate(items) for i in range(96 * days)]
    return spark.createDataFrame(rows, "item_id string, datetime_15min timestamp_ntz, active_kw double, n_clients int")


def test_quantiles_ensemble_and_tree_ignore_rows_at_or_after_the_origin(spark):  # D17, F8, F12, F13
    from wattline.operators import evaluate as EV
    from wattline.operators.tree import TreeForecaster

    df = _wavy(spark)
    changed = df.withColumn("active_kw", F.when(F.col("datetime_15min") >= T(2024, 1, 15), F.lit(6e5)).otherwise(F.col("active_kw")))
    forecasts = {
        "quantile": lambda p: EV.quantile_forecast(p, FC.SeasonalNaive(96), "2024-01-15", "2024-01-16", 5),
        "ensemble": lambda p: FC.rolling_forecast(FC.WeightedEnsemble([FC.SeasonalNaive(96), FC.SeasonalNaive(672)], [0.5, 0.5]), p, "2024-01-15", "2024-01-16"),
        "tree": lambda p: FC.rolling_forecast(TreeForecaster(max_iter=3).fit(p, cutoff="2024-01-15"), p, "2024-01-15", "2024-01-16"),
    }
    for name, f in forecasts.items():
        a, b = (sorted(tuple(r) for r in f(p).collect()) for p in (df, changed))
        assert len(a) == 96 and a == b, name


def test_quantiles_use_the_days_before_each_origin(spark):  # F13
    from wattline.operators import evaluate as EV

    rows = EV.quantile_forecast(_wavy(spark), FC.SeasonalNaive(96), "2024-01-15", "2024-01-17", 5).collect()
    assert len(rows) == 192
    for r in rows:  # the load rises by 1 a day, so every residual is 1
        assert r["q10"] == pytest.approx(r["prediction"] + 1) and r["q90"] == pytest.approx(r["prediction"] + 1)


@pytest.mark.parametrize("loads", [[0.0004, 0.0006], [0.0005] * 3, [5e6, 5e6 + 1, 5e6 + 2], [2.0e6], [1e-7, 3e-7]])
def test_std_of_small_and_large_loads(spark, loads):  # A8, A9
    import statistics

    r = readings(spark, [(1, T(2024, 1, 1, i), "A", x) for i, x in enumerate(loads)])
    s = PR.client_stats(PR.profile_partials(r)).first()
    assert s.std_kw == pytest.approx(statistics.pstdev(loads), rel=1e-6, abs=1e-15)


def test_exact_p95_of_many_readings(spark):  # A10
    rnd = __import__("random").Random(3)
    base = T(2024, 1, 1)
    rows = [(c, base + dt.timedelta(minutes=i), "A", round(rnd.gammavariate(2, 10), 4)) for c in range(3) for i in range(3000)]
    got = {r.client_id: r.p95_kw for r in PR.client_p95_exact(readings(spark, rows)).collect()}
    for c in range(3):
        values = sorted(x for cc, _, _, x in rows if cc == c)
        assert got[c] == values[-(-95 * len(values) // 100) - 1]


@pytest.mark.parametrize("series", [40, 300])
def test_tree_takes_any_number_of_series(spark, series):  # F8
    from wattline.operators.tree import TreeForecaster

    df = spark.range(series).selectExpr("concat('R', id) item_id", "id").selectExpr(
        "item_id", "explode(sequence(timestamp_ntz'2024-01-01', timestamp_ntz'2024-01-03 23:45:00', interval 6 hours)) datetime_15min", "double(id) active_kw")
    model = TreeForecaster(max_iter=2).fit(df, cutoff="2024-01-03")
    pred = FC.rolling_forecast(model, df, "2024-01-03", "2024-01-04")
    assert pred.select("item_id").distinct().count() == series


def test_missing_covariates_are_flagged(spark):  # F8
    from wattline.operators.tree import TreeForecaster

    df = _wavy(spark, 4).withColumn("temp_forecast", F.when(F.hour("datetime_15min") < 12, F.lit(3.0)))
    m = TreeForecaster(max_iter=1).fit(df)
    rows, names = m.features(df.select("item_id", "datetime_15min"), df)
    assert "has_temp_forecast" in names
    assert {(r.temp_forecast, r.has_temp_forecast) for r in rows.select("temp_forecast", "has_temp_forecast").collect()} == {(3.0, 1), (0.0, 0)}
    ahead = spark.createDataFrame([("S", T(2024, 1, 9), 7.0)], "item_id string, datetime_15min timestamp_ntz, temp_forecast double")
    grid = ahead.select("item_id", "datetime_15min").withColumn("origin", F.col("datetime_15min"))
    assert m.predict(df, grid, covariates=ahead).count() == 1  # a day without any load row


def test_seasonal_grid_beyond_the_data(spark):  # F1
    load = _wavy(spark, 14)
    out = FC.seasonal_grid(load, "2024-02-05", "2024-02-12").collect()
    assert len(out) == 672 and len({r.datetime_15min for r in out}) == 672 and all(r.prediction is not None for r in out)


def test_holidays_span_the_data(spark):  # S3
    from paths import SF01
    from wattline.sources import tables as TB

    last = spark.read.parquet(f"{SF01}/events.parquet").agg(F.to_date(F.max("ts"))).first()[0]
    days = [r[0].date() for r in TB.holidays(spark, SF01).select("date").distinct().collect()]
    assert max(days) == last


def test_refit_and_learned_ensemble(spark):  # F10, F11, F12
    from wattline.operators import evaluate as EV
    from wattline.operators.tree import TreeForecaster

    panel = _wavy(spark, 12, ("S", "R"))
    models = [FC.SeasonalNaive(96), FC.SeasonalNaive(672), TreeForecaster(max_iter=2)]
    bt = EV.backtest(panel, models, 2, refit_every=1)
    board = {r.model: r for r in EV.leaderboard(bt).collect()}
    assert set(board) == {m.name for m in models} and all(r.n_windows == 2 and r.n_items == 2 for r in board.values())
    weights = EV.greedy_weights(bt, rounds=3)
    ens = EV.learned_ensemble(models, weights)
    assert sum(ens.weights) == pytest.approx(1) and {m.name for m in ens.members} <= set(board)


def test_time_range_reaches_the_scan(spark):  # P5
    from paths import SF01
    from wattline.functions.timefn import raw_range
    from wattline.sources import tables as TB

    plan = raw_range(TB.readings(spark, SF01), "datetime_local", "2024-01-20")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan
