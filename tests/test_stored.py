"""Catalog tables, bucketed layouts, saved chains and predictors, refits."""

import datetime as dt
import math
import os
import random
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from paths import SF001, SF01
from wattline.operators import evaluate as E
from wattline.operators import feature_chain as CH
from wattline.operators import features as X
from wattline.operators import forecast as FC
from wattline.operators import panel as P
from wattline.operators import persist as PE
from wattline.operators import stored_panel as SP
from wattline.operators.tree import LinearScorer, TreeForecaster, permutation_importance
from wattline.sources import catalog_tables as CT
from wattline.sources import tables as T

LOAD = "item_id string, datetime_15min timestamp_ntz, active_kw double, n_clients long, avg_kw_per_client double"


def fresh(name):
    return f"{name}_{uuid.uuid4().hex}"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def load(spark, days=10, gaps=True):
    base, rnd = dt.datetime(2024, 1, 1), random.Random(4)
    rows = []
    for item in ("A", "B", "C", "D"):
        for i in range(days * 96):
            if not (gaps and rnd.random() < 0.1):
                kw = None if rnd.random() < 0.05 else 50 + 10 * math.sin(i / 15) + rnd.random()
                rows.append((item, base + dt.timedelta(minutes=15 * i), kw, 5, None if kw is None else kw / 5))
    return spark.createDataFrame(rows, LOAD)


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


# ---------------------------------------------------------------- catalog

def test_every_source_reads_from_the_catalog(spark, tmp_path):
    source = CT.register_sources(spark, SF001, fresh("raw"), str(tmp_path / "db"), ["events", "customer", "nation", "region"])
    for read in (T.readings, T.weather, T.holidays, T.region_dim, T.admin_map):
        assert rows_of(read(spark, source)) == rows_of(read(spark, SF001))
    again = CT.register_sources(spark, SF001, source[len(CT.CATALOG):], str(tmp_path / "db"), ["events"])
    assert again == source


def test_runs_replace_themselves_only(spark, tmp_path):
    table, path = fresh("runs"), str(tmp_path / "runs")
    one = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 2), 2.0)], "at timestamp_ntz, prediction double")
    assert CT.write_run(one, table, "a", path) == 2
    assert CT.write_run(one.limit(1), table, "b") == 1
    assert CT.write_run(one.select("prediction", "at").withColumn("prediction", F.col("prediction") * 10), table, "a") == 2
    assert sorted(r["prediction"] for r in CT.read_run(spark, table, "a").collect()) == [10.0, 20.0]
    assert CT.read_run(spark, table, "b").count() == 1 and spark.table(table).count() == 3
    assert "PartitionFilters: [isnotnull(run_id" in plan(CT.read_run(spark, table, "a"))
    assert any(f.startswith("run_id=a") for f in os.listdir(path))
    assert CT.write_run(one, table, "it's \\ a run") == 2 and CT.read_run(spark, table, "it's \\ a run").count() == 2
    assert CT.write_run(one.limit(0), table, "a") == 0 and CT.read_run(spark, table, "a").count() == 0 and spark.table(table).count() == 3


@pytest.mark.parametrize("change, words", [
    (lambda d: d.withColumn("prediction", F.col("prediction").cast("string")), "prediction is string, not double"),
    (lambda d: d.drop("at"), "at is missing"), (lambda d: d.withColumn("more", F.lit(1)), "more is not a column")])
def test_a_run_of_another_schema_is_refused(spark, tmp_path, change, words):
    table = fresh("runs")
    one = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0)], "at timestamp_ntz, prediction double")
    CT.write_run(one, table, "a", str(tmp_path / "runs"))
    with pytest.raises(CT.SchemaMismatch, match=words):
        CT.write_run(change(one), table, "b")
    assert spark.table(table).count() == 1


# ---------------------------------------------------------------- bucketed layouts

def test_lags_need_no_exchange(spark, tmp_path, no_broadcast):
    df = load(spark)
    got = SP.lags_from(SP.store_series(df, fresh("series"), str(tmp_path / "s"), 4), "active_kw", {"d": 96, "w": 672, "s": 1})
    assert "Exchange" not in plan(got) and "Window" in plan(got)
    assert rows_of(got) == rows_of(X.lag_time(df, "active_kw", {"d": 96, "w": 672, "s": 1}))


def test_panel_needs_no_exchange(spark, tmp_path, no_broadcast):
    raw = P.load_by(T.readings(spark, SF01), "region")
    w15 = P.weather_15min(T.weather(spark, SF01), T.admin_map(spark, SF01), "region")
    hol = P.holidays_by(T.holidays(spark, SF01), "region")
    days = SP.store_days(raw, fresh("days"), str(tmp_path / "d"), 4)
    cov = SP.store_covariates(w15, hol, fresh("cov"), str(tmp_path / "c"), 4)
    got = SP.panel_from(days, cov)
    assert "Exchange" not in plan(got) and "SortMergeJoin" in plan(got)
    assert got.count() == raw.count()
    part = F.col("item_id") < "G"
    assert rows_of(got.where(part)) == rows_of(P.build_panel(raw, w15, hol).where(part))


# ---------------------------------------------------------------- saved chains and predictors

def test_saved_chain_in_a_new_process(spark, tmp_path):
    """A chain saved here is loaded by another Python process with a session of its own."""
    df = load(spark, 4).select("item_id", "datetime_15min", "active_kw")
    chain = CH.deepar_chain(lags=[1, 96])
    CH.save_chain(chain, str(tmp_path / "chain"))
    df.write.parquet(str(tmp_path / "in"))
    code = f"""
from wattline.session import get_session
from wattline.operators.feature_chain import load_chain
s = get_session("local[2]", shuffle_partitions=2)
load_chain({str(tmp_path / 'chain')!r}).transform(s.read.parquet({str(tmp_path / 'in')!r})).write.parquet({str(tmp_path / 'out')!r})
s.stop()"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"PYTHONPATH": root}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=str(tmp_path), timeout=300)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = X.deepar_features(P.regular_grid(df, ["active_kw"]).drop("observed"), lags=[1, 96])
    assert set(got.columns) == set(want.columns) and rows_of(got) == rows_of(want)


def test_saved_stages_keep_their_parameters(spark, tmp_path):
    from pyspark.ml import PipelineModel

    df = load(spark, 3).withColumnRenamed("item_id", "series").withColumnRenamed("datetime_15min", "at")
    chain = PipelineModel([CH.TimeParts(scaled=False, ts="at"), CH.ObservedFlag(column="active_kw", flag="seen", filled="kw"),
                           CH.LogAge(output="old", keys=["series"], ts="at"), CH.Lags(column="kw", steps=[96], prefix="t", by="time", keys=["series"], ts="at")])
    CH.save_chain(chain, str(tmp_path / "c"))
    got, want = CH.load_chain(str(tmp_path / "c")).transform(df), chain.transform(df)
    assert got.columns == want.columns and {"seen", "kw", "old", "t96", "slot"} <= set(got.columns)
    assert rows_of(got) == rows_of(want)


def test_saved_tree_forecasts_as_the_fitted_one(spark, tmp_path):
    panel = FC.materialize(load(spark, 12))
    tree = TreeForecaster(max_iter=3, max_depth=3).fit(panel, cutoff="2024-01-10")
    with pytest.raises(ValueError):
        PE.save_predictor(spark, TreeForecaster(), str(tmp_path / "unfitted"))
    with pytest.raises(TypeError):
        PE.save_predictor(spark, object(), str(tmp_path / "other"))
    for model in (tree, FC.SeasonalNaive(672, fallback=None, name="week"), FC.SlotMean(), FC.WeightedEnsemble([tree, FC.SlotMean()], [0.75, 0.25], "mix")):
        path = str(tmp_path / model.name)
        PE.save_predictor(spark, model, path)
        PE.save_predictor(spark, model, path)  # over what is there
        back = PE.load_predictor(spark, path)
        assert back.name == model.name and type(back) is type(model)
        cols = ["item_id", "origin", "datetime_15min", "prediction"]
        want = FC.rolling_forecast(model, panel, "2024-01-10", "2024-01-12").select(*cols)
        assert rows_of(FC.rolling_forecast(back, panel, "2024-01-10", "2024-01-12").select(*cols)) == rows_of(want) and want.count() > 0
    assert PE.load_predictor(spark, str(tmp_path / tree.name)).cutoff == "2024-01-10"


# ---------------------------------------------------------------- refits and importances

def test_slot_mean_reads_rows_before_its_cutoff_only(spark):
    panel = load(spark, 10, gaps=False)
    late = panel.withColumn("active_kw", F.when(F.col("datetime_15min") >= "2024-01-07", 1e9).otherwise(F.col("active_kw")))
    out = {}
    for name, p in (("as is", panel), ("changed", late)):
        bt = E.backtest(p, [FC.SlotMean()], 4, refit_every=2)
        out[name] = {(r["window"], r["item_id"], r["datetime_15min"]): r["prediction"] for r in bt.collect()}
    day = dt.datetime(2024, 1, 7)
    # windows 3 and 4 (7 and 8 January) share the fit before the 7th; windows 1 and 2 one before the 9th
    assert {k for k in out["as is"] if out["as is"][k] == out["changed"][k]} == {k for k in out["as is"] if k[0] in (3, 4)}
    rows = [(r["item_id"], r["datetime_15min"], r["active_kw"]) for r in panel.where("active_kw is not null").collect()]
    for (w, item, at), got in list(out["as is"].items())[:200]:
        cut = day + dt.timedelta(days=0 if w > 2 else 2)
        mine = [kw for i, t, kw in rows if i == item and t < cut and (t.hour, t.minute) == (at.hour, at.minute)]
        assert got == pytest.approx(sum(mine) / len(mine), abs=1e-6)


def test_refits_are_counted_and_timed(spark):
    bt, times = E.timed_backtest(load(spark, 14), [FC.SeasonalNaive(96), TreeForecaster(max_iter=2, max_depth=2)], 5, refit_every=2)
    lb = {r["model"]: r for r in E.ranked_leaderboard(bt, times).collect()}
    assert [lb[m]["fits"] for m in ("SeasonalNaive", "DirectTabular")] == [0, 3]
    assert [lb[m]["fit_order"] for m in ("SeasonalNaive", "DirectTabular")] == [1, 2]
    assert sorted(r["rank"] for r in lb.values()) == [1, 2]
    assert lb["SeasonalNaive"]["fit_time"] == 0 < lb["DirectTabular"]["fit_time"] and all(r["pred_time"] > 0 for r in lb.values())
    assert bt.where("model = 'DirectTabular'").select("window").distinct().count() == 5


def test_importance_of_a_weightless_feature_is_zero(spark):
    panel = FC.materialize(load(spark, 14))
    got = {r["feature"]: r for r in permutation_importance(LinearScorer({"lag_1d": 1.0, "lag_2d": 0.0}), panel, panel.where("datetime_15min >= '2024-01-10'"), ["lag_1d", "lag_2d"]).collect()}
    assert got["lag_2d"]["importance"] == pytest.approx(0) and got["lag_1d"]["importance"] > 0 and got["lag_1d"]["n"] == 3
