"""Clustering, tree forecaster and sinks."""

import datetime as dt
import math
import os
import tempfile

from pyspark.sql import functions as F

from paths import SF001
from wattline.operators import clusters as C
from wattline.operators import forecast as FC
from wattline.operators import profiles as PR
from wattline.sources import sinks as S
from wattline.sources import tables as TB


def test_kmeans_sweep_and_repeatable(spark):
    feats = PR.client_features(TB.readings(spark, "/root/testdata/sf0.01"))
    scaled = C.scale(feats).cache()
    sw = {r.k: r.inertia for r in C.sweep_k(scaled, ks=[2, 4, 8]).collect()}
    assert sw[2] > sw[4] > sw[8]
    a = {r.client_id: r.cluster for r in C.fit_clusters(scaled, 4).collect()}
    b = {r.client_id: r.cluster for r in C.fit_clusters(scaled, 4).collect()}
    assert a == b and set(a.values()) == {0, 1, 2, 3}


def test_sweep_takes_the_best_of_ten_starts(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i, Vectors.dense([math.sin(i * i) * 5, math.cos(3 * i * i) * 5])) for i in range(60)]
    points = spark.createDataFrame(rows, ["client_id", "features"]).coalesce(1).cache()
    best = C.best_of(points, 7, 42, 10).summary.trainingCost
    assert best < C.best_of(points, 7, 42, 1).summary.trainingCost * 0.999  # else the starts make no difference here
    assert math.isclose(C.sweep_k(points, ks=[7]).first().inertia, best, rel_tol=1e-9)


def test_fits_keep_their_own_decoded_vectors(spark, monkeypatch):
    """KMeans keeps the vectors of a fit only where its input is not cached itself; else each pass decodes them anew."""
    from pyspark.ml.linalg import Vectors

    seen = []

    class Seen(C.KMeans):
        def fit(self, dataset, params=None):
            seen.append((dataset.storageLevel.useMemory, self.getSolver()))
            return super().fit(dataset, params)

    monkeypatch.setattr(C, "KMeans", Seen)
    points = spark.createDataFrame([(i, Vectors.dense([float(i % 5), float(i % 3)])) for i in range(30)], ["client_id", "features"]).coalesce(1)
    assert C.sweep_k(points, ks=[2, 3], starts=2).count() == 2
    assert seen == [(False, "row")] * 4


def test_tree_beats_seasonal_on_weekly_pattern(spark):
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(96 * 35):
        t = base + dt.timedelta(minutes=15 * i)
        temp = 10 + 8 * math.sin(i / 300.0)
        y = 100 + 30 * math.sin(2 * math.pi * (i % 96) / 96) + (25 if t.weekday() >= 5 else 0) + 3 * temp
        rows.append(("S", t, y, temp))
    panel = spark.createDataFrame(rows, "item_id string, datetime_15min timestamp_ntz, active_kw double, temp_forecast double")
    from wattline.operators.tree import TreeForecaster

    tree = TreeForecaster(max_iter=30).fit(panel, cutoff="2024-01-29")
    act = panel.select("item_id", "datetime_15min", F.col("active_kw").alias("actual"))

    def mae(model):
        p = FC.rolling_forecast(model, panel, "2024-01-29", "2024-02-05").join(act, ["item_id", "datetime_15min"])
        return p.agg(F.avg(F.abs(F.col("actual") - F.col("prediction")))).first()[0]

    assert mae(tree) < mae(FC.SeasonalNaive(96))


def test_publish_overwrite_keeps_other_runs(spark):
    pred = FC.contract(spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0)], "datetime_15min timestamp_ntz, prediction double"))
    path = os.path.join(tempfile.mkdtemp(prefix="wl-sink-"), "subs")
    assert S.write_runs(S.publish_forecast(pred, "t", "r1"), path) == 1
    assert S.write_runs(S.publish_forecast(pred, "t", "r2"), path) == 1
    assert S.write_runs(S.publish_forecast(pred, "t", "r1"), path) == 1
    got = spark.read.parquet(path)
    assert sorted(r.run_id for r in got.select("run_id").collect()) == ["r1", "r2"]


def test_metric_names_cleaned(spark):
    lb = spark.createDataFrame([("Chronos[bolt small]", -2.0, 3)], "model string, score_val double, n_items long")
    got = {r.metric: r.value for r in S.metric_log(lb).collect()}
    assert got == {"val_avg_region_MAE_Chronos_bolt_small": 2.0, "val_sum_region_MAE_Chronos_bolt_small": 6.0}


def test_rows_only_queries_run(spark):
    import __spark_entry__ as E

    for name in ["cluster_mix", "ensemble_weights", "approach_comparison", "publish_forecast"]:
        assert E.queries()[name](spark, SF001).count() > 0


def test_leaderboard_csv_and_metric_log_are_written(spark, tmp_path):
    lb = spark.createDataFrame([("A", -1.5, 2), ("B [x]", -2.0, 2)], "model string, score_val double, n_items long")
    S.write_leaderboard(lb, str(tmp_path / "lb"))
    back = spark.read.option("header", True).csv(str(tmp_path / "lb"))
    assert back.columns == lb.columns and {r.model for r in back.collect()} == {"A", "B [x]"}
    for run in ("r1", "r2"):
        S.append_metrics(S.metric_log(lb), str(tmp_path / "log"), run)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 8 and {r.run_id for r in log.collect()} == {"r1", "r2"}
