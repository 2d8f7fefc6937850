"""Forecast evaluation."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.timefn import floor_day, half_open
from wattline.operators import forecast as fc
from wattline.operators.panel import head_steps, tail_steps


def mae(joined: DataFrame, actual: str = "actual", pred: str = "prediction") -> DataFrame:
    """A16 + matched count in one aggregate (one job, not two)."""
    return joined.agg(
        F.avg(F.abs(F.col(actual) - F.col(pred))).alias("mae"),
        F.count(F.lit(1)).alias("n_matched"),
    )


def national_actuals(readings: DataFrame, start=None, end=None) -> DataFrame:
    """Actual national totals per slot; the range filter is on the raw column (pushdown)."""
    from wattline.operators.panel import load_by

    r = readings.where(half_open("datetime_local", start, end)) if (start or end) else readings
    return load_by(r, "national").select("datetime_15min", "active_kw")


def local_validation(readings: DataFrame, start, end) -> DataFrame:
    """F1 over ``[start, end)``, joined to actuals (J4), MAE and matched count."""
    from wattline.operators.panel import load_by

    load = load_by(readings, "national")
    pred = fc.seasonal_with_mean(load, start, end)
    act = national_actuals(readings, start, end)
    return mae(pred.join(act, "datetime_15min").withColumnRenamed("active_kw", "actual"))


def align_totals(pred: DataFrame, actual: DataFrame, pred_col: str = "prediction",
                 actual_col: str = "active_kw") -> DataFrame:
    """Full outer alignment then dropping incomplete rows == inner join on non-NULL values."""
    p = fc.to_total(pred, pred_col).withColumnRenamed(pred_col, "predicted")
    a = actual.groupBy("datetime_15min").agg(F.sum(actual_col).alias("actual"))
    return p.join(a, "datetime_15min").where(F.col("predicted").isNotNull() & F.col("actual").isNotNull())


def last_day_validation(panel: DataFrame, model, steps: int = 96, target: str = "active_kw",
                        keys=("item_id",)) -> DataFrame:
    """cut the last ``steps`` of each series, forecast them from the rest, total MAE.

    With a per-client target the forecast and the actuals are scaled by the
    realised ``n_clients`` (the reference's evaluation, D18 'actual').
    """
    panel = fc.materialize(panel)
    hist = head_steps(panel, steps)
    val = tail_steps(panel, steps)
    orig = val.groupBy(*keys).agg(F.min("datetime_15min").alias("origin"))
    grid = val.select(*keys, "datetime_15min").join(orig, list(keys))
    pred = model.predict(hist, grid, keys)
    if target == "avg_kw_per_client":
        n = val.select(*keys, "datetime_15min", "n_clients")
        pred = pred.join(n, [*keys, "datetime_15min"], "left").withColumn(
            "prediction", F.col("prediction") * F.col("n_clients"))
        val = val.withColumn(target, F.col(target) * F.col("n_clients"))
    aligned = align_totals(pred, val, actual_col=target)
    return aligned.agg(
        F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("total_mae"),
        F.count(F.lit(1)).alias("n_steps"),
    )


def holdout_slots(panel: DataFrame, model, holdout_start, keys=("item_id",),
                  target: str = "active_kw") -> DataFrame:
    """F16 per-slot rows: rolling day-ahead totals vs actual totals over the holdout.

    Test days are the distinct days with rows at or after ``holdout_start``
    (T6); a day without history or without actuals is skipped.
    """
    panel = fc.materialize(panel)
    test = panel.where(F.col("datetime_15min") >= fc._ts(holdout_start))
    days = test.select(*keys, floor_day("datetime_15min").alias("origin")).distinct()
    first = panel.groupBy(*keys).agg(F.min("datetime_15min").alias("_first"))
    o = days.join(first, list(keys)).where(F.col("_first") < F.col("origin")).drop("_first")
    grid = fc.horizon_grid(o, keys=keys)
    pred = model.predict(panel, grid, keys)
    aligned = align_totals(pred, test, actual_col=target)
    return aligned.withColumn("date", floor_day("datetime_15min"))


def daily_mae(slots: DataFrame) -> DataFrame:
    """MAE and aligned step count per day."""
    return slots.groupBy("date").agg(
        F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("total_MAE_kW"),
        F.count(F.lit(1)).alias("n_steps"),
    )


def holdout_summary(daily: DataFrame) -> DataFrame:
    """Days, mean, median, min, max of the daily MAE."""
    m = F.col("total_MAE_kW")
    return daily.agg(F.count(F.lit(1)).alias("days"), F.avg(m).alias("avg_mae"),
                     F.median(m).alias("median_mae"), F.min(m).alias("min_mae"), F.max(m).alias("max_mae"))


# ---------------------------------------------------------------- backtests

def _window_forecasts(m, panel: DataFrame, orig: DataFrame, grid: DataFrame, n_windows: int, keys, refit_every: int | None):
    """(forecast, seconds spent fitting) for each part of the windows that one call of ``predict`` serves.

    A generation is ``refit_every`` windows (all, if None), fitted on the rows before the
    earliest of their origins.  A model that fits in its plan gets all generations at once,
    keyed by the cutoff of each origin; another fitted model is fitted once per generation.
    """
    step = refit_every or n_windows
    if getattr(m, "fits_in_plan", False):
        number = F.floor((F.col("window") - 1) / step)
        cutoffs = orig.groupBy(number.alias("_generation")).agg(F.min("origin").alias("cutoff"))
        yield m.predict(panel, grid.withColumn("_generation", number).join(cutoffs, "_generation").drop("_generation"), keys), 0.0
    elif getattr(m, "needs_fit", hasattr(m, "model")):
        for lo in range(1, n_windows + 1, step):
            mine = F.col("window").between(lo, lo + step - 1)
            first = orig.where(mine).agg(F.min("origin")).first()[0]
            if first is not None:
                began = time.perf_counter()
                m.fit(panel, cutoff=first, keys=keys)
                yield m.predict(panel, grid.where(mine), keys), time.perf_counter() - began
    else:
        yield m.predict(panel, grid, keys), 0.0


def _backtest_rows(panel: DataFrame, models: list, n_windows: int, keys, target: str, refit_every: int | None):
    """(model, joined rows, seconds spent fitting) of every part, in the order of the models."""
    orig = fc.last_days_origins(panel, n_windows, keys)
    grid = fc.horizon_grid(orig, keys=(*keys, "window"))
    act = panel.select(*keys, "datetime_15min", F.col(target).alias("actual"))
    for m in models:
        for p, spent in _window_forecasts(m, panel, orig, grid, n_windows, keys, refit_every):
            yield m, p.join(act, [*keys, "datetime_15min"]).select(F.lit(m.name).alias("model"), "window", *keys, "datetime_15min", "prediction", "actual"), spent


def backtest(panel: DataFrame, models: list, n_windows: int = 5, keys=("item_id",),
             target: str = "active_kw", refit_every: int | None = None) -> DataFrame:
    """each model forecasts each of the last ``n_windows`` days of every series
    from the rows before that day; rows ``(model, window, keys, ts, prediction, actual)``.

    A model is fitted on the rows before the earliest origin of the windows it forecasts:
    of all of them, or with ``refit_every`` of so many at a time.
    """
    parts = [rows for _, rows, _ in _backtest_rows(fc.materialize(panel), models, n_windows, keys, target, refit_every)]
    return reduce(DataFrame.unionByName, parts)


def timed_backtest(panel: DataFrame, models: list, n_windows: int = 5, keys=("item_id",), target: str = "active_kw",
                   refit_every: int | None = None) -> tuple[DataFrame, DataFrame]:
    """F10 + F11: ``backtest`` and a row per model (model, fit_order, fits, fit_time, pred_time), in seconds.

    Each part is written when its turn comes, so its time is that of the forecasts
    themselves; where the fit is part of the plan, it counts as prediction.
    """
    from wattline.session import cut_lineage

    panel = fc.materialize(panel)
    parts, seen, began = [], {}, time.perf_counter()
    for m, rows, spent in _backtest_rows(panel, models, n_windows, keys, target, refit_every):
        parts.append(cut_lineage(rows))
        row = seen.setdefault(m.name, [m.name, len(seen) + 1, 0, 0.0, 0.0])
        row[2] += 1 if spent else 0
        row[3] += spent
        now = time.perf_counter()
        row[4] += now - began - spent
        began = now
    times = panel.sparkSession.createDataFrame([tuple(r) for r in seen.values()], "model string, fit_order int, fits int, fit_time double, pred_time double")
    return reduce(DataFrame.unionByName, parts), times


def ranked_leaderboard(bt: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """the leaderboard with ``rank`` (best first, ties by name) and, if given, the order and times of the fits."""
    lb = leaderboard(bt).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score_val"), "model")).cast("int"))  # a row per model
    return (lb if times is None else lb.join(times, "model")).orderBy("rank")


def leaderboard(bt: DataFrame) -> DataFrame:
    """score = -(mean over windows of the window MAE), best first, with n_items."""
    per_window = bt.groupBy("model", "window").agg(
        F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("w_mae"))
    items = bt.groupBy("model").agg(F.countDistinct("item_id").alias("n_items"))
    lb = per_window.groupBy("model").agg((-F.avg("w_mae")).alias("score_val"),
                                         F.count(F.lit(1)).alias("n_windows"))
    return lb.join(items, "model")


def best_model(lb: DataFrame) -> DataFrame:
    """The top row of the leaderboard; ties broken by model name."""
    return lb.agg(F.min_by("model", F.struct(-F.col("score_val"), F.col("model"))).alias("best_model"),
                  F.max("score_val").alias("score_val"))


def regional_bound(lb: DataFrame) -> DataFrame:
    """Mean regional MAE times the number of series, an upper bound on the total MAE."""
    return lb.select("model", (F.abs("score_val") * F.col("n_items")).alias("sum_region_mae"))


def quantile_forecast(panel: DataFrame, model, start, end, n_windows: int = 5,
                      levels=(0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
                      keys=("item_id",), target: str = "active_kw") -> DataFrame:
    """day-ahead forecasts with exact residual quantiles per (series, slot of day).

    The residuals of an origin are those of the forecasts made for the ``n_windows`` days
    before it, so nothing at or after the origin is read.  One rolling forecast over the
    longer span serves both; each day's residuals go to the origins that look back on it.
    """
    from wattline.functions.timefn import add_minutes, slot_of_day

    panel = fc.materialize(panel)
    first = fc.origin_days(start, end)[0]
    early = (fc._parse(first) - fc._dt.timedelta(days=n_windows)).isoformat(sep=" ")
    pred = fc.rolling_forecast(model, panel, early, end, keys, reuse=False).select(
        *keys, "origin", "datetime_15min", "prediction", slot_of_day("datetime_15min").alias("slot"))
    act = panel.select(*keys, "datetime_15min", F.col(target).alias("actual"))
    resid = pred.join(act, [*keys, "datetime_15min"]).select(
        *keys, "slot", (F.col("actual") - F.col("prediction")).alias("resid"),
        F.explode(F.sequence(F.lit(1), F.lit(n_windows))).alias("_d"), F.col("origin").alias("_day"))
    resid = resid.withColumn("origin", add_minutes("_day", F.col("_d") * 24 * 60))
    q = resid.groupBy(*keys, "origin", "slot").agg(F.percentile("resid", list(levels)).alias("_q"))
    out = pred.where(half_open("datetime_15min", start, end)).join(q, [*keys, "origin", "slot"], "left")
    cols = {f"q{int(round(lv * 100)):02d}": F.col("prediction") + F.col("_q")[i] for i, lv in enumerate(levels)}
    return out.withColumns(cols).drop("_q", "slot")


def greedy_weights(bt: DataFrame, rounds: int = 10, keys=("item_id",)) -> DataFrame:
    """greedy ensemble selection with replacement on backtest forecasts.

    The member forecasts are pivoted once and checkpointed; each round scores
    every candidate in a single aggregate and the driver keeps only the counts.
    """
    from wattline.session import cut_lineage

    names = sorted(r[0] for r in bt.select("model").distinct().collect())
    wide = (bt.groupBy("window", *keys, "datetime_15min").pivot("model", names)
            .agg(F.first("prediction")).join(
                bt.select("window", *keys, "datetime_15min", "actual").distinct(),
                ["window", *keys, "datetime_15min"]))
    wide = cut_lineage(wide.dropna())
    counts = {n: 0 for n in names}
    for r in range(1, rounds + 1):
        cur = sum((F.col(f"`{n}`") * counts[n] for n in names), F.lit(0.0))
        scores = wide.agg(*[F.avg(F.abs(F.col("actual") - (cur + F.col(f"`{n}`")) / r)).alias(n) for n in names]).first()
        pick = min(names, key=lambda n: (scores[n], n))
        counts[pick] += 1
    spark = bt.sparkSession
    return spark.createDataFrame([(n, counts[n] / rounds) for n in names], "model string, weight double")


def learned_ensemble(models: list, weights: DataFrame) -> fc.WeightedEnsemble:
    """the ensemble of the models to which ``greedy_weights`` gave weight (one row per model reaches the driver)."""
    given = {r["model"]: r["weight"] for r in weights.collect()}
    used = [m for m in models if given.get(m.name, 0.0) > 0]
    return fc.WeightedEnsemble(used, [given[m.name] for m in used])


def approach_scores(long_targets: DataFrame, n_windows: int = 5, models: list | None = None) -> DataFrame:
    """F7 per (approach, series): the error of its best model over a backtest, times the last
    known client count where the target is per client (``proxy``)."""
    keys = ("approach", "item_id")
    panel = fc.materialize(long_targets.select(*keys, "datetime_15min", "target", "n_clients", "rescale_by_n"))
    bt = backtest(panel, models or [fc.SeasonalNaive(target="target")], n_windows, keys, target="target")
    per = bt.groupBy("approach", "item_id", "model", "window").agg(F.avg(F.abs(F.col("actual") - F.col("prediction"))).alias("w_mae"))
    per = per.groupBy("approach", "item_id", "model").agg(F.avg("w_mae").alias("score_val"))
    best = per.groupBy("approach", "item_id").agg(F.min(F.struct("score_val", "model")).alias("b")).select(
        "approach", "item_id", F.col("b.model").alias("model"), F.col("b.score_val").alias("score_val"))
    last = panel.groupBy("approach", "item_id").agg(
        F.max_by("n_clients", "datetime_15min").alias("n_clients_last"), F.bool_or("rescale_by_n").alias("rescale_by_n"))
    scale = F.when(F.col("rescale_by_n"), F.col("n_clients_last")).otherwise(F.lit(1))
    return best.join(last, ["approach", "item_id"]).withColumn("proxy", F.col("score_val") * scale)


def approach_comparison(long_targets: DataFrame, n_windows: int = 5, models: list | None = None) -> DataFrame:
    """F7 + L3: the approaches' errors summed over series, ranked (six rows; ties by label)."""
    total = approach_scores(long_targets, n_windows, models).groupBy("approach").agg(
        F.sum("proxy").alias("spain_total_mae"), F.count(F.lit(1)).alias("n_regions"), F.bool_or("rescale_by_n").alias("rescale_by_n"))
    return total.withColumn("rank", F.row_number().over(Window.orderBy("spain_total_mae", "approach"))).orderBy("rank")


def best_worst_targets(scores: DataFrame) -> DataFrame:
    """L3: per series the approach of least and of largest ``proxy`` (ties by label)."""
    return scores.groupBy("item_id").agg(
        F.min_by("approach", F.struct("proxy", "approach")).alias("best_approach"), F.min("proxy").alias("best_mae"),
        F.max_by("approach", F.struct("proxy", "approach")).alias("worst_approach"), F.max("proxy").alias("worst_mae"))


def actual_vs_pred(pred_total: DataFrame, actual: DataFrame) -> DataFrame:
    """per-slot actual and predicted totals over a window."""
    return actual.select("datetime_15min", "active_kw").join(pred_total, "datetime_15min")
