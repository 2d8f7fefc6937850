"""Forecasters and the loop-free rolling day-ahead forecast.

Rolling forecast without a driver loop (F3): an *origin table* holds one row
per (series, forecast day D) for which the series has history before D; it is
exploded into the day's slots (the *horizon grid*).  Every feature of a row
for day D is read from rows strictly before D (rule D17): seasonal lags of at
least one day, the historical mean and the last known client count are
as-of-origin values computed with a cumulative window over *daily* partials,
so the whole backtest is one plan and no series is copied per day.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline import SLOT_MINUTES, SLOTS_PER_DAY
from wattline.functions.safe import exact_mean, exact_sum, safe_div
from wattline.functions.timefn import add_minutes, floor_day, half_open, slot_of_day



def _day():
    return F.make_dt_interval(F.lit(1))


def _step():
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(SLOT_MINUTES))


def _parse(value) -> _dt.datetime:
    return value if isinstance(value, _dt.datetime) else _dt.datetime.fromisoformat(str(value))


def _ts(value):
    return F.lit(_parse(value).isoformat(sep=" ")).cast("timestamp_ntz")


# ---------------------------------------------------------------- materialisation

def materialize(panel: DataFrame) -> DataFrame:
    """Checkpoint the (small, aggregated) panel once into the shared checkpoint folder.

    Forecast operators read the panel several times (origins, seasonal
    sources, as-of partials, actuals) with different column sets, so Spark
    cannot reuse one exchange and would rescan the raw readings for each read.
    The panel has series x slots rows (it grows with the time span, not with
    the raw volume), so writing it once is cheap and bounds the raw scans to one;
    it also cuts the lineage a lost executor would have to recompute.
    """
    from wattline.session import cut_lineage

    return cut_lineage(panel)


# ---------------------------------------------------------------- origins / grid

def origin_days(start, end) -> tuple[str, str]:
    """First and last calendar day D with ``floor(start) <= D < end``."""
    s, e = _parse(start), _parse(end)
    first = _dt.datetime(s.year, s.month, s.day)
    last = _dt.datetime(e.year, e.month, e.day)
    if last == e:
        last -= _dt.timedelta(days=1)
    return first.isoformat(sep=" "), last.isoformat(sep=" ")


def origins(panel: DataFrame, start, end, keys=("item_id",), ts: str = "datetime_15min") -> DataFrame:
    """One row per (series, day) in ``[start, end)`` with history strictly before the day.

    Days with no earlier row are skipped (the reference's ``len(hist) == 0``).
    """
    first, last = origin_days(start, end)
    items = panel.groupBy(*keys).agg(F.min(ts).alias("_first"))
    o = items.select(*keys, "_first", F.explode(F.sequence(_ts(first), _ts(last), _day())).alias("origin"))
    return o.where(F.col("_first") < F.col("origin")).drop("_first")


def horizon_grid(orig: DataFrame, start=None, end=None, keys=("item_id",),
                 steps: int = SLOTS_PER_DAY) -> DataFrame:
    """Explode each origin into its ``steps`` slots, cut to ``[start, end)``."""
    stop = add_minutes("origin", (steps - 1) * SLOT_MINUTES)
    g = orig.select(*keys, "origin", F.explode(F.sequence("origin", stop, _step())).alias("datetime_15min"))
    if start is not None or end is not None:
        g = g.where(half_open("datetime_15min", None if start is None else _ts(start),
                              None if end is None else _ts(end)))
    return g


def last_days_origins(panel: DataFrame, n_windows: int, keys=("item_id",),
                      ts: str = "datetime_15min") -> DataFrame:
    """the last ``n_windows`` days of each series as backtest origins.

    ``window`` = 1 is the most recent day.  Built per series (no cross join).
    """
    b = panel.groupBy(*keys).agg(floor_day(F.max(ts)).alias("_last"), F.min(ts).alias("_first"))
    o = b.select(*keys, "_last", "_first", F.explode(F.sequence(F.lit(1), F.lit(n_windows))).alias("window"))
    o = o.withColumn("origin", F.col("_last") - F.make_dt_interval(F.col("window") - 1))
    return o.where(F.col("_first") < F.col("origin")).drop("_last", "_first")


# ---------------------------------------------------------------- as-of-origin values

def _asof_daily(daily: DataFrame, orig: DataFrame, keys, value_cols: dict, agg: str) -> DataFrame:
    """Join per-(series, day) partials to origins as of the day before each origin.

    Marker rows for the origins are unioned into the daily partials and
    ordered before the same day's partial, so a running window over the
    series' *days* (not its rows) yields the value over days < origin.
    """
    cols = list(value_cols)
    d = daily.select(*keys, "day", *cols, F.lit(1).alias("_kind"))
    m = orig.select(*keys, F.col("origin").alias("day"), *[F.lit(None).cast(t).alias(c) for c, t in value_cols.items()],
                    F.lit(0).alias("_kind")).distinct()
    u = d.unionByName(m)
    w = Window.partitionBy(*keys).orderBy("day", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    if agg == "sum":
        u = u.withColumns({c: F.sum(c).over(w) for c in cols})
    else:
        u = u.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    return u.where(F.col("_kind") == 0).withColumnRenamed("day", "origin").drop("_kind")


def hist_mean_asof(panel: DataFrame, orig: DataFrame, target: str, keys=("item_id",),
                   ts: str = "datetime_15min") -> DataFrame:
    """Mean of ``target`` over rows strictly before each origin (F1 fallback, W4)."""
    daily = panel.groupBy(*keys, floor_day(ts).alias("day")).agg(
        exact_sum(target).alias("_s"), F.count(target).alias("_n"))
    a = _asof_daily(daily, orig, keys, {"_s": "decimal(38,10)", "_n": "bigint"}, "sum")
    return a.select(*keys, "origin", exact_mean("_s", "_n").alias("hist_mean"))


def last_known_asof(panel: DataFrame, orig: DataFrame, col: str = "n_clients", keys=("item_id",),
                    ts: str = "datetime_15min") -> DataFrame:
    """Last value of ``col`` before each origin (D18 ``last_known``)."""
    daily = panel.where(F.col(col).isNotNull()).groupBy(*keys, floor_day(ts).alias("day")).agg(
        F.max_by(col, ts).alias("_v"))
    a = _asof_daily(daily, orig, keys, {"_v": panel.schema[col].dataType.simpleString()}, "last")
    return a.select(*keys, "origin", F.col("_v").alias(f"{col}_last"))


# ---------------------------------------------------------------- models

class SeasonalNaive:
    """Value one season earlier, repeated over the horizon (F2); season in 15-min steps.

    For slot ``s`` of origin ``o`` the source is ``s - k * season`` with the
    smallest ``k`` that lands before ``o``, so the forecast never reads the
    horizon.  Missing source slots fall back to the historical mean before the
    origin (F1's rule) unless ``fallback=None``.
    """

    def __init__(self, season: int = SLOTS_PER_DAY, target: str = "active_kw",
                 fallback: str | None = "mean", name: str | None = None):
        self.season, self.target, self.fallback = season, target, fallback
        self.name = name or ("SeasonalNaive" if season == SLOTS_PER_DAY else f"SeasonalNaive{season}")

    def fit(self, panel: DataFrame, cutoff=None) -> "SeasonalNaive":
        return self

    def predict(self, panel: DataFrame, grid: DataFrame, keys=("item_id",)) -> DataFrame:
        season_min = self.season * SLOT_MINUTES
        offset = F.timestamp_diff("MINUTE", F.col("origin"), F.col("datetime_15min"))
        k = F.floor(offset / F.lit(season_min)).cast("int") + 1
        g = grid.withColumn("_src", F.col("datetime_15min") - F.make_dt_interval(
            F.lit(0), F.lit(0), k * F.lit(season_min)))
        src = panel.select(*keys, F.col("datetime_15min").alias("_src"), F.col(self.target).alias("_v"))
        out = g.join(src, [*keys, "_src"], "left").drop("_src")
        if self.fallback == "mean":
            hm = hist_mean_asof(panel, grid.select(*keys, "origin").distinct(), self.target, keys)
            out = out.join(hm, [*keys, "origin"], "left").withColumn("_v", F.coalesce("_v", "hist_mean")).drop("hist_mean")
        return out.withColumnRenamed("_v", "prediction")


class SlotMean:
    """Mean of the target per (series, slot of day) over the rows before the fit; where a slot has none, the series' mean.

    Fits of several generations are one plan: a grid with a ``cutoff`` (a midnight) per row
    says which fit the row uses; without one, each origin has its own.
    """

    fits_in_plan = True

    def __init__(self, target: str = "active_kw", name: str = "SlotMean"):
        self.target, self.name = target, name

    def fit(self, panel: DataFrame, cutoff=None) -> "SlotMean":
        return self

    def predict(self, panel: DataFrame, grid: DataFrame, keys=("item_id",)) -> DataFrame:
        cut = F.col("cutoff") if "cutoff" in grid.columns else F.col("origin")
        g = grid.withColumns({"_slot": slot_of_day("datetime_15min"), "_cut": cut})
        fits = g.select(*keys, "_slot", F.col("_cut").alias("origin")).distinct()
        means = hist_mean_asof(panel.withColumn("_slot", slot_of_day("datetime_15min")), fits, self.target, (*keys, "_slot"))
        whole = hist_mean_asof(panel, fits.select(*keys, "origin").distinct(), self.target, keys)
        out = g.join(means.select(*keys, "_slot", F.col("origin").alias("_cut"), F.col("hist_mean").alias("_m")), [*keys, "_slot", "_cut"], "left")
        out = out.join(whole.select(*keys, F.col("origin").alias("_cut"), F.col("hist_mean").alias("_all")), [*keys, "_cut"], "left")
        return out.select(*grid.columns, F.coalesce("_m", "_all").alias("prediction"))


class WeightedEnsemble:
    """Weighted mean of member forecasts (F12); weights must sum to 1."""

    def __init__(self, members: list, weights: list[float], name: str = "WeightedEnsemble"):
        if abs(sum(weights) - 1.0) > 1e-9:
            raise ValueError("weights must sum to 1")
        self.members, self.weights, self.name = members, weights, name

    def fit(self, panel, cutoff=None):
        for m in self.members:
            m.fit(panel, cutoff)
        return self

    def predict(self, panel: DataFrame, grid: DataFrame, keys=("item_id",)) -> DataFrame:
        out = None
        for i, (m, w) in enumerate(zip(self.members, self.weights)):
            p = m.predict(panel, grid, keys).select(*keys, "origin", "datetime_15min",
                                                     (F.col("prediction") * F.lit(w)).alias(f"_p{i}"))
            out = p if out is None else out.join(p, [*keys, "origin", "datetime_15min"], "inner")
        total = sum((F.col(f"_p{i}") for i in range(len(self.members))), F.lit(0.0))
        return out.select(*keys, "origin", "datetime_15min", total.alias("prediction"))


# ---------------------------------------------------------------- rolling forecast

def rolling_forecast(model, panel: DataFrame, start, end, keys=("item_id",), reuse: bool = True) -> DataFrame:
    """day-ahead forecasts for every day in ``[start, end)`` in one plan."""
    panel = materialize(panel) if reuse else panel
    grid = horizon_grid(origins(panel, start, end, keys), start, end, keys)
    return model.predict(panel, grid, keys)


def to_total(pred: DataFrame, col: str = "prediction") -> DataFrame:
    """Hierarchical total per slot (sum over series)."""
    return pred.groupBy("datetime_15min").agg(F.sum(col).alias(col))


def contract(pred: DataFrame, start=None, end=None) -> DataFrame:
    """``(datetime_15min timestamp, prediction double)`` cut to ``[start, end)``."""
    p = pred.select(F.col("datetime_15min").cast("timestamp_ntz").alias("datetime_15min"),
                    F.col("prediction").cast("double").alias("prediction"))
    if start is not None or end is not None:
        p = p.where(half_open("datetime_15min", start, end))
    return p


def per_client_forecast(model, panel: DataFrame, start, end, keys=("item_id",),
                        rescale: str = "last_known") -> DataFrame:
    """forecast the per-client target and scale back by the client count.

    ``rescale='last_known'`` uses the last count before the origin (no
    leakage, D18); ``'actual'`` uses the realised count of the slot.
    """
    panel = materialize(panel)
    grid = horizon_grid(origins(panel, start, end, keys), start, end, keys)
    pred = model.predict(panel, grid, keys)
    if rescale == "actual":
        n = panel.select(*keys, "datetime_15min", F.col("n_clients").alias("_n"))
        pred = pred.join(n, [*keys, "datetime_15min"], "left")
    else:
        lk = last_known_asof(panel, grid.select(*keys, "origin").distinct(), "n_clients", keys)
        pred = pred.join(lk, [*keys, "origin"], "left").withColumnRenamed("n_clients_last", "_n")
    return pred.withColumn("prediction", F.col("prediction") * F.col("_n")).drop("_n")


def seasonal_with_mean(load: DataFrame, start, end, season: int = 7 * SLOTS_PER_DAY,
                       lag_mode: str = "time", target: str = "active_kw") -> DataFrame:
    """the exploration baseline on one series.

    Value ``season`` steps earlier (time-exact by default; ``lag_mode='rows'``
    reproduces the row shift), else the mean of the series before ``start``.
    Only slots present in ``[start, end)`` are returned, as in the reference.
    The scalar mean is a scalar subquery, not a driver round trip (J7).
    """
    from wattline.operators.features import add_lags

    load = materialize(load)
    lagged = add_lags(load, target, {"lag_7d": season}, mode=lag_mode)
    hist = load.where(F.col("datetime_15min") < _ts(start)).agg(F.avg(target)).scalar()
    return lagged.where(half_open("datetime_15min", _ts(start), _ts(end))).select(
        "datetime_15min", F.coalesce(F.col("lag_7d"), hist.cast("double")).alias("prediction"))


def seasonal_grid(load: DataFrame, start, end, season: int = 7 * SLOTS_PER_DAY, target: str = "active_kw") -> DataFrame:
    """F1 for every slot of ``[start, end)``, whether or not it has a load yet.

    A slot takes the value ``k`` seasons earlier, ``k`` being the least that lands before
    ``start``, else the mean before ``start``.  The grid is generated, so a window in the
    future gives all its rows, and rows at or after ``start`` are not read.
    """
    hist = materialize(load.where(F.col("datetime_15min") < _ts(start)))
    stop = add_minutes(_ts(end), -SLOT_MINUTES)
    grid = hist.sparkSession.range(1).select(F.explode(F.sequence(_ts(start), stop, _step())).alias("datetime_15min"))
    span = season * SLOT_MINUTES
    k = F.floor(F.timestamp_diff("MINUTE", _ts(start), F.col("datetime_15min")) / F.lit(span)).cast("int") + 1
    grid = grid.withColumn("_src", F.col("datetime_15min") - F.make_dt_interval(F.lit(0), F.lit(0), k * F.lit(span)))
    src = hist.select(F.col("datetime_15min").alias("_src"), F.col(target).alias("_v"))
    mean = hist.agg(F.avg(target)).scalar()
    return grid.join(src, "_src", "left").select("datetime_15min", F.coalesce("_v", mean.cast("double")).alias("prediction"))
