"""Lags, calendar features and target transforms.

Two lag flavours, both offered (rule D13):

- ``lag_rows``: the value ``n`` rows back in the series (what a shift does);
  wrong wherever a slot is missing.  Needs a per-series window.
- ``lag_time``: the value at ``ts - n * 15 min`` looked up by an equi-join on
  ``(item_id, ts)``; exact under gaps and fully hash-partitioned, so no series
  has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline import SLOT_MINUTES
from wattline.functions.calendar import calendar_columns, deepar_time_columns
from wattline.functions.timefn import add_minutes

# Fixed lag set of the trained DeepAR pipeline (steps of 15 minutes).
DEEPAR_LAGS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14,
               95, 96, 97, 191, 192, 193, 287, 288, 289, 383, 384, 385,
               479, 480, 481, 575, 576, 577, 671, 672, 673]

# Fixed approach labels (output values).  An approach models a column minus a weighted baseline of its
# values some steps earlier; a per-client column has to be scaled back by the client count.
PER_CLIENT = "avg_kw_per_client"
BASELINES: dict[str, tuple[str, dict[int, float]]] = {
    "A1_residual_48h": (PER_CLIENT, {2 * 96: 1.0}),
    "A2_residual_24h": (PER_CLIENT, {96: 1.0}),
    "A3_residual_weekly": (PER_CLIENT, {7 * 96: 1.0}),
    "A4_residual_dw_avg": (PER_CLIENT, {96: 0.5, 7 * 96: 0.5}),
    "A5_raw_active_kw": ("active_kw", {}),
    "A6_per_client": (PER_CLIENT, {}),
}


def lag_rows(df: DataFrame, col: str, lags: dict[str, int], keys=("item_id",),
             ts: str = "datetime_15min") -> DataFrame:
    """Row lags; all offsets share one sort per series."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.withColumns({name: F.lag(col, n).over(w) for name, n in lags.items()})


def lag_time(df: DataFrame, col: str, lags: dict[str, int], keys=("item_id",),
             ts: str = "datetime_15min", step_minutes: int = SLOT_MINUTES) -> DataFrame:
    """Time-exact lags: one left equi-join per offset on ``(keys, ts)``.

    With several offsets the input is materialised first so the raw source
    behind it is scanned once (see ``forecast.materialize``).
    """
    if len(lags) > 1:
        from wattline.session import cut_lineage

        df = cut_lineage(df)
    base = df.select(*keys, ts, col)
    out = df
    for name, n in lags.items():
        shifted = base.select(*keys, add_minutes(ts, n * step_minutes).alias(ts), F.col(col).alias(name))
        out = out.join(shifted, [*keys, ts], "left")
    return out


def add_lags(df: DataFrame, col: str, lags: dict[str, int], mode: str = "time", **kw) -> DataFrame:
    return (lag_time if mode == "time" else lag_rows)(df, col, lags, **kw)


def calendar_features(df: DataFrame, ts: str = "datetime_15min") -> DataFrame:
    return df.withColumns(calendar_columns(ts))


def deepar_features(df: DataFrame, col: str = "active_kw", keys=("item_id",),
                    ts: str = "datetime_15min", lags: list[int] = DEEPAR_LAGS) -> DataFrame:
    """scaled calendar parts, log age, observed flag, the declared lag set.

    Expects a regular grid (``regular_grid``) so row lags are time lags.
    Age is ``log10(2 + position)`` in the series; missing targets are
    observed = 0 and imputed with 0 before lagging.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    obs = F.col(col).isNotNull() & ~F.isnan(col)
    out = df.withColumns(deepar_time_columns(ts)).withColumns({
        "observed": obs.cast("double"),
        "target_filled": F.when(obs, F.col(col)).otherwise(F.lit(0.0)),
        "age": F.log10(F.lit(2.0) + (F.row_number().over(w) - 1)),
    })
    return out.withColumns({f"lag_{n}": F.lag("target_filled", n).over(w) for n in lags})


def target_transforms(panel: DataFrame, mode: str = "time") -> DataFrame:
    """``(approach, item_id, datetime_15min, n_clients, target, rescale_by_n)`` for every entry of ``BASELINES``.

    A row whose column or any baseline value is missing has no target and is left out.
    """
    steps = sorted({n for _, lags in BASELINES.values() for n in lags})
    x = add_lags(panel, PER_CLIENT, {f"_lag{n}": n for n in steps}, mode=mode)
    entries = []
    for label, (column, lags) in BASELINES.items():
        baseline = sum((F.col(f"_lag{n}") * F.lit(w) for n, w in lags.items()), F.lit(0.0))
        entries.append(F.struct(F.lit(label).alias("approach"), (F.col(column) - baseline).alias("target"),
                                F.lit(column == PER_CLIENT).alias("rescale_by_n")))
    long = x.select("item_id", "datetime_15min", "n_clients", F.inline(F.array(*entries)))
    return long.where(F.col("target").isNotNull() & ~F.isnan("target"))
