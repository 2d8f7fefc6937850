"""Direct tabular forecaster on Spark ML and its importances.

One gradient-boosted tree model over all series and all horizon steps.  Every
lag is at least one day (96 steps), so a row of day D only reads rows before
D and one fitted model serves every origin of a rolling forecast, as the
reference's fixed predictor does.  Known covariates are read at the slot.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.calendar import calendar_columns
from wattline.functions.timefn import add_minutes
from wattline.operators.panel import KNOWN_COV_COLS

DAY_LAGS = {"lag_1d": 96, "lag_2d": 192, "lag_7d": 672}
CALENDAR = ["hour", "minute", "dow", "is_weekend", "slot"]
LEVELS = ["level_mean", "level_std", "level_rows"]


def _row_features(rows: DataFrame, panel: DataFrame, target: str, keys=("item_id",), covariates: DataFrame | None = None):
    """Attach lags (time-exact lookups into ``panel``), calendar parts and known covariates.

    Covariates come from ``covariates`` (item, slot, columns), which may reach beyond the
    load, or else from the panel.  A missing value is 0 with its ``has_`` flag at 0, so
    that it is never read as a measured 0.
    """
    out = rows
    for name, steps in DAY_LAGS.items():
        src = panel.select(*keys, add_minutes("datetime_15min", steps * 15).alias("datetime_15min"),
                           F.col(target).alias(name))
        out = out.join(src, [*keys, "datetime_15min"], "left")
    known = panel if covariates is None else covariates
    cov = [c for c in KNOWN_COV_COLS if c in known.columns]
    out = out.drop(*cov)
    if cov:
        out = out.join(known.select(*keys, "datetime_15min", *cov), [*keys, "datetime_15min"], "left")
    cal = calendar_columns("datetime_15min")
    out = out.withColumns({c: cal[c] for c in CALENDAR})
    feats = list(DAY_LAGS) + cov
    out = out.withColumns({f"has_{n}": (F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double"))).cast("int") for n in feats})
    out = out.withColumns({n: F.when(F.col(f"has_{n}") == 1, F.col(n)).otherwise(F.lit(0)) for n in feats})
    return out, feats + [f"has_{n}" for n in feats] + CALENDAR


class TreeForecaster:
    """Gradient-boosted trees over all series.

    A series is described by numbers from its training rows (mean, spread, count of its
    target, before the cutoff), not by an index, so there is no limit to their number and
    a series without training rows is one with ``has_level`` 0.
    """

    name = "DirectTabular"

    def __init__(self, target: str = "active_kw", max_iter: int = 20, max_depth: int = 5, seed: int = 0):
        self.target, self.max_iter, self.max_depth, self.seed = target, max_iter, max_depth, seed
        self.model = None
        self.levels: DataFrame | None = None
        self.cutoff = None
        self.feature_names: list[str] = []

    def features(self, rows: DataFrame, panel: DataFrame, keys=("item_id",), covariates: DataFrame | None = None):
        out, names = _row_features(rows, panel, self.target, keys, covariates)
        out = out.join(self.levels, list(keys), "left").withColumn("has_level", F.col("level_mean").isNotNull().cast("int"))
        return out.fillna(0.0, subset=LEVELS), names + LEVELS + ["has_level"]

    def fit(self, panel: DataFrame, cutoff=None, keys=("item_id",), covariates: DataFrame | None = None) -> "TreeForecaster":
        from wattline.session import cut_lineage

        self.cutoff = cutoff
        train = panel.where(F.col(self.target).isNotNull())
        if cutoff is not None:
            train = train.where(F.col("datetime_15min") < F.lit(str(cutoff)).cast("timestamp_ntz"))
        y = F.col(self.target)
        self.levels = cut_lineage(train.groupBy(*keys).agg(F.avg(y).alias("level_mean"), F.stddev_pop(y).alias("level_std"),
                                                           F.log1p(F.count(y)).alias("level_rows")))
        rows, self.feature_names = self.features(train.select(*keys, "datetime_15min", self.target), panel, keys, covariates)
        pipe = Pipeline(stages=[
            VectorAssembler(inputCols=self.feature_names, outputCol="features"),
            GBTRegressor(featuresCol="features", labelCol=self.target, maxIter=self.max_iter,
                         maxDepth=self.max_depth, seed=self.seed),
        ])
        # the boosting loop rescans its input every round: materialise the feature rows once
        self.model = pipe.fit(cut_lineage(rows))
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows)

    def predict(self, panel: DataFrame, grid: DataFrame, keys=("item_id",), covariates: DataFrame | None = None) -> DataFrame:
        rows, _ = self.features(grid, panel, keys, covariates)
        return self.transform(rows).select(*grid.columns, "prediction")

    def native_importance(self, spark) -> DataFrame:
        """normalised gain importance per feature (split counts are not exposed)."""
        gbt = self.model.stages[-1]
        imp = gbt.featureImportances.toArray().tolist()
        rows = list(zip(self.feature_names, [float(v) for v in imp]))
        return spark.createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"))


class LinearScorer:
    """A fixed linear score over the tree's row features, for importances that other engines can repeat."""

    def __init__(self, weights: dict[str, float], target: str = "active_kw", name: str = "Linear"):
        self.weights, self.target, self.name = weights, target, name

    def features(self, rows: DataFrame, panel: DataFrame, keys=("item_id",), covariates: DataFrame | None = None):
        return _row_features(rows, panel, self.target, keys, covariates)

    def transform(self, rows: DataFrame) -> DataFrame:
        score = sum((F.col(c) * F.lit(w) for c, w in self.weights.items()), F.lit(0.0))
        return rows.withColumn("prediction", score)


def shuffle_key(keys, repeat: int):
    """The order of a repeat's permutation: a digest of series, slot and repeat, the same in any engine."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("datetime_15min").cast("string"), F.lit(str(repeat))).cast("binary"))


def permutation_importance(model: TreeForecaster | LinearScorer, panel: DataFrame, eval_rows: DataFrame,
                           features: list[str], repeats: int = 3, seed: int = 0,
                           keys=("item_id",)) -> DataFrame:
    """MAE increase when one feature is shuffled inside each series, largest first.

    In repeat r the rows of a series are put in the order of a digest of (series, slot, r),
    and row i takes the feature (with its flag) from the i-th of them: the same
    permutation on every run and partitioning.  Only the permuted values travel, one
    feature at a time.  Importance = mean over repeats, with its std.
    """
    from wattline.session import cut_lineage

    rows, _ = model.features(eval_rows.select(*keys, "datetime_15min", model.target), panel, keys)
    in_time = Window.partitionBy(*keys).orderBy("datetime_15min")
    base = cut_lineage(rows.withColumn("_i", F.row_number().over(in_time)))
    error = F.avg(F.abs(F.col(model.target) - F.col("prediction")))
    before = model.transform(base).agg(error).first()[0]
    scores = []
    for r in range(repeats):
        shuffled = Window.partitionBy(*keys).orderBy(shuffle_key(keys, seed + r), "datetime_15min")
        order = cut_lineage(base.select(*keys, F.row_number().over(shuffled).alias("_i"), *[c for f in features for c in (f, f"has_{f}")]))
        for f in features:
            given = order.select(*keys, "_i", f, f"has_{f}")
            scored = model.transform(base.drop(f, f"has_{f}").join(given, [*keys, "_i"]))
            scores.append(scored.select(F.lit(f).alias("feature"), F.abs(F.col(model.target) - F.col("prediction")).alias("_e"), F.lit(r).alias("_r"))
                          .groupBy("feature", "_r").agg(F.avg("_e").alias("_mae")))
    each = scores[0]
    for s in scores[1:]:
        each = each.unionByName(s)
    return (each.withColumn("_delta", F.col("_mae") - F.lit(before)).groupBy("feature")
            .agg(F.avg("_delta").alias("importance"), F.stddev_samp("_delta").alias("stddev"), F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("importance"), "feature"))
