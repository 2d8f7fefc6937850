"""Saving and loading predictors (F3, F8): a fixed predictor is fitted once and used by later sessions.

A predictor's folder holds ``config`` (its class, settings and cutoff), and what it learned:
a tree model and the levels of its series, or its members in folders of their own.
"""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from wattline.operators import forecast as fc
from wattline.operators.tree import TreeForecaster

SIMPLE = {"SeasonalNaive": (fc.SeasonalNaive, ("season", "target", "fallback", "name")), "SlotMean": (fc.SlotMean, ("target", "name"))}


def _config_of(model) -> dict:
    kind = type(model).__name__
    if kind in SIMPLE:
        return {"kind": kind, "args": {a: getattr(model, a) for a in SIMPLE[kind][1]}}
    if isinstance(model, fc.WeightedEnsemble):
        return {"kind": kind, "args": {"weights": list(model.weights), "name": model.name}, "members": len(model.members)}
    if isinstance(model, TreeForecaster):
        if model.model is None:
            raise ValueError("a tree forecaster is saved after its fit")
        return {"kind": kind, "args": {"target": model.target, "max_iter": model.max_iter, "max_depth": model.max_depth, "seed": model.seed},
                "features": model.feature_names, "cutoff": None if model.cutoff is None else str(model.cutoff)}
    raise TypeError(f"{kind} cannot be saved")


def save_predictor(spark: SparkSession, model, path: str) -> None:
    """Write ``model`` below ``path`` (on storage that later sessions reach), over what is there."""
    config = _config_of(model)
    if config["kind"] == "TreeForecaster":
        model.model.write().overwrite().save(f"{path}/model")
        model.levels.write.mode("overwrite").parquet(f"{path}/levels")
    for i in range(config.get("members", 0)):
        save_predictor(spark, model.members[i], f"{path}/member-{i}")
    # the config is written last: a folder without it is not a predictor
    spark.createDataFrame([(json.dumps(config),)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_predictor(spark: SparkSession, path: str):
    """The predictor saved below ``path``; it predicts what the saved one did."""
    config = json.loads(spark.read.text(f"{path}/config").first()[0])
    kind, args = config["kind"], config["args"]
    if kind in SIMPLE:
        return SIMPLE[kind][0](**args)
    if kind == "WeightedEnsemble":
        return fc.WeightedEnsemble([load_predictor(spark, f"{path}/member-{i}") for i in range(config["members"])], **args)
    model = TreeForecaster(**args)
    model.model = PipelineModel.load(f"{path}/model")
    model.levels = spark.read.parquet(f"{path}/levels")
    model.feature_names, model.cutoff = config["features"], config["cutoff"]
    return model
