"""Sinks (S4-S6, S10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish_forecast(pred: DataFrame, team_name: str, run_id: str | None = None, submitted_at: str | None = None) -> DataFrame:
    """Shape forecasts as the submission table ``(team_name, datetime_15min, prediction, submitted_at)``.

    ``run_id`` (optional) becomes a partition column so that overwriting one
    run keeps the others (dynamic partition overwrite in ``write_runs``).  ``submitted_at``
    fixes the time of submission; by default it is the time of the query.
    """
    out = pred.select(
        F.lit(team_name).alias("team_name"),
        F.col("datetime_15min").cast("timestamp_ntz").alias("datetime_15min"),
        F.col("prediction").cast("double").alias("prediction"),
        (F.current_timestamp() if submitted_at is None else F.lit(submitted_at).cast("timestamp")).alias("submitted_at"),
    )
    if run_id is not None:
        out = out.withColumn("run_id", F.lit(run_id))
    return out


def write_runs(df: DataFrame, path: str, observe_name: str = "written") -> int:
    """Write partitioned by ``run_id`` with dynamic overwrite; the row count is
    taken with ``observe`` in the same pass instead of a second job (S5)."""
    from pyspark.sql import Observation

    obs = Observation(observe_name)
    (df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("run_id").parquet(path))
    return int(obs.get["rows"])


def write_leaderboard(lb: DataFrame, path: str) -> None:
    """Leaderboard to CSV with a header."""
    lb.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _clean_name(col):
    """Metric-name cleaning (P27): spaces and '[' become '_', ']' is removed."""
    return F.regexp_replace(F.regexp_replace(col, r"[ \[]", "_"), r"\]", "")


def metric_log(lb: DataFrame, n_items_col: str = "n_items") -> DataFrame:
    """Long metric rows (S10): per model the average and summed regional MAE."""
    name = _clean_name(F.col("model"))
    score = F.abs(F.col("score_val"))
    wide = lb.select(
        F.concat(F.lit("val_avg_region_MAE_"), name).alias("m1"), score.alias("v1"),
        F.concat(F.lit("val_sum_region_MAE_"), name).alias("m2"),
        (score * F.col(n_items_col)).alias("v2"),
    )
    return wide.select(
        F.inline(F.array(
            F.struct(F.col("m1").alias("metric"), F.col("v1").alias("value")),
            F.struct(F.col("m2").alias("metric"), F.col("v2").alias("value")),
        ))
    )


def append_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    metrics.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)
