"""Standardise, k-means sweep, final clusters, PCA, mix and spread.

All models are ``pyspark.ml`` estimators; the feature vectors never leave the
executors.  Spark's ``StandardScaler`` divides by the sample std (scikit-learn
by the population std): labels are unaffected, inertia scales by a constant.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def feature_columns(df: DataFrame, exclude=("client_id", "community_code")) -> list[str]:
    return [c for c in df.columns if c not in exclude]


def scale(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop incomplete rows (P7), assemble and standardise to ``features``.

    The client table (one row per client) is written once, so that the scaler, the
    estimators and the output do not scan the readings again.
    """
    from wattline.session import cut_lineage

    cols = cols or feature_columns(df)
    clean = cut_lineage(df.dropna("any", subset=cols))
    vec = VectorAssembler(inputCols=cols, outputCol="raw", handleInvalid="skip").transform(clean)
    model = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(vec)
    return model.transform(vec).drop("raw")


AT_ONCE = 8  # fits whose jobs run side by side


def _side_by_side(spark, call, items: list) -> list:
    """``call`` of every item, some at a time: independent jobs share the cluster instead of waiting for each other."""
    with ThreadPool(min(AT_ONCE, max(1, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(call), items)


def best_of(scaled: DataFrame, k: int, seed: int, starts: int):
    """The k-means model of least cost out of ``starts`` seeded ones (the first on a tie)."""
    return _best_of_each(scaled, [k], seed, starts)[0]


def _best_of_each(scaled: DataFrame, ks: list[int], seed: int, starts: int) -> list:
    """The model of least cost for every k, all starts of all k fitted side by side.

    A fit gets a view that is not itself cached, so KMeans keeps its decoded vectors for the
    fit's 20-odd passes (they spill) instead of decoding ``scaled`` anew in each; the row
    solver needs no pass to choose one.
    """
    tried = [(k, i) for k in ks for i in range(starts)]
    vectors = scaled.select("features")
    models = _side_by_side(scaled.sparkSession, lambda t: KMeans(k=t[0], seed=seed + t[1], featuresCol="features", solver="row").fit(vectors), tried)
    return [min((m for (of, _), m in zip(tried, models) if of == k), key=lambda m: m.summary.trainingCost) for k in ks]


def sweep_k(scaled: DataFrame, ks=range(2, 11), seed: int = 42, starts: int = 10) -> DataFrame:
    """Inertia (training cost) and silhouette (squared Euclidean) per k, of the best of ``starts`` fits."""
    ks = list(ks)
    scaled = scaled.select("client_id", "features").cache()
    scaled.count()  # filled once, before the fits share it
    models = _best_of_each(scaled, ks, seed, starts)

    def silhouette(m) -> float | None:
        return float(ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(m.transform(scaled))) if m.getK() > 1 else None

    scores = _side_by_side(scaled.sparkSession, silhouette, models)
    rows = [(int(k), float(m.summary.trainingCost), sil) for k, m, sil in zip(ks, models, scores)]
    scaled.unpersist()
    return scaled.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def fit_clusters(scaled: DataFrame, k: int = 4, seed: int = 42, starts: int = 10) -> DataFrame:
    """C4: final k-means labels, renumbered by cluster size (largest = 0) for stable ids."""
    fitted_on = scaled.cache()
    fitted_on.count()
    model = best_of(fitted_on, k, seed, starts)
    fitted_on.unpersist()
    pred = model.transform(scaled)
    sizes = pred.groupBy("prediction").count()
    rank = sizes.withColumn("cluster", F.row_number().over(
        Window.orderBy(F.desc("count"), F.asc("prediction"))) - 1)  # k rows only
    return pred.join(rank.select("prediction", "cluster"), "prediction").drop("prediction")


def project_2d(scaled: DataFrame) -> DataFrame:
    """First two principal components (sign is arbitrary)."""
    model = PCA(k=2, inputCol="features", outputCol="pca").fit(scaled)
    from pyspark.ml.functions import vector_to_array

    arr = vector_to_array(F.col("pca"))
    return model.transform(scaled).withColumn("pca_x", arr[0]).withColumn("pca_y", arr[1]).drop("pca")


def cluster_mix(labelled: DataFrame, by: str = "community_code", label: str = "cluster") -> DataFrame:
    """Percent of each region's clients in each cluster (row-normalised cross-tab)."""
    c = labelled.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy(by).agg(F.sum("n").alias("_t"))
    return c.join(tot, by).select(by, label, "n", (F.col("n") * 100.0 / F.col("_t")).alias("pct"))


def cluster_spread(labelled: DataFrame, value: str = "mean_kw", label: str = "cluster") -> DataFrame:
    """Box statistics; whiskers are the extreme values within 1.5 IQR of the box."""
    from wattline.operators.quantiles import exact_quantiles

    v = F.col(value)
    q = exact_quantiles(labelled, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by=[label]).join(
        labelled.groupBy(label).agg(F.count(v).alias("n")), label)
    j = labelled.select(label, value).join(q, label)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    w = j.groupBy(label).agg(F.min(F.when(v >= lo, v)).alias("whisker_lo"),
                             F.max(F.when(v <= hi, v)).alias("whisker_hi"))
    return q.join(w, label)
