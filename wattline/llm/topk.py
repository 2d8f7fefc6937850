"""Exact top-k inner-product search over norm buckets (operator 4).

Vectors are sorted by length and cut into buckets of like lengths, whose size is
bounded.  A query needs a product of at least its threshold, so in a bucket with
greatest length l it needs a cosine of threshold / (|q| l), its local threshold:
above 1 the whole bucket is skipped.  Where the local threshold is high, the
bucket prunes by coordinates (for unit vectors, a cosine of t with q bounds every
coordinate of p to an interval around t * q_i); where it is low, only the prefix
of long enough vectors is kept.  Products of what is left are computed and
verified.  The first threshold of each query comes from the bucket of the longest
vectors, and rises while a task works.

Queries come in blocks and each (query block, bucket) pair is a group of its own,
so no task holds all queries or all candidates.  A query is sent only to buckets whose
longest vector can meet its threshold, and a bucket only to blocks that ask for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import Scratch, numbered

BUCKET_ROWS = 8192
QUERY_ROWS = 1024
HIT = "query_id long, vec_id long, score long"
COORDINATE_FROM = 0.6  # local cosine threshold from which a bucket prunes by coordinates
COORDINATES = 3


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v, n2): floor(scale * x) per component; vectors null or with null or non-finite parts are left out."""
    # no component of a kept vector is null, so a comparison that is not true means a bad part
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
            .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
            .select("vec_id", whole.alias("v"))
            .withColumn("n2", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)))


def _keep_best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id; a repeated row counts as often as it occurs."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        there = np.flatnonzero(score >= least)
        return there[np.lexsort((ids[there], -score[there]))][:k]
    return np.lexsort((ids, -score))[:k]


def search_bucket(queries: pd.DataFrame, bucket: pd.DataFrame, k: int, stats: dict | None = None) -> list[tuple[int, int, int]]:
    """Up to k (query_id, vec_id, score) per query, from one bucket, that can still be among its best.

    ``queries``: query_id, q, n2 and ``least`` (a score that k rows are known to reach, or null).
    ``bucket``: vec_id, v, n2.  Vectors of another dimension than the query's do not meet it.
    """
    out: list[tuple[int, int, int]] = []
    for dim in np.unique(queries["q"].map(len)):
        qs = queries[queries["q"].map(len) == dim]
        b = bucket[bucket["v"].map(len) == dim].sort_values(["n2", "vec_id"], ascending=[False, True])
        if not len(b):
            continue
        v = np.stack(b["v"].to_numpy()).astype(np.float64).reshape(len(b), dim)
        ids, length = b["vec_id"].to_numpy(), np.sqrt(b["n2"].to_numpy(np.float64))
        unit = v / np.maximum(length, 1e-300)[:, None]
        exact = float(length[0]) * np.sqrt(float(qs["n2"].max())) < 2.0 ** 52  # else products in Python integers
        for qid, q, n2, least in qs[["query_id", "q", "n2", "least"]].itertuples(index=False):
            q = np.asarray(q, np.float64)
            size = float(np.sqrt(n2))
            at = np.arange(len(b))
            if not pd.isna(least) and least > 0 and size > 0:
                local = least / (size * length[0]) if length[0] > 0 else np.inf
                if local > 1 + 1e-9:
                    continue
                at = np.arange(np.searchsorted(-length, -least / size * (1 - 1e-9), "right"))  # long enough
                if local >= COORDINATE_FROM:
                    u = q / size
                    t = np.minimum(least / (size * np.maximum(length[at], 1e-300)), 1.0)
                    for i in np.argsort(-np.abs(u))[:COORDINATES]:
                        reach = np.sqrt(np.maximum((1 - t * t) * (1 - u[i] * u[i]), 0)) + 1e-9
                        p = unit[at, i]
                        # cos >= t: p_i lies within t*u_i -/+ reach on the side away from q, and up to u_i's side
                        low = np.where(u[i] >= 0, t * u[i] - reach, -1.0)
                        high = np.where(u[i] <= 0, t * u[i] + reach, 1.0)
                        keep = (p >= low) & (p <= high)
                        at, t = at[keep], t[keep]
            at = at[ids[at] != qid]
            if stats is not None:
                stats["verified"] = stats.get("verified", 0) + len(at)
            if not len(at):
                continue
            score = v[at] @ q if exact else np.array([sum(int(x) * int(y) for x, y in zip(v[a], q)) for a in at], object)
            score = score.astype(np.int64)
            best = _keep_best(score, ids[at], k)
            out += [(int(qid), int(ids[at[j]]), int(score[j])) for j in best]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024,
          bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer products of each query with every other row.

    ``queries`` and ``vectors`` have vec_id and embedding.  Ties go to the smaller
    vec_id.  Unfit vectors take no part on either side; a query without candidates
    has no rows; a repeated candidate row counts as often as it occurs, a repeated
    query id stands for its smallest vector; empty tables give no rows.
    """
    spark = vectors.sparkSession
    keep = Scratch(spark, "topk")
    rows = quantised(vectors, scale)
    n = rows.count()
    buckets = max(1, -(-n // bucket_rows))
    # equal lengths (a third of all rows may be one vector) part by vec_id
    cand = keep.table("candidates", rows.repartitionByRange(buckets, F.col("n2").desc(), "vec_id")
                      .withColumn("bucket", F.spark_partition_id()))
    top = cand.agg(F.min("bucket")).first()[0]
    q = quantised(queries, scale).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "n2")).alias("s"))
    q = q.select("query_id", F.col("s.v").alias("q"), F.col("s.n2").alias("n2"))
    blocks = max(1, -(-q.count() // query_rows))
    q = keep.table("queries", q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")))
    lengths = keep.table("lengths", cand.groupBy("bucket").agg(F.max("n2").alias("most")))  # a row per bucket

    def hits(name: str, left: DataFrame) -> DataFrame:
        """Query blocks against buckets: a group per pair of which a query still asks for the bucket (column ``bucket``)."""
        pairs = keep.table(name, left.select("block", "bucket").distinct())

        def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            found = search_bucket(a, b, k) if len(a) and len(b) else []
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

        return left.groupBy("block", "bucket").cogroup(cand.join(pairs, "bucket").groupBy("block", "bucket")).applyInPandas(search, HIT)

    first = keep.table("first", hits("first-pairs", q.withColumns({"least": F.lit(None).cast("long"), "bucket": F.lit(top or 0)})))
    # the k-th best of the longest vectors: a score that k rows are known to reach
    least = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    # a candidate must be this long; queries of like needs share a block, and no block is sent to buckets that are too short for all of it
    need = F.coalesce(F.when((F.col("least") > 0) & (F.col("n2") > 0), F.col("least") / F.sqrt(F.col("n2").cast("double"))), F.lit(0.0)) * (1 - 1e-9)
    bound = numbered(keep, "by_need", q.drop("block").join(least, "query_id", "left").withColumn("need", need), ["need", "query_id"])
    bound = bound.withColumn("block", F.floor(F.col("pos") / query_rows).cast("int")).drop("pos", "n")
    last = lengths.agg(F.max("bucket")).first()[0]
    others = F.explode(F.sequence(F.lit(top + 1), F.lit(last))) if last is not None and last > top else F.explode(F.array().cast("array<int>"))
    asks = bound.withColumn("bucket", others).join(lengths, "bucket").where(F.sqrt(F.col("most").cast("double")) >= F.col("need")).drop("most", "need")
    rest = hits("rest-pairs", asks)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
