"""Dimension lookups.

No side carries a broadcast hint: Spark broadcasts one only if its size, measured again at
run time by AQE, is under ``spark.sql.autoBroadcastJoinThreshold``; a larger one is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def map_codes(df: DataFrame, dim: DataFrame, key: str, value: str,
              out: str | None = None, unmapped: str = "drop") -> DataFrame:
    """Look ``df[key]`` up in ``dim(key, value)``.

    ``unmapped='drop'`` removes unknown keys (the dict-map + dropna of the
    reference), ``'null'`` keeps them with NULL (a map lookup, D25),
    ``'label'`` keeps them as the string ``unmapped``.
    """
    out = out or value
    lookup = dim.select(F.col(key).alias("_k"), F.col(value).alias(out)).distinct()
    how = "inner" if unmapped == "drop" else "left"
    res = df.join(lookup, df[key] == F.col("_k"), how).drop("_k")
    if unmapped == "label":
        res = res.withColumn(out, F.coalesce(F.col(out), F.lit("unmapped")))
    return res
