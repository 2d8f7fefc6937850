"""Exact quantiles without one task per group.

Spark's exact ``percentile`` merges a value->count map of the whole group in one task.
Here the distinct values (with counts, combined map-side) are range-partitioned by
(group, value), so a hot group spreads over as many partitions as its values fill.  Counts
per (group, partition), a tiny table, give exact offsets, and ranks are resolved only in
the few (group, partition) pairs that hold a wanted position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, value: str, levels: dict[str, float], by=(), discrete: bool = False,
                    n_ranges: int | None = None) -> DataFrame:
    """One row per group with a column per ``levels`` entry (name -> q).

    Equal to ``quantile_cont`` (linear), or with ``discrete`` to ``quantile_disc`` (the
    least value that a share q of the rows does not exceed).  NULL and NaN are left out;
    without ``by`` there is one row, of NULLs for an empty frame.
    """
    from wattline.session import cut_lineage

    by = list(by)
    if not by:
        one = exact_quantiles(df.withColumn("_g", F.lit(0)), value, levels, ["_g"], discrete, n_ranges)
        return one.agg(*[F.max(n).alias(n) for n in levels])
    ranges = n_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("_v"))
    counts = v.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # written once: read for the counts and again for the ranks
    d = cut_lineage(counts.repartitionByRange(ranges, *by, "_v").withColumn("_r", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy(*by, "_r").agg(F.sum("_c").alias("_rc")).withColumn("_off", F.coalesce(F.sum("_rc").over(before), F.lit(0)))
    per = per.withColumn("_n", F.sum("_rc").over(Window.partitionBy(*by)))
    level = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in levels.items()]))
    wanted = per.withColumn("_l", level).withColumn("_name", F.col("_l.name"))
    if discrete:
        # decimals, as 0.95 * n in doubles can pass a whole number
        at = F.greatest(F.ceil(F.col("_l.q").cast("decimal(18,9)") * F.col("_n")) - 1, F.lit(0)).cast("double")
    else:
        at = F.col("_l.q") * (F.col("_n") - 1)
    wanted = wanted.select(*by, "_r", "_off", "_rc", "_name", at.alias("_h")).withColumn("_pos", F.explode(F.array(F.floor("_h"), F.ceil("_h"))))
    wanted = wanted.where((F.col("_pos") >= F.col("_off")) & (F.col("_pos") < F.col("_off") + F.col("_rc")))
    upto = Window.partitionBy(*by, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = d.join(wanted.select(*by, "_r").distinct(), [*by, "_r"], "left_semi").withColumn("_end", F.sum("_c").over(upto))
    place = F.col("_pos") - F.col("_off")
    hit = wanted.join(inside, [*by, "_r"]).where((place >= F.col("_end") - F.col("_c")) & (place < F.col("_end")))
    ends = hit.groupBy(*by, "_name", "_h").agg(F.min_by("_v", "_pos").alias("_lo"), F.max_by("_v", "_pos").alias("_hi"))
    q = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_h") - F.floor("_h"))
    return ends.select(*by, "_name", q.alias("_q")).groupBy(*by).pivot("_name", list(levels)).agg(F.first("_q"))
