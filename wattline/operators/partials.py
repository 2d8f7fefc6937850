"""Mergeable partials in day-partitioned stores: load with exact client counts (A1-A4), profiles (A8), p95 sketches (A10).

Raw readings are scanned once per load; what the reports need is kept per day and merged
for any grain and any window:

- slot partials ``(slot, region, bucket)``: the load, and a bitmap of the clients of that
  bucket of client numbers.  Sums add and bitmaps are or-ed, so the distinct clients of a
  region, a group, the nation, an hour or a day come from the same rows, exactly;
- profile partials ``(client, region, weekend, hour)`` of a day: exact sums and moments;
- quantile sketches (KLL) of a client's day.

A store is a Parquet folder partitioned by ``(day, load_id)``.  A load writes partitions of
its own for the days it touches, late rows included, and no others; running it again
replaces them (dynamic overwrite), so a failed or repeated load counts once.  Readers merge
the loads of a day; ``compact`` writes the merged days as one load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wattline import NATIONAL_ID, SLOT_MINUTES
from wattline.functions.safe import exact_mean, safe_div
from wattline.functions.timefn import floor_day
from wattline.operators import profiles as PR
from wattline.operators.dims import map_codes
from wattline.operators.panel import with_slot

SKETCH_K = 200  # of a KLL sketch: exact up to so many values, a rank error of about 1.3 % (single quantile, 99 %) beyond
SLOT_KEYS = ["datetime_15min", "community_code", "bucket"]
PROFILE_KEYS = ["client_id", "community_code", "is_weekend", "hour"]


# ---------------------------------------------------------------- the store

class DayStore:
    """Partials with a ``day`` (date), kept per (day, load).

    A load id names one batch: running it again with rows of fewer days leaves the other
    days' earlier rows, so a corrected batch with fewer days needs an id of its own and
    ``compact`` without the old one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str | None = None):
        """``schema``: that of the rows read; by default that of what this object loaded, else the files'."""
        self.spark, self.path, self.schema = spark, path, schema

    def load(self, partials: DataFrame, load_id: str, cluster_by: str) -> None:
        """Write the partials of one batch; a second call with the same id replaces the days that it touches."""
        # ranges of (day, key): a day's rows lie in few files, and a heavy day is spread
        dealt = partials.withColumn("load_id", F.lit(load_id)).repartitionByRange("day", cluster_by)
        fields = [f for f in dealt.schema.fields if f.name not in ("day", "load_id")] + [dealt.schema["day"], dealt.schema["load_id"]]
        self.schema = self.schema or StructType([StructField(f.name, f.dataType) for f in fields])  # a load without rows writes no file
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "load_id").parquet(self.path)

    def _all(self) -> DataFrame:
        return (self.spark.read.schema(self.schema) if self.schema else self.spark.read).parquet(self.path)

    def read(self, start=None, end=None) -> DataFrame:
        """The partials of the days in [start, end); other days' folders are not listed."""
        df = self._all()
        if start is not None:
            df = df.where(F.col("day") >= F.lit(str(start)).cast("date"))
        if end is not None:
            df = df.where(F.col("day") < F.lit(str(end)).cast("date"))
        return df

    def loads(self) -> DataFrame:
        """(day, load_id) of every partition, from the folder names alone."""
        return self._all().select("day", "load_id").distinct()

    def compact(self, into: DayStore, merge, cluster_by: str, start=None, end=None, load_id: str = "compacted", without: tuple[str, ...] = ()) -> None:
        """``merge`` the loads of each day (but those in ``without``) into one, written to another store (readers switch when it is done)."""
        rows = self.read(start, end)
        into.load(merge(rows.where(~F.col("load_id").isin(*without)) if without else rows), load_id, cluster_by)


# ---------------------------------------------------------------- client numbers and slot partials (A1-A4)

def number_clients(clients: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(client_id, client_no): numbers from 1 without gaps; ``known`` clients keep theirs, new ones follow.

    Numbers come from a range partitioning and the counts of the ranges before, so no
    task sees all clients.
    """
    from wattline.session import cut_lineage

    new = clients.select("client_id").where(F.col("client_id").isNotNull()).distinct()
    start = 0
    if known is not None:
        new = new.join(known, "client_id", "left_anti")
        start = known.agg(F.max("client_no")).first()[0] or 0
    placed = cut_lineage(new.repartitionByRange("client_id").sortWithinPartitions("client_id").withColumn("_row", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    per = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = placed.join(per, "_part").select("client_id", (F.col("_before") + F.col("_row") - F.col("_first") + 1 + start).alias("client_no"))
    return out if known is None else known.select("client_id", "client_no").unionByName(out)


def slot_partials(readings: DataFrame, numbers: DataFrame | None = None, width: int = SLOT_MINUTES) -> DataFrame:
    """One row per (slot, region, bucket of client numbers): day, load, rows, and the bitmap of its clients.

    Whole-number client ids are their own numbers, without a join; others need ``numbers``
    (client_id, client_no).  A null client adds to the load and to no bitmap.
    """
    r = with_slot(readings, width=width)
    if numbers is None:
        r = r.withColumn("client_no", F.col("client_id").cast("long"))
    else:
        r = r.join(numbers.select("client_id", "client_no"), "client_id", "left")
    bucket = F.coalesce(F.bitmap_bucket_number("client_no"), F.lit(0).cast("long"))
    return r.groupBy("datetime_15min", "community_code", bucket.alias("bucket")).agg(
        F.sum("active_kw").alias("active_kw"), F.count(F.lit(1)).alias("n_rows"),
        F.bitmap_construct_agg(F.bitmap_bit_position("client_no")).alias("clients")).withColumn("day", F.col("datetime_15min").cast("date"))


def merge_slots(partials: DataFrame) -> DataFrame:
    """One row per (slot, region, bucket) of several loads."""
    return partials.groupBy("day", *SLOT_KEYS).agg(F.sum("active_kw").alias("active_kw"), F.sum("n_rows").alias("n_rows"),
                                                   F.bitmap_or_agg("clients").alias("clients"))


def _clients() -> Column:
    return F.sum(F.bitmap_count("clients")).cast("long")


def roll_up(partials: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Load, rows and exact distinct clients for any grouping of slot partials (``by``: name -> expression).

    Bitmaps of a group and bucket are or-ed (map-side too), then counted and added over buckets.
    """
    p = partials.select(*[c.alias(n) for n, c in by.items()], "bucket", F.col("active_kw").alias("_kw"), F.col("n_rows").alias("_rows"), F.col("clients").alias("_c"))
    merged = p.groupBy(*by, "bucket").agg(F.sum("_kw").alias("active_kw"), F.sum("_rows").alias("n_rows"), F.bitmap_or_agg("_c").alias("clients"))
    return merged.groupBy(*by).agg(F.sum("active_kw").alias("active_kw"), F.sum("n_rows").alias("n_rows"), _clients().alias("n_clients"))


def load_from(partials: DataFrame, grain: str = "region", dim: DataFrame | None = None) -> DataFrame:
    """A1-A3 from slot partials: the rows of ``panel.load_by``."""
    if grain == "group":
        partials = map_codes(partials, dim, "community_code", "region_group", unmapped="drop")
    key = {"national": F.lit(NATIONAL_ID), "region": F.col("community_code")}.get(grain)
    if grain == "group":
        key = F.col("region_group")
    out = roll_up(partials, {"item_id": key, "datetime_15min": F.col("datetime_15min")})
    return out.drop("n_rows").withColumn("avg_kw_per_client", safe_div("active_kw", "n_clients"))


def all_grains_from(partials: DataFrame, dim: DataFrame) -> DataFrame:
    """A4 from slot partials: three grains by one pass of grouping sets over the partials, none over the readings."""
    p = map_codes(partials, dim, "community_code", "region_group", unmapped="null")
    sets = ["datetime_15min", "community_code", "region_group", "bucket"]
    gs = p.groupingSets([["datetime_15min", "bucket"], ["datetime_15min", "community_code", "bucket"], ["datetime_15min", "region_group", "bucket"]], *sets).agg(
        F.sum("active_kw").alias("active_kw"), F.bitmap_or_agg("clients").alias("clients"),
        F.grouping("community_code").alias("_no_region"), F.grouping("region_group").alias("_no_group"))
    grain = F.when(F.col("_no_region") == 0, "region").when(F.col("_no_group") == 0, "group").otherwise("national")
    item = F.when(F.col("_no_region") == 0, F.col("community_code")).when(F.col("_no_group") == 0, F.col("region_group")).otherwise(F.lit(NATIONAL_ID))
    return gs.groupBy(grain.alias("grain"), item.alias("item_id"), "datetime_15min").agg(F.sum("active_kw").alias("active_kw"), _clients().alias("n_clients"))


def clients_per_day(partials: DataFrame) -> DataFrame:
    """Exact distinct clients of a region's day, from the same bitmaps as the slots' counts."""
    return roll_up(partials, {"item_id": F.col("community_code"), "day": floor_day("datetime_15min")})


# ---------------------------------------------------------------- profiles and sketches

def daily_profiles(readings: DataFrame) -> DataFrame:
    """A8 per day: the partials of ``profiles.profile_partials`` with the day of the readings."""
    day = F.col("datetime_local").cast("date")
    r = readings.where(F.col("datetime_local").isNotNull()).select(
        "client_id", "community_code", "active_kw", F.hour("datetime_local").alias("hour"),
        F.dayofweek("datetime_local").isin(1, 7).cast("int").alias("is_weekend"), day.alias("day"))
    return r.groupBy("day", *PROFILE_KEYS).agg(*PR._moments(F.col("active_kw")))


def merge_profiles(partials: DataFrame, keys: list[str] = PROFILE_KEYS) -> DataFrame:
    """Partials of days and loads merged per ``keys``; squared deviations gain those of each part's mean from the whole mean."""
    same = Window.partitionBy(*keys)  # at most a row per day and load
    p = partials.withColumn("_mean", exact_mean("sum_kw", "n")).withColumn("_whole", exact_mean(F.sum("sum_kw").over(same), F.sum("n").over(same)))
    off = F.col("_mean") - F.col("_whole")
    out = p.groupBy(*keys).agg(
        F.sum("sum_kw").cast("decimal(38,10)").alias("sum_kw"), F.sum("sumsq_kw").alias("sumsq_kw"),
        F.sum(F.col("m2_kw") + F.coalesce(off * off * F.col("n"), F.lit(0.0))).alias("m2_kw"), F.max("max_kw").alias("max_kw"), F.sum("n").alias("n"))
    return out.withColumn("avg_kw", exact_mean("sum_kw", "n"))


def daily_sketches(readings: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """A10 per day: (day, client_id, n, sketch); null and NaN readings are left out, and a client's day without others too."""
    r = readings.where(F.col("datetime_local").isNotNull() & F.col("active_kw").isNotNull() & ~F.isnan("active_kw"))
    return r.groupBy(F.col("datetime_local").cast("date").alias("day"), "client_id").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col("active_kw").cast("double"), F.lit(k)).alias("sketch"))


def merge_sketches(partials: DataFrame) -> DataFrame:
    """One sketch per (day, client) of several loads."""
    return partials.groupBy("day", "client_id").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def p95_from(partials: DataFrame, q: float = 0.95) -> DataFrame:
    """A10 for the days given: the sketches of a client are merged (map-side too) and asked for the quantile."""
    return partials.groupBy("client_id").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")).select(
        "client_id", "n", F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("p95_kw"))
