"""Catalog tables (S1, S4, S5): registered sources, run-partitioned results, bucketed series.

Data lies below a path that the caller gives (a shared folder); the catalog holds names and
schemas.  Any catalog of the session serves, the built-in one included.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wattline.sources.tables import CATALOG, read_table

RUN = "run_id"


class SchemaMismatch(ValueError):
    """A frame whose columns do not fit the table that it is meant for."""


def register_sources(spark: SparkSession, sf_dir: str, database: str, location: str, tables: list[str]) -> str:
    """External catalog tables over the Parquet files of a folder; the result names them as a source for the readers."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    for t in tables:
        if not spark.catalog.tableExists(f"{database}.{t}"):
            spark.catalog.createTable(f"{database}.{t}", path=os.path.join(sf_dir, f"{t}.parquet"), source="parquet")
    return f"{CATALOG}{database}"


def check_schema(given: StructType, wanted: StructType) -> None:
    """Names (in any order) and types must be the table's; what differs is named."""
    a, b = ({f.name: f.dataType for f in s.fields} for s in (given, wanted))
    wrong = [f"{c} is missing" for c in b if c not in a] + [f"{c} is not a column of the table" for c in a if c not in b]
    wrong += [f"{c} is {a[c].simpleString()}, not {b[c].simpleString()}" for c in b if c in a and a[c] != b[c]]
    if wrong:
        raise SchemaMismatch("; ".join(wrong))


def write_run(df: DataFrame, table: str, run_id: str, path: str | None = None) -> int:
    """Put the rows of one run into a table partitioned by run, and return their number (counted on the way).

    The table is made if it does not exist (``path``: where its data go), else the frame must
    have its columns.  Running a run again replaces that run's rows and no others.
    """
    spark = df.sparkSession
    obs = Observation()
    rows = df.drop(RUN).withColumn(RUN, F.lit(run_id))
    if not spark.catalog.tableExists(table):
        out = rows.observe(obs, F.count(F.lit(1)).alias("rows")).write.format("parquet").partitionBy(RUN)
        (out.option("path", path) if path else out).saveAsTable(table)
    else:
        wanted = spark.table(table)
        check_schema(rows.schema, wanted.schema)
        view = f"run_{uuid.uuid4().hex}"
        rows.select(*[c for c in wanted.columns if c != RUN]).observe(obs, F.count(F.lit(1)).alias("rows")).createOrReplaceTempView(view)
        # one named partition is overwritten, with nothing if the run has no rows
        literal = run_id.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({RUN} = '{literal}') SELECT * FROM {view}")
        spark.catalog.dropTempView(view)
    return int(obs.get["rows"])


def read_run(spark: SparkSession, table: str, run_id: str) -> DataFrame:
    """The rows of one run; only its folder is read."""
    return spark.table(table).where(F.col(RUN) == run_id).drop(RUN)


def write_bucketed(df: DataFrame, table: str, by: list[str], sort: list[str], path: str, buckets: int | None = None) -> DataFrame:
    """A table in hash buckets of ``by``, a sorted file each: joins and windows on ``by`` read it without a shuffle."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *by).write.format("parquet").mode("overwrite").bucketBy(n, *by).sortBy(*sort).option("path", path).saveAsTable(table)
    return spark.table(table)


__all__ = ["CATALOG", "SchemaMismatch", "check_schema", "read_run", "read_table", "register_sources", "write_bucketed", "write_run"]
