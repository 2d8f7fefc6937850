"""Spark-vs-DuckDB comparison in the driver's manner: row count, column names, value hash."""

from __future__ import annotations

import hashlib
import os

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    try:
        if pd.isna(v):
            return "NULL"
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        return repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (bool,)):
        return str(int(v))
    return str(v)


def value_hash(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark_df, con, sql: str) -> dict:
    s = spark_df.toPandas()
    o = con.execute(sql).fetchdf()
    res = {"rows_spark": len(s), "rows_oracle": len(o),
           "cols_match": sorted(s.columns) == sorted(o.columns)}
    res["rows_match"] = res["rows_spark"] == res["rows_oracle"]
    res["hash_match"] = res["cols_match"] and value_hash(s) == value_hash(o)
    if not res["cols_match"]:
        res["cols"] = (sorted(s.columns), sorted(o.columns))
    return res
