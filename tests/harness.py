"""Spark-vs-DuckDB comparison in the spirit of the driver's correctness gate:
row count + column names + order-insensitive values (floats compared with a
relative tolerance)."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark_df, con, sql: str) -> dict:
    sp = spark_df.toPandas()
    dk = con.execute(sql).df()
    res = {"rows_spark": len(sp), "rows_oracle": len(dk),
           "schema_match": sorted(sp.columns) == sorted(dk.columns)}
    res["rows_match"] = len(sp) == len(dk)
    if res["schema_match"] and res["rows_match"]:
        a, b = rows(sp), rows(dk)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        res["values_match"] = not bad
        res["first_diff"] = bad[:2]
    else:
        res["values_match"] = False
        res["cols_spark"] = sorted(sp.columns)
        res["cols_oracle"] = sorted(dk.columns)
    return res
