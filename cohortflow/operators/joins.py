"""Joins that hold a promise about their keys.

The promise is checked inside the plan, by the rows that are joined: a broken
one fails the job instead of multiplying rows.  A checked side is aggregated
by the key it is joined on, so the aggregate's shuffle is the join's own.  (Only
where nothing of the right side is read, as in a bare count of a left join, is the
check left out with the join, which then cannot multiply rows either.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, on: list[str], what: str = "rows") -> DataFrame:
    """df, failing where several rows share a key.  Null keys match nothing and may repeat."""
    rest = [c for c in df.columns if c not in on]
    whole = F.lit(True)
    for c in on:
        whole = whole & F.col(c).isNotNull()
    seen = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*[F.col(c) for c in rest] or [F.lit(0).alias("_none")])).alias("_row"))
    key = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in on])
    broken = F.raise_error(F.concat(F.lit(f"several {what} share the key "), key)).cast("boolean")
    return seen.filter(whole).filter(F.when(F.col("_n") > 1, broken).otherwise(F.lit(True))).select(*on, *[F.col("_row")[c].alias(c) for c in rest])


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", promise: str = "m:1",
                 small: bool = False, what: str = "rows") -> DataFrame:
    """Equi-join under the promise ``m:1`` (the right side has one row a key) or ``1:1`` (both have).
    ``small``: the right side is bounded by configuration and broadcast."""
    if promise not in ("m:1", "1:1"):
        raise ValueError(promise)
    if promise == "1:1":
        keyless = left.filter(" or ".join(f"`{c}` is null" for c in on)) if how in ("left", "full") else None
        left = one_per_key(left, on, what).select(*left.columns)
        left = left if keyless is None else left.unionByName(keyless)
    right = one_per_key(right, on, what)
    return left.join(F.broadcast(right) if small else right, on, how)
