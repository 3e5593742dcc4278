"""Connected components of an edge table, on Spark.

Alternates large-star and small-star: each node's larger neighbours, then its
smaller ones, are hung under the least node it knows, until every edge points
to the least node of its component.  Every round is a map-side combined
minimum and a join, written to the shared folder; a node with very many edges
is one key of a pre-aggregated minimum, and the join that brings the minimum
back is one that Spark splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import drop_staged, staged


def _star(edges: DataFrame) -> DataFrame:
    """Least neighbour (or self) of each node, joined back to its edges."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for the nodes of ``edges``
    (columns a, b; a <> b); staged."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u <> v").distinct(), "cc-large")
        small = _star(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        small = staged(small.filter("u <> v").distinct(), "cc-small")
        old, now = now, small
        # done when every node has one edge and no root has an edge of its own
        twice = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        roots = small.select(F.col("v").alias("u")).distinct().join(small.select("u").distinct(), "u", "left_semi")
        done = twice.unionByName(roots).isEmpty()
        drop_staged(old, large)
        if done:
            ends = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return staged(ends.unionByName(ends.select(F.col("root").alias("node"), "root").distinct()), "cc")
