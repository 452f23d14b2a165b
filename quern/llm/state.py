"""Connected components over edge tables (and the lineage cuts that the operators use)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.checkpoints import checkpoint_dir, cut

__all__ = ["checkpoint_dir", "components", "cut"]


def _digest(edges: DataFrame) -> tuple:
    """Number of (distinct) edges and a hash of them all, in any order."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(7)))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, least): the smallest node of each connected component of ``edges(a, b)`` (longs).

    Alternates large-star and small-star steps; each is a minimum for each node (combined before
    the shuffle) and one equi-join, and the number of rounds grows with the logarithm of the
    component size.  Nodes without an edge are not returned."""
    e = cut(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    held = _digest(e)
    for _ in range(rounds):
        both = e.union(e.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b")
        # each node of e now points at nodes smaller than itself
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("b AS a", "m AS b").union(low.selectExpr("a", "m AS b")).where("a <> b").distinct()
        e, before = cut(small), held
        held = _digest(e)
        if held == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "node").union(e.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct())
