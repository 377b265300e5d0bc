"""Connected components of links between 64-bit node ids.

They use the alternating large-star / small-star
contraction (Kiveris et al., 2014): every round is two aggregations and two equi-joins, so a hub
is only a skewed join key, never a group that one task has to hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges``; the root is the smallest node reachable.

    Self-links and repeated links are harmless, links with a null end are dropped, no links give
    no rows.  The loop ends when a round changes nothing (the round limit only guards the driver).
    """
    pairs = edges.select(F.col(src).cast("long").alias("x"), F.col(dst).cast("long").alias("y")).where("x is not null and y is not null and x != y")
    now = materialize(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "cc")
    state = None
    for _ in range(max_rounds):
        size = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first()
        if size[0] == 0 or tuple(size) == state:
            break
        state = tuple(size)
        after = materialize(_small_star(_large_star(now)), "cc")
        discard(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
