"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.stages import materialize


def _with_smallest(pairs: DataFrame, near: str, far: str) -> DataFrame:
    """Adds ``least``: the smallest of ``near`` and all its ``far`` ends.

    The minimum is a map-side combined aggregate joined back on, so the links of a
    vertex with very many of them need not meet in one task.
    """
    least = pairs.groupBy(F.col(near).alias("of")).agg(F.least(F.min(far), F.col("of")).alias("least"))
    return pairs.join(least, F.col(near) == F.col("of")).drop("of")


def large_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to the smallest vertex around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (_with_smallest(both, "a", "b").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .filter("a <> b").distinct())


def small_star(edges: DataFrame) -> DataFrame:
    """Every vertex links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    grown = _with_smallest(down, "a", "b")
    return (grown.select(F.col("b").alias("a"), F.col("least").alias("b"))
            .union(grown.select("a", F.col("least").alias("b"))).filter("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(vertex, root) of every vertex of ``edges`` (a, b), root being the smallest vertex reachable.

    Loops and repeated links are ignored.  Each round is written to the shared folder;
    the number of rounds grows with the logarithm of the longest path.
    """
    now = materialize(edges.select("a", "b").filter("a <> b").distinct())
    size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)"))).first()
    while size[0]:
        now = materialize(small_star(large_star(now)))
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == size:
            break
        size = after
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
