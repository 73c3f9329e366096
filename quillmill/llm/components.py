"""Connected components of a graph kept in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.runtime import materialize, release


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every vertex of edges (a, b), both long; the component is its smallest vertex.

    Alternates large-star and small-star steps, each an aggregate and a join, until every vertex has one edge to a least one.
    Vertices of high degree only meet in partial minima. Loops are allowed; nulls and repeated edges are ignored. No edges, no
    rows.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    for _ in range(most_rounds):
        ends = now.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty():
            break
        # Large star: neighbours above a vertex move to the least vertex around it.
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct())
        # Small star: a vertex and its neighbours below it move to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = materialize(small.where("a > b").distinct())
        release(now, large)
        now = after
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def joined(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """What components() would give if edges had been among those that led to ``reached``: only whole components are linked."""
    own = lambda c: reached.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    between = edges.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    moved = materialize(components(between))
    new = moved.select(F.col("id").alias("component"), F.col("component").alias("to"))
    kept = reached.join(new, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return kept.union(moved.join(reached.select("id"), "id", "left_anti"))
