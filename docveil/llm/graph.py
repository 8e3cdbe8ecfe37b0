"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """edges: a, b (long). Returns v, c for each vertex of an edge; c is the smallest vertex of its component.

    Each step joins a minimum back to an edge list by vertex; nothing gathers a vertex's neighbours in one row, and
    the joins' skewed partitions can be split at run time. Self-loops are allowed; no edges give no rows. Rounds grow
    with the logarithm of a component's diameter; if ``most_rounds`` don't do, that is an error, never a partial result.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v"), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").unionByName(low.select(F.col("u").alias("v"), "m")).where("v > m").distinct()
        now = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        # done if no vertex has two edges down, or one down and one from above
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if not ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").head(1):
            break
    else:
        raise RuntimeError(f"components not found in {most_rounds} rounds")
    tops = now.select(F.col("v")).distinct().select("v", F.col("v").alias("c"))
    return now.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(tops)
