"""Connected components of a pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.storage import saved


def connected_components(nodes: DataFrame, pairs: DataFrame, id_col: str = "id", most_rounds: int = 60) -> DataFrame:
    """Id, component (the smallest id reachable); nodes without pairs are their own.

    Rounds of large-star and small-star until the edges no longer change.
    ``pairs`` has columns ``left_id`` and ``right_id``.
    """
    edges = saved(pairs.filter("left_id != right_id").select(F.greatest("left_id", "right_id").alias("a"), F.least("left_id", "right_id").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = saved(small.filter("a != b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components are unfinished after {most_rounds} rounds")
    return nodes.select(F.col(id_col).alias("id")).join(edges.select(F.col("a").alias("id"), F.col("b").alias("m")), "id", "left").select("id", F.coalesce("m", "id").alias("component"))
