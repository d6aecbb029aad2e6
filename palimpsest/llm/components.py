"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """vid, label for every end of an edge: label is the least id that can be reached.

    Least neighbours are found by a partial aggregate, so a hub of many edges is summed before it is
    shuffled; rounds grow with the logarithm of the largest component.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    now = saved(edges.where(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct(), "edges")
    state = _state(now)
    while True:
        # Large star: neighbours above a vertex go to its least neighbour.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a vertex and its neighbours below go to the least of them.
        large = saved(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(moved.union(least.select("u", "m")).distinct(), "small-star")
        dropped(now)
        dropped(large)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("vid"), F.col("v").alias("label")).union(now.select("v", "v").distinct())
