"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.storage import discard, saved


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_minima(down), "u")
    kept = joined.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(kept)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """vertex, root (the smallest vertex it reaches) for all ends of edges (u, v).

    A round is a pass of minima with partial aggregation, and a join that Spark may split at hot vertices; rounds grow with
    the logarithm of the number of links. The links stay in tables, none comes to the driver.
    """
    edges = saved(edges.where("u <> v").select("u", "v").distinct(), "stars")
    before = None
    for _ in range(most_rounds):
        older, edges = edges, saved(_small_star(_large_star(edges)).where("u <> v").distinct(), "stars")
        discard(older)
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
