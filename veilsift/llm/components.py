"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilsift.llm.common import discard, materialize


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and comp, the smallest node that links reach, for every node of links(a, b).

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to the least node
    it knows, until nothing changes; what remains are stars around the least nodes. Links stay in tables
    in the shared folder: never on the driver, and not lost with an executor. Nodes may be of any type that has an order.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = _state(edges)
    for _ in range(most_rounds):
        older, edges = edges, materialize(_small_star(_large_star(edges)), "links")
        discard(older)
        before, state = state, _state(edges)
        if before == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    raise RuntimeError(f"links have not settled after {most_rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    handed = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return handed.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
