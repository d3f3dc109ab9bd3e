"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(edges: DataFrame, owner: str = "query") -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the smallest node it can reach.

    A round hangs each node's larger neighbours, then its smaller ones, on its smallest neighbour. A node's neighbours are
    never listed: the minimum is a partial aggregate, and a table of its own before it is handed back, so that both sides of that
    join are read anew and Spark can split the large keys. A round's edges are written to the shared folder; it ends when all that is left are stars around smallest nodes.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", owner)
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", owner)
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large", owner)
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "low", owner)
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(small, "edges", owner)
        for used in (now, least, large, low):
            scratch.drop(after.sparkSession, used)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v``, which is no ``u`` itself."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    return several.isEmpty() and edges.join(edges.select(F.col("v").alias("u")).distinct().hint("merge"), "u", "left_semi").isEmpty()
