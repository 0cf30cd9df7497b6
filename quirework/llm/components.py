"""Connected components of a link table, by alternating large and small stars.

Every step is an aggregation with partial sums and a join by node; a node of very
many links is no group that a task must hold. Nothing is collected but whether a
round has left anything but stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save


def _least(directed: DataFrame) -> DataFrame:
    """Of each node the least of itself and its neighbours (u, v: v a neighbour of u)."""
    return directed.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("u_"), F.least("u", "v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _least(both)
    return both.filter("v > u").join(m, F.col("u") == F.col("u_")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _least(down)
    near = down.join(m, F.col("u") == F.col("u_")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(m.select(F.col("u_").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()


def _only_stars(links: DataFrame) -> bool:
    """Whether each node is either the end of one link or a centre: as steps keep what is connected, each star then is a component."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("n")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("n")))
    return ends.groupBy("x").agg(F.sum("n").alias("ends"), F.min("n").alias("least")).filter("ends > 1 OR (ends = 1 AND least = 0)").isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every linked node, from links (u, v); the component is its least node."""
    now = save(links.select("u", "v").filter("u <> v").distinct(), "cc-links")
    for _ in range(rounds):
        large = save(_large_star(now), "cc-large")
        new = save(_small_star(large), "cc-small")
        drop(now, large)
        now = new
        if _only_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError("components didn't settle")
