"""Connected components of a table of links, by alternating large and small stars.

Each step moves every node's neighbours to the smallest node that it knows, so a link table shrinks
to stars in a number of steps that grows with the logarithm of the longest path.  A hub of very many
links is handled by partial minima and by joins of written tables, which Spark splits where skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import cut_lineage


def _least(links: DataFrame) -> DataFrame:
    return cut_lineage(links.groupBy("u").agg(F.min("v").alias("m")), "least")


def star_round(links: DataFrame) -> DataFrame:
    """One large and one small star over ``links(u, v)`` of different nodes: links of the same
    components, each from a node to a smaller one."""
    both = cut_lineage(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both-ways")
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = cut_lineage(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"), "down")
    least = _least(down)
    small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")


def labels(stars: DataFrame) -> DataFrame:
    """``(node, component)`` after a round: nodes of one label are connected, though not all connected ones
    need have one."""
    return cut_lineage(stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "star-labels")


def _are_stars(links: DataFrame) -> bool:
    """Whether every node is either a centre or linked to one centre only."""
    roles = links.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    roles = roles.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return roles.where("leaf > 1 or (leaf = 1 and centre = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``links(u long, v long)``; the component is its smallest node."""
    links = star_round(links.where("u <> v").select("u", "v"))
    while not _are_stars(links):
        links = star_round(links)
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
