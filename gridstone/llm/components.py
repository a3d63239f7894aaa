"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.tables import discard, written


def _least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and its partners; the minima are pre-aggregated, and the join can split a hot u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down)
    out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _is_star(links: DataFrame) -> bool:
    """Whether each node has one link, to a node without any."""
    n, nodes = links.agg(F.count("*"), F.count_distinct("u")).first()
    return n == nodes and links.join(links.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is one node of its component, the
    same for all: the least, or the centre where the links are stars already.

    Rounds of stars shrink the links until each node hangs on its root; rounds
    grow with the logarithm of the longest path. Each round is written to the
    shared folder. Links with a null end, and of a node to itself, count for
    nothing. Nodes may be of any orderable type.
    """
    links = links.filter("u is not null and v is not null and u != v").select("u", "v").distinct()
    links = written(links, "links")
    while not _is_star(links):
        old = links
        links = written(_small_star(_large_star(links)), "links")
        discard(old)
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
