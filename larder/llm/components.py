"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.skew import lookup
from larder.llm.workspace import Workspace


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """node, component (the smallest node reachable) of every node in ``links`` (a, b; both long).

    In each round every node points to its smallest neighbour, pointers are followed a few steps, and links
    are redrawn between the nodes pointed to; links shrink at least by half of the nodes they connect. A node that very
    many others point to is joined in salted parts."""
    edges = space.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-links-0")
    labels = None
    turn = 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p")).select(F.col("a").alias("v"), "p")
        points = space.write(points, f"{name}-points-{turn}")
        for jump in range(2):
            up = points.select(F.col("v").alias("p"), F.col("p").alias("q"))
            points = space.write(lookup(points, up, "p", "v").select("v", F.col("q").alias("p")), f"{name}-points-{turn}-{jump}")
        if labels is None:
            labels = points.select(F.col("v").alias("node"), F.col("p").alias("component"))
        else:
            to = points.select(F.col("v").alias("component"), F.col("p").alias("q"))
            labels = lookup(labels, to, "component", "node", "left").select("node", F.coalesce("q", "component").alias("component"))
        labels = space.write(labels, f"{name}-labels-{turn}")
        redrawn = lookup(edges, points.select(F.col("v").alias("a"), F.col("p").alias("q")), "a", "b").select(F.col("q").alias("a"), "b")
        redrawn = space.write(redrawn, f"{name}-half-{turn}")
        redrawn = lookup(redrawn, points.select(F.col("v").alias("b"), F.col("p").alias("q")), "b", "a").select("a", F.col("q").alias("b")).filter("a <> b")
        turn += 1
        edges = space.write(redrawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links-{turn}")
        if edges.isEmpty():
            return labels
