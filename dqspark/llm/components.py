"""Connected components by alternating large-star and small-star steps; links stay on the executors.

Large-star links every larger neighbour of a vertex to the smallest vertex it sees, small-star does so with the smaller
neighbours. Both keep components and end in stars around their smallest vertices, after O(log^2 n) rounds at most
and two or three where links are stars already. A vertex's neighbours are only ever reduced to their minimum before
they are shuffled, and met again by a join whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def are_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one link only, and none is a smaller end too."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    return ends.groupBy("v").agg(F.sum("x").alias("x"), F.max("y").alias("y")).where("x > 1 OR x + y > 1").isEmpty()


def components(links: DataFrame, work: Workspace, name: str = "components") -> DataFrame:
    """(v, comp) for each vertex of links(a, b) that isn't the smallest of its component; comp is the smallest."""
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = work.save(edges, f"{name}-0")
    turn = 0
    while not are_stars(edges):
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = low.select("a", F.col("m").alias("b")).unionByName(rest).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
        edges = work.save(small, f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("comp"))
