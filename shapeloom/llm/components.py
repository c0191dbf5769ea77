"""Connected components of a link table, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace


def _with_least(pairs: DataFrame) -> DataFrame:
    """a, b of every pair, with the least of a and all its b."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    return pairs.join(least, "a").select("a", "b", F.least("a", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id in links (columns a, b).

    Each round hangs the larger neighbours of every id, and then its smaller ones, on the least neighbour. The minima are
    combined before the shuffle, each round is written to the shared folder, and the rounds end when only stars are left,
    after about the logarithm of the longest path.
    """
    edges = workspace.stash(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while not _only_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = _with_least(both)
        large = hung.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(hung.where("m < a").select("a", F.col("m").alias("b")))
        small = _with_least(large.where("a > b").distinct())
        hung = small.select("a", F.col("m").alias("b")).unionByName(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = workspace.stash(hung, "stars")
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _only_stars(edges: DataFrame) -> bool:
    """Whether every id hangs on one centre and no centre hangs on another id."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ups, downs = F.sum("up").alias("ups"), F.sum("down").alias("downs")
    return ends.groupBy("id").agg(ups, downs).where("ups > 1 OR (ups > 0 AND downs > 0)").isEmpty()
