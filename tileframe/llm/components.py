"""Connected components of a graph of long ids, as rounds of joins and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges a task writes.
A_TASK = 20_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation: each vertex hands its (larger, or other) neighbours to its
    smallest neighbour. ``edges``: u, v in one direction each, distinct."""
    both = edges.union(edges.select(F.col("v"), F.col("u"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    moved = joined.filter("v > u") if large else joined.filter("v != m").unionByName(joined.select("m", F.col("u").alias("v"), F.col("u")))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex has one smaller neighbour at most, which itself has none."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    of = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not of.filter("up > 1 OR up = 1 AND down = 1").agg(F.count("*").alias("n")).first()["n"]


def roots(links: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """id, root (smallest id of the component) of every id in ``links`` (a, b; ``most`` rows
    at most, if that is known).

    Large-star and small-star rounds, which never add edges; each round is written to the
    shared folder, and the rounds end when all components are stars around their roots."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = common.materialize(edges if most is None else common.gathered(edges, most, A_TASK), name)
    n = edges.count()
    while n and not _stars(edges):
        done, edges = edges, common.materialize(common.gathered(_star(_star(edges, True), False), n, A_TASK), name)
        common.discard(done)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v"))).distinct()
