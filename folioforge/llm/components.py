"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize


def _least(edges: DataFrame, total: int) -> DataFrame:
    """Per u: m, the least of u and its neighbours; n_rows; n_below, how many are below u."""
    below = F.count(F.when(F.col("v") < F.col("u"), True))
    m = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n_rows"), below.alias("n_below"))
    return materialize(m, "components-least", most_rows=total)


def connected_components(edges: DataFrame, name: str = "components", most_rows: int | None = None) -> DataFrame:
    """A written table (node, label) for every node that occurs in ``edges`` (a, b); label is
    the smallest node that can be reached.

    Only minima are kept per node, never lists of neighbours; the edges of a hub
    meet its minimum as a broadcast.  Every star is a written table in the shared
    folder.  Rounds grow with the logarithm of the longest path; they end as soon as
    every node has either one neighbour below it or only neighbours above it.
    ``most_rows`` is a bound on the edges, if one is known.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, most_rows=most_rows)
    n = now.count()
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        m = _least(both, 2 * n)
        if m.where("n_below > 1 or (n_below = 1 and n_rows > 1)").isEmpty():
            # the minima are the labels then; a root has no neighbour below it
            return m.select(F.col("u").alias("node"), F.col("m").alias("label"))
        large = join_hot(both, m, ["u"], 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, name, most_rows=n)
        # small star: an edge points down already, so u's neighbours are below it
        small = join_hot(large, _least(large, n), ["u"], n)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        now = materialize(small, name, most_rows=2 * n)
        n = now.count()
