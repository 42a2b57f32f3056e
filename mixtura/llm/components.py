"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixtura.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every id in ``links`` (a, b): the least id that it reaches.

    Each round, a vertex points at its least neighbour where that is smaller, then at what that one points
    at. Links are drawn between the vertices pointed at, once each, and those inside one vertex go, so a
    round works on what the rounds before left open: stars are done in one or two, a chain in about the
    logarithm of its length. All sides of the joins are read from written tables, so Spark can split a
    vertex with very many links.
    """
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        # The smaller end of a link has it among its own, the larger end takes the least.
        least = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("label")).union(edges.select(F.col("a").alias("v"), F.col("a").alias("label")))
        points = written(least.groupBy("v").agg(F.min("label").alias("label")), "points")
        jump = points.select(F.col("v").alias("label"), F.col("label").alias("jump"))
        points = written(points.join(jump, "label").select("v", F.col("jump").alias("label")), "points")
        if labels is None:
            labels = points
        else:
            of = points.select(F.col("v").alias("label"), F.col("label").alias("to"))
            labels = written(labels.join(of, "label", "left").select("v", F.coalesce("to", "label").alias("label")), "labels")
        low = points.select(F.col("v").alias("a"), F.col("label").alias("x"))
        high = points.select(F.col("v").alias("b"), F.col("label").alias("y"))
        drawn = edges.join(low, "a").join(high, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = written(drawn, "links")
        if edges.isEmpty():
            return labels
