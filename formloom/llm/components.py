"""Connected components of a link table by contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.session import cut


def components(links: DataFrame) -> DataFrame:
    """(v, component) for every end of ``links`` (a, b); the component is the smallest v in it.

    Each round every vertex points to the neighbour, or itself, whose hash is smallest, and the links
    are contracted to what is pointed at. As hashes are random the links shrink by a factor a round
    whatever the shape (a star takes two rounds, a path of n vertices about log n). A hub's neighbours
    are only ever aggregated, with partial sums before the shuffle.
    """
    links = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = ends.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("r"), "b")).alias("best"))
        own = F.struct(F.xxhash64("a").alias("r"), F.col("a").alias("b"))
        points = cut(best.select(F.col("a").alias("v"), F.least("best", own)["b"].alias("m")), "points")
        if labels is None:
            labels = points.select("v", F.col("m").alias("cur"))
        else:
            moved = points.select(F.col("v").alias("cur"), "m")
            labels = cut(labels.join(moved, "cur", "left").select("v", F.coalesce("m", "cur").alias("cur")), "labels")
        links = cut(
            links.join(points.select(F.col("v").alias("a"), F.col("m").alias("ma")), "a")
            .join(points.select(F.col("v").alias("b"), F.col("m").alias("mb")), "b")
            .filter("ma <> mb")
            .select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"))
            .distinct(),
            "links",
        )
        if links.isEmpty():
            break
    smallest = labels.groupBy("cur").agg(F.min("v").alias("component"))
    return labels.join(smallest, "cur").select("v", "component")
