"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that the links reach, for every node of an edge.

    Alternates two star steps, each a minimum per node joined back to the edges: every node
    hooks its larger neighbours, then its smaller ones and itself, to its least neighbour. The
    minimum combines before its shuffle and the joined side has one row per node, so a hub is a
    splittable join key and never a list. Every round is written to the shared folder; the
    rounds end when the edges no longer change. Null ends and self links are left out.
    """
    links = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u is not null and v is not null and u < v")
    links = cut(links.distinct(), "edges")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        links = cut(small.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    nodes = links.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return nodes.unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
