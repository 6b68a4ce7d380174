"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersight.operators.staging import stage


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Hang the neighbours of every node below the smallest node around it.

    links: u > v. larger: of a node's neighbours move those above it (large-star), else those below
    it and the node itself (small-star).
    """
    if larger:
        around = links.select(F.col("u").alias("n"), F.col("v").alias("w")).unionAll(
            links.select(F.col("v").alias("n"), F.col("u").alias("w"))
        )
    else:
        around = links.select(F.col("u").alias("n"), F.col("v").alias("w"))
    least = around.groupBy("n").agg(F.min("w").alias("m")).select("n", F.least("n", "m").alias("m"))
    if larger:
        moved = around.join(least, "n").where("w > n").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        moved = (
            around.join(least, "n").where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v"))
        ).unionAll(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Edges with a null end, loops and repeats change nothing. Rounds grow with the logarithm of a
    component's size; each is two joins and is written to the shared folder.
    """
    links = stage(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    mark = None
    while True:
        sums = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
        if not sums[0]:
            break
        links = stage(_stars(_stars(links, True), False))
    tops = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(tops)
