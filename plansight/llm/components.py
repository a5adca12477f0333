"""Connected components of a link table by alternating star contraction.

Every round hangs nodes on smaller ones (large star, then small star) with a
minimum per node and a join; nothing is collected, and each round's links are
a written table. The number of rounds grows with the logarithm of the longest
chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, run_folder, written


def _hang(pairs: DataFrame, keep: str) -> DataFrame:
    """Hang the neighbours of u (with ``keep`` true) on the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.where(keep).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node that is reachable."""
    spark, folder = links.sparkSession, run_folder(links.sparkSession, "components")
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                    f"{folder}/0")
    seen, i = None, 0
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _hang(both, "v > u").where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        i += 1
        edges = written(small, f"{folder}/{i}")
        drop_folder(spark, f"{folder}/{i - 1}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    # a star forest: every node hangs on its component directly
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
