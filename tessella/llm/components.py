"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, materialise


def _meet(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """``edges`` (u, v) with m of ``least`` (u, m, n: how many edges have this u). Hubs meet their many edges where these are read."""
    return heavy_join(edges, least, "u", "n", rows)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
    return _meet(both.where("v > u"), least, 2 * edges.count()).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialise(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    side = _meet(down, least, edges.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return side.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long) with root the smallest node of its component.

    Every round writes its edges to the shared folder; the number of rounds grows with the logarithm of the
    longest path. A hub is aggregated partially before it is shuffled; the edges of hubs, of which there are few, meet them
    in a broadcast join, so that no task has them all.
    """
    edges, before = materialise(edges.where("u <> v")), None
    while True:
        edges = materialise(_small_star(materialise(_large_star(edges))))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
