"""Connected components by alternating star contractions, on DataFrames throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, parts_for


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.withColumnRenamed("m", "b")).coalesce(parts).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``id``, ``component``: the least id that each id of the edges ``(a, b)`` reaches.

    Every round hangs neighbours on the least node near them; rounds end when all edges are stars: no centre hangs on another node, and
    none on two.  Rounds are written to the checkpoint folder, and only two numbers a round come to the driver.  Loops and repeated
    edges are harmless; without edges the result is empty.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")).where("a <> b").distinct())
    parts = parts_for(2 * edges.count())  # stars have no more edges than were given
    edges = edges.coalesce(parts)
    while not edges.isEmpty():
        edges = checkpoint(_small_star(_large_star(edges, parts), parts)).coalesce(parts)
        ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        if ends.groupBy("v").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs > 0 and holds > 0").isEmpty():
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


class Forest:
    """Union-find of small integers, for the links that one task finds."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
