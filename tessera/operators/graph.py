"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Alternating star steps: every node's larger neighbours, then its smaller ones, are hung on its smallest neighbour.
    The number of edges never grows, a path of n nodes needs about log n rounds, and the rows of one hub are summed on the
    map side before they are shuffled.  Each round is written, so lineage stays short.  Loops and repeated edges are fine.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    alone = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    now = scratch.write(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = _size(now)
    scratch.sized(size[0])
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        grown = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b"))).where("a <> b")
        after = scratch.write(grown.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        new = _size(after)
        scratch.drop(now)
        now = after
        if new == size:
            break
        size = new
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    named = found.unionByName(roots)
    return named.unionByName(alone.join(named.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))


def _size(pairs: DataFrame) -> tuple:
    """Equal for equal edge sets, whatever their order."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first())
