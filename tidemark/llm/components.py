"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.runtime import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = Window.partitionBy("a")
    low = F.least(F.col("a"), F.min("b").over(near))
    return both.select("a", "b", low.alias("m")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    marked = down.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    moved = marked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(marked.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that has an edge and isn't its component's least node.

    edges: long columns a and b, in either direction, repeats and loops allowed; null ends are
    dropped. Rounds grow with the logarithm of the largest component; each is written to the
    shared folder, so no round depends on an executor that may be lost.
    """
    now = materialize(edges.select("a", "b").dropna().filter("a <> b").distinct(), "edges")
    before = None
    while before != (state := _state(now)):
        before = state
        if not state[0]:
            break
        now = materialize(_small_star(_large_star(now)), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
