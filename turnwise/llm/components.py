"""Connected components of a distributed edge list, in a number of rounds that grows with the logarithm of the size.

Rounds of large-star and small-star: every node hands the smallest of its neighbours to its larger ones, then to its
smaller ones, until each component is a star around its smallest node. Minima are aggregates with map-side combine and
joins with a hub are split by the skew rule, so a node with any number of neighbours is not gathered anywhere. Each
round is written once to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One operation on edges (a, b) with a > b; the result has the same form, with distinct rows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # Shuffled also where the files look small: packed edges take many times their bytes as a table in the driver.
    joined = both.join(least.hint("merge"), "a")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter(F.col("a") > F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) in any direction to (node, root): root is the smallest node reachable; lone nodes do not occur.

    Null ends and loops are no edges; repeated edges count once; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    current = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(current, "edges")
    state = None
    while True:
        following = materialize(_star(_star(current, large=True), large=False), "stars")
        discard(current)
        current = following
        # The star of a finished component maps to itself; equal counts and sums over two rounds mean nothing moved.
        row = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
