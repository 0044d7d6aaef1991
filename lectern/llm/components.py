"""Connected components of a link table, by repeated contraction in Spark.

Every round maps each node to the neighbour (or itself) of least priority, a digest of its
number, and links the images; random priorities shrink chains and stars alike by a constant
share per round. Links and maps stay tables in the shared folder throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.session import through_table


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``links`` (a, b); one root per component."""
    edges = through_table(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = None
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), F.col(c).alias("n"))  # noqa: E731, B023
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("near"))
        step = least.select("node", F.least("near", rank("node"))["n"].alias("to"))
        step = through_table(step, "contraction")
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(
            step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b"
        )
        moved = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = through_table(moved, "edges")
        if maps is None:
            maps = step.select("node", F.col("to").alias("root"))
        else:
            after = step.select(F.col("node").alias("root"), "to")
            maps = maps.join(after, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        maps = through_table(maps, "roots")
        turn += 1
    if maps is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).where("false")
    return maps
