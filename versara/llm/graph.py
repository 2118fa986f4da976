"""Connected components by repeated contraction, with every step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_rows, write_cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, root)``: root is the smallest node that is reachable.

    Each round gives every node the smallest node of its closed neighbourhood, follows these parents to
    their ends by pointer doubling, and keeps the edges between different ends. A node that has an edge
    loses it or meets another end, so rounds are logarithmic in number. Minima are summed before the
    shuffle; the joins read plain written tables, whose large partitions Spark splits. Nothing is collected
    but row counts. Self-loops, repeated edges and both directions are fine; null ends are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = write_cut(edges.distinct(), "edges")
    found = None
    while count_rows(left):
        both = left.union(left.select("b", "a"))
        up = write_cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "parents")
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
            up = write_cut(up.join(over, "up").select("node", F.col("over").alias("up"), (F.col("over") != F.col("up")).alias("moved")), "parents")
            moved = count_rows(up.where("moved"))
            up = up.select("node", "up")
            if not moved:
                break
        if found is None:
            found = up.select("node", F.col("up").alias("root"))
        else:
            then = up.select(F.col("node").alias("root"), "up")
            found = write_cut(found.join(then, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        to_a, to_b = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = left.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = write_cut(left.distinct(), "edges")
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
