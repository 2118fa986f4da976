"""Exact order statistics of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upper_median(rows: DataFrame, key: str, value: str, cuts: int = 256) -> DataFrame:
    """``(key, median, largest, n)``: the value at place n div 2 (from 0) of each group, and the greatest.

    Approximate quantiles cut a group's values into ranges; the ranges' counts tell which one holds the
    place, and only that one's values are put in order. So a group with most of the rows is no single
    task's work, and the answer is exact whatever the cuts are. Null values don't count.
    """
    known = rows.select(F.col(key).alias("k"), F.col(value).alias("x")).where("x is not null")
    places = [i / cuts for i in range(1, cuts)]
    groups = known.groupBy(F.col("k").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("largest"), F.percentile_approx("x", places, 4096).alias("cuts"))
    ranged = known.join(groups, F.col("k").eqNullSafe(F.col("g"))).select("k", "x", "n", "largest", F.size(F.filter("cuts", lambda c: c < F.col("x"))).alias("r"))
    counts = ranged.groupBy("k", "r").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n"))
    before = F.sum("m").over(Window.partitionBy("k").orderBy("r")) - F.col("m")
    held = counts.withColumn("before", before).withColumn("place", F.expr("n div 2")).where("place >= before and place < before + m").select(F.col("k").alias("k2"), F.col("r").alias("r2"), (F.col("place") - F.col("before")).alias("at"))
    inside = ranged.join(held, F.col("k").eqNullSafe(F.col("k2")) & (F.col("r") == F.col("r2"))).withColumn("i", F.row_number().over(Window.partitionBy("k", "r").orderBy("x")) - 1)
    return inside.where("i = at").select(F.col("k").alias(key), F.col("x").alias("median"), "largest", "n")
