"""Attribution of rows to the last milestone before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attribute(rows: DataFrame, key: str, block: Column, order: list[str], mark: Column, name: str = "open") -> DataFrame:
    """Adds the last non-null ``mark`` of the row's key at or before it in ``order``; null before the first.
    ``block`` never falls along the order (a day, say): marks are carried inside blocks by a window, and from
    block to block by one row each, so a key with most of the rows is as many tasks as it has blocks."""
    rows = rows.withColumn("_block", block).withColumn("_mark", mark)
    last = rows.groupBy(key, "_block").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.struct(*order))).alias("_last"))
    line = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), F.last("_last", ignorenulls=True).over(line).alias("_carried"))
    joined = rows.join(carried, rows[key].eqNullSafe(F.col("_k")) & rows["_block"].eqNullSafe(F.col("_b")))
    inside = Window.partitionBy(key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.coalesce(F.last("_mark", ignorenulls=True).over(inside), "_carried")).drop("_block", "_mark", "_k", "_b", "_carried")
