"""Books, traditions and editions as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versara.seeds import canon


def books(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(canon.BOOK_ROWS, canon.BOOK_SCHEMA)


def orders(spark: SparkSession, of: dict[str, list[str]], name: str) -> DataFrame:
    """``(name, pos, book)`` of enumerated orders."""
    return spark.createDataFrame([(k, i + 1, b) for k, ids in of.items() for i, b in enumerate(ids)], f"{name} string, pos int, book string")


def traditions(spark: SparkSession) -> DataFrame:
    return orders(spark, canon.TRADITIONS, "tradition")


def printing_order(spark: SparkSession) -> DataFrame:
    return orders(spark, canon.EDITION_ORDER, "edition")


def editions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(canon.EDITIONS, canon.EDITION_SCHEMA)


def positions(bridge: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """A bridge of orders turned to one row per book with its place in each; null where it is absent."""
    return bridge.groupBy("book").pivot(kind, names).agg(F.min("pos"))


def book_rows(spark: SparkSession, tradition: str, edition: str, chapters: DataFrame | None = None) -> DataFrame:
    """The books of a tradition in its order: their metadata, places in all traditions, place in the
    edition, whether the edition has their text, and how many chapters."""
    places = positions(traditions(spark), "tradition", list(canon.TRADITIONS))
    listed = traditions(spark).where(F.col("tradition") == tradition).select("pos", "book")
    printed = printing_order(spark).where(F.col("edition") == edition).select("book", F.col("pos").alias("edition_position"))
    out = listed.join(books(spark).withColumnRenamed("id", "book"), "book").join(places, "book").join(printed, "book", "left")
    if chapters is None:
        counted = printed.select("book", F.lit(None).cast("long").alias("chapters"))
    else:
        counted = chapters.where(F.col("edition") == edition).groupBy("book").agg(F.count(F.lit(1)).alias("chapters"))
    out = out.join(counted.withColumn("here", F.lit(True)), "book", "left")
    out = out.withColumn("availability", F.when(F.col("here"), "full").otherwise("metadata_only"))
    return out.select("pos", "book", "name", "testament", "author", "approximate_date", "genre", "is_deuterocanon", F.struct(*canon.TRADITIONS).alias("canons"), "edition_position", "availability", F.coalesce("chapters", F.lit(0)).alias("chapters")).orderBy("pos")


def capabilities(edition_rows: DataFrame, edition_books: DataFrame, book_meta: DataFrame) -> DataFrame:
    """Editions with the testaments that they cover."""
    covered = edition_books.join(book_meta.select(F.col("id").alias("book"), "testament"), "book").groupBy("edition").agg(F.array_sort(F.collect_set("testament")).alias("testaments"), F.count(F.lit(1)).alias("books"))
    return edition_rows.join(covered.withColumnRenamed("edition", "id"), "id", "left")
