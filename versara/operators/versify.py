"""Coordinates: chapters, dense sequences, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST = Window.unboundedPreceding


def chapters(verses: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """The chapter table of ``verses(edition, book, chapter, verse)``: verses per chapter, how many of the
    book come before it, and the sequence at which the book starts. ``order(edition, book, pos)`` places the
    books; without it they stand in order of name. One row per chapter, so the windows are small."""
    found = verses.groupBy("edition", "book", "chapter").agg(F.count(F.lit(1)).alias("n_verses"))
    if order is None:
        order = found.select("edition", "book").distinct().withColumn("pos", F.row_number().over(Window.partitionBy("edition").orderBy("book")))
    books = found.groupBy("edition", "book").agg(F.sum("n_verses").alias("book_verses")).join(order, ["edition", "book"])
    before = F.sum("book_verses").over(Window.partitionBy("edition").orderBy("pos").rowsBetween(FIRST, -1))
    books = books.select("edition", "book", "pos", (F.coalesce(before, F.lit(0)) + 1).alias("book_start"))
    offset = F.sum("n_verses").over(Window.partitionBy("edition", "book").orderBy("chapter").rowsBetween(FIRST, -1))
    return found.withColumn("chapter_offset", F.coalesce(offset, F.lit(0))).join(books, ["edition", "book"]).select("edition", "pos", "book", "chapter", "n_verses", "chapter_offset", "book_start")


def numbered(verses: DataFrame, table: DataFrame) -> DataFrame:
    """``verses`` with their dense 1-based ``sequence``. Inside a chapter, verses are numbered by rank, so a
    chapter that leaves a verse out keeps its real numbers beside a sequence without holes. The window is a
    chapter's."""
    rank = F.row_number().over(Window.partitionBy("edition", "book", "chapter").orderBy("verse"))
    start = table.select("edition", "book", "chapter", (F.col("book_start") + F.col("chapter_offset") - 1).alias("base"))
    return verses.withColumn("rank", rank).join(start, ["edition", "book", "chapter"]).withColumn("sequence", F.col("base") + F.col("rank")).drop("rank", "base")


def locate(sequences: DataFrame, table: DataFrame) -> DataFrame:
    """``(edition, sequence)`` to ``(book, chapter, verse)`` by counting, as an edition without omissions
    numbers its verses; a sequence beyond the edition's range gives nulls.

    The greatest chapter start at or below the sequence is found by a running last value over chapters and
    sequences together, in blocks of sequences, so no row meets every chapter."""
    spans = table.select("edition", (F.col("book_start") + F.col("chapter_offset")).alias("lo"), "book", "chapter", "n_verses")
    block = 65_536
    spread = spans.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(lo + n_verses - 1) div {block}"))))
    wanted = sequences.withColumn("block", F.expr(f"sequence div {block}"))
    hit = (F.col("s.edition") == F.col("c.edition")) & (F.col("s.block") == F.col("c.block")) & F.col("s.sequence").between(F.col("c.lo"), F.col("c.lo") + F.col("c.n_verses") - 1)
    joined = wanted.alias("s").join(spread.alias("c"), hit, "left")
    return joined.select("s.edition", "s.sequence", "c.book", "c.chapter", (F.col("s.sequence") - F.col("c.lo") + 1).alias("verse"))


def ranges(verses: DataFrame, segments: DataFrame) -> DataFrame:
    """The verses of many ``segments(request, segment, edition, first, last)`` over sequences: verses that
    two segments share come twice, each row with its request and segment. Segments are spread over blocks of
    sequences, so the join is an equality with a check inside the block."""
    block = 1024
    spread = segments.withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"last div {block}"))))
    rows = verses.withColumn("block", F.expr(f"sequence div {block}"))
    return rows.join(spread, ["edition", "block"]).where(F.col("sequence").between(F.col("first"), F.col("last"))).drop("block", "first", "last")


def offsets(rows: DataFrame, part: str, order: str, length: str) -> DataFrame:
    """Exclusive running sums of a length: where each text would start in one blob per part. Sums run inside
    blocks of the whole-numbered order, and over the blocks, so a part that holds most rows is many tasks."""
    block = F.expr(f"{order} div 4096")
    rows = rows.withColumn("_block", block)
    over = Window.partitionBy(part).orderBy("_block")
    sums = rows.groupBy(part, "_block").agg(F.sum(length).alias("_sum")).select(part, "_block", (F.sum("_sum").over(over) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy(part, "_block").orderBy(order).rowsBetween(FIRST, -1)
    joined = rows.join(sums, [part, "_block"])
    return joined.withColumn("start", F.col("_before") + F.coalesce(F.sum(length).over(inside), F.lit(0))).drop("_block", "_before")


def differing(table: DataFrame, a: str, b: str) -> DataFrame:
    """Books that two editions share and divide otherwise: whether all totals agree, and the first chapter
    whose counts differ (the shorter's end if one is a start of the other)."""
    def side(edition: str, name: str) -> DataFrame:
        lists = table.where(F.col("edition") == edition).groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter", "n_verses"))).alias("l"))
        return lists.select("book", F.transform("l", lambda r: r["n_verses"]).alias(name))
    both = side(a, "x").join(side(b, "y"), "book")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    first = F.array_position(F.zip_with("x", "y", lambda p, q: ~p.eqNullSafe(q)), True)
    return both.select("book", (F.col("x") == F.col("y")).alias("same"), (total("x") == total("y")).alias("same_total"), F.when(first > 0, first).alias("first_difference"))
