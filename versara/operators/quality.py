"""The gate that a corpus passes before it is published: every check is a query for failures.

All failures are found, then raised together. A failure is a row of check, key, expected and actual.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versara.functions.text import open_selah, residual_markup, unbalanced
from versara.sources.corpus import Corpus


@dataclass(frozen=True)
class Expectations:
    """What a corpus has to be, written by hand and never taken from a build. ``books``: id to (chapters,
    verses), in printing order unless ``order`` says otherwise. ``dropped``: by format, characters per
    marker that are known to be left out."""

    total: int
    books: dict[str, tuple[int, int]]
    order: list[str] | None = None
    empty: list[str] = field(default_factory=list)
    omitted: list[str] = field(default_factory=list)
    titles: int = 0
    subscriptions: list[str] = field(default_factory=list)
    notes: bool = False
    dropped: dict[str, dict[str, int]] = field(default_factory=dict)
    unbalanced: list[str] = field(default_factory=list)
    title_book: str = "PSA"


class GateError(ValueError):
    def __init__(self, failures: list) -> None:
        super().__init__(f"{len(failures)} failures:\n" + "\n".join(f"- {f.check} {f.key}: expected {f.expected}, found {f.actual}" for f in failures))
        self.failures = failures


def _rows(df: DataFrame, check: str, key: Column, expected: Column, actual: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))


def gate(c: Corpus, e: Expectations) -> DataFrame:
    """The failures of a corpus of one translation."""
    spark = c.verses.sparkSession
    absent, present = F.lit("absent"), F.lit("present")
    out = []

    def frame(rows: list, schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema)

    def one(df: DataFrame, check: str, actual: Column, expected) -> None:
        found = df.agg(actual.alias("actual"))
        out.append(_rows(found.where(~F.col("actual").eqNullSafe(F.lit(expected))), check, F.lit(""), F.lit(expected), F.col("actual")))

    def same_set(check: str, found: DataFrame, wanted: list[str]) -> None:
        """Symmetric difference of keys."""
        a, b = found.select("key").distinct().withColumn("a", F.lit(1)), frame([(x,) for x in sorted(set(wanted))], "key string").withColumn("b", F.lit(1))
        both = a.join(b, "key", "full").where("a is null or b is null")
        out.append(_rows(both, check, F.col("key"), F.when(F.col("b").isNull(), absent).otherwise(present), F.when(F.col("a").isNull(), absent).otherwise(present)))

    order = e.order or list(e.books)
    one(c.verses, "total verses", F.count(F.lit(1)), e.total)
    one(c.books, "book count", F.count(F.lit(1)), len(order))
    places = c.books.select("pos", "book").join(frame([(i + 1, b) for i, b in enumerate(order)], "pos int, wanted string"), "pos", "left")
    out.append(_rows(places.where(~F.col("book").eqNullSafe(F.col("wanted"))), "book order", F.col("pos"), F.coalesce("wanted", F.lit("none")), F.col("book")))

    chapters = c.verses.groupBy("book", "chapter").agg(F.count(F.lit(1)).alias("n"), F.max("verse").alias("most"))
    books = chapters.groupBy("book").agg(F.count(F.lit(1)).alias("chapters"), F.sum("n").alias("verses"), F.max("chapter").alias("last"))
    wanted = frame([(b, *n) for b, n in e.books.items()], "book string, want_chapters int, want_verses long")
    both = books.join(wanted, "book", "full")
    out.append(_rows(both.where("chapters is null"), "book missing", F.col("book"), present, absent))
    out.append(_rows(both.where("want_chapters is null"), "unexpected book", F.col("book"), absent, present))
    for what in ("chapters", "verses"):
        out.append(_rows(both.where(f"{what} <> want_{what}"), f"book {what}", F.col("book"), F.col(f"want_{what}"), F.col(what)))
    grid = both.where("want_chapters is not null and chapters is not null").select("book", F.explode(F.sequence(F.lit(1), "want_chapters")).alias("chapter"))
    out.append(_rows(grid.join(chapters, ["book", "chapter"], "left_anti"), "missing chapter", F.concat_ws(".", "book", "chapter"), present, absent))

    out.append(_rows(c.verses.groupBy("bcv").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "duplicate verse", F.col("bcv"), F.lit(1), F.col("n")))
    seen, omitted = c.verses.select("bcv"), frame([(x,) for x in e.omitted], "bcv string")
    every = chapters.select("book", "chapter", F.explode(F.sequence(F.lit(1), "most")).alias("verse")).select(F.concat_ws(".", "book", "chapter", "verse").alias("bcv"))
    out.append(_rows(every.join(seen, "bcv", "left_anti").join(omitted, "bcv", "left_anti"), "gap in numbering", F.col("bcv"), present, absent))
    out.append(_rows(omitted.join(seen, "bcv", "left_semi"), "declared omitted", F.col("bcv"), absent, present))

    same_set("empty verses", c.verses.where("text = ''").select(F.col("bcv").alias("key")), e.empty)
    bare = c.verses.where("note is null").join(frame([(x,) for x in e.empty], "bcv string"), "bcv", "left_semi")
    out.append(_rows(bare, "empty verse without a note", F.col("bcv"), present, absent))
    titles, ends = c.chapter_lines.where("kind = 'title'"), c.chapter_lines.where("kind = 'subscription'")
    one(titles, "title count", F.count(F.lit(1)), e.titles)
    out.append(_rows(titles.where(F.col("book") != e.title_book), "title elsewhere", F.concat_ws(".", "book", "chapter"), absent, present))
    same_set("subscriptions", ends.select(F.concat_ws(".", "book", "chapter").alias("key")), e.subscriptions)
    same_set("unbalanced brackets", c.verses.where(unbalanced(F.col("text"))).select(F.col("bcv").alias("key")), e.unbalanced)
    out.append(_rows(c.verses.where(open_selah(F.col("text"))), "open musical mark", F.col("bcv"), F.lit("closed"), F.lit("open")))

    total = c.sources.agg(F.sum("source_chars").alias("s")).crossJoin(F.broadcast(c.ledger.agg(F.sum("chars").alias("a"))))  # one row each
    out.append(_rows(total.where("not s <=> a"), "characters accounted for", F.lit(""), F.col("s"), F.col("a")))
    formats = c.sources.select("format").distinct()
    known = frame([(f,) for f in e.dropped], "format string")
    out.append(_rows(formats.join(known, "format", "left_anti"), "no expectations for format", F.col("format"), present, absent))
    want = frame([(f, m, n) for f, counts in e.dropped.items() for m, n in counts.items()], "format string, marker string, want long").join(formats, "format", "left_semi").select("marker", "want")
    drop = c.ledger.where("bucket = 'dropped'").select("marker", "chars").join(want, "marker", "full")
    judged = drop.crossJoin(F.broadcast(formats.join(known, "format", "left_semi").agg((F.count(F.lit(1)) > 0).alias("judged")))).where("judged")
    out.append(_rows(judged.where("want is not null and coalesce(chars, 0) <> want"), "dropped characters", F.col("marker"), F.col("want"), F.coalesce("chars", F.lit(0))))
    out.append(_rows(judged.where("want is null"), "newly dropped", F.col("marker"), absent, F.col("chars")))
    for bucket, needed in (("titles", e.titles > 0), ("subscriptions", bool(e.subscriptions)), ("notes", e.notes)):
        if needed:
            got = c.ledger.where(F.col("bucket") == bucket).agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("n")).where("n = 0")
            out.append(_rows(got, "nothing reached", F.lit(bucket), F.lit("text"), F.lit("none")))
    out.append(_rows(c.verses.where(residual_markup(F.col("text"))), "residual markup", F.col("bcv"), absent, present))
    return reduce(DataFrame.unionByName, out)


def require(c: Corpus, e: Expectations, most: int = 1000) -> None:
    """Raises with the failures (``most`` of them in the message's list) unless there are none."""
    found = gate(c, e).orderBy("check", "key").limit(most).collect()
    if found:
        raise GateError(found)


def profile(c: Corpus) -> DataFrame:
    """What a source holds, for writing expectations: counts by book, and the ledger."""
    books = c.verses.groupBy("book").agg(F.countDistinct("chapter").alias("a"), F.count(F.lit(1)).alias("b"))
    rows = books.select(F.lit("book").alias("kind"), F.col("book").alias("key"), F.concat_ws("/", "a", "b").alias("value"))
    return rows.unionByName(c.ledger.select("bucket", F.col("marker").alias("key"), F.col("chars").cast("string").alias("value")).withColumnRenamed("bucket", "kind"))
