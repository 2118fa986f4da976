"""Conversion between psalm numberings, as interval tables and as range joins on them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versara.seeds import numbering as seed

INTERVALS = "greek int, lo int, hi int, kind string, psalm int, verse int, reason string"


def english_verses() -> list[int]:
    return [int(x) for x in seed.ENGLISH_VERSES.split()]


@cache
def titled() -> frozenset[int]:
    return frozenset(int(x) for x in seed.TITLED.split())


@cache
def intervals() -> tuple[tuple, ...]:
    """One row per run of Greek verses: ``kind`` title, verse or refused; a verse run starts at ``verse`` of
    Hebrew ``psalm`` and goes on by one; a refused run has its reason. The running position inside a psalm
    turns the runs into closed intervals, so a conversion is one range join."""
    counts, has_title = english_verses(), titled()
    override = {int(p): 0 for p in seed.NO_TITLE_VERSE.split()} | {int(p): 2 for p in seed.TWO_TITLE_VERSES.split()}
    runs = {g: [(g + add, 1, None, override.get(g))] for lo, hi, add in seed.REGULAR for g in range(lo, hi + 1)} | seed.IRREGULAR
    out = []
    for greek in sorted(runs):
        at = 1
        for run in runs[greek]:
            if len(run) == 2:
                n, reason = run
                out.append((greek, at, at + n - 1, "refused", None, None, reason))
                at += n
                continue
            psalm, verse, n, titles = run
            n = counts[psalm - 1] - verse + 1 if n is None else n
            titles = int(psalm in has_title) if titles is None else titles
            for size, kind, first in ((titles, "title", None), (n, "verse", verse)):
                if size:
                    out.append((greek, at, at + size - 1, kind, psalm, first, None))
                    at += size
    return tuple(out)


def interval_table(spark: SparkSession) -> DataFrame:
    """The intervals as a DataFrame: a few hundred rows, whatever the corpus."""
    return spark.createDataFrame(list(intervals()), INTERVALS)


def greek_counts(spark: SparkSession) -> DataFrame:
    """Verses of each Greek psalm, superscriptions counted."""
    return interval_table(spark).groupBy("greek").agg(F.max("hi").alias("n_verses"))


def from_greek(positions: DataFrame) -> DataFrame:
    """``(greek, greek_verse)`` columns to ``kind`` (title, verse, refused, out_of_range), ``psalm``,
    ``verse`` and ``reason``; other columns stay. The table's size is fixed, so it is broadcast."""
    table = F.broadcast(interval_table(positions.sparkSession).withColumnRenamed("greek", "g").withColumnRenamed("verse", "first"))
    inside = (F.col("greek") == F.col("g")) & F.col("greek_verse").between(F.col("lo"), F.col("hi"))
    joined = positions.join(table, inside, "left")
    return joined.select(*positions.columns, F.coalesce("kind", F.lit("out_of_range")).alias("kind"), "psalm", (F.col("first") + F.col("greek_verse") - F.col("lo")).alias("verse"), "reason")


def has_title(psalm: Column) -> Column:
    return psalm.isin(sorted(titled()))


def english_count(psalm: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*[F.lit(n) for n in english_verses()]), psalm), F.lit(0))


def hebrew_count(psalm: Column) -> Column:
    """Verses of a psalm with its superscription counted, as the Hebrew division does."""
    return english_count(psalm) + has_title(psalm).cast("int")


def from_hebrew(psalm: Column, verse: Column) -> Column:
    """A struct of kind, psalm and verse: the superscription is the Hebrew verse 1 where there is one."""
    shift = has_title(psalm).cast("int")
    kind = F.when((verse < 1) | (verse > hebrew_count(psalm)), "out_of_range").when((shift == 1) & (verse == 1), "title").otherwise("verse")
    return F.struct(kind.alias("kind"), psalm.alias("psalm"), F.when(kind == "verse", verse - shift).alias("verse"))


def greek_psalm(psalm: Column) -> Column:
    """The Greek psalm that holds a Hebrew one, for display."""
    out = F.lit(None).cast("int")
    for lo, hi, fixed, add in seed.TO_GREEK:
        out = F.when(psalm.between(lo, hi), F.lit(fixed) if fixed else psalm + add).otherwise(out)
    return out


class NumberingError(ValueError):
    """A position that the scheme doesn't have, or that the edition can't give."""


def greek_position(psalm: int, verse: int) -> tuple[str, int, int | None]:
    """One position on the driver: (kind, psalm, verse)."""
    mine = [r for r in intervals() if r[0] == psalm]
    if not mine:
        raise NumberingError(f"no Greek psalm {psalm}")
    for _, lo, hi, kind, target, first, reason in mine:
        if lo <= verse <= hi:
            if kind == "refused":
                raise NumberingError(reason)
            return kind, target, None if kind == "title" else first + verse - lo
    raise NumberingError(f"Greek psalm {psalm} ends at verse {mine[-1][2]}")


def greek_length(psalm: int) -> int:
    mine = [r[2] for r in intervals() if r[0] == psalm]
    if not mine:
        raise NumberingError(f"no Greek psalm {psalm}")
    return max(mine)


def hebrew_position(psalm: int, verse: int) -> tuple[str, int, int | None]:
    total = hebrew_length(psalm)
    if not 1 <= verse <= total:
        raise NumberingError(f"Hebrew psalm {psalm} ends at verse {total}")
    if psalm not in titled():
        return "verse", psalm, verse
    return ("title", psalm, None) if verse == 1 else ("verse", psalm, verse - 1)


def hebrew_length(psalm: int) -> int:
    return (english_verses()[psalm - 1] if 1 <= psalm <= 150 else 0) + (psalm in titled())
