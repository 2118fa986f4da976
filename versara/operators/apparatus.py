"""Variant notes: from markup to rows, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versara.seeds.markup import GREEK_NAME


def note_parts(text: Column) -> Column:
    """A note's struct: ``raw`` without its bullet or verse label, ``lemma`` before the first ``]``,
    ``readings`` after it between semicolons, and ``range``, the label if it spans verses. A note without
    ``]`` raises."""
    flat = F.regexp_replace(text, r"^\s+|\s+$", "")
    label = F.regexp_extract(flat, "^([0-9–-]+)\\s+", 1)
    raw = F.when(flat.startswith("•"), F.regexp_replace(flat, r"^•\s*", "")).otherwise(F.regexp_replace(flat, "^[0-9–-]+\\s+", ""))
    at = F.instr(raw, "]")
    safe = F.when(at == 0, F.raise_error(F.concat(F.lit("a note without ]: "), raw)).cast("string")).otherwise(raw)
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    readings = F.filter(F.transform(F.split(F.substring(raw, at + 1, F.length(raw)), ";"), trim), lambda r: r != "")
    spans = ~flat.startswith("•") & F.regexp_like(label, F.lit("[–-]"))
    return F.struct(safe.alias("raw"), trim(F.substring(raw, F.lit(1), at - 1)).alias("lemma"), readings.alias("readings"), F.when(spans, label).alias("range"))


def verse_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(GREEK_NAME.items()), "book_name string, book string")


def parse(sources: DataFrame, translation: str) -> DataFrame:
    """``sources(path, text)`` to one row per note: translation, bcv, note (its number in the verse), raw,
    lemma, readings, range. A note belongs to the last verse named before it; one before any verse raises, as
    does a verse of an unknown book. Windows stay inside a file."""
    tag = F.expr(r"regexp_extract_all(text, '<verse>[^<]*</verse>|<note>[^<]*</note>', 0)")
    rows = sources.select("path", F.posexplode(tag).alias("i", "tag"))
    rows = rows.withColumn("body", F.regexp_extract("tag", "(?s)^<[a-z]+>(.*)</", 1)).withColumn("named", F.when(F.col("tag").startswith("<verse>"), F.regexp_replace("body", r"^\s+|\s+$", "")))
    line = Window.partitionBy("path").orderBy("i")
    rows = rows.withColumn("named", F.last("named", ignorenulls=True).over(line)).where(F.col("tag").startswith("<note>"))
    place = lambda k: F.regexp_extract("named", r"(?s)^(.*?)\s+([0-9]+):([0-9]+)$", k)
    rows = rows.withColumn("book_name", place(1)).withColumn("chapter", place(2)).withColumn("verse", place(3))
    rows = rows.join(F.broadcast(verse_names(rows.sparkSession)), "book_name", "left")  # the canon's size is fixed
    lost = F.when(F.col("book").isNull(), F.raise_error(F.concat_ws(" ", F.lit("a note without a known verse:"), F.coalesce("named", F.lit("none")), "body")).cast("string")).otherwise(F.col("book"))
    rows = rows.withColumn("bcv", F.concat_ws(".", lost, "chapter", "verse")).withColumn("n", note_parts(F.col("body")))
    number = F.row_number().over(Window.partitionBy("path", "bcv").orderBy("i"))
    return rows.select(F.lit(translation).alias("translation"), "bcv", number.alias("note"), "n.raw", "n.lemma", "n.readings", "n.range", "path")


def merged(notes: DataFrame) -> DataFrame:
    """The notes of all files; a verse that two files annotate raises."""
    files = F.size(F.collect_set("path").over(Window.partitionBy("translation", "bcv")))
    checked = F.when(files > 1, F.raise_error(F.concat(F.lit("two files annotate "), F.col("bcv"))).cast("string")).otherwise(F.col("bcv"))
    return notes.withColumn("bcv", checked).drop("path")


def orphans(notes: DataFrame, verses: DataFrame) -> DataFrame:
    """Verses with notes that the text doesn't have."""
    return notes.select("translation", "bcv").distinct().join(verses, ["translation", "bcv"], "left_anti")


def of_verses(notes: DataFrame, verses: DataFrame) -> DataFrame:
    """The notes of some verses, each under its own id ``bcv!n``."""
    return verses.join(notes, ["translation", "bcv"]).withColumn("id", F.concat_ws("!", "bcv", "note"))
