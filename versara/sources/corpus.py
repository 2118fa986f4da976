"""Corpora from files: one row per source file, then the document model's tables; and their writer."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from versara import schemas
from versara.sources.markup import BrokenSource, Document, UnknownMarkup, read, sniff

SUFFIXES = (".usx", ".usfm", ".sfm", ".xml")


def as_row(path: str, source: str, format: str | None) -> tuple:
    """A file's document as a row; a reader's refusal is data: its message."""
    try:
        doc = read(source, format)
    except (BrokenSource, UnknownMarkup) as e:
        return path, format, f"{type(e).__name__}: {e}", None, [], [], [], []
    return path, doc.format, None, doc.source_chars, doc.books, _verses(doc), _lines(doc), _ledger(doc)


def _verses(doc: Document) -> list[dict]:
    return [{"book": v.book, "chapter": v.chapter, "verse": v.verse, "text": v.text, "note": v.note or None} for v in doc.verses]


def _lines(doc: Document) -> list[dict]:
    groups = (("title", doc.titles), ("subscription", doc.subscriptions), ("interpolation", doc.interpolations))
    return [{"kind": kind, "key": key, "text": text} for kind, lines in groups for key, text in lines.items()]


def _ledger(doc: Document) -> list[dict]:
    return [{"bucket": b, "marker": m, "chars": n} for b, counts in doc.ledger.items() for m, n in counts.items()]


@dataclass(frozen=True)
class Corpus:
    """A corpus's tables; every row names its translation."""

    verses: DataFrame
    chapter_lines: DataFrame
    interpolations: DataFrame
    books: DataFrame
    ledger: DataFrame
    sources: DataFrame

    def write(self, path: str) -> None:
        """Parquet by translation, verses in order of their coordinates, so that ranges skip row groups."""
        self.verses.repartition("translation", "book").sortWithinPartitions("book", "chapter", "verse").write.partitionBy("translation").parquet(f"{path}/verses")
        for name in ("chapter_lines", "interpolations", "books", "ledger", "sources"):
            getattr(self, name).write.partitionBy("translation").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Corpus:
        tables = {"verses": schemas.SERVED, "chapter_lines": schemas.CHAPTER_LINES, "interpolations": schemas.INTERPOLATIONS, "books": schemas.BOOKS, "ledger": schemas.LEDGER, "sources": schemas.SOURCES}
        return Corpus(*[spark.read.schema(s).parquet(f"{path}/{n}") for n, s in tables.items()])


def _parse(batches, format: str | None):
    types = ["path", "format", "error", "source_chars", "books", "verses", "lines", "ledger"]
    line, verse = pa.struct([("kind", pa.string()), ("key", pa.string()), ("text", pa.string())]), pa.struct([("book", pa.string()), ("chapter", pa.int32()), ("verse", pa.int32()), ("text", pa.string()), ("note", pa.string())])
    entry = pa.struct([("bucket", pa.string()), ("marker", pa.string()), ("chars", pa.int64())])
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(verse), pa.list_(line), pa.list_(entry)]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = [as_row(p, text, format) for p, text in members(path, content)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], types)


def members(path: str, content: bytes) -> list[tuple[str, str]]:
    """A file's sources: itself, or the members of an archive that have a source's suffix, in order."""
    if not path.lower().endswith(".zip"):
        return [(path, content.decode("utf-8"))]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(f"{path}!{n}", z.read(n).decode("utf-8")) for n in sorted(z.namelist()) if n.lower().endswith(SUFFIXES)]


def read_sources(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """One row per file (or archive member) at ``path``, which Spark opens, wherever it lies. A named format
    wins over the one that a file looks like."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    wanted = F.lit(False)
    for suffix in (*SUFFIXES, ".zip"):
        wanted = wanted | F.lower("path").endswith(suffix)
    return files.where(wanted).mapInArrow(lambda it: _parse(it, format), schemas.DOCUMENT)


def corpus(sources: DataFrame, translation: str, order: DataFrame | None = None) -> Corpus:
    """The tables of a translation from ``read_sources``; any file's error is raised when rows are made.

    Books stand in ``order(book, pos)`` or, without it, in the order of file names and of their place in
    them."""
    t = F.lit(translation).alias("translation")
    good = sources.withColumn("format", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "error")).cast("string")).otherwise(F.col("format")))
    bcv = F.concat_ws(".", "v.book", "v.chapter", "v.verse").alias("bcv")
    verses = good.where("format is not null").select(F.explode("verses").alias("v")).select(t, bcv, "v.book", "v.chapter", "v.verse", "v.text", "v.note")
    lines = good.where("format is not null").select(F.explode("lines").alias("l")).select("l.kind", "l.key", "l.text")
    key = F.split("key", r"\.")
    chapter_lines = lines.where("kind <> 'interpolation'").select(t, "kind", key[0].alias("book"), key[1].cast("int").alias("chapter"), "text")
    interpolations = lines.where("kind = 'interpolation'").select(t, F.col("key").alias("after_bcv"), "text")
    books = good.where("format is not null").select("path", F.posexplode("books").alias("i", "book")).groupBy("book").agg(F.min(F.struct("path", "i")).alias("at"))
    if order is not None:
        books = books.join(order, "book").select(t, F.row_number().over(Window.orderBy("pos")).alias("pos"), "book")
    else:
        books = books.select(t, F.row_number().over(Window.orderBy("at")).alias("pos"), "book")
    ledger = good.where("format is not null").select(F.explode("ledger").alias("l")).groupBy("l.bucket", "l.marker").agg(F.sum("l.chars").alias("chars")).select(t, "bucket", "marker", "chars")
    return Corpus(verses, chapter_lines, interpolations, books, ledger, good.select(t, "path", "format", "source_chars"))


class _Part(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.format = options["path"], options.get("markup")

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "*"))) if os.path.isdir(self.path) else [self.path]
        return [_Part(p) for p in found if p.lower().endswith((*SUFFIXES, ".zip"))]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            content = f.read()
        for path, source in members(partition.path, content):
            yield as_row(path, source, self.format)


class ScriptureSource(DataSource):
    """``spark.read.format("scripture").load(path)``: the same rows as ``read_sources``, for paths that every
    worker can open by itself. Register with ``spark.dataSource.register(ScriptureSource)``; option
    ``markup`` names a format."""

    @classmethod
    def name(cls) -> str:
        return "scripture"

    def schema(self) -> str:
        return schemas.DOCUMENT

    def reader(self, schema):
        return _Reader(self.options)


def sniffed(text):
    """The format of a column of sources, by built-in functions; an unknown one raises."""
    head = F.substring(text, 1, 4096)
    like = lambda p: F.regexp_like(head, F.lit(p))
    return (
        F.when(like(r"<usfx[\s>]"), "usfx").when(like(r"<usx[\s>]"), "usx").when(like(r"(?m)^\s*\\id\s"), "usfm")
        .when(like(r'\A\x{FEFF}?\s*<book\s+id="'), "greek").otherwise(F.raise_error(F.lit("unknown source format")).cast("string"))
    )


__all__ = ["Corpus", "ScriptureSource", "corpus", "read_sources", "sniff", "sniffed"]
