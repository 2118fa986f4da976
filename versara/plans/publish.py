"""From source files to a published corpus: parse, gate, derive, name by contents, write, swap the pointer.

Nothing is written unless the gate passes; readers see either the old generation or the new one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versara.functions import identity
from versara.operators import index, versify
from versara.operators.quality import Expectations, require
from versara.plans.errors import RequestError
from versara.sources.corpus import Corpus, corpus, read_sources


@dataclass(frozen=True)
class Build:
    """An edition as it is built: where its source lies, in which format, and what has to come out.
    ``members``: file names inside an archive, where it holds more than the text."""

    translation: str
    edition_id: str
    path: str
    expectations: Expectations
    format: str | None = None
    searchable: bool = True

    def source(self, override: str | None = None) -> str:
        """The place to read from: the build's own, or one that the caller names."""
        if override is not None and not override.strip():
            raise RequestError("a source override needs a path")
        return override or self.path


class Registry:
    """Known builds by translation; unknown ones are refused by name."""

    def __init__(self, builds: list[Build]) -> None:
        self.by_id = {b.translation: b for b in builds}

    def __getitem__(self, name: str) -> Build:
        if name not in self.by_id:
            raise RequestError(f"unknown edition {name!r}; there are {', '.join(sorted(self.by_id))}", 404)
        return self.by_id[name]


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def table_digest(df: DataFrame) -> tuple[str, int]:
    """A table's SHA-256 and rows, whatever their order: rows are hashed, and the hashes combined by their
    first digits before they meet."""
    row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
    parts = df.select(row.alias("h")).groupBy(F.substring("h", 1, 3).alias("part")).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    found = parts.orderBy("part").collect()  # 4,096 rows at most
    return identity.sha256_hex("".join(r.h for r in found)), sum(r.n for r in found)


def publish(spark: SparkSession, build: Build, target: str, source: str | None = None) -> dict:
    """Builds a translation under ``target/<translation>/<generation>`` and points ``CURRENT`` at it.
    Returns the manifest."""
    path = build.source(source)
    rows = read_sources(spark, path, build.format).cache()
    try:
        order = build.expectations.order or list(build.expectations.books)
        c = corpus(rows, build.translation, spark.createDataFrame([(i + 1, b) for i, b in enumerate(order)], "pos int, book string"))
        require(c, build.expectations)
        v = c.verses.withColumn("edition", F.col("translation"))
        places = c.books.select(F.col("translation").alias("edition"), "pos", "book")
        numbered = versify.numbered(v, versify.chapters(v, places)).drop("edition")
        digests = [(name, *table_digest(df)) for name, df in (("verses", numbered), ("chapter_lines", c.chapter_lines), ("ledger", c.ledger))]
        revision = table_digest(spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256")))[0]
        counts = dict(zip(("verses", "books", "notes"), (digests[0][2], c.books.count(), c.verses.where("note is not null").count())))
        counts |= {k: c.chapter_lines.where(F.col("kind") == k[:-1]).count() for k in ("titles", "subscriptions")}
        m = identity.manifest(build.edition_id, revision, {"url": path}, [{"name": n, "sha256": h, "rows": k} for n, h, k in digests], counts)
        generation = identity.generation_id(m)
        home = f"{target}/{build.translation}/{generation}"
        Corpus(numbered, c.chapter_lines, c.interpolations, c.books, c.ledger, c.sources).write(home)
        if build.searchable:
            index.build(numbered.select(F.col("translation").alias("edition"), F.col("sequence").alias("doc"), "text")).write(f"{home}/index")
        _swap(spark, f"{target}/{build.translation}", m | {"generationId": generation})
        return m | {"generationId": generation}
    finally:
        rows.unpersist()


def _swap(spark: SparkSession, home: str, manifest: dict) -> None:
    """Writes the manifest, then lets it take the pointer's place in one rename."""
    fs, staged = _fs(spark, f"{home}/.current-{manifest['generationId']}")
    out = fs.create(staged, True)
    out.write(identity.canonical_json(manifest).encode())
    out.close()
    _, current = _fs(spark, f"{home}/CURRENT")
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri() if staged.isAbsolute() and staged.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._jvm.java.lang.reflect.Array.newInstance(spark.sparkContext._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(fs.makeQualified(staged), fs.makeQualified(current), options)


def current(spark: SparkSession, target: str, translation: str) -> tuple[dict, Corpus]:
    """The manifest in force, and its corpus."""
    (row,) = spark.read.text(f"{target}/{translation}/CURRENT", wholetext=True).collect()
    m = json.loads(row.value)
    return m, Corpus.read(spark, f"{target}/{translation}/{m['generationId']}")
