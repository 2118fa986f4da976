"""The inverted index as tables: postings, term and document statistics, and their delta encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from versara.functions.text import base36, tokenize, word_count
from versara.operators.morphology import lemmas


def postings(docs: DataFrame) -> DataFrame:
    """``(edition, token, doc)`` from ``docs(edition, doc, text)``: each token of a document once."""
    return docs.select("edition", "doc", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("token")).select("edition", "token", "doc")


def term_stats(entries: DataFrame) -> DataFrame:
    """Document frequency of every token."""
    return entries.groupBy("edition", "token").agg(F.count(F.lit(1)).alias("df"))


def doc_stats(docs: DataFrame) -> DataFrame:
    """Words of every document, null text counting as empty."""
    return docs.select("edition", "doc", word_count(F.coalesce("text", F.lit(""))).alias("n_words"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """Documents and total words of each edition; empty documents count."""
    return stats.groupBy("edition").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"))


@dataclass(frozen=True)
class Index:
    """Four tables with an ``edition`` column each. ``families(edition, token, lemma)`` may be None."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    families: DataFrame | None = None

    def write(self, path: str) -> None:
        """Parquet, by edition; postings in token order, so that row groups are skipped by token."""
        self.postings.repartition("edition", F.pmod(F.xxhash64("token"), F.lit(64))).sortWithinPartitions("token", "doc").write.partitionBy("edition").parquet(f"{path}/postings")
        self.terms.sortWithinPartitions("token").write.partitionBy("edition").parquet(f"{path}/terms")
        self.docs.write.partitionBy("edition").parquet(f"{path}/docs")
        if self.families is not None:
            self.families.write.partitionBy("edition").parquet(f"{path}/families")

    @staticmethod
    def read(spark: SparkSession, path: str, with_families: bool = True) -> Index:
        names = ["postings", "terms", "docs"] + ["families"] * with_families
        return Index(*[spark.read.parquet(f"{path}/{n}") for n in names])


def build(docs: DataFrame, with_families: bool = True) -> Index:
    """The index of ``docs(edition, doc, text)``."""
    entries = postings(docs)
    terms = term_stats(entries)
    fam = None
    if with_families:
        # families are per edition: an edition's words never vouch for another's
        editions = [r.edition for r in docs.select("edition").distinct().collect()]
        parts = [lemmas(terms.where(F.col("edition").eqNullSafe(e)).select("token")).select(F.lit(e).cast("string").alias("edition"), "token", "lemma") for e in editions]
        for p in parts:
            fam = p if fam is None else fam.unionByName(p)
    return Index(entries, terms, doc_stats(docs), fam)


#: Long lists are worked on in blocks, so that no word's list, however common, is one task's work.
BLOCK = 65_536
#: Bytes of tables that are read for one task's postings: a million or so of prose.
SHARE = 8 << 20
_LIST = ("edition", "token")
_KEY = (*_LIST, "block")
_LAST = (1 << 63) - 1


def _tasks(rows: DataFrame) -> int:
    """One task for each share of the tables that are read, so that what a task sorts doesn't grow with the
    input; as many as the session has if the size isn't known. A table read twice counts once."""
    leaves = rows._jdf.queryExecution().analyzed().collectLeaves()
    tables = [leaves.apply(i) for i in range(leaves.size())]
    size = sum({t.canonicalized().hashCode(): int(t.stats().sizeInBytes()) for t in tables}.values())
    if size >= 1 << 62:
        return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // SHARE))


def _dealt(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """Rows dealt out by list and block, once for all that is made of them. Keys are never null, so that windows
    and joins agree on them: a null edition is one like any other and gets a mark, null documents are a last block."""
    edition = F.coalesce(F.concat(F.lit("="), "edition"), F.lit("")).alias("edition")
    block = F.coalesce(F.expr(f"{by} div {BLOCK}"), F.lit(_LAST)).alias("block")
    return rows.select(edition, "token", block, *columns).repartition(_tasks(rows), *_KEY)


def _along(blocks: DataFrame, *columns: Column) -> DataFrame:
    """What blocks know of those before them in their list, dealt out as their rows are."""
    n = _tasks(blocks)
    return blocks.repartition(n, *_LIST).select(*_KEY, *columns).repartition(n, *_KEY)


def _edition() -> Column:
    """The edition without its mark."""
    return F.when(F.col("edition") != "", F.expr("substring(edition, 2)")).alias("edition")


def deltas(entries: DataFrame) -> DataFrame:
    """Postings as differences from the one before in the same list (the first from 0), with their place.
    Inside a block of documents by a window; across blocks by their counts and greatest documents, of which
    a list has few."""
    rows = _dealt(entries, "doc", "doc")
    line = Window.partitionBy(*_LIST).orderBy("block")
    blocks = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("most"))
    blocks = _along(blocks, (F.sum("n").over(line) - F.col("n")).alias("before"), F.lag("most", 1, 0).over(line).alias("last"))
    inside = Window.partitionBy(*_KEY).orderBy("doc")
    placed = rows.select(*_KEY, "doc", F.row_number().over(inside).alias("place"), F.lag("doc").over(inside).alias("prior"))
    pos, delta = F.col("before") + F.col("place"), F.col("doc") - F.coalesce("prior", "last")
    return placed.join(blocks, list(_KEY)).select(_edition(), "token", "doc", pos.alias("pos"), delta.alias("delta"))


def undelta(encoded: DataFrame) -> DataFrame:
    """Differences back to documents: running sums inside blocks of places, and of the blocks' own sums."""
    rows = _dealt(encoded, "pos", "pos", "delta")
    line = Window.partitionBy(*_LIST).orderBy("first")
    blocks = rows.groupBy(*_KEY).agg(F.min("pos").alias("first"), F.sum("delta").alias("s"))
    blocks = _along(blocks, (F.sum("s").over(line) - F.col("s")).alias("before"))
    inside = Window.partitionBy(*_KEY).orderBy("pos")
    placed = rows.select(*_KEY, "pos", F.col("delta").isNotNull().alias("known"), F.sum("delta").over(inside).alias("since"))
    return placed.join(blocks, list(_KEY)).select(_edition(), "token", "pos", F.when(F.col("known"), F.col("before") + F.col("since")).alias("doc"))


def lists36(encoded: DataFrame) -> DataFrame:
    """Lists as strings of base-36 differences, in segments of 65,536 places."""
    items = F.array_sort(F.collect_list(F.struct("pos", base36(F.col("delta")).alias("d"))))
    rows = encoded.select("edition", "token", F.expr(f"(pos - 1) div {BLOCK}").alias("segment"), "pos", "delta").repartition(_tasks(encoded), *_LIST, "segment")
    return rows.groupBy(*_LIST, "segment").agg(F.array_join(F.transform(items, lambda r: r["d"]), " ").alias("encoded"))
