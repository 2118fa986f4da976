"""The query surface: one method per question that the service answers, each a DataFrame.

Parameters are checked before any data is read; errors carry the status that a service would answer with.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versara.operators import apparatus, catalog
from versara.operators.index import Index
from versara.operators.numbering import has_title
from versara.plans import references, search
from versara.plans.errors import BadReference, RequestError
from versara.seeds import canon
from versara.sources.corpus import Corpus

#: What one request may ask for at most.
MOST_VERSES, MOST_NOTES, LONGEST_REFERENCE = 500, 2_000, 512


@dataclass(frozen=True)
class Edition:
    """An edition with its tables: verses carry ``sequence``; ``chapters`` is its chapter table."""

    id: str
    name: str
    corpus: Corpus
    chapters: DataFrame
    versification: references.Versification
    identity: dict[str, str] = field(default_factory=dict)
    index: Index | None = None
    notes: DataFrame | None = None
    schemes: tuple[str, ...] = ()


class Engine:
    def __init__(self, spark: SparkSession, editions: list[Edition]) -> None:
        self.spark, self.by_id = spark, {e.id: e for e in editions}
        self.default = editions[0].id

    def edition(self, name: str | None) -> Edition:
        """A named edition, or the default; never another in its stead."""
        try:
            return self.by_id[self.default if name is None else name]
        except KeyError:
            raise RequestError(f"unknown translation {name!r}; there are {', '.join(self.by_id)}", 404) from None

    def _attested(self, rows: DataFrame, e: Edition) -> DataFrame:
        """Rows that name another edition stop the query."""
        told: Column = F.when(~F.col("translation").eqNullSafe(F.lit(e.id)), F.raise_error(F.concat(F.lit("a row of "), F.coalesce("translation", F.lit("no edition")))).cast("string")).otherwise(F.col("translation"))
        return rows.withColumn("translation", told)

    def _verses(self, e: Edition) -> DataFrame:
        return e.corpus.verses.where(F.col("translation") == e.id)

    def health(self, translation: str | None = None) -> DataFrame:
        e = self.edition(translation)
        return self.spark.createDataFrame([(e.id, e.identity.get("edition_id"), e.identity.get("revision_id"), e.identity.get("generation_id"))], "translation string, edition_id string, revision_id string, generation_id string").withColumn("timestamp", F.current_timestamp())

    def translations(self) -> DataFrame:
        rows = [(e.id, e.name, e.index is not None, e.notes is not None, list(e.schemes)) for e in self.by_id.values()]
        base = self.spark.createDataFrame(rows, "id string, name string, search boolean, apparatus boolean, psalm_schemes array<string>")
        printed = None
        for e in self.by_id.values():
            mine = e.chapters.select(F.lit(e.id).alias("edition"), "book").distinct()
            printed = mine if printed is None else printed.unionByName(mine)
        return catalog.capabilities(base, printed, catalog.books(self.spark)).orderBy("id")

    def books(self, tradition: str = "protestant", translation: str | None = None) -> DataFrame:
        e = self.edition(translation)
        if tradition not in canon.TRADITIONS:
            raise RequestError(f"tradition must be one of {', '.join(canon.TRADITIONS)}")
        return catalog.book_rows(self.spark, tradition, e.id, e.chapters)

    def book(self, id: str, translation: str | None = None) -> DataFrame:
        book = id.upper()
        if book not in canon.NAMES:
            raise RequestError(f"unknown book {id!r}", 404)
        tradition = next(t for t, ids in canon.TRADITIONS.items() if book in ids)
        return self.books(tradition, translation).where(F.col("book") == book).drop("pos")

    def chapter(self, id: str, number, translation: str | None = None) -> DataFrame:
        """The verses of a chapter in order, its title and subscription on every row; in the Psalms, each
        verse's Hebrew number."""
        e, book = self.edition(translation), id.upper()
        if book not in canon.NAMES:
            raise RequestError(f"unknown book {id!r}", 404)
        counts = e.versification.counts.get(book)
        if counts is None:
            raise RequestError(f"{canon.NAMES[book]} is not present in the {e.name}", 404)
        try:
            n = int(number)
        except (TypeError, ValueError):
            raise RequestError("a chapter is a whole number") from None
        if not 1 <= n <= len(counts):
            raise RequestError(f"{canon.NAMES[book]} has {len(counts)} chapters", 404)
        lines = e.corpus.chapter_lines.where((F.col("translation") == e.id) & (F.col("book") == book) & (F.col("chapter") == n))
        heads = lines.groupBy("book", "chapter").pivot("kind", ["title", "subscription"]).agg(F.first("text"))
        rows = self._verses(e).where((F.col("book") == book) & (F.col("chapter") == n)).join(heads, ["book", "chapter"], "left")
        hebrew = F.when((F.lit(book) == "PSA") & has_title(F.col("chapter")), F.col("verse") + 1) if "hebrew" in e.schemes else F.lit(None).cast("int")
        return self._attested(rows, e).withColumn("hebrew_numbering", hebrew).orderBy("verse")

    def _bind(self, e: Edition, ref: str | None, numbering: str = "english") -> references.Bound:
        if ref is None or not ref.strip():
            raise RequestError("ref is required")
        if len(ref) > LONGEST_REFERENCE:
            raise RequestError(f"ref has {LONGEST_REFERENCE} characters at most")
        if numbering not in references.SCHEMES:
            raise RequestError(f"numbering must be one of {', '.join(references.SCHEMES)}")
        if numbering != "english" and numbering not in e.schemes:
            others = [x.id for x in self.by_id.values() if numbering in x.schemes]
            raise RequestError(f"{e.name} has no {numbering} numbering" + (f"; {', '.join(others)} does" if others else ""), 501)
        try:
            return references.bind(ref, e.versification, numbering)
        except BadReference as error:
            raise RequestError(str(error), error.status) from error

    def passage(self, ref: str | None, numbering: str = "english", translation: str | None = None) -> DataFrame:
        """The verses of a reference in its own order, ``segment`` by segment; those of overlapping segments
        come twice. A title that belongs to it is verse 0 and comes first."""
        e = self.edition(translation)
        b = self._bind(e, ref, numbering)
        if b.verse_count > MOST_VERSES:
            raise RequestError(f"a passage has {MOST_VERSES} verses at most; this one has {b.verse_count}", 413)
        rows = self._verses(e)
        out = None
        for i, (first, last) in enumerate(b.segments):
            part = rows.where(F.col("sequence").between(first.sequence, last.sequence)).select(F.lit(i + 1).alias("segment"), "translation", "bcv", "book", "chapter", "verse", "text", "note", "sequence")
            out = part if out is None else out.unionByName(part)
        if b.include_title:
            lines = e.corpus.chapter_lines.where((F.col("translation") == e.id) & (F.col("kind") == "title") & (F.col("book") == b.book) & (F.col("chapter") == b.title_chapter))
            title = lines.select(F.lit(0).alias("segment"), "translation", F.concat_ws(".", "book", "chapter", F.lit(0)).alias("bcv"), "book", "chapter", F.lit(0).alias("verse"), "text", F.lit(None).cast("string").alias("note"), F.lit(None).cast("long").alias("sequence"))
            out = title if out is None else title.unionByName(out)
        return self._attested(out, e).withColumn("reference", F.lit(b.reference)).orderBy("segment", "sequence")

    def passages(self, refs: DataFrame, translation: str | None = None) -> DataFrame:
        """Many references at once, from a column ``ref``: parsed in batches and answered by one range join;
        a reference that can't be bound gives one row with its error."""
        from versara.operators.versify import ranges

        e = self.edition(translation)
        parsed = refs.select("ref", references.parse_column(F.col("ref"), e.versification).alias("p"))
        segments = parsed.select("ref", F.posexplode("p.segments").alias("segment", "s")).select(F.col("ref"), (F.col("segment") + 1).alias("segment"), F.lit(e.id).alias("edition"), F.col("s.first.sequence").alias("first"), F.col("s.last.sequence").alias("last"))
        found = ranges(self._verses(e).withColumn("edition", F.col("translation")), segments).select("ref", "segment", "bcv", "book", "chapter", "verse", "text", "sequence", F.lit(None).cast("string").alias("error"))
        wrong = parsed.where("p.error is not null").select("ref", F.lit(None).cast("int").alias("segment"), *[F.lit(None).cast(t).alias(c) for c, t in (("bcv", "string"), ("book", "string"), ("chapter", "int"), ("verse", "int"), ("text", "string"), ("sequence", "long"))], F.concat_ws(": ", "p.error_kind", "p.error").alias("error"))
        return found.unionByName(wrong)

    def apparatus(self, ref: str | None, translation: str | None = None) -> DataFrame:
        """The variant notes of a reference's verses."""
        e = self.edition(translation)
        if e.notes is None:
            raise RequestError(f"{e.name} has no variant notes", 501)
        b = self._bind(e, ref)
        inside = F.lit(False)
        for first, last in b.segments:
            inside = inside | F.col("sequence").between(first.sequence, last.sequence)
        verses = self._verses(e).where(inside).select("translation", "bcv", "book", "chapter", "verse", "sequence")
        found = apparatus.of_verses(e.notes, verses)
        if found.limit(MOST_NOTES + 1).count() > MOST_NOTES:
            raise RequestError(f"an answer has {MOST_NOTES} notes at most", 413)
        return self._attested(found, e).orderBy("sequence", "note")

    def search(self, q: str | None, limit=None, offset=None, translation: str | None = None, *, compat: bool = False) -> search.Outcome:
        """Ranked hits with their verses, and the totals."""
        e = self.edition(translation)
        if e.index is None:
            raise RequestError(f"{e.name} can't be searched", 501)
        q, limit, offset = search.admit(q, limit, offset)
        found = search.search(e.index, e.id, q, limit, offset, compat=compat)
        hits = found.hits.join(self._verses(e).withColumnRenamed("sequence", "doc"), "doc")
        return search.Outcome(self._attested(hits, e).orderBy("n_words", "doc"), found.summary)
