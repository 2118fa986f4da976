"""Versification, passages, numbering and catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from versara.operators import catalog, numbering, versify
from versara.plans import references
from versara.queries.common import SQL_CHAPTERS, SQL_VERSES, table, verses
from versara.seeds import canon


def _numbered(spark, sf_dir):
    v = verses(spark, sf_dir)
    ch = versify.chapters(v)
    return versify.numbered(v, ch), ch


def versification(spark, sf_dir):
    return versify.chapters(verses(spark, sf_dir)).select("edition", "book", "chapter", "n_verses", F.col("pos").cast("long").alias("pos"), F.col("book_start").cast("long").alias("book_start"))


def chapter_offsets(spark, sf_dir):
    return versify.chapters(verses(spark, sf_dir)).select("book", "chapter", F.col("chapter_offset").cast("long").alias("chapter_offset"))


def global_sequence(spark, sf_dir):
    return _numbered(spark, sf_dir)[0].select("book", "chapter", "verse", F.col("sequence").cast("long").alias("sequence"))


def locate_sequence(spark, sf_dir):
    v, ch = _numbered(spark, sf_dir)
    beyond = v.agg(F.max("sequence").alias("m")).select(F.lit("talk").alias("edition"), F.explode(F.array(F.col("m") + 1, F.col("m") + 70_000)).alias("sequence"))
    return versify.locate(v.select("edition", "sequence").unionByName(beyond), ch).select(F.col("sequence").cast("long").alias("sequence"), "book", "chapter", F.col("verse").cast("long").alias("verse"))


def sequence_roundtrip(spark, sf_dir):
    """Sequences whose coordinates don't come back; there are none."""
    v, ch = _numbered(spark, sf_dir)
    back = versify.locate(v.select("edition", "sequence"), ch).withColumnRenamed("verse", "found")
    return v.join(back, ["edition", "sequence", "book", "chapter"], "left").where("not found <=> verse").select("book", "chapter", "verse")


def passage_ranges(spark, sf_dir):
    """Three requests with two overlapping segments each."""
    v, _ = _numbered(spark, sf_dir)
    seg = spark.range(3).select((F.col("id") * 40 + 5).alias("a"), F.col("id").alias("request")).select("request", F.explode(F.array(F.struct(F.lit(1).alias("segment"), F.col("a").alias("first"), (F.col("a") + 20).alias("last")), F.struct(F.lit(2).alias("segment"), (F.col("a") + 15).alias("first"), (F.col("a") + 18).alias("last")))).alias("s")).select(F.lit("talk").alias("edition"), "request", "s.segment", "s.first", "s.last")
    return versify.ranges(v, seg).select("request", "segment", "book", "chapter", "verse", F.col("sequence").cast("long").alias("sequence"))


def verse_point_lookup(spark, sf_dir):
    return verses(spark, sf_dir).where((F.col("book") == "B00000") & (F.col("chapter") == 3) & (F.col("verse") == 2)).select("book", "chapter", "verse", "text")


def chapter_scan(spark, sf_dir):
    return verses(spark, sf_dir).where((F.col("book") == "B00001") & (F.col("chapter") == 4)).orderBy("verse").select("verse", "role", "text")


def contiguity(spark, sf_dir):
    """Orders of a customer whose key doesn't follow the one before."""
    line = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    step = F.col("o_orderkey") - F.lag("o_orderkey").over(line)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", step.cast("long").alias("step")).where("step <> 1")


def notes_left_join(spark, sf_dir):
    """Every document with its label, as verses with their notes; none is lost."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def availability(spark, sf_dir):
    """Nations whose own tables hold rows, as editions that print a book."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").select("n_name", F.when(F.col("suppliers") > 0, "full").otherwise("metadata_only").alias("availability"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def canon_positions(spark, sf_dir):
    places = catalog.positions(catalog.traditions(spark), "tradition", list(canon.TRADITIONS))
    return catalog.books(spark).select(F.col("id").alias("book"), "is_deuterocanon").join(places, "book", "left")


def edition_order(spark, sf_dir):
    return catalog.positions(catalog.printing_order(spark), "edition", list(canon.EDITION_ORDER))


def edition_capabilities(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("noted"))
    return d.join(l, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count("noted").alias("notes"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def interval_mapping(spark, sf_dir):
    """Turns as Greek verses: each conversation stands for a psalm."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 150 + 1).cast("int").alias("greek"), (F.col("turn") + 1).cast("int").alias("greek_verse")).distinct()
    return numbering.from_greek(c).select("greek", "greek_verse", "kind", "psalm", "verse")


def greek_numbering_sweep(spark, sf_dir):
    """Every verse of every Greek psalm: refusals, verses, titles, and different targets."""
    every = numbering.greek_counts(spark).select("greek", F.explode(F.sequence(F.lit(1), "n_verses")).alias("greek_verse"))
    got = numbering.from_greek(every)
    return got.agg(F.count_if(F.col("kind") == "refused").alias("refused"), F.count_if(F.col("kind") == "verse").alias("verses"), F.count_if(F.col("kind") == "title").alias("titles"), F.count_distinct(F.when(F.col("kind") != "refused", F.concat_ws(":", "kind", "psalm", F.coalesce(F.col("verse").cast("string"), F.lit(""))))).alias("targets"))


def hebrew_numbering(spark, sf_dir):
    psalms = spark.range(1, 151).select(F.col("id").cast("int").alias("psalm"))
    each = psalms.select("psalm", F.explode(F.sequence(F.lit(1), numbering.hebrew_count(F.col("psalm")))).alias("hebrew"))
    return each.select("psalm", "hebrew", numbering.from_hebrew(F.col("psalm"), F.col("hebrew")).alias("p")).select("psalm", "hebrew", "p.kind", "p.verse", numbering.greek_psalm(F.col("psalm")).alias("greek"))


def cross_edition_compare(spark, sf_dir):
    """Sources in two languages, as books in two editions: documents by decade of length."""
    d = table(spark, sf_dir, "documents").where("lang in ('en', 'de')")
    rows = d.groupBy(F.col("lang").alias("edition"), F.col("source").alias("book"), F.expr("cast(least(n_chars div 1000, 5) + 1 as int)").alias("chapter")).agg(F.count(F.lit(1)).alias("n_verses"))
    return versify.differing(rows, "en", "de").select("book", "same", "same_total", F.col("first_difference").cast("long").alias("first_difference"))


#: A small edition for references: verses per chapter of four books.
SMALL = references.Versification("asv", "American Standard Version", {"GEN": (31, 25, 24), "PSA": tuple(numbering.english_verses()), "JHN": (51, 25, 36), "JUD": (25,)}, default=True)
REFS = ["John 3:16", "Jn 3:16-17,20", "Jude 5", "jude 1:5", "Genesis 1:31-2:3", "Gen 1-3", "Jo 3:16", "John 3:99", "Hezekiah 1:1", "Tobit 1:1", "John 3:abc", "Psalm 117", "Ps. 23", "Genesis", ""]


def parse_references(spark, sf_dir):
    rows = spark.createDataFrame([(r,) for r in REFS], "ref string")
    p = rows.select("ref", references.parse_column(F.col("ref"), SMALL).alias("p"))
    return p.select("ref", "p.reference", "p.book", "p.verse_count", "p.error_kind")


QUERIES = {f.__name__: f for f in (versification, chapter_offsets, global_sequence, locate_sequence, sequence_roundtrip, passage_ranges, verse_point_lookup, chapter_scan, contiguity, notes_left_join, availability, canon_positions, edition_order, edition_capabilities, interval_mapping, greek_numbering_sweep, hebrew_numbering, cross_edition_compare, parse_references)}


def _values(rows, names: str) -> str:
    lit = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()
    return f"(values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) as t({names})"


def _walk() -> str:
    """Greek psalms verse by verse, in SQL from the fixed values alone: every part's title lines, then its verses,
    numbered through."""
    seed = numbering.seed
    listed = lambda text: ", ".join(text.split())
    regular = " union all ".join(f"select unnest(range({lo}, {hi + 1})) as greek, {add} as shift" for lo, hi, add in seed.REGULAR)
    odd = [(g, i, *part, None) if len(part) == 4 else (g, i, None, None, part[0], 0, part[1]) for g, parts in seed.IRREGULAR.items() for i, part in enumerate(parts)]
    return f"""
english as (select unnest(range(1, 151))::int as psalm, unnest([{listed(seed.ENGLISH_VERSES)}]) as n),
hebrew as (select psalm, n, (psalm in ({listed(seed.TITLED)}))::int as title from english),
parts as (
  select greek, 0 as part, greek + shift as psalm, 1 as first, null as n, case when greek in ({listed(seed.NO_TITLE_VERSE)}) then 0 when greek in ({listed(seed.TWO_TITLE_VERSES)}) then 2 end as titles, null as reason from ({regular}) where greek not in ({', '.join(map(str, seed.IRREGULAR))})
  union all select * from {_values(odd, "greek, part, psalm, first, n, titles, reason")}),
known as (select greek, part, p.psalm, first, coalesce(p.n, h.n - first + 1) as n, coalesce(titles, title) as titles, reason from parts p left join hebrew h on h.psalm = p.psalm),
lines as (select *, unnest(range(0, (n + titles)::bigint)) as o from known),
walk as (select greek::int as greek, row_number() over (partition by greek order by part, o)::int as greek_verse, case when reason is not null then 'refused' when o < titles then 'title' else 'verse' end as kind, psalm::int as psalm, case when reason is null and o >= titles then first + o - titles end::int as verse from lines)"""


_PLACES = lambda of, names: ", ".join(f"max(case when k = '{n}' then pos end)::int as {n}" for n in names)
_TRAD = _values([(k, i + 1, b) for k, ids in canon.TRADITIONS.items() for i, b in enumerate(ids)], "k, pos, book")
_EDN = _values([(k, i + 1, b) for k, ids in canon.EDITION_ORDER.items() for i, b in enumerate(ids)], "k, pos, book")
_BOOKS = _values([(r[0], r[6]) for r in canon.BOOK_ROWS], "book, is_deuterocanon")
_C = f"with {SQL_CHAPTERS}"
ORACLE_SQL = {
    "versification": f"{_C} select edition, book, chapter, n_verses, pos, book_start from chapters",
    "chapter_offsets": f"{_C} select book, chapter, chapter_offset from chapters",
    "global_sequence": f"{_C} select book, chapter, verse, sequence::bigint as sequence from numbered",
    "locate_sequence": f"{_C}, s as (select sequence::bigint as sequence from numbered union all select max(sequence)::bigint + x from numbered, (values (1), (70000)) t(x) group by x) select s.sequence, book, chapter, (s.sequence - book_start - chapter_offset + 1)::bigint as verse from s left join chapters c on s.sequence >= book_start + chapter_offset and s.sequence < book_start + chapter_offset + n_verses",
    "sequence_roundtrip": f"{_C} select book, chapter, verse from numbered where false",
    "passage_ranges": f"{_C}, seg as (select r::bigint as request, (x.s)::int as segment, r * 40 + x.a as first, r * 40 + x.b as last from range(3) q(r), (values (1, 5, 25), (2, 20, 23)) x(s, a, b)) select request, segment, book, chapter, verse, sequence::bigint as sequence from seg join numbered on sequence between first and last",
    "verse_point_lookup": f"select book, chapter, verse, text from ({SQL_VERSES}) where book = 'B00000' and chapter = 3 and verse = 2",
    "chapter_scan": f"select verse, role, text from ({SQL_VERSES}) where book = 'B00001' and chapter = 4",
    "contiguity": "select * from (select o_custkey, o_orderkey, (o_orderkey - lag(o_orderkey) over (partition by o_custkey order by o_orderkey))::bigint as step from orders) where step <> 1",
    "notes_left_join": "select doc_id, lang, n_chars, quality, toxic from documents left join labels using (doc_id)",
    "availability": "select n_name, case when count(s_suppkey) > 0 then 'full' else 'metadata_only' end as availability, count(s_suppkey) as suppliers from nation left join supplier on n_nationkey = s_nationkey group by n_name",
    "canon_positions": f"select b.book, b.is_deuterocanon, {_PLACES(0, canon.TRADITIONS)} from (select * from {_BOOKS}) b left join (select * from {_TRAD}) o on o.book = b.book group by all",
    "edition_order": f"select book, {_PLACES(0, canon.EDITION_ORDER)} from (select * from {_EDN}) group by book",
    "edition_capabilities": "select lang, count(*) as docs, count(l.doc_id) as notes, string_agg(distinct source, ',' order by source) as sources from documents d left join labels l using (doc_id) group by lang",
    "interval_mapping": f"with {_walk()}, c as (select distinct (conv_id % 150 + 1)::int as greek, (turn + 1)::int as greek_verse from conversations) select greek, greek_verse, coalesce(kind, 'out_of_range') as kind, psalm, verse from c left join walk using (greek, greek_verse)",
    "greek_numbering_sweep": f"with {_walk()} select count(*) filter (kind = 'refused') as refused, count(*) filter (kind = 'verse') as verses, count(*) filter (kind = 'title') as titles, count(distinct case when kind <> 'refused' then kind || ':' || psalm || ':' || coalesce(verse::varchar, '') end) as targets from walk",
    "hebrew_numbering": f"with {_walk()}, g as (select psalm, min(greek) as greek from walk where psalm is not null group by psalm), e as (select psalm, title, unnest(range(1, n + title + 1))::int as hebrew from hebrew) select psalm, hebrew, case when hebrew <= title then 'title' else 'verse' end as kind, case when hebrew > title then hebrew - title end as verse, greek from e left join g using (psalm)",
    "cross_edition_compare": "with r as (select lang, source as book, least(n_chars // 1000, 5) + 1 as chapter, count(*) as n from documents where lang in ('en', 'de') group by all), l as (select lang, book, list(n order by chapter) as l, sum(n) as t from r group by all), b as (select x.book, x.l as x, y.l as y, x.t = y.t as same_total from l x join l y using (book) where x.lang = 'en' and y.lang = 'de') select book, x = y as same, same_total, (select min(i) from range(1, greatest(len(x), len(y)) + 1) q(i) where x[i] is distinct from y[i]) as first_difference from b",
}
