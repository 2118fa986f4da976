"""How the driver's tables stand for a corpus: an edition is a language, a document a verse; a conversation is
a chapter, a turn a verse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("edition"), F.col("doc_id").alias("doc"), "text")


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as an edition of books (fifty conversations each), chapters and verses."""
    c = table(spark, sf_dir, "conversations")
    book = F.format_string("B%05d", F.expr("conv_id div 50"))
    return c.select(F.lit("talk").alias("edition"), book.alias("book"), (F.col("conv_id") % 50 + 1).cast("int").alias("chapter"), (F.col("turn") + 1).cast("int").alias("verse"), "text", "role")


SQL_FOLD = "replace(replace(replace(replace(replace(text, '’', ' '), 'æ', 'ae'), 'Æ', 'Ae'), 'ï', 'i'), 'ü', 'u')"
SQL_TOKENS = f"list_filter(string_split_regex(lower({SQL_FOLD}), '[^a-z]+'), lambda x: length(x) >= 2)"
SQL_POSTINGS = f"select lang as edition, doc_id as doc, unnest(list_distinct({SQL_TOKENS})) as token from documents"
SQL_WORDS = "case when coalesce(text, '') = '' then 0 else len(string_split(text, ' ')) end"
SQL_VERSES = "select 'talk' as edition, format('B{:05d}', conv_id // 50) as book, (conv_id % 50 + 1)::int as chapter, (turn + 1)::int as verse, text, role from conversations"
SQL_CHAPTERS = f"""v as ({SQL_VERSES}),
ch as (select edition, book, chapter, count(*) as n_verses from v group by all),
bk as (select edition, book, sum(n_verses)::bigint as book_verses, row_number() over (partition by edition order by book) as pos from ch group by edition, book),
bs as (select *, coalesce(sum(book_verses) over (partition by edition order by pos rows between unbounded preceding and 1 preceding), 0)::bigint + 1 as book_start from bk),
chapters as (select ch.*, pos, book_start, coalesce(sum(n_verses) over (partition by ch.edition, ch.book order by chapter rows between unbounded preceding and 1 preceding), 0)::bigint as chapter_offset from ch join bs using (edition, book)),
numbered as (select v.*, book_start + chapter_offset - 1 + row_number() over (partition by v.edition, v.book, v.chapter order by verse) as sequence from v join chapters using (edition, book, chapter))"""
