"""Ranked conjunctive search: a planner over the index tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versara.functions.text import half_up, tokens_of
from versara.operators.index import Index
from versara.plans.errors import RequestError, bounded_int

#: Limits of a query, and the ranking's constants.
MOST_TERMS, MOST_PREFIX, MOST_SCANNED = 12, 64, 25_000
SHORTEST_QUERY, LONGEST_QUERY = 2, 512
K1, B = 1.2, 0.75
PAGE = "doc long, n_words int, score double"


@dataclass(frozen=True)
class Term:
    """A word of the query with the index tokens that stand for it, in order: itself, its family, what it
    is a prefix of. ``df`` is the sum of theirs."""

    word: str
    members: tuple[str, ...]
    df: int


@dataclass(frozen=True)
class Outcome:
    """``hits(doc, n_words, score)`` in rank order; ``summary(total, truncated)``, one row."""

    hits: DataFrame
    summary: DataFrame


def query_terms(query: str) -> list[str]:
    """Distinct tokens in order, twelve at most."""
    return list(dict.fromkeys(tokens_of(query)))[:MOST_TERMS]


def admit(query: str | None, limit=None, offset=None) -> tuple[str, int, int]:
    """The checks before a search, in their order."""
    if query is None or len(query.strip()) < SHORTEST_QUERY:
        raise RequestError(f"a query has {SHORTEST_QUERY} characters or more")
    if len(query) > LONGEST_QUERY:
        raise RequestError(f"a query has {LONGEST_QUERY} characters at most")
    if len(set(tokens_of(query))) > MOST_TERMS:
        raise RequestError(f"a query has {MOST_TERMS} different words at most")
    return query, bounded_int(limit, 20, 1, 100, "limit"), bounded_int(offset, 0, 0, 2**31 - 1, "offset")


def resolve(index: Index, edition: str, words: list[str]) -> list[Term]:
    """The terms that the edition's index has. Only candidates reach the driver: the words, their families
    and, for the last word, the tokens that it begins, of which 64 in all can count."""
    if not words:
        return []
    terms = index.terms.where(F.col("edition") == edition).select("token", "df")
    family: dict[str, list[str]] = {w: [] for w in words}
    if index.families is not None:
        fam = index.families.where(F.col("edition") == edition)
        mine = fam.where(F.col("token").isin(words)).select(F.col("token").alias("word"), "lemma")
        for r in fam.join(F.broadcast(mine), "lemma").select("word", "token").orderBy("token").collect():  # twelve rows at most
            family[r.word].append(r.token)
    wanted = {w for w in words} | {m for ms in family.values() for m in ms}
    df = {r.token: r.df for r in terms.where(F.col("token").isin(sorted(wanted))).collect()}
    last = words[-1]
    room = MOST_PREFIX + len(family[last]) + 1
    begun = terms.where(F.col("token").startswith(last)).orderBy("token").limit(room).collect()
    df |= {r.token: r.df for r in begun}
    out = []
    for w in words:
        members = dict.fromkeys(t for t in [w, *family[w]] if t in df)
        if w == last:
            for r in begun:
                if len(members) >= MOST_PREFIX:
                    break
                members[r.token] = None
        if members:
            out.append(Term(w, tuple(members), sum(df[t] for t in members)))
    return out


def search(index: Index, edition: str, query: str, limit: int = 20, offset: int = 0, *, compat: bool = False) -> Outcome:
    """Documents that have every term, shortest first, then by number; scores by BM25 with one occurrence per
    term. A query without tokens, or with a word that the index lacks, has no hits.

    One shuffle: postings are filtered to the terms' tokens (which reaches the scan), and each document's
    bits of terms are combined before and after it. ``compat`` scans 25,000 postings of the rarest term at
    most, in the order of its members, and says whether that cut it off.
    """
    spark = index.postings.sparkSession
    words = query_terms(query)
    terms = resolve(index, edition, words)
    if not words or len(terms) != len(words):
        return Outcome(spark.createDataFrame([], PAGE), spark.createDataFrame([(0, False)], "total long, truncated boolean"))
    bits: dict[str, int] = {}
    for i, t in enumerate(terms):
        for m in t.members:
            bits[m] = bits.get(m, 0) | 1 << i
    mine = index.postings.where((F.col("edition") == edition) & F.col("token").isin(sorted(bits)))
    mask = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(bits.items()) for x in kv]), F.col("token"))
    docs = mine.select("doc", mask.alias("mask")).groupBy("doc").agg(F.bit_or("mask").alias("mask")).where(F.col("mask") == (1 << len(terms)) - 1).select("doc")
    truncated = F.lit(False)
    if compat:
        rarest = min(terms, key=lambda t: t.df)  # the first of equals, as a stable sort has it
        place = F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(rarest.members) for x in (m, i)]), F.col("token"))
        seed = mine.where(F.col("token").isin(list(rarest.members))).orderBy(place, "doc").limit(MOST_SCANNED)
        docs = docs.join(seed.select("doc").distinct(), "doc", "left_semi")
        truncated = F.lit(rarest.df >= MOST_SCANNED)
    stats = index.docs.where(F.col("edition") == edition).select("doc", "n_words")
    corpus = stats.agg(F.count(F.lit(1)).alias("n"), F.avg("n_words").alias("avg"))
    found = docs.join(stats, "doc")
    page = found.orderBy("n_words", "doc").offset(offset).limit(limit)
    idf = sum((F.log(1 + (F.col("n") - t.df + 0.5) / (t.df + 0.5)) for t in terms), F.lit(0.0))
    score = idf * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("n_words") / F.col("avg")))
    scored = page.crossJoin(F.broadcast(corpus)).select("doc", "n_words", half_up(score, 4).alias("score"))  # one row
    return Outcome(scored.orderBy("n_words", "doc"), found.agg(F.count(F.lit(1)).alias("total")).select("total", truncated.alias("truncated")))
