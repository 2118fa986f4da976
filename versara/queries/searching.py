"""Search, index and morphology."""

from __future__ import annotations

from pyspark.sql import functions as F

from versara.functions.text import fold, half_up, highlight, tokens_of
from versara.operators import index, morphology
from versara.plans import search
from versara.queries.common import SQL_FOLD, SQL_POSTINGS, SQL_TOKENS, SQL_WORDS, documents, table
from versara.seeds.morphology import LEMMA_OF, REFUSED

_IRREGULAR = ", ".join(f"('{a}', '{b}')" for a, b in sorted(LEMMA_OF.items()))
_FORMS = ", ".join(f"'{a}'" for a in sorted(LEMMA_OF))
_REFUSED = ", ".join(f"'{x}'" for x in sorted(REFUSED))
_RULES = [("eth", 2, "", 0), ("eth", 3, "", 0), ("est", 2, "", 0), ("est", 3, "", 0), ("ing", 3, "e", 6), ("ing", 3, "", 6), ("ed", 1, "", 0), ("ed", 2, "", 0), ("es", 1, "", 0), ("es", 2, "", 0), ("s", 1, "", 0)]
_CANDIDATES = " union all ".join(
    f"select token, {i} as pos, left(token, length(token) - {cut}) || '{add}' as root from vocabulary where token like '%{end}' and length(token) >= {least}" + (" and token not like '%ss'" if end == "s" else "")
    for i, (end, cut, add, least) in enumerate(_RULES)
)


def _lemma_sql(edition: str) -> str:
    """CTEs up to ``lemmas(token, lemma)`` of one edition's vocabulary."""
    hops = "".join(f",\nh{i} as (select h.token, coalesce(l.next, h.lemma) as lemma from h{i - 1} h left join links l on l.token = h.lemma)" for i in range(2, 5))
    return f"""postings as ({SQL_POSTINGS}),
vocabulary as (select distinct token from postings where edition = '{edition}'),
irregular(token, lemma) as (values {_IRREGULAR}),
cands as ({_CANDIDATES}),
regular as (select token, arg_min(root, pos) as root from cands where length(root) >= 3 and root <> token and root not in ({_FORMS}) and token || '>' || root not in ({_REFUSED}) and root in (select token from vocabulary) group by token),
links as (select v.token, coalesce(i.lemma, r.root) as next from vocabulary v left join (select * from irregular where lemma in (select token from vocabulary)) i using (token) left join regular r using (token) where coalesce(i.lemma, r.root) is not null),
h1 as (select v.token, coalesce(l.next, v.token) as lemma from vocabulary v left join links l using (token)){hops},
lemmas as (select * from h4)"""


def search_sql(edition: str, query: str, limit: int, offset: int, families: bool = False, cap: int | None = None) -> str:
    words = search.query_terms(query)
    last = words[-1]
    parts = []
    for i, w in enumerate(words):
        own = f"select {i} as term, token, df, case when token = '{w}' then 0 else 1 end as rank from terms where token = '{w}'"
        if families:
            own += f" or token in (select b.token from lemmas a join lemmas b using (lemma) where a.token = '{w}')"
        parts.append(f"b{i} as ({own})")
    n = len(words) - 1
    parts.append(f"px as (select {n} as term, token, df, 2 as rank from (select *, row_number() over (order by token) as r from terms where token like '{last}%' and token not in (select token from b{n})) where r <= {search.MOST_PREFIX} - (select count(*) from b{n}))")
    parts.append("members as (" + " union all ".join([f"select * from b{i}" for i in range(len(words))] + ["select * from px"]) + ")")
    capped = ""
    if cap is not None:
        parts.append("rarest as (select term from members group by term order by sum(df), term limit 1)")
        parts.append(f"seed as (select distinct doc from (select p.doc from postings p join members m using (token) where p.edition = '{edition}' and m.term = (select term from rarest) order by m.rank, m.token, p.doc limit {cap}))")
        capped = " where doc in (select doc from seed)"
    lemma = _lemma_sql(edition) if families else f"postings as ({SQL_POSTINGS})"
    return f"""with {lemma},
terms as (select token, count(*) as df from postings where edition = '{edition}' group by token),
{", ".join(parts)},
hits as (select p.doc from postings p join members m using (token) where p.edition = '{edition}' group by p.doc having count(distinct m.term) = {len(words)}),
stats as (select doc_id as doc, ({SQL_WORDS})::int as n_words from documents where lang = '{edition}'),
corpus as (select count(*) as n, avg(n_words) as a from stats),
idf as (select sum(ln(1 + (n - df + 0.5) / (df + 0.5))) as s from (select term, sum(df) as df from members group by term) cross join corpus),
page as (select doc, n_words from hits join stats using (doc){capped} order by n_words, doc limit {limit} offset {offset})
select doc, n_words, floor(s * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n_words / a)) * 10000 + 0.5) / 10000.0 as score from page cross join corpus cross join idf"""


def _search(edition: str, query: str, limit: int = 20, offset: int = 0, families: bool = False, compat: bool = False):
    def run(spark, sf_dir):
        ix = index.build(documents(spark, sf_dir).where(F.col("edition") == edition), with_families=families)
        return search.search(ix, edition, query, limit, offset, compat=compat).hits

    return run


def postings(spark, sf_dir):
    return index.postings(documents(spark, sf_dir))


def doc_frequency(spark, sf_dir):
    return index.term_stats(postings(spark, sf_dir))


def doc_lengths(spark, sf_dir):
    return index.doc_stats(documents(spark, sf_dir))


def corpus_length_stats(spark, sf_dir):
    return index.corpus_stats(doc_lengths(spark, sf_dir)).select("edition", "docs", F.col("words").cast("long").alias("words"), F.round(F.col("words") / F.col("docs"), 6).alias("average"))


def bm25_scores(spark, sf_dir):
    """The score of every document of every edition for one frequent word."""
    entries = postings(spark, sf_dir).where(F.col("token").isin("the", "de", "la", "der"))
    df = index.term_stats(entries)
    stats = doc_lengths(spark, sf_dir)
    c = index.corpus_stats(stats).withColumn("average", F.col("words") / F.col("docs"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * (search.K1 + 1) / (1 + search.K1 * (1 - search.B + search.B * F.col("n_words") / F.col("average")))
    return entries.join(stats, ["edition", "doc"]).join(df, ["edition", "token"]).join(c, "edition").select("edition", "token", "doc", half_up(score, 4).alias("score"))


def families(spark, sf_dir):
    vocabulary = postings(spark, sf_dir).where("edition = 'en'").select("token")
    return morphology.families(vocabulary).select("lemma", F.array_join("members", " ").alias("members"))


def lemma_closure(spark, sf_dir):
    vocabulary = postings(spark, sf_dir).where("edition = 'en'").select("token")
    return morphology.lemmas(vocabulary).where("token <> lemma")


def fold_typography(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))


def query_terms_dedupe_cap(spark, sf_dir):
    from versara.functions.text import tokenize

    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(F.slice(F.array_distinct(tokenize(F.col("text"))), 1, search.MOST_TERMS), " ").alias("terms"))


def postings_delta_encode(spark, sf_dir):
    """The lists of every edition, a null one among them."""
    return index.deltas(postings(spark, sf_dir)).select("edition", "token", F.col("pos").cast("long").alias("pos"), "delta")


def postings_delta_roundtrip(spark, sf_dir):
    return index.undelta(index.deltas(postings(spark, sf_dir))).select("edition", "token", "doc")


def postings_base36(spark, sf_dir):
    return index.lists36(index.deltas(postings(spark, sf_dir))).select("edition", "token", "segment", "encoded")


def text_offsets(spark, sf_dir):
    from versara.operators.versify import offsets

    d = documents(spark, sf_dir).select("edition", "doc", F.length("text").cast("long").alias("n"))
    return offsets(d, "edition", "doc", "n").select("edition", "doc", "n", F.col("start").cast("long").alias("start"))


def highlighted(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(highlight(F.col("text"), "thing that")).alias("marked"), F.regexp_count(highlight(F.col("text"), "thing that"), F.lit("<mark>")).cast("long").alias("marks"))


def search_absent_term(spark, sf_dir):
    return _search("en", "the zzzznotaword", families=True)(spark, sf_dir)


QUERIES = {
    "search_and_page": _search("en", "the with that", 20, 5),
    "search_absent_term": search_absent_term,
    "search_prefix_last": _search("en", "of th", 25),
    "search_family": _search("en", "thering tiones", 25, families=True),
    "search_scan_capped": _search("en", "the of", 15, compat=True),
    "search_by_edition": _search("fr", "les des", 10),
    "query_terms_dedupe_cap": query_terms_dedupe_cap,
    "postings": postings,
    "doc_frequency": doc_frequency,
    "doc_lengths": doc_lengths,
    "corpus_length_stats": corpus_length_stats,
    "bm25_scores": bm25_scores,
    "families": families,
    "lemma_closure": lemma_closure,
    "fold_typography": fold_typography,
    "postings_delta_encode": postings_delta_encode,
    "postings_delta_roundtrip": postings_delta_roundtrip,
    "postings_base36": postings_base36,
    "text_offsets": text_offsets,
    "highlight": highlighted,
}

_STEMS = "|".join(sorted({t[:4] for t in tokens_of("thing that")}, key=lambda s: (-len(s), s)))
_MARKED = f"regexp_replace(text, '({_STEMS})', '<mark>\\1</mark>', 'gi')"
_LISTS = f"p as (select edition, token, doc from ({SQL_POSTINGS})), d as (select edition, token, row_number() over (partition by edition, token order by doc) as pos, doc - lag(doc, 1, 0) over (partition by edition, token order by doc) as delta from p)"
ORACLE_SQL = {
    "search_and_page": search_sql("en", "the with that", 20, 5),
    "search_absent_term": search_sql("en", "the zzzznotaword", 20, 0, families=True),
    "search_prefix_last": search_sql("en", "of th", 25, 0),
    "search_family": search_sql("en", "thering tiones", 25, 0, families=True),
    "search_scan_capped": search_sql("en", "the of", 15, 0, cap=search.MOST_SCANNED),
    "search_by_edition": search_sql("fr", "les des", 10, 0),
    "query_terms_dedupe_cap": f"with t as (select item_id, {SQL_TOKENS} as l from benchmark), o as (select item_id, x.t as t, min(x.i) as i from (select item_id, unnest(list_zip(l, range(1, len(l) + 1))) as z from t) q, lateral (select z[1] as t, z[2] as i) x group by all), r as (select *, row_number() over (partition by item_id order by i) as n from o) select item_id, coalesce(string_agg(t, ' ' order by n), '') as terms from t left join (select * from r where n <= {search.MOST_TERMS}) using (item_id) group by item_id",
    "postings": SQL_POSTINGS,
    "doc_frequency": f"select edition, token, count(*) as df from ({SQL_POSTINGS}) group by all",
    "doc_lengths": f"select lang as edition, doc_id as doc, ({SQL_WORDS})::int as n_words from documents",
    "corpus_length_stats": f"select lang as edition, count(*) as docs, sum({SQL_WORDS})::bigint as words, round(sum({SQL_WORDS}) / count(*), 6) as average from documents group by lang",
    "bm25_scores": f"with p as (select * from ({SQL_POSTINGS}) where token in ('the', 'de', 'la', 'der')), s as (select lang as edition, doc_id as doc, {SQL_WORDS} as w from documents), c as (select edition, count(*) as n, sum(w) / count(*) as a from s group by edition), f as (select edition, token, count(*) as df from p group by all) select edition, token, doc, floor(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * w / a)) * 10000 + 0.5) / 10000.0 as score from p join s using (edition, doc) join f using (edition, token) join c using (edition)",
    "families": f"with {_lemma_sql('en')} select lemma, string_agg(token, ' ' order by token) as members from lemmas group by lemma having count(*) >= 2",
    "lemma_closure": f"with {_lemma_sql('en')} select token, lemma from lemmas where token <> lemma",
    "fold_typography": f"select doc_id, md5({SQL_FOLD}) as folded from documents",
    "postings_delta_encode": f"with {_LISTS} select edition, token, pos, delta from d",
    "postings_delta_roundtrip": f"with {_LISTS} select edition, token, doc from p",
    "postings_base36": f"with {_LISTS} select edition, token, (pos - 1) // {index.BLOCK} as segment, string_agg(lower(to_base(delta, 36)), ' ' order by pos) as encoded from d group by all",
    "text_offsets": "select lang as edition, doc_id as doc, length(text) as n, coalesce(sum(length(text)) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start from documents",
    "highlight": f"select doc_id, md5({_MARKED}) as marked, (length({_MARKED}) - length(replace({_MARKED}, '<mark>', ''))) // 6 as marks from documents",
}
