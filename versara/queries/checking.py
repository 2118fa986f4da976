"""The gate's checks, ledgers, markup and probes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from versara.functions.identity import fingerprint, row_sha256
from versara.functions.text import collapse, count_of, decode_entities, excerpt, residual_markup, strip_tags, unbalanced
from versara.operators.apparatus import note_parts
from versara.operators.milestones import attribute
from versara.operators.stats import upper_median
from versara.queries.common import table


def gate_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def gate_gaps(spark, sf_dir):
    """Line numbers up to an order's highest that don't occur."""
    seen = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("line"))
    every = seen.groupBy("l_orderkey").agg(F.max("line").alias("most")).select("l_orderkey", F.explode(F.sequence(F.lit(1), "most")).alias("line"))
    return every.join(seen, ["l_orderkey", "line"], "left_anti")


def gate_anti_join(spark, sf_dir):
    """Documents that have no label."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


def gate_full_outer(spark, sf_dir):
    """Orders against their lines, from both sides: missing, unexpected, and how many."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(1).alias("o"))
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("lines"))
    state = F.when(F.col("lines").isNull(), "missing").when(F.col("o").isNull(), "unexpected").otherwise("both")
    return o.join(l, "key", "full").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def gate_set_equality(spark, sf_dir):
    """Documents that only one of two tables names."""
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("key")).distinct().withColumn("a", F.lit(1))
    b = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("key")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "key", "full").where("a is null or b is null").select("key", F.col("a").isNotNull().alias("in_documents"), F.col("b").isNotNull().alias("in_labels"))


def gate_brackets_markup(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", unbalanced(F.col("html")).alias("unbalanced"), residual_markup(F.col("html")).alias("markup"), count_of(F.col("html"), "<").cast("long").alias("opens"))


def ledger_conservation(spark, sf_dir):
    """Characters inside tags, outside tags, and all."""
    p = table(spark, sf_dir, "pages")
    text, whole = F.length(strip_tags(F.col("html"))).cast("long"), F.length("html").cast("long")
    tags = F.aggregate(F.regexp_extract_all(F.col("html"), F.lit("<[^>]*>"), F.lit(0)), F.lit(0).cast("long"), lambda s, t: s + F.length(t))
    return p.select("page_id", tags.alias("tags"), text.alias("text"), whole.alias("whole"), (tags + text == whole).alias("balanced"))


def html_tag_inventory(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    names = F.transform(F.regexp_extract_all(F.col("html"), F.lit("</?([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)
    return p.select(F.explode(names).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def html_tag_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(strip_tags(F.col("html"))).alias("stripped"))


def entity_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(decode_entities(F.col("html"))).alias("decoded"))


def collapse_whitespace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(collapse(F.col("text"))).alias("collapsed"))


def milestone_attribution(spark, sf_dir):
    """Events belong to the user's last signup before them."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    opened = attribute(e, "user_id", F.date_trunc("day", F.col("ts")), ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")))
    return opened.groupBy("open").agg(F.count(F.lit(1)).alias("events"))


def median_max(spark, sf_dir):
    """The upper median and the greatest value per kind of event, exactly."""
    return upper_median(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "median", "largest")


def row_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", row_sha256(F.col("doc_id"), F.col("lang"), F.col("text")).alias("sha256"))


def corpus_fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint(d, "doc_id", F.sha2("text", 256))


def excerpts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", excerpt(F.col("text"), 60).alias("excerpt"))


NOTES = ["• word W1 ] other W2; third", "22–23 a b WH ] – Treg; c NA ; ", "3 x ] y", "plain ] "]


def note_split(spark, sf_dir):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(NOTES)], "i int, note string")
    return rows.select("i", note_parts(F.col("note")).alias("n")).select("i", "n.raw", "n.lemma", F.array_join("n.readings", "|").alias("readings"), "n.range")


def probe_matrix(spark, sf_dir):
    """Every region against every nation, as services against probes: is the nation there, and how large?"""
    r, n = table(spark, sf_dir, "region").select("r_regionkey", "r_name"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("k"))
    verdict = F.when(F.col("n_regionkey") != F.col("r_regionkey"), "not-applicable").when(F.col("k").isNull(), "missing").when(F.col("k") > 3, "safe").otherwise("divergent")
    return r.crossJoin(n).join(s, "n_nationkey", "left").select("r_name", "n_name", verdict.alias("verdict"))  # five rows by twenty-five


def verdict_histogram(spark, sf_dir):
    return probe_matrix(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (gate_duplicates, gate_gaps, gate_anti_join, gate_full_outer, gate_set_equality, gate_brackets_markup, ledger_conservation, html_tag_inventory, html_tag_strip, entity_decode, collapse_whitespace, milestone_attribution, median_max, row_hash, corpus_fingerprint, excerpts, note_split, probe_matrix, verdict_histogram)}

_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_FLAT = f"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))"
_MATRIX = "select r_name, n_name, case when n_regionkey <> r_regionkey then 'not-applicable' when k is null then 'missing' when k > 3 then 'safe' else 'divergent' end as verdict from region cross join nation left join (select s_nationkey, count(*) as k from supplier group by 1) on s_nationkey = n_nationkey"
_DECODED = "html"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("amp", "&")):
    _DECODED = f"replace({_DECODED}, '&{_name};', '{_char}')"
ORACLE_SQL = {
    "gate_duplicates": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1",
    "gate_gaps": "with m as (select l_orderkey, unnest(range(1, max(l_linenumber) + 1))::int as line from lineitem group by l_orderkey) select * from m where not exists (select 1 from lineitem l where l.l_orderkey = m.l_orderkey and l.l_linenumber = m.line)",
    "gate_anti_join": "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
    "gate_full_outer": "select case when lines is null then 'missing' when o_orderkey is null then 'unexpected' else 'both' end as state, count(*) as orders, coalesce(sum(lines), 0)::bigint as lines from orders full join (select l_orderkey, count(*) as lines from lineitem group by 1) on o_orderkey = l_orderkey group by 1",
    "gate_set_equality": "select coalesce(a.k, b.k)::bigint as key, a.k is not null as in_documents, b.k is not null as in_labels from (select distinct doc_id as k from documents) a full join (select distinct doc_id as k from labels) b on a.k = b.k where a.k is null or b.k is null",
    "gate_brackets_markup": "select page_id, length(replace(html, '[', '')) <> length(replace(html, ']', '')) as unbalanced, regexp_matches(html, '[<>]') as markup, length(html) - length(replace(html, '<', '')) as opens from pages",
    "ledger_conservation": "select page_id, coalesce(list_sum(list_transform(regexp_extract_all(html, '<[^>]*>'), lambda x: length(x))), 0)::bigint as tags, length(regexp_replace(html, '<[^>]*>', '', 'g')) as text, length(html) as whole, true as balanced from pages",
    "html_tag_inventory": "select lower(t) as tag, count(*) as n from (select unnest(regexp_extract_all(html, '</?([a-zA-Z][a-zA-Z0-9]*)', 1)) as t from pages) group by 1",
    "html_tag_strip": "select page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) as stripped from pages",
    "entity_decode": f"select page_id, md5({_DECODED}) as decoded from pages",
    "collapse_whitespace": f"select doc_id, md5({_FLAT}) as collapsed from documents",
    "milestone_attribution": "select open, count(*) as events from (select last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as open from events) group by open",
    "median_max": "with r as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null) select event_type, max(value) filter (r = n // 2 + 1) as median, max(value) as largest from r group by event_type",
    "row_hash": "select doc_id, sha256(concat_ws(chr(31), doc_id::varchar, coalesce(lang, chr(0)), coalesce(text, chr(0)))) as sha256 from documents",
    "corpus_fingerprint": "with p as (select doc_id // 4096 as k, sha256(string_agg(sha256(text), '' order by doc_id)) as h from documents group by 1), b as (select k // 4096 as k, sha256(string_agg(h, '' order by k)) as h from p group by 1) select sha256(string_agg(h, '' order by k)) as fingerprint from b",
    "excerpts": f"select doc_id, case when length({_FLAT}) > 60 then left({_FLAT}, 60) || '…' else {_FLAT} end as excerpt from documents",
    "note_split": "select * from (values (0, 'word W1 ] other W2; third', 'word W1', 'other W2|third', null), (1, 'a b WH ] – Treg; c NA ;', 'a b WH', '– Treg|c NA', '22–23'), (2, 'x ] y', 'x', 'y', null), (3, 'plain ]', 'plain', '', null)) t(i, raw, lemma, readings, range)",
    "probe_matrix": _MATRIX,
    "verdict_histogram": f"select verdict, count(*) as n from ({_MATRIX}) group by verdict",
}
