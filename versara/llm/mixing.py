"""Mixing sources to target weights by hierarchical budgeting. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, write_cut

#: Stands for a null level in the tree's keys, so that joins are plain equalities.
MISSING = "\x00null"
BIG = "decimal(38,0)"


def words(text: str = "text") -> Column:
    """Tokens of a text: runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch's seeded order: the MD5 of seed, epoch and id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


@dataclass(frozen=True)
class Plan:
    """``leaves``: per leaf its levels l0, l1, ..., rows, tokens, budget, full (whole epochs), rest (tokens of
    the epoch after them), and the last document of that epoch's prefix: cut_key, cut_take."""

    leaves: DataFrame
    levels: Sequence[Column]
    seed: int


def allocate(leaves: DataFrame, depth: int, weights: Sequence[dict[str, int]], budget: DataFrame) -> DataFrame:
    """Adds ``budget`` to ``leaves(l0, ..., cap)``: the one-row frame's ``budget`` goes down the tree level
    by level. Siblings share by integer weight (1 unless named; 0 takes nothing), none beyond the capacity of
    its subtree; what a full node can't take goes to its siblings, and only what all of them can't take was
    withheld from their parent before, so that the parent's siblings have it. Shares are rounded down.

    Siblings are full in the order of capacity over weight: node i is full if its capacity is at most its
    share of what the nodes before it leave. All arithmetic is on integers.
    """
    given = budget.select(F.col("budget").cast("long").alias("given"))
    keys: list[str] = []
    for k in range(depth):
        parents, keys = list(keys), [*keys, f"l{k}"]
        pairs = [F.lit(x) for kv in weights[k].items() for x in (kv[0], int(kv[1]))] if weights[k] else []
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col(f"l{k}")), F.lit(1)) if pairs else F.lit(1)
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", weight.cast("long")).where("w > 0 and cap > 0")
        nodes = nodes.join(given, parents) if parents else nodes.crossJoin(F.broadcast(given))  # one row
        side = Window.partitionBy(*parents)
        line = side.orderBy(F.col("cap") / F.col("w"), F.col(f"l{k}"))
        nodes = nodes.withColumn("before", F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.sum("w").over(line.rowsBetween(0, Window.unboundedFollowing)))
        left = (F.col("given") - F.coalesce("before", F.lit(0))).cast(BIG)
        nodes = nodes.withColumn("full", F.col("cap").cast(BIG) * F.col("after").cast(BIG) <= F.col("w").cast(BIG) * left)
        nodes = nodes.withColumn("taken", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(side), F.lit(0))).withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(side))
        share = F.expr(f"cast(cast(w as {BIG}) * cast(given - taken as {BIG}) div open as bigint)")
        given = nodes.select(*keys, F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(share, F.lit(0))).alias("given"))
    return leaves.join(given, keys, "left").withColumn("budget", F.coalesce("given", F.lit(0))).drop("given")


def _keyed(levels: Sequence[Column]) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit(MISSING)).alias(f"l{i}") for i, c in enumerate(levels)]


def plan(docs: DataFrame, levels: Sequence[Column], weights: Sequence[dict[str, int]], *, share: float = 1.0, max_epochs: int = 1, seed: int = 1) -> Plan:
    """Budgets ``share`` of all tokens over the leaves, each able to give ``max_epochs`` times its tokens, and
    finds where each leaf's last epoch stops.

    Texts are read once, for their token counts. A leaf's documents fall into as many hash ranges as the
    root of their number; running sums of the ranges find the one range in which the budget ends, and only
    its documents are put in order. So no leaf, however large, is sorted by one task.

    Null texts have no tokens, null levels are leaves of their own, null ids are one document in the order.
    Rows that repeat an id count each, and fall into the same place. Very long texts are counted whole. Leaves of
    the same capacity by weight stand in alphabetical order; documents of the same key can't be told apart. Other
    columns are ignored. An empty table gives no leaves.
    """
    keys = [f"l{i}" for i in range(len(levels))]
    thin = write_cut(docs.select("doc_id", *_keyed(levels), words().alias("n")), "mix-documents")
    leaves = write_cut(thin.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs), "mix-leaves")
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).alias("budget"))
    budgets = allocate(leaves, len(levels), weights, total)
    full = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    budgets = write_cut(budgets.withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")), "mix-budgets")
    some = budgets.where("rest > 0").select(*keys, "full", "rest", F.ceil(F.sqrt("rows")).alias("ranges"))
    placed = thin.join(some, keys).withColumn("key", order_key(seed, F.col("full"), F.col("doc_id")))
    placed = placed.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32)))
    sums = placed.groupBy(*keys, "range").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    run = F.sum("n").over(Window.partitionBy(*keys).orderBy("range"))
    ends = write_cut(sums.withColumn("before", run - F.col("n")).where("before < rest and before + n >= rest").select(*keys, "range", "before"), "mix-ranges")
    inside = placed.join(ends, [*keys, "range"]).groupBy(*keys, "range", "key", "before", "rest").agg(F.sum("n").alias("n"))
    start = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "range").orderBy("key")) - F.col("n")
    cuts = inside.withColumn("start", start).where("start < rest").groupBy(*keys).agg(F.max(F.struct("key", (F.col("rest") - F.col("start")).alias("take"))).alias("m"))
    cuts = cuts.select(*keys, F.col("m.key").alias("cut_key"), F.col("m.take").alias("cut_take"))
    return Plan(write_cut(budgets.drop("cap").join(cuts, keys, "left"), "mix-plan"), levels, seed)


def select(docs: DataFrame, p: Plan) -> DataFrame:
    """The rows of ``docs`` once for each epoch that takes them, with all columns, and ``epoch``, ``n_tokens``
    and ``take_tokens`` (below n_tokens for the document in which a leaf's budget ends) as columns of those
    names, or with underscores before them where docs has such columns.

    Each row decides by itself from its leaf's row of the plan: no text is shuffled unless the plan is too
    large to broadcast. Documents without tokens come along in whole epochs and inside a prefix. Null levels
    are leaves of their own. Rows that repeat an id stand or fall together. Very long texts are taken whole, as
    ``take_tokens`` says how much of one counts. An empty table gives no rows.
    """
    keys = [f"l{i}" for i in range(len(p.levels))]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    plan_row = p.leaves.select(*keys, "full", "rest", "cut_key", "cut_take")
    both = docs.select(row, F.col("doc_id").alias("id"), words().alias("n"), *_keyed(p.levels)).join(plan_row, keys)
    key = order_key(p.seed, F.col("full"), F.col("id"))
    last = F.when((F.col("rest") > 0) & (key <= F.col("cut_key")), F.when(key == F.col("cut_key"), F.least("n", "cut_take")).otherwise(F.col("n")))
    both = both.withColumn("last", last).withColumn("times", F.col("full") + F.col("last").isNotNull().cast("int"))
    both = both.where("times > 0").withColumn("epoch", F.explode(F.expr("sequence(0, cast(times - 1 as int))")))
    names = []
    for name in ("epoch", "n_tokens", "take_tokens"):
        while name in docs.columns:
            name = f"_{name}"
        names.append(name)
    take = F.when(F.col("epoch") < F.col("full"), F.col("n")).otherwise(F.col("last"))
    return both.select("row.*", F.col("epoch").alias(names[0]), F.col("n").alias(names[1]), take.alias(names[2]))


#: What the query and the pipeline ask for: domains of the synthetic sources, and weights by level.
DOMAINS = {"web": range(5), "forum": range(5, 10), "books": range(10, 15), "papers": range(15, 20)}
WEIGHTS = ({"web": 4, "books": 3, "forum": 2, "papers": 1}, {"en": 4, "de": 2, "fr": 2, "es": 2}, {})


def domain(source: str = "source") -> Column:
    out = F.when(F.lit(False), "")
    for name, numbers in DOMAINS.items():
        out = out.when(F.col(source).isin([f"src{i}" for i in numbers]), name)
    return out.otherwise("other")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    levels = (domain(), F.col("lang"), F.col("source"))
    p = plan(docs, levels, WEIGHTS, share=0.6, max_epochs=3, seed=10)
    return select(docs, p).select("doc_id", domain().alias("domain"), "lang", "source", "n_tokens", "epoch", "take_tokens")


def _oracle() -> str:
    cases = " ".join(f"when source in ({', '.join(repr(f'src{i}') for i in numbers)}) then '{name}'" for name, numbers in DOMAINS.items())
    weight = lambda k: "case " + " ".join(f"when l{k} = '{v}' then {w}" for v, w in WEIGHTS[k].items()) + " else 1 end" if WEIGHTS[k] else "1"
    levels = []
    for k in range(3):
        keys, parents = ", ".join(f"l{i}" for i in range(k + 1)), ", ".join(f"l{i}" for i in range(k))
        over = f"partition by {parents}" if parents else ""
        given = f"join g{k - 1} using ({parents})" if k else "cross join total"
        levels.append(f"""
n{k} as (select {keys}, sum(cap)::bigint as cap, ({weight(k)})::bigint as w from leaves group by {keys}),
a{k} as (select n{k}.*, given, coalesce(sum(cap) over ({over} order by cap / w, l{k} rows between unbounded preceding and 1 preceding), 0) as before,
  sum(w) over ({over} order by cap / w, l{k} rows between current row and unbounded following) as after from n{k} {given} where w > 0 and cap > 0),
b{k} as (select *, cap::hugeint * after <= w::hugeint * (given - before) as is_full from a{k}),
c{k} as (select *, coalesce(sum(case when is_full then cap end) over ({over}), 0) as taken, sum(case when not is_full then w end) over ({over}) as open from b{k}),
g{k} as (select {keys}, (case when is_full then cap else greatest((w::hugeint * (given - taken)::hugeint) // open::hugeint, 0) end)::bigint as given from c{k}),""")
    return f"""
with d as (select doc_id, case {cases} else 'other' end as domain, lang, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n from documents),
k as (select *, coalesce(domain, chr(1)) as l0, coalesce(lang, chr(1)) as l1, coalesce(source, chr(1)) as l2 from d),
leaves as (select l0, l1, l2, sum(n)::bigint as tokens, (sum(n) * 3)::bigint as cap from k group by all),
total as (select floor(coalesce(sum(tokens), 0)::double * 0.6)::bigint as given from leaves),
{''.join(levels)}
plan as (select l0, l1, l2, tokens, coalesce(given, 0) as budget, case when tokens > 0 then coalesce(given, 0) // tokens else 0 end as whole from leaves left join g2 using (l0, l1, l2)),
o as (select k.*, whole, budget - whole * tokens as rest, md5(concat_ws('|', '10', whole::varchar, coalesce(doc_id::varchar, 'null'))) as key from k join plan using (l0, l1, l2)),
s as (select *, sum(n) over (partition by l0, l1, l2 order by key range between unbounded preceding and current row) - sum(n) over (partition by l0, l1, l2, key) as start from o),
t as (select *, rest > 0 and start < rest as in_last from s),
e as (select *, unnest(range(0, (whole + in_last::bigint)::bigint)) as epoch from t)
select doc_id, domain, lang, source, n as n_tokens, epoch::int as epoch, (case when epoch < whole then n else least(n, rest - start) end)::bigint as take_tokens from e"""


OP10_SQL = _oracle()
