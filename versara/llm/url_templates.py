"""URL filters: rules by host and path, and a path-template tree judged by labelled purity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_cuts, table, write_cut

ALLOW, BLOCK = "allow", "block"
ANY = "*"


@dataclass(frozen=True)
class Rule:
    """``text`` like ``example.net/en/``: the host before the first slash, the path from it on."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


@dataclass(frozen=True)
class Settings:
    """``children``: a node with more literal children than this is variable. ``rare``: so is one whose
    children have fewer pages on average. ``z``: branches merge if their shares of blocked labels differ by less
    than so many standard errors. ``prior``: labels' worth of the node above in a node's smoothed share.
    ``reject``: the smoothed share from which a template is blocked. ``agreed``: a branch also ends where its
    labels agree or there are none, so a template there can hold branches that have labels and some that have
    none; ``WHOLE``, which is taken where no settings are given, grows those too."""

    children: int = 24
    rare: float = 3.0
    z: float = 1.96
    prior: float = 4.0
    reject: float = 0.5
    agreed: bool = True


WHOLE = Settings(agreed=False)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule], what: str) -> Column:
    """The text or verdict of the longest rule that fits: its host is the url's or a parent of it, its path
    a start of the url's. Null if none fits."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, what))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """A segment's form: runs of digits, and of 8 or more hex digits that hold a digit, stand as ``{n}`` and
    ``{x}``, so that numbered pages are one child."""
    hexed = F.regexp_replace(segment, r"(?i)(?<![0-9a-z])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?:-[0-9a-f]{4,})*(?![0-9a-z])", "{x}")
    return F.regexp_replace(hexed, r"[0-9]+", "{n}")


def segments(path: Column) -> Column:
    """The shapes of all of a path's segments."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), shape)


def branches(children: Column, s: Settings) -> Column:
    """Branches ``(deep, b, l, segs)`` from a node's children ``(deep, p, seg, b, l)`` in order. Each child joins
    the branch before it if both go equally deep, both have labels or neither has, and a two-proportion test
    can't tell the child's labels from all of that branch's."""

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        pooled = (last["b"] + x["b"] + 1) / (last["l"] + x["l"] + 2)
        error = F.sqrt(pooled * (1 - pooled) * (1 / (last["l"] + 1) + 1 / (x["l"] + 1)))
        near = F.abs((last["b"] + 0.5) / (last["l"] + 1) - (x["b"] + 0.5) / (x["l"] + 1)) < s.z * error
        joins = F.coalesce((last["deep"] == x["deep"]) & ((last["l"] == 0) == (x["l"] == 0)) & near, F.lit(False))
        grown = F.struct(x["deep"].alias("deep"), (last["b"] + x["b"]).alias("b"), (last["l"] + x["l"]).alias("l"), F.concat(last["segs"], F.array(x["seg"])).alias("segs"))
        alone = F.struct(x["deep"].alias("deep"), x["b"].alias("b"), x["l"].alias("l"), F.array(x["seg"]).alias("segs"))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(alone)))

    none = F.array().cast("array<struct<deep:int,b:bigint,l:bigint,segs:array<string>>>")
    return F.aggregate(children, none, step)


def walk(rows: DataFrame, s: Settings) -> DataFrame:
    """``rows(host, segs, n, blocked, labelled, at, k, above)`` at the next node where their paths part or end, ``k``
    segments down, with its ``share`` and whether they go on below it (``goes``)."""
    tail = F.slice("segs", F.col("k") + 1, F.size("segs"))
    nodes = rows.groupBy("host", "at", "k").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"), F.count(F.lit(1)).alias("shapes"), F.first("above").alias("above"), F.min(tail).alias("lo"), F.max(tail).alias("hi"))
    opens = F.col("shapes") > 1
    if s.agreed:
        opens = opens & (F.col("b") > 0) & (F.col("b") < F.col("l"))
    # what the first and the last of the tails share at the start, all of them share
    parts = F.array_position(F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    nodes = nodes.withColumn("opens", opens).withColumn("run", F.when(~F.col("opens"), 0).when(parts > 0, parts - 1).otherwise(F.size("lo")).cast("int"))
    # each segment on the way draws the share towards that of the labels themselves by one more factor
    once, weight, bare = (F.col("b") + s.prior * F.col("above")) / (F.col("l") + s.prior), s.prior / (F.col("l") + s.prior), F.col("b") / F.greatest("l", F.lit(1))
    share = F.when(F.col("run") > 0, bare + (once - bare) * F.pow(weight, F.col("run"))).otherwise(once)
    way = F.array_join(F.transform(F.slice("lo", F.lit(1), F.col("run")), lambda x: F.concat(F.lit("/"), x)), "")
    nodes = nodes.select("host", "at", "k", "opens", "run", way.alias("way"), share.alias("share"))
    at = rows.drop("above").join(nodes, ["host", "at", "k"]).withColumn("at", F.concat("at", "way")).withColumn("k", F.col("k") + F.col("run"))
    return at.select("host", "segs", "n", "blocked", "labelled", "at", "k", "share", (F.col("opens") & (F.size("segs") > F.col("k"))).alias("goes"))


def grow(urls: DataFrame, s: Settings) -> DataFrame:
    """From ``urls(host, segs, n, blocked, labelled)``, one row per host and shape with its counts: the same with
    ``template`` and ``share``, the smoothed share of blocked labels at the template's node.

    Step by step, over all hosts at once. A branch ends at the end of its paths and where it has one shape only;
    with ``agreed`` also where all of its labels agree or there are none. What lies below is one wildcard (``*``
    for a segment, ``**`` for more). In other nodes children are counted; where they are many or rare they
    become one wildcard; those left (at most ``children`` in a node) are merged into ``branches``.
    A node's share counts ``prior`` labels of the share above it; above a host is the share of all labels, and
    that has one half above it. Segments that all shapes of a node go through are nodes with one child each;
    they are walked in one step (``walk``), so steps are as many as the places one below another where paths part
    or end (each takes a few small jobs), not as segments.
    A node's name is its template; the host's own is empty.
    """
    top = urls.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).select(((F.coalesce("b", F.lit(0)) + s.prior / 2) / (F.coalesce("l", F.lit(0)) + s.prior)).alias("above"))
    rows = write_cut(urls.withColumn("at", F.lit("")).withColumn("k", F.lit(0)).crossJoin(F.broadcast(top)), "url-rows")  # top is one row
    ended = []
    while True:
        here = write_cut(walk(rows, s), "url-level")
        drop_cuts(rows)
        left = F.size("segs") - F.col("k")
        below = F.when(left <= 0, "").when(left == 1, f"/{ANY}").otherwise(f"/{ANY}{ANY}")
        ended.append(here.where("not goes").select("host", "segs", F.concat("at", below).alias("template"), "share"))
        going = here.where("goes").select("host", "segs", "n", "blocked", "labelled", "at", "k", F.col("share").alias("above"), F.get("segs", F.col("k")).alias("seg"))
        if not going.head(1):
            break
        kids = going.groupBy("host", "at", "seg").agg(F.sum("n").alias("n"), F.sum("blocked").alias("b"), F.sum("labelled").alias("l"), F.max(F.size("segs")).alias("deep"))
        kids = write_cut(kids, "url-children")
        # a wildcard needs no list of its children, so counting them is an aggregate of its own
        size = kids.groupBy("host", "at").agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("total"))
        wide = (F.col("kids") > s.children) | (F.col("kids") > 1) & (F.col("total") / F.col("kids") < s.rare)
        size = write_cut(size.select("host", "at", wide.alias("wide")), "url-sizes")
        child = F.struct("deep", ((F.col("b") + 0.5) / (F.col("l") + 1)).alias("p"), "seg", "b", "l")
        few = kids.join(size.where("not wide"), ["host", "at"]).groupBy("host", "at").agg(F.array_sort(F.collect_list(child)).alias("children"))
        few = few.select("host", "at", F.explode(branches(F.col("children"), s)["segs"]).alias("segs"))
        name = F.when(F.size("segs") > 1, F.concat(F.lit("("), F.array_join(F.array_sort("segs"), "|"), F.lit(")"))).otherwise(F.element_at("segs", 1))
        own = write_cut(few.select("host", "at", F.concat("at", F.lit("/"), name).alias("to"), F.explode("segs").alias("seg")), "url-steps")
        moved = going.join(size, ["host", "at"]).join(own, ["host", "at", "seg"], "left")
        moved = moved.withColumn("at", F.when(F.col("wide"), F.concat("at", F.lit(f"/{ANY}"))).otherwise(F.col("to"))).withColumn("k", F.col("k") + 1)
        rows = write_cut(moved.select("host", "segs", "n", "blocked", "labelled", "at", "k", "above"), "url-rows")
        drop_cuts(kids, size, own)
    out = ended[0]
    for x in ended[1:]:
        out = out.unionByName(x)
    return out


def judge(pages: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", settings: Settings | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, share)`` for every row.

    The urls that a rule fits are the labels; the tree learns from them and judges the rest: a url is blocked
    if the smoothed share of blocked labels at its template is ``reject`` or more. Urls are counted by host
    and shape before anything else is shuffled, and the tree is built on these counts, so a host with a
    third of all pages is as cheap as any; pages meet their template by host and shape, in a join that Spark
    can split.

    Null urls and urls without ``://``: empty host and path, no rule, and the verdict of the empty host's
    template. Paths are taken to their ends, however long the url. Of rules of one length the last in
    alphabetical order is taken; a share of exactly ``reject`` blocks; children of one share are merged in
    alphabetical order. Null ids stay null, repeated rows come back as often, other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    s = settings or WHOLE
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    base = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, "text")).withColumn("said", rule_of(F.col("host"), F.col("path"), rules, "verdict")).withColumn("segs", segments(F.col("path")))
    counts = base.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("said") == BLOCK).cast("long")).alias("b"), F.count("said").alias("labelled"))
    counts = write_cut(counts.select("host", "segs", "n", F.coalesce("b", F.lit(0)).alias("blocked"), "labelled"), "url-counts")
    templates = write_cut(grow(counts, s), "url-templates")
    verdict = F.coalesce("said", F.when(F.col("share") >= s.reject, F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return base.join(templates, ["host", "segs"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "share")


RULES = (Rule("net/", BLOCK), Rule("example.net/en/", ALLOW), Rule("example.com/de/", BLOCK), Rule("org/fr/", ALLOW))


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)
