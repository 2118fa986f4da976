import hashlib
from collections import defaultdict

import duckdb
import pytest
from cases import awkward, empty
from pyspark.sql import functions as F

from versara.llm import mixing, sharding
from versara.llm.common import table


def levels():
    return mixing.domain(), F.col("lang"), F.col("source")


def share_out(budget, nodes):
    """Brute force on {name: (cap, weight)}: fill whoever is full at the current rate, then go on."""
    given, open_ = {}, {n: cw for n, cw in nodes.items() if cw[0] > 0 and cw[1] > 0}
    for n, (cap, w) in sorted(open_.items(), key=lambda x: (x[1][0] / x[1][1], x[0])):
        rest = {k: v for k, v in open_.items() if k not in given}
        left, weights = budget - sum(given.values()), sum(v[1] for v in rest.values())
        if cap * weights <= w * left:
            given[n] = cap
        else:
            given |= {k: max(0, v[1] * left // weights) for k, v in rest.items()}
            break
    return given


def brute(rows, share, epochs, seed, weights):
    """rows: (doc_id, path, tokens). Returns [(doc_id, epoch, take)]."""
    leaves = defaultdict(int)
    for _, path, n in rows:
        leaves[path] += n
    caps = defaultdict(int)
    for path, n in leaves.items():
        for k in range(len(path) + 1):
            caps[path[:k]] += n * epochs
    budgets = {(): int(sum(leaves.values()) * share)}
    for k in range(3):
        for parent in {p[:k] for p in leaves if p[:k] in budgets}:
            kids = {p[: k + 1] for p in leaves if p[:k] == parent}
            budgets |= share_out(budgets[parent], {c: (caps[c], weights[k].get(c[-1], 1)) for c in kids})
    out = []
    for path, total in leaves.items():
        budget = budgets.get(path, 0)
        full, rest = divmod(budget, total) if total else (0, 0)
        mine = [(d, n) for d, p, n in rows if p == path]
        out += [(d, e, n) for d, n in mine for e in range(full)]
        at = 0
        for d, n in sorted(mine, key=lambda x: hashlib.md5(f"{seed}|{full}|{x[0]}".encode()).hexdigest()):
            if at < rest:
                out.append((d, full, min(n, rest - at)))
            at += n
    return sorted(out)


@pytest.mark.parametrize(("share", "epochs"), [(0.6, 3), (0.9, 1), (1.7, 2), (0.0, 1), (5.0, 2)])
def test_against_brute_force(spark, sf, share, epochs):
    docs = table(spark, sf, "documents")
    got = mixing.select(docs, mixing.plan(docs, levels(), mixing.WEIGHTS, share=share, max_epochs=epochs, seed=3))
    rows = [(r.doc_id, (r.d, r.lang, r.source), len((r.text or "").split())) for r in docs.withColumn("d", mixing.domain()).collect()]
    assert sorted((r.doc_id, r.epoch, r.take_tokens) for r in got.collect()) == brute(rows, share, epochs, 3, mixing.WEIGHTS)


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 1000), ("b", "x", "1", 1000)]
    leaves = spark.createDataFrame(rows, "l0 string, l1 string, l2 string, cap long")
    got = mixing.allocate(leaves, 3, ({}, {}, {}), spark.createDataFrame([(800,)], "budget long"))
    assert {(r.l0, r.l1, r.l2): r.budget for r in got.collect()} == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("a", "y", "1"): 200, ("b", "x", "1"): 400}


@pytest.mark.parametrize("name", ["op7_sharding", "op10_mixing"])
def test_queries_against_sql(spark, sf, name):
    from versara.llm.catalog import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = QUERIES[name](spark, sf)
    assert sorted(rows.columns) == sorted(names)
    assert sorted(map(str, map(tuple, rows.select(names).collect()))) == sorted(map(str, want.fetchall()))
    assert sharding.tiers(1 << 18, 1 << 25, 4)[-1] == (1 << 23, 1 << 25)


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("epoch", F.lit("mine"))
    p = mixing.plan(docs, (F.col("lang"), F.col("source")), ({}, {}), share=1.0, max_epochs=1)
    got = mixing.select(docs, p)
    assert got.columns == [*docs.columns, "_epoch", "n_tokens", "take_tokens"]
    kept = got.collect()
    assert {r.epoch for r in kept} == {"mine"} and {1, 2, 6, 7, 8, None} <= {r.doc_id for r in kept}
    assert sum(r.take_tokens for r in kept) == docs.select(F.sum(mixing.words())).first()[0]
    assert mixing.select(empty(spark), mixing.plan(empty(spark), (F.col("lang"),), ({},))).collect() == []
