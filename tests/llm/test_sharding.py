import pytest
from cases import awkward, empty
from pyspark.sql import functions as F

from versara.llm.common import table, table_path
from versara.llm.sharding import Store, compact_plan, compacted, op7_sharding, text_bytes, tiers


def simulate(sizes, base, target, fan_in):
    """Brute force on [(first, bytes)]: the same rule, shard by shard."""
    shards = [([f], b) for f, b in sizes]
    for low, high in tiers(base, target, fan_in):
        here = sorted(s for s in shards if low <= s[1] < high)
        rest = [s for s in shards if not low <= s[1] < high]
        runs, run, before = [], [], 0
        for s in here:
            if high < target:
                run.append(s)
                if len(run) == fan_in:
                    runs.append(run)
                    run = []
            else:
                if run and before // high != (before - run[-1][1]) // high:
                    runs.append(run)
                    run = []
                run.append(s)
                before += s[1]
        shards = rest + [(sum((x[0] for x in r), []), sum(x[1] for x in r)) for r in runs] + run
    return sorted((min(m), max(m), b, len(m)) for m, b in shards)


def test_plan_against_brute_force(spark):
    import random

    rng = random.Random(2)
    sizes = [(i, rng.choice([20, 30, 90, 400, 1500, 9000]) + rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame([(f, f, b, 1, [f]) for f, b in sizes], "first long, last long, bytes long, docs long, members array<long>")
    got = compact_plan(df, base=16, target=4096, fan_in=4)
    assert sorted((r.first, r.last, r.bytes, r.docs) for r in got.select(F.col("first"), "last", "bytes", "docs").toLocalIterator()) == simulate(sizes, 16, 4096, 4)
    assert sum(r.bytes < 1024 for r in got.toLocalIterator()) <= 3 * 4


def test_every_document_once_and_in_its_shard(spark, sf):
    docs = table(spark, sf, "documents")
    rows = op7_sharding(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.shard_first <= r.arrival <= r.shard_last for r in rows)


def test_versions_appends_and_conflicts(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 50 as int))").alias("text"), F.lit(7).alias("shard"), F.lit("v").alias("arrival"))
    store = Store(spark, table_path(spark, "t"))
    assert store.version() == 0 and store.read() is None
    store.append(docs.where("doc_id < 2000"), F.floor(F.col("doc_id") / 50), text_bytes())
    store.append(docs.where("doc_id >= 2000"), F.floor(F.col("doc_id") / 50), text_bytes())
    assert store.version() == 2 and store.manifest().count() == 80
    store.compact(base=500, target=20_000)
    assert store.version() == 3 and store.manifest().count() < 20
    back = store.read().select("row.*")
    assert back.columns == docs.columns and back.exceptAll(docs).count() == 0 and back.count() == 4000
    store.compact(base=500, target=20_000)
    assert store.read().count() == 4000
    assert store.read(2).count() == 4000 and store.read(1).count() == 2000  # old versions stay readable
    assert store.vacuum(keep_versions=1) == [] and store.read(2).count() == 4000  # too young
    assert 1 in store.vacuum(keep_versions=1, older_than=0) and store.versions() == [store.version()]
    assert store.read().count() == 4000


def test_of_two_writers_one_commits(spark):
    """Both saw the same newest version; the second is refused, its rows aren't live, and nothing is lost."""
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    root = table_path(spark, "race")
    one, two = Store(spark, root), Store(spark, root)
    two.version = lambda: 0
    one.append(docs.where("doc_id < 50"), F.col("doc_id"), text_bytes())
    before = sorted(r.row.doc_id for r in one.read().collect())
    with pytest.raises(RuntimeError, match="version 1"):
        two.commit(two.spark.createDataFrame([(7, 7, 1, 1, 1)], Store.SCHEMA), 1)
    assert sorted(r.row.doc_id for r in one.read().collect()) == before == list(range(50))
    assert one.versions() == [1]


def test_one_file_an_arrival_and_large_ones_spread(spark):
    """Ids dealt by hash over many partitions: still one file a small shard; a hot arrival has several."""
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', 100)").alias("text")).repartition(32, "doc_id")
    store = Store(spark, table_path(spark, "files"), task_bytes=20_000)
    store.append(docs, F.when(F.col("doc_id") >= 500, F.floor(F.col("doc_id") / 50)), text_bytes())
    files = [f.rsplit("/", 2)[1] for f in spark.read.parquet(f"{store.root}/data/version=1").inputFiles()]
    assert {n: files.count(n) for n in set(files) if n != "shard=-1"} == {f"shard={i}": 1 for i in range(10, 20)}
    assert files.count("shard=-1") > 1
    assert store.manifest().where("first = -1").first().docs == 500


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = compacted(docs).collect()
    assert len(got) == docs.count()
    assert {r.arrival for r in got} == {-1, 0}
    assert compacted(empty(spark)).collect() == []
