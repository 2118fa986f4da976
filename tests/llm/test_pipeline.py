from cases import awkward, empty
from pyspark.sql import functions as F
from test_packing import check
from test_shingles import least

import corpus_pipeline
from versara.llm import langid, mixing
from versara.llm.common import table, write_cut


def test_stages_in_order_and_by_brute_force(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "mixing", "packing"]
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame([(10**6, "12 34 !!", "en", "src1", 8), (10**6 + 1, None, None, None, None), (10**6 + 2, "日本語日本語日本語", None, "src2", 9)], docs.schema)
    start = write_cut(docs.unionByName(odd), "test")
    first = write_cut(corpus_pipeline.language_stage(spark, start, sf), "test")
    before = {r.doc_id: r for r in start.collect()}
    one = {r.doc_id: r for r in first.collect()}
    assert first.columns == docs.columns and not {10**6, 10**6 + 1} & one.keys()
    assert all(one[i] == before[i] for i in one) and len(one) >= len(before) - 4
    second = write_cut(corpus_pipeline.dedup_stage(spark, first, sf), "test")
    two = {r.doc_id: r for r in second.collect()}
    want = least([(i, r.text) for i, r in one.items()])  # every pair by five-word Jaccard
    assert second.columns == docs.columns and two.keys() == set(want.values())
    third = write_cut(corpus_pipeline.mixing_stage(spark, second, sf), "test")
    three = {r.doc_id: r for r in third.collect()}
    size = lambda rows: sum(len((r.text or "").split()) for r in rows.values())
    assert third.columns == docs.columns and third.count() == len(three) and three.keys() <= two.keys()
    assert 0.5 * size(two) - 20 * 4 < size(three) <= 0.5 * size(two) + size({r.doc_id: r for r in sorted(two.values(), key=lambda r: -(r.n_chars or 0))[:40]})
    check(corpus_pipeline.packing_stage(spark, third, sf).collect(), [(i, r.text) for i, r in three.items()])


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    kept = {r.doc_id for r in rows}
    model = langid.train(table(spark, sf, "documents"))
    assert kept and not kept & {r.doc_id for r in langid.predict(table(spark, sf, "documents"), model).where("rejected").collect()}
    assert {sum(r.length for r in rows if r.doc_id == i) == next(r.doc_tokens for r in rows if r.doc_id == i) for i in list(kept)[:20]} == {True}


def test_mixing_stage_keeps_to_its_weights(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = mixing.select(docs, mixing.plan(docs, (mixing.domain(), docs.lang, docs.source), mixing.WEIGHTS, share=0.5, max_epochs=1, seed=10))
    taken = {r.d: r.n for r in got.groupBy(mixing.domain().alias("d")).agg(F.sum("take_tokens").alias("n")).collect()}
    want = {"web": 0.4, "books": 0.3, "forum": 0.2, "papers": 0.1}
    rest = {d: n / sum(taken.values()) for d, n in taken.items() if d in want}
    assert all(abs(rest[d] / sum(rest.values()) - want[d]) < 0.02 for d in want)
    whole = corpus_pipeline.mixing_stage(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in whole.collect())


def test_awkward_tables(spark, tmp_path):
    """Every stage on nulls, copies, long texts and clashing names, and on nothing."""
    for docs in (awkward(spark), empty(spark)):
        rows = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = write_cut(stage(spark, docs, ""), "awkward")
            assert name == "packing" or out.columns == docs.columns and out.count() <= rows
            assert rows or out.count() == 0
    docs = awkward(spark).unionByName(awkward(spark))
    kept = write_cut(corpus_pipeline.dedup_stage(spark, docs, ""), "awkward")
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 5, 6, 7, 8]
    for name, some in (("some", docs), ("none", empty(spark))):
        some.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in got} <= {1, 2, 6, 7, 8, None} and bool(got) == (name == "some")
