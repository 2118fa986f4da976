from pyspark.sql import functions as F

from versara import queries
from versara.operators import index


def by_list(rows):
    out = {}
    for r in rows:
        out.setdefault((r.edition, r.token), []).append(r)
    return out


def test_every_edition_is_encoded(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = F.when(F.col("doc_id") % 7 != 0, F.col("lang"))
    docs.withColumn("lang", lang).write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    want = {k: sorted(r.doc for r in v) for k, v in by_list(run("postings")).items()}
    assert {e for e, _ in want} == {None, "en", "de", "fr", "es"}
    steps = {k: [b - a for a, b in zip([0, *v], v)] for k, v in want.items()}
    encoded = by_list(run("postings_delta_encode"))
    assert {k: [(r.pos, r.delta) for r in sorted(v, key=lambda r: r.pos)] for k, v in encoded.items()} == {k: list(enumerate(v, 1)) for k, v in steps.items()}
    assert {k: sorted(r.doc for r in v) for k, v in by_list(run("postings_delta_roundtrip")).items()} == want
    lists = by_list(run("postings_base36"))
    assert {k: [int(d, 36) for r in sorted(v, key=lambda r: r.segment) for d in r.encoded.split()] for k, v in lists.items()} == steps


def test_null_edition_over_blocks(spark):
    docs = [1, 2, index.BLOCK, 3 * index.BLOCK + 5]
    entries = spark.createDataFrame([(None, "a", d) for d in docs] + [("en", "a", 7)], "edition string, token string, doc long")
    back = index.undelta(index.deltas(entries)).collect()
    assert sorted(r.doc for r in back if r.edition is None) == docs and [r.doc for r in back if r.edition] == [7]
