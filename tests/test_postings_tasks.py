"""What one task of the postings' encoding holds doesn't grow with the input, and the lists stay whole."""

from pyspark.sql import functions as F

from versara import queries
from versara.operators import index


def corpora(spark, sf, tmp_path, monkeypatch):
    """The documents once and four times, with shifted keys."""
    monkeypatch.setattr(index, "SHARE", 1 << 15, raising=False)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for n in (1, 4):
        for i in range(n):  # a file each: in one, the copies' texts would be written once
            docs.withColumn("doc_id", F.col("doc_id") + 10_000 * i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{n}/documents.parquet")
    return [f"{tmp_path}/{n}" for n in (1, 4)]


def most(spark, name, path, rows=None):
    """Rows (or what stands for them) of the largest task, and of all."""
    rows = F.count(F.lit(1)) if rows is None else rows
    n = [r.n for r in queries.QUERIES[name](spark, path).groupBy(F.spark_partition_id()).agg(rows.alias("n")).collect()]
    return max(n), sum(n)


def test_roundtrip_tasks_stay_small(spark, sf, tmp_path, monkeypatch):
    (small, few), (large, many) = (most(spark, "postings_delta_roundtrip", p) for p in corpora(spark, sf, tmp_path, monkeypatch))
    assert many == 4 * few and large < 1.5 * small


def test_documents_without_a_number_stay(spark):
    entries = spark.createDataFrame([("en", "a", 70_000), ("en", "a", None), ("en", "a", 3), (None, "a", None)], "edition string, token string, doc long")
    encoded = index.deltas(entries)
    assert sorted([tuple(r) for r in encoded.select("pos", "doc", "delta").where("edition = 'en'").collect()]) == [(1, 3, 3), (2, 70_000, 69_997), (3, None, None)]
    assert {(r.edition, r.doc) for r in index.undelta(encoded).collect()} == {("en", 3), ("en", 70_000), ("en", None), (None, None)}


def test_encoding_tasks_stay_small(spark, sf, tmp_path, monkeypatch):
    (small, few), (large, many) = (most(spark, "postings_delta_encode", p) for p in corpora(spark, sf, tmp_path, monkeypatch))
    assert many == 4 * few and large < 1.5 * small


def test_base36_tasks_stay_small(spark, sf, tmp_path, monkeypatch):
    places = F.sum(F.size(F.split("encoded", " ")))
    (small, few), (large, many) = (most(spark, "postings_base36", p, places) for p in corpora(spark, sf, tmp_path, monkeypatch))
    assert many == 4 * few and large < 1.5 * small
