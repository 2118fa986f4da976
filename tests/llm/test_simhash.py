import random

import xxhash
from cases import awkward, empty
from pyspark.sql import functions as F

from versara.llm.common import table
from versara.llm.graph import connected_components
from versara.llm.simhash import embedding, fingerprint, links, near_duplicates, op8_simhash
from versara.llm.shingles import one_of_each


def slow_fingerprint(text):
    words, word = [], []
    for b in (text or "").encode():
        if b == 0x20 or 9 <= b <= 13:
            words, word = (words + [bytes(word)] if word else words), []
        else:
            word.append(b + 32 if 65 <= b <= 90 else b)
    words += [bytes(word)] if word else []
    if not words:
        return 0
    h = [xxhash.xxh64(b" ".join(words[i : i + 3]), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def classes(pairs, distance=2):
    """Brute force: {id: smallest id reachable} for [(id, fp)]."""
    up = {i: i for i, _ in pairs}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in pairs:
        for j, b in pairs:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= distance:
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: find(i) for i, _ in pairs}


def test_whole_table_against_brute_force(spark, sf):
    docs = [(r.doc_id, slow_fingerprint(r.text)) for r in table(spark, sf, "documents").collect()]
    rows = op8_simhash(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{f:016x}" for d, f in docs}
    assert {r.doc_id: r.component_id for r in rows} == classes(docs)


def test_links_with_and_without_full_cells(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    fps = {s for s in seeds} | {seeds[i % 5] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.4) << 7 for i in range(300)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = classes([(f, f) for f in signed])
    want = {frozenset(k for k in want if want[k] == v) for v in want.values()}
    for limit in (1000, 4):
        got = {r.node: r.root for r in connected_components(links(df, cell_limit=limit)).collect()}
        got |= {f: f for f in signed if f not in got}
        assert {frozenset(k for k in got if got[k] == v) for v in got.values()} == want


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(1)
    rows = [(a, a ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62))) for a in (rng.getrandbits(62) for _ in range(200))]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select(F.bit_count(embedding(F.col("a")).bitwiseXOR(embedding(F.col("b")))).alias("m"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("h"))
    assert got.where("m > h").count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (300, 100), (7, 7), (None, 3), (200, 100)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == 1
    assert by[3].fp == by[4].fp == 0 and by[4].component_id == 3
    assert by[6].fp & (2**64 - 1) == fingerprint("wort " * 60_000)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 5, 6, 7, 8]
    assert near_duplicates(empty(spark)).collect() == []
    assert one_of_each(empty(spark)).collect() == []
