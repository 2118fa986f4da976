import random

from cases import awkward, empty

import corpus_pipeline
from versara.llm import shingles
from versara.llm.common import table
from versara.llm.graph import connected_components


def shingle_strings(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def least(docs, percent=80):
    """Brute force: {id: smallest id reachable} for [(id, text)], by every pair."""
    sets, up = {i: shingle_strings(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both * 100 >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return {i: find(i) for i in ids}


def copies(rng, words, n, group):
    """A text and near copies of it, by one to a few words changed."""
    start = rng.choices(words, k=n)
    out = [" ".join(start)]
    for _ in range(group):
        new = list(start)
        for _ in range(rng.randrange(1, max(2, n // 40))):
            new[rng.randrange(n)] = rng.choice(words)
        out.append(" ".join(new))
    return out


def test_dedup_stage_against_brute_force(spark, sf):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(500)]
    line = " ".join(rng.choices(words, k=30))
    texts = [t for n in (6, 9, 10, 40, 80, 150, 300, 300) for t in copies(rng, words, n, 12)] + copies(rng, words, 200, 60)
    texts += [f"{line} {' '.join(rng.choices(words, k=rng.randrange(5, 60)))}" for _ in range(80)] + ["", None, " \n", "a b", "A  b"]
    rng.shuffle(texts)
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    docs += [(10**6 + i, t) for i, t in enumerate(texts)]
    want = least(docs)
    assert 40 < len(docs) - len(set(want.values())) and len({i for i in set(want.values()) if i >= 10**6}) > 20
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], table(spark, sf, "documents").schema).repartition(5)
    assert {r.doc_id: r.component_id for r in shingles.alike(df).collect()} == want
    kept = [r.doc_id for r in corpus_pipeline.dedup_stage(spark, df, sf).collect()]
    assert sorted(kept) == sorted(set(want.values()))
    few = shingles.Likeness(one_in=4, often=2, most=7)
    assert {r.doc_id: r.component_id for r in shingles.alike(df, few).collect()} == want


def test_awkward_rows(spark):
    kept = shingles.one_of_each(awkward(spark))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 5, 6, 7, 8]
    assert shingles.one_of_each(empty(spark)).collect() == []


def test_rows_that_repeat_an_id(spark):
    x, y = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    of = lambda rows: sorted((r.doc_id, r.text) for r in shingles.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, mark int, id string")).collect())
    clash = lambda *rows: [(i, t, 1, "z") for i, t in rows]
    assert of(clash((3, x), (5, y), (5, x))) == [(3, x), (5, y)]
    assert of(clash((5, y), (5, x))) == sorted([(5, y), (5, x)])
    assert of(clash((5, x), (5, x), (7, x), (8, y))) == [(5, x), (8, y)]
    got = shingles.one_of_each(spark.createDataFrame(clash((None, x), (4, x), (None, y), (None, y)), "doc_id long, text string, mark int, id string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [(-1, y), (4, x)]


def test_a_row_without_id_links_others(spark):
    w = [f"w{i}" for i in range(64)]
    x, y = [*w, "p", "q", "r", "s", "t", "u"], ["p1", "q1", "r1", "s1", "t1", "u1", *w]
    rows = [(1, " ".join(x)), (None, " ".join(w)), (2, " ".join(y))]
    assert len(shingle_strings(rows[0][1]) & shingle_strings(rows[2][1])) == 60
    got = shingles.alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}


def test_edges_that_come_later_give_the_same_components(spark):
    rng = random.Random(8)
    edge = lambda n: [tuple(rng.sample(range(n), 2)) for _ in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    for first, more in [(edge(120), edge(160)), ([], edge(90)), (edge(90), [])]:
        found = shingles._joined(connected_components(frame(first)), frame(more))
        want = connected_components(frame(first + more))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select("node", "root").collect()))
