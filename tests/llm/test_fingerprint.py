import hashlib
import random
import re

import pytest
from cases import awkward, empty

from versara.llm import fingerprint as ctph
from versara.llm.common import table


def slow(text):
    """The fingerprint byte by byte."""
    import zlib

    raw = (text or "").encode()
    block = 3
    while block * 64 < len(raw):
        block *= 2
    signs = []
    for size in (block, 2 * block):
        out, at = "", 0
        for i in range(len(raw)):
            window = [raw[i - k] if i >= k else 0 for k in range(7)]
            mixed = 0
            for k, b in enumerate(window):
                mixed ^= (b << 5 * k) & 0xFFFFFFFF
            h = (sum(window) + sum(b * (7 - k) for k, b in enumerate(window)) + mixed) & 0xFFFFFFFF
            if h % size == size - 1 or i == len(raw) - 1:
                out += ctph.LETTERS[zlib.crc32(raw[at : i + 1]) >> 13 & 63]
                at = i + 1
        signs.append(out)
    return f"{block}:{signs[0]}:{signs[1]}"


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fingerprint_and_distance_against_brute_force():
    rng = random.Random(3)
    for n in (0, 1, 6, 7, 8, 50, 400, 5000):
        text = "".join(rng.choices("abcdé \n", k=n))
        assert ctph.fingerprint(text) == slow(text)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(70))) for _ in "ab")
        assert ctph.edit_distance(a, b) == slow_distance(a, b)


def test_likeness():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    text = " ".join(rng.choices(words, k=600))
    other = " ".join(rng.choices(words, k=600))
    mark = ctph.fingerprint
    assert ctph.likeness(mark(text), mark(text)) == 1.0
    assert ctph.likeness(mark(text), mark("inserted " + text)) > 0.8
    assert ctph.likeness(mark(text), mark(text + " " + other)) > 0.3  # block sizes differ by two
    assert 0.3 < ctph.likeness(mark(text), mark(ctph.edited(text, other))) < 0.8
    assert ctph.likeness(mark(text), mark(other)) < 0.2
    assert ctph.likeness(mark(text), mark("x")) == 0.0 and ctph.likeness(mark(""), mark("abc")) == 0.0


def slow_likeness(x, y):
    """By dynamic programming, from the signatures' rules alone."""
    if x == y:
        return 1.0
    (p, *a), (q, *b) = x.split(":"), y.split(":")
    sign = {(int(p) << i, 0): s for i, s in enumerate(a)} | {(int(q) << i, 1): s for i, s in enumerate(b)}
    best = 0.0
    for size in {size for size, _ in sign}:
        if (size, 0) in sign and (size, 1) in sign:
            s, t = (re.sub(r"(.)\1{3,}", r"\1\1\1", sign[size, side]) for side in (0, 1))
            k = max(1, min(4, min(len(s), len(t)) // 3))
            if s and t and any(s[i : i + k] in t for i in range(len(s) - k + 1)):
                best = max(best, 1 - slow_distance(s, t) / max(len(s), len(t)))
    return best


def expected(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for (i, text), (_, after) in zip(order, [*order[1:], order[0]]):
        text, after = text or "", after or ""
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = ctph.fingerprint(text), ctph.fingerprint(changed), ctph.fingerprint(after)
        out[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, slow_likeness(a, b), slow_likeness(a, c))
    return out


@pytest.mark.parametrize("bucket_rows", [7, 1000])
def test_whole_table(spark, sf, bucket_rows):
    docs = table(spark, sf, "documents")
    rows = ctph.neighbours(docs, bucket_rows=bucket_rows).collect()
    got = {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows}
    assert len(rows) == len(got) and got == expected([(r.doc_id, r.text) for r in docs.collect()])
    query = {r.doc_id: tuple(r)[1:] for r in ctph.op5_fingerprint(spark, sf).collect()}
    assert query == got


@pytest.mark.parametrize("bucket_rows", [2, 100])
def test_awkward_rows(spark, bucket_rows):
    docs = awkward(spark)
    rows = ctph.neighbours(docs, bucket_rows=bucket_rows).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[None].next_id == 8 and by[1].next_id is None and by[8].next_id == 7 and by[4].fingerprint == by[3].fingerprint == "3::"
    assert sorted(r.next_id for r in rows if r.doc_id == 2) == [1, 2]
    alone = docs.where("doc_id = 6")
    assert [(r.next_id, r.near_next) for r in ctph.neighbours(alone).collect()] == [(6, 1.0)]
    assert ctph.neighbours(empty(spark)).collect() == []


def test_bounds_in_two_steps(spark, monkeypatch):
    from versara.llm import common

    ids = spark.createDataFrame([(int(i),) for i in [*range(0, 4000, 2), *[77] * 600]] + [(None,)], "doc_id long").repartition(3)
    for coarse in (1024, 4):
        monkeypatch.setattr(common, "COARSE", coarse)
        bounds, weight = common.id_bounds(ids, 100)
        assert bounds[-1] == 3998 and weight[list(bounds).index(77)] >= 4
        every = sorted(r.doc_id for r in ids.where("doc_id is not null and doc_id <> 77").collect())
        sizes = [sum(a < i <= b for i in every) for a, b in zip([-1, *bounds], bounds)]
        assert 15 <= len(bounds) and max(sizes) <= 400
