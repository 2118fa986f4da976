import zlib

import numpy as np
from cases import awkward, empty

from versara.llm import langid
from versara.llm.common import table


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    rows = langid.op3_langid(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_training_never_sees_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    s = langid.Settings(slots=50)
    a = langid.sample(docs, ~langid.held_out(), s)
    b = langid.sample(docs.where(~langid.held_out()), langid.F.lit(True), s)
    assert [(r.lang, r.slot, r.ids) for r in a] == [(r.lang, r.slot, r.ids) for r in b] and a


def test_subwords_against_brute_force():
    s = langid.Settings()
    for text in ("Ab, c1dé", "", "123", "x", "a  bb", "日本 ab"):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        grams = []
        for n in range(1, s.longest + 1):
            flat = [f" {w} " for w in words]
            grams += [g for w in flat for i in range(len(w) - n + 1) if (g := w[i : i + n]).strip() and " " not in g[1:-1] and not (n == 1 and g == " ") and not (g[0] == g[-1] == " ")]
        assert len(langid.subwords(text, s)) == len(grams), text
        assert len(set(langid.subwords(text, s).tolist())) <= len(set(grams))
    assert np.array_equal(langid.subwords("the cat", s), langid.subwords("THE--CAT", s))


def test_small_tables_are_learnt(spark, sf):
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    held = [r for r in langid.op3_langid(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) > 0.9 * len(held)


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    x, y = rng.random((5, 7)), np.eye(3)[[0, 2, 1, 1, 0]]
    x /= x.sum(axis=1, keepdims=True)
    parts = [rng.normal(0, 1, (7, 4)), rng.normal(0, 1, (4, 3)), rng.normal(0, 1, 3)]
    loss, *found = langid.gradients(x, y, *parts)
    z = np.array([[sum(sum(x[d, b] * parts[0][b, w] for b in range(7)) * parts[1][w, c] for w in range(4)) + parts[2][c] for c in range(3)] for d in range(5)])
    assert np.isclose(loss, -np.mean([np.log(np.exp(z[d]) / np.exp(z[d]).sum())[y[d].argmax()] for d in range(5)]))
    for part, g in zip(parts, found):
        for i in np.ndindex(part.shape):
            part[i] += 1e-6
            more = langid.gradients(x, y, *parts)[0]
            part[i] -= 2e-6
            less = langid.gradients(x, y, *parts)[0]
            part[i] += 1e-6
            assert np.isclose(g[i], (more - less) / 2e-6, atol=1e-6)
    before = [p.copy() for p in parts]
    langid.descend(x, y, *parts, rate=0.01, decay=0.0)
    assert langid.gradients(x, y, *parts)[0] < loss
    assert np.allclose(parts[0], before[0] - 0.01 * found[0]) and np.allclose(parts[1], before[1] - 0.01 * found[1])


def test_prediction_is_the_softmax_of_the_mean_embedding(spark, sf):
    docs = table(spark, sf, "documents")
    m = langid.train(docs, settings=langid.Settings(slots=40))
    for r in docs.where("text is not null").limit(20).collect():
        rows = [m.scores[i].astype(float) for i in langid.subwords(r.text, m.settings)]
        z = (sum(rows) / len(rows) + m.bias) / m.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score, _ = langid.classify(r.text, m)
        assert lang == m.languages[int(p.argmax())] and np.isclose(score, p.max())


def test_long_texts_in_blocks_equal_the_whole():
    s = langid.Settings()
    text = "mot été. " * 500 + "x" * 300 + " fin " + "日本" * 50
    for size in (1, 7, 100, 10_000):
        parts = list(langid.blocks(text, size))
        assert "".join(parts) == text
        assert sorted(np.concatenate([langid.subwords(p, s) for p in parts]).tolist()) == sorted(langid.subwords(text, s).tolist())


def test_awkward_rows(spark):
    docs = awkward(spark)
    m = langid.train(docs, settings=langid.Settings(slots=4))
    rows = langid.predict(docs, m).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    for i in (3, 4, 5):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[6].lang_pred == "de"
    kept = langid.accepted(docs, m)
    assert kept.schema.names == docs.columns and not {3, 4, 5} & {r.doc_id for r in kept.collect()}
    assert langid.predict(empty(spark), m).collect() == []
    none = langid.train(empty(spark))
    assert none.languages == [] and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
