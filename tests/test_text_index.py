import json

import pytest
from pyspark.sql import functions as F

from versara.functions import identity, text
from versara.operators import index, morphology
from versara.plans import search
from versara.plans.errors import RequestError


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "tokens"),
    [("Jehovah’s", ["jehovah"]), ("Jehovah's", ["jehovah"]), ("Cæsar Caesar", ["caesar", "caesar"]), ("Jaïrus, Nicolaüs", ["jairus", "nicolaus"]), ("a I o", []), ("", []), ("é été", [])],
)
def test_tokens(spark, raw, tokens):
    assert one(spark, text.tokenize(F.lit(raw))) == tokens == text.tokens_of(raw)


def test_small_functions(spark):
    lit = F.lit
    cases = [
        (text.word_count(lit("a  b")), 3), (text.word_count(lit("")), 0), (text.collapse(lit(" a ﻿\n b ")), "a b"),
        (text.decode_entities(lit("&amp;lt; &lt;&quot;")), '&lt; <"'), (text.attribute(lit(' id="x" bcv="GEN.1.1"'), "bcv"), "GEN.1.1"), (text.attribute(lit("a"), "b"), None),
        (text.close_brackets(lit("[[a]")), "[[a]]"), (text.unbalanced(lit("[a")), True), (text.open_selah(lit("x [Selah")), True), (text.open_selah(lit("x [Selah]")), False),
        (text.strip_signs(lit("⸀a⟧")), "a"), (text.count_signs(lit("⸀a⟧")), 2), (text.before_bar(lit("the|x=1")), "the"), (text.excerpt(lit("a  b c"), 3), "a b…"),
        (text.highlight(lit("Good shepherds"), "shepherd"), "Good <mark>shep</mark>herds"), (text.half_up(lit(-0.00005), 4), 0.0), (text.base36(lit(-71)), "-1z"), (text.from_base36(lit("-1z")), -71), (text.residual_markup(lit("a<b")), True),
    ]
    for column, want in cases:
        assert one(spark, column) == want


def test_canonical_json_and_hashes():
    assert identity.canonical_json({"b": 1, "a": {"d": None, "c": [2, "é", True, 1.5]}, "z": identity.ABSENT}) == '{"a":{"c":[2,"é",true,1.5],"d":null},"b":1}'
    assert identity.sha256_hex("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert identity.sha256_hex(b"abc") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    m = identity.manifest("eng", identity.revision_id(b"x"), {"url": "u"}, [], {"verses": 1})
    assert identity.generation_id(m) != identity.generation_id(m | {"corpus": {"verses": 2}}) and json.loads(identity.canonical_json(m)) == m


def test_families(spark):
    words = "say said saith speak spake spoken go went see saw have hath hades hasted be wasted arts sawed find founded fall felled bee being doe doing lye lying the thing child children love loved loveth lovest loving riches rich judges judge walked walk walkedst".split()
    got = {r.token: r.lemma for r in morphology.lemmas(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert got["said"] == got["saith"] == "say" and got["spoken"] == "speak" and got["went"] == "go" and got["saw"] == "see" and got["hath"] == "have" and got["children"] == "child"
    assert {got[w] for w in ("loved", "loveth", "lovest", "loving")} == {"love"} and got["riches"] == "rich" and got["judges"] == "judge" and got["walked"] == "walk"
    for w in ("hades", "hasted", "wasted", "sawed", "founded", "felled", "thing"):
        assert got[w] == w
    assert got["being"] == "be" and got["lying"] == "lying" and got["doing"] == "doing"


DOCS = [("en", 1, "the good shepherd loves"), ("en", 2, "good shepherds"), ("en", 3, "the the bad one is a wolf here"), ("en", 4, ""), ("en", 5, None), ("de", 6, "good shepherd")]


def brute(query, docs, families=None):
    terms = search.query_terms(query)
    tokens = {d: set(text.tokens_of(t or "")) for e, d, t in docs if e == "en"}
    vocabulary = set().union(*tokens.values())
    members = [{t for t in vocabulary if t == w or i == len(terms) - 1 and t.startswith(w)} for i, w in enumerate(terms)]
    return sorted((len((t or "").split(" ")) if t else 0, d) for e, d, t in docs if e == "en" and members and all(m & tokens[d] for m in members))


@pytest.mark.parametrize("query", ["good shepherd", "the", "good zzz", "123", "sh", "wolf good"])
@pytest.mark.parametrize("compat", [False, True])
def test_search(spark, query, compat):
    ix = index.build(spark.createDataFrame(DOCS, "edition string, doc long, text string"), with_families=False)
    found = search.search(ix, "en", query, compat=compat)
    assert [(r.n_words, r.doc) for r in found.hits.collect()] == brute(query, DOCS)
    assert found.summary.first().total == len(brute(query, DOCS)) and not found.summary.first().truncated


def test_search_pages_families_and_storage(spark, tmp_path):
    docs = spark.createDataFrame(DOCS + [("en", 7, "he loveth all of it"), ("en", 8, "love")], "edition string, doc long, text string")
    index.build(docs).write(str(tmp_path / "ix"))
    ix = index.Index.read(spark, str(tmp_path / "ix"))
    assert [r.doc for r in search.search(ix, "en", "loved loves").hits.collect()] == []
    assert [r.doc for r in search.search(ix, "en", "love").hits.collect()] == [8, 1, 7]
    assert [r.doc for r in search.search(ix, "en", "love", limit=1, offset=1).hits.collect()] == [1]
    plan = search.search(ix, "en", "love").hits._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(token" in plan or "token, love" in plan


def test_admission():
    assert search.admit("ab", "5", None) == ("ab", 5, 0)
    for args in ((None,), (" a ",), ("x" * 513,), (" ".join(f"w{c}" for c in "abcdefghijklm"),), ("ab", 0), ("ab", 101), ("ab", "x"), ("ab", 5, -1)):
        with pytest.raises(RequestError):
            search.admit(*args)


def test_delta_roundtrip(spark):
    entries = spark.createDataFrame([("e", "t", d) for d in (3, 1, 40, 7)] + [("e", "u", 0)], "edition string, token string, doc long")
    encoded = index.deltas(entries)
    assert sorted(map(tuple, index.undelta(encoded).select("token", "doc").collect())) == [("t", 1), ("t", 3), ("t", 7), ("t", 40), ("u", 0)]
    assert {r.token: r.encoded for r in index.lists36(encoded).collect()} == {"t": "1 2 4 x", "u": "0"}
