import dataclasses

import pytest
from pyspark.sql import functions as F

from versara.engine import Edition, Engine
from versara.operators import apparatus, index, numbering, probes, versify
from versara.operators.quality import Expectations, GateError, gate, require
from versara.plans.errors import RequestError
from versara.plans.references import Versification
from versara.sources.corpus import corpus, read_sources

SOURCE = """\\id GEN a
\\c 1
\\p
\\v 1 In the beginning was light.
\\v 2 And light was good.
\\v 4 The shepherd rested.
\\c 2
\\p
\\v 1 Thus it went on.
\\id PSA b
\\c 3
\\d A Psalm of David.
\\q1
\\v 1 Many rise up. \\f + \\ft a note\\f*
\\v 2 Good shepherd. [Selah]
"""
NOTES = "<book><verse>John 1:1</verse><note>• a ] b; c</note></book>"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    (folder / "x.usfm").write_text(SOURCE, encoding="utf-8")
    c = corpus(read_sources(spark, str(folder)), "t")
    c.write(str(folder / "out"))
    return type(c).read(spark, str(folder / "out"))


EXPECTED = Expectations(total=6, books={"GEN": (2, 4), "PSA": (1, 2)}, omitted=["GEN.1.3"], titles=1, notes=True)


def checks(c, e):
    return {(r.check, r.key) for r in gate(c, e).collect()}


def test_gate_passes_and_every_mutation_fails(spark, made):
    known = {r.marker: r.chars for r in made.ledger.where("bucket = 'dropped'").collect()}
    good = dataclasses.replace(EXPECTED, dropped={"usfm": known})
    psalms = [("missing chapter", "PSA.1")]  # the fixture's Psalter begins at 3
    assert checks(made, good) == set(psalms)
    mutations = [
        (
            dict(total=7, order=["PSA", "GEN"], books={"GEN": (3, 5), "JUD": (1, 25)}, omitted=["GEN.1.1"], empty=["GEN.1.1"], titles=2, title_book="GEN", subscriptions=["HAB.3"], unbalanced=["GEN.1.1"], dropped={"usfm": {k: v + (k == "verse-number") for k, v in known.items() if k != "id"}}),
            {("total verses", ""), ("book order", "1"), ("book order", "2"), ("unexpected book", "PSA"), ("book missing", "JUD"), ("book chapters", "GEN"), ("book verses", "GEN"), ("missing chapter", "GEN.3"), ("gap in numbering", "GEN.1.3"), ("declared omitted", "GEN.1.1"), ("empty verses", "GEN.1.1"), ("empty verse without a note", "GEN.1.1"), ("title count", ""), ("title elsewhere", "PSA.3"), ("subscriptions", "HAB.3"), ("nothing reached", "subscriptions"), ("unbalanced brackets", "GEN.1.1"), ("dropped characters", "verse-number"), ("newly dropped", "id")},
        ),
        (dict(dropped={"usx": {}}), {("no expectations for format", "usfm")} | set(psalms)),
    ]
    for change, failures in mutations:
        assert checks(made, dataclasses.replace(good, **change)) == failures
    bad = dataclasses.replace(made, verses=made.verses.union(made.verses.where("bcv = 'GEN.1.1'").withColumn("text", F.lit("a <b> [Selah"))), ledger=made.ledger.where("bucket <> 'notes'"))
    got = checks(bad, good)
    assert {("duplicate verse", "GEN.1.1"), ("residual markup", "GEN.1.1"), ("open musical mark", "GEN.1.1"), ("unbalanced brackets", "GEN.1.1"), ("characters accounted for", ""), ("nothing reached", "notes")} <= got
    with pytest.raises(GateError, match="missing chapter"):
        require(made, good)


@pytest.fixture(scope="module")
def engine(spark, made):
    order = spark.createDataFrame([("t", 1, "GEN"), ("t", 2, "PSA")], "edition string, pos int, book string")
    v = made.verses.withColumn("edition", F.col("translation"))
    chapters = versify.chapters(v, order)
    numbered = versify.numbered(v, chapters).drop("edition")
    counts = Versification("t", "Test", {"GEN": (3, 1), "PSA": (0, 0, 2)}, default=True)
    docs = numbered.select(F.lit("t").alias("edition"), F.col("sequence").alias("doc"), "text")
    notes = spark.createDataFrame([("t", "GEN.1.1", 1, "a ] b", "a", ["b"], None)], "translation string, bcv string, note int, raw string, lemma string, readings array<string>, range string")
    e = Edition("t", "Test", dataclasses.replace(made, verses=numbered), chapters, counts, {"edition_id": "eng-t"}, index.build(docs), notes, ("hebrew",))
    return Engine(spark, [e])


def test_engine_answers(engine):
    assert engine.health().first().edition_id == "eng-t"
    assert engine.translations().first().testaments == ["OT"]
    books = engine.books("catholic").collect()
    assert len(books) == 73 and books[0].availability == "full" and books[1].availability == "metadata_only" and books[0].canons.orthodox_greek == 1
    assert engine.book("tob").first().canons.protestant is None
    chapter = engine.chapter("psa", "3").collect()
    assert [(r.verse, r.hebrew_numbering, r.title) for r in chapter] == [(1, 2, "A Psalm of David."), (2, 3, "A Psalm of David.")]
    assert [r.verse for r in engine.passage("Genesis 1").collect()] == [1, 2, 4]
    got = engine.passage("Gen 1:1-2,2,2:1").collect()
    assert [(r.segment, r.bcv) for r in got] == [(1, "GEN.1.1"), (1, "GEN.1.2"), (2, "GEN.1.2"), (3, "GEN.2.1")]
    title = engine.passage("Psalm 3:1-2", "hebrew").collect()
    assert [(r.verse, r.text) for r in title] == [(0, "A Psalm of David."), (1, "Many rise up.")]
    hits = engine.search("good shepherd")
    assert [r.bcv for r in hits.hits.collect()] == ["PSA.3.2"] and hits.summary.first().total == 1
    assert [(r.id, r.lemma) for r in engine.apparatus("Genesis 1:1-2").collect()] == [("GEN.1.1!1", "a")]


def test_engine_refuses(engine):
    for call, status in (
        (lambda: engine.books(translation="zz"), 404), (lambda: engine.books("none"), 400), (lambda: engine.book("xyz"), 404), (lambda: engine.chapter("GEN", 9), 404), (lambda: engine.chapter("GEN", "x"), 400),
        (lambda: engine.passage(None), 400), (lambda: engine.passage("x" * 600), 400), (lambda: engine.passage("Gen 1", "roman"), 400), (lambda: engine.passage("Psalm 3", "greek"), 501), (lambda: engine.passage("Tobit 1"), 404), (lambda: engine.search("a"), 400),
    ):
        with pytest.raises(RequestError) as e:
            call()
        assert e.value.status == status


def test_many_references_at_once(spark, engine):
    got = engine.passages(spark.createDataFrame([("Genesis 1:1-2",), ("nope 1",)], "ref string")).collect()
    assert sorted((r.ref, r.bcv or "", (r.error or "")[:12]) for r in got) == [("Genesis 1:1-2", "GEN.1.1", ""), ("Genesis 1:1-2", "GEN.1.2", ""), ("nope 1", "", "unknown_book")]


def test_apparatus(spark):
    files = [("a", "<book><verse>Jude 1:3</verse><note>3 lemma W1 ] reading W2; other</note><note>22–23 x ] y</note><verse>1 John 2:1</verse><note>• z ] </note></book>"), ("b", NOTES)]
    rows = apparatus.merged(apparatus.parse(spark.createDataFrame(files, "path string, text string"), "gnt")).orderBy("bcv", "note").collect()
    assert [(r.bcv, r.note, r.raw, r.lemma, r.readings, r.range) for r in rows] == [
        ("1JN.2.1", 1, "z ]", "z", [], None), ("JHN.1.1", 1, "a ] b; c", "a", ["b", "c"], None),
        ("JUD.1.3", 1, "lemma W1 ] reading W2; other", "lemma W1", ["reading W2", "other"], None), ("JUD.1.3", 2, "x ] y", "x", ["y"], "22–23"),
    ]
    for bad in ("<verse>Jude 1:3</verse><note>no bracket</note>", "<note>a ] b</note>", "<verse>Nobody 1:1</verse><note>a ] b</note>"):
        with pytest.raises(Exception, match="without"):
            apparatus.parse(spark.createDataFrame([("a", bad)], "path string, text string"), "gnt").collect()
    twice = spark.createDataFrame([("a", NOTES), ("b", NOTES)], "path string, text string")
    with pytest.raises(Exception, match="two files"):
        apparatus.merged(apparatus.parse(twice, "gnt")).collect()


def test_probes(spark):
    every = [probes.FREE, probes.VERSE, probes.SELF]
    adapters = spark.createDataFrame([("good", "asv", False, every), ("bad", "asv", False, every), ("mute", "asv", False, []), ("down", "asv", False, every)], "adapter string, edition string, carries_markup boolean, capabilities array<string>")
    v = lambda *t: [dict(zip(("book", "chapter", "verse", "text"), x)) for x in t]
    good = {
        "Jo 3:16": (400, '{"detail":"Job, Joel or John"}', []), "John 3:99": (404, "only 36", []), "Genesis 99:1": (404, "", []), "Genesis 1:31-2:3": (200, "", v(*[("GEN", c, n, "x") for c, n in ((1, 31), (2, 1), (2, 2), (2, 3))])),
        "1 Corinthians 13:4-7,13": (200, "", v(*[("1CO", 13, n, "x") for n in (4, 5, 6, 7, 13)])), "Jude 5": (200, "", v(("JUD", 1, 5, "a"))), "Jude 1:5": (200, "", v(("JUD", 1, 5, "a"))),
        "MAT 17:21": (200, '{"verses":[{"note":"omitted"}]}', v(("MAT", 17, 21, ""))), "PSA 23:1": (200, "", v(("PSA", 23, 1, "is my shepherd"))), "PSA 23": (200, "A Psalm of David", []), "EXO 6:3": (200, "", v(("EXO", 6, 3, "Jehovah"))),
        "JHN 3:16": (200, "", v(("JHN", 3, 16, "For God"))), "MAT 22:21": (200, "", v(("MAT", 22, 21, "Cæsar’s"))), "REV 22:21": (200, "", v(("REV", 22, 21, "The grace"))), "self": (200, '{"edition":"x","sha":"y","license":"z"}', []), "Hezekiah 1:1": (404, "", []),
    }
    bad = {
        "Jo 3:16": (200, "", v(("Job", 3, 16, "x"))), "John 3:99": (200, "", v(("John", 3, 36, "x"))), "Genesis 99:1": (200, "", v(("Gen", 50, 1, "x"))), "Genesis 1:31-2:3": (400, "", []), "1 Corinthians 13:4-7,13": (200, "", v(("1CO", 13, 4, "x"))),
        "Jude 5": (200, "", v(("JUD", 1, 5, "a"))), "Jude 1:5": (200, "", v(("JUD", 1, 5, "b"))), "MAT 17:21": (200, "", v(("MAT", 17, 21, "[But this kind"))), "PSA 23:1": (200, "", v(("PSA", 23, 1, "A Psalm of David. my shepherd"))), "PSA 23": (200, "", []),
        "EXO 6:3": (200, "", v(("EXO", 6, 3, "LORD"))), "JHN 3:16": (200, "", v(("JHN", 3, 16, "<i>For</i>"))), "MAT 22:21": (200, "", v(("MAT", 22, 21, "Caesar's"))), "REV 22:21": (200, "", []), "self": (200, "{}", []), "Hezekiah 1:1": (200, "", v(("x", 1, 1, "x"))),
    }
    rows = [(a, q, s, None, raw, vs) for a, answers in (("good", good), ("bad", bad)) for q, (s, raw, vs) in answers.items()] + [("down", q, None, "timeout", None, []) for q in good]
    outcomes = spark.createDataFrame(rows, "adapter string, request string, status int, transport_error string, raw string, verses array<struct<book:string,chapter:int,verse:int,text:string>>")
    cells = {(r.adapter, r.probe): r for r in probes.matrix(adapters, outcomes).collect()}
    assert len(cells) == 4 * 15
    want_good = ["safe"] * 6 + ["divergent"] + ["safe"] * 8
    want_bad = ["unsafe", "unsafe", "unsafe", "missing", "divergent", "unsafe", "divergent", "unsafe", "unsafe", "unsafe", "divergent", "missing", "missing", "missing", "unsafe"]
    for name, want in (("good", want_good), ("bad", want_bad), ("mute", ["not-applicable"] * 15), ("down", ["unreachable"] * 15)):
        assert [cells[name, p.id].verdict for p in probes.PROBES] == want, name
    assert cells["good", "verse-out-of-range"].summary == "error answer with the true length"
    assert probes.histogram(probes.matrix(adapters, outcomes)).first().n >= 15
    raw = spark.createDataFrame([('{"verses":[{"book_id":"JHN","chapter":3,"verse":16,"text":"a"}]}', '[{"bookname":"John","chapter":"3","verse":"16","text":"a"}]', '[{"b":"43","c":"3","v":"16","t":"a"}]', '{"16":{"chapter":3,"verse":16,"text":"a"}}')], "a string, b string, c string, d string")
    for column, kind in zip("abcd", ("verses", "list", "rows", "map")):
        (got,) = raw.select(probes.normalize(F.col(column), kind).alias("v")).first().v
        assert (got.chapter, got.verse, got.text) == (3, 16, "a")
    assert raw.select(probes.normalize(F.lit("not json"), "verses").alias("v")).first().v == []


def test_stream_indexes_what_lands(spark, tmp_path):
    from versara.streaming.ingest import index_stream, landing, read_stream_index

    for i, text in enumerate(("good shepherd", "the wolf")):
        spark.createDataFrame([("en", i, text)], "edition string, doc long, text string").write.mode("append").json(str(tmp_path / "in"))
        index_stream(landing(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    ix = read_stream_index(spark, str(tmp_path / "out"))
    assert sorted(r.token for r in ix.terms.collect()) == ["good", "shepherd", "the", "wolf"] and ix.docs.count() == 2


def test_sequences_with_omitted_verses(spark, made):
    v = made.verses.withColumn("edition", F.col("translation"))
    ch = versify.chapters(v)
    rows = versify.numbered(v, ch).orderBy("sequence").collect()
    assert [(r.bcv, r.sequence) for r in rows][:4] == [("GEN.1.1", 1), ("GEN.1.2", 2), ("GEN.1.4", 3), ("GEN.2.1", 4)]
    assert numbering.interval_table(spark).count() == len(numbering.intervals())
