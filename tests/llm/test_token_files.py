import zlib

import numpy as np
import pytest
from cases import awkward, empty
from test_packing import whole

from versara.llm import token_files
from versara.llm.common import table, table_path, tokenizer_path

WORDS = "word_bpe_49k.json"


def expected(docs):
    out, at = [], 0
    for d, ids in zip([d for d, _ in docs], whole([t for _, t in docs], WORDS)):
        raw = np.array([*ids, 2], dtype="<u4").tobytes()
        out.append((d, at, len(ids) + 1, zlib.crc32(raw)))
        at += len(ids) + 1
    return out


def test_whole_table(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    assert sorted(map(tuple, token_files.op6_token_files(spark, sf).collect())) == expected(docs)


def test_shards_and_single_documents(spark, sf):
    path = table_path(spark, "t")
    docs = table(spark, sf, "documents")
    d = token_files.write(docs, path, tokenizer_path(WORDS), end_id=2, shard_docs=17)
    assert d.data and d == token_files.open_dictionary(spark, path)
    want = expected(sorted((r.doc_id, r.text) for r in docs.collect()))
    rows = token_files.read(spark, path).collect()
    assert sorted(tuple(r)[:4] for r in rows) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    assert len(blocks) > 5
    by = {w[0]: w for w in want}
    block = token_files.Block(bytes(blocks[3].data), d)
    for i in (0, len(block.doc_ids) - 1):  # one document's frame opens alone
        assert zlib.crc32(block.ids(i).astype("<u4").tobytes()) == by[int(block.doc_ids[i])][3]
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Block(bytes(blocks[0].data), token_files.Dictionary(b"x"))
    with pytest.raises(Exception):  # noqa: B017
        token_files.Block(bytes(blocks[0].data)[:-9], d).ids(len(token_files.Block(bytes(blocks[0].data), d).doc_ids) - 1)


def test_awkward_rows(spark):
    docs = awkward(spark)
    path = table_path(spark, "t")
    token_files.write(docs, path, tokenizer_path(WORDS), end_id=2, width=4, shard_docs=2)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8]
    assert [r.n_tokens for r in rows if r.doc_id in (3, 4)] == [1, 1]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    path = table_path(spark, "t")
    token_files.write(empty(spark), path, tokenizer_path(WORDS), end_id=2)
    assert token_files.read(spark, path).collect() == []


def test_extreme_and_repeated_ids(spark):
    """The least long is an id like any other; an id, or null, that fills several shards is dealt over them."""
    least = -(1 << 63)
    rows = [(None, f"null {i}") for i in range(60)] + [(least, "least"), (5, "five")] + [(9, f"nine {i}") for i in range(60)] + [(i, f"t {i}") for i in range(20, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = table_path(spark, "t")
    dictionary = token_files.write(docs, path, tokenizer_path(WORDS), end_id=2, shard_docs=20)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 60 + sorted(i for i, _ in rows if i is not None)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:])) and got[0].start == 0
    index = spark.read.parquet(f"{path}/index").collect()
    assert max(r.n_docs for r in index) < 60 and sum(r.n_docs for r in index) == len(rows)
    want = {i: np.array([*ids, 2]) for (i, _), ids in zip(rows, whole([t for _, t in rows], WORDS))}
    for i in (least, 5, 59):
        (ids,) = token_files.lookup(spark, path, i)
        assert ids.tolist() == want[i].tolist()
    assert len(token_files.lookup(spark, path, 9)) == 60 and token_files.lookup(spark, path, 6) == []
    blocks = [token_files.Block(bytes(r.data), dictionary) for r in spark.read.parquet(f"{path}/blocks").collect()]
    assert sum(len(b.find(None)) for b in blocks) == 60 and sum(len(b.find(least)) for b in blocks) == 1
