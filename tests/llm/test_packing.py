import zlib
from collections import defaultdict

import numpy as np
from cases import awkward, empty
from tokenizers import Tokenizer

from versara.llm.common import table, tokenizer_path
from versara.llm.packing import SumOfSquares, finish, op2_packing, pack, packed
from versara.llm.tokens import Encoder


def whole(texts, name="byte_bpe_50k.json"):
    t = Tokenizer.from_file(tokenizer_path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def check(rows, docs):
    """Each id lies in one piece, offsets have no gaps, and nothing needs padding."""
    ids = dict(zip([d for d, _ in docs], ([*x, 0] for x in whole([t for _, t in docs]))))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids[d])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0


def test_whole_table_against_the_tokenizer(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    check(op2_packing(spark, sf).collect(), docs)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = packed(docs.dropDuplicates(["doc_id"])).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id"]).collect()])
    assert sum(r.start == 0 for r in packed(docs).collect()) == docs.count()
    assert packed(empty(spark)).collect() == []


def test_few_open_windows_lose_nothing(spark, sf):
    docs = table(spark, sf, "documents")
    out = pack(docs, tokenizer_path("byte_bpe_50k.json"), window=64, most_open=3)
    total = {r.doc_id: r.doc_tokens for r in out.collect()}
    assert sum(r.length for r in out.collect()) == sum(total.values())


def test_level_is_the_least_sum_of_squares():
    rng = np.random.default_rng(5)
    rule, serial = SumOfSquares(16, 1000), [0]

    def new():
        serial[0] += 1
        return [serial[0], 0, []]

    for size in rng.integers(1, 16, 400).tolist():
        best = None
        for h in range(16 - size, -1, -1):
            if h and not rule.levels[h]:
                continue
            n = rule.levels.copy()
            n[h] -= h > 0
            n[h + size] += h + size < 16
            total = int((n[1:16] ** 2).sum())
            if best is None or total < best[0]:
                best = (total, h)
        assert rule.level(size) == best[1]
        rule.place(size, None, new)


def test_bounded_rule_against_brute_force():
    """Items whole where they fit; cut only when no window may be opened and none has room."""
    rng = np.random.default_rng(6)
    for most in (1, 2, 5):
        rule, serial, placed = SumOfSquares(16, most), [0], []

        def new():
            serial[0] += 1
            return [serial[0], 0, []]

        for size in rng.integers(1, 16, 300).tolist():
            ids, at = np.arange(size), 0
            fills = sorted(w[1] for ws in rule.open.values() for w in ws)
            assert len(fills) <= most and fills == sorted(h for h in range(17) for _ in range(rule.levels[h]))
            pieces = []
            rule.place_cut(ids, lambda a, b: pieces.append((a, b)) or (0, a, ids[a:b], size, False), new)
            for a, b in pieces:
                assert a == at
                at = b
            assert at == size
            fits = len(fills) < most or any(h + size <= 16 for h in fills)
            assert (len(pieces) == 1) == fits
            if not fits:
                common = max(fills, key=lambda h: (fills.count(h), h))
                assert pieces[0] == (0, 16 - common)
            placed.append(size)
        left = rule.drain()
        total = sum(w[1] for w in left)
        done = finish(left, 16, new)
        sizes = [sum(len(x[2]) for x in w[2]) for w in done]
        assert sum(sizes) == total and sum(n == 16 for n in sizes) >= total // 16 and all(n & (n - 1) == 0 for n in sizes)


def test_the_rule_places_nearly_all(spark):
    rows = op2_packing(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.length for r in rows if r.recut) < 0.01 * sum(r.length for r in rows)


def test_memo_equals_tokenizer(spark):
    texts = ["", " a", "a ", "a  b", "a\n\nb", "it's 2024's 12345 don't", "x<|endoftext|> y <|startoftext|>", "Ünïcödé ÇA İI ǅ", "日本 語", "éa", "a\x1cb c", "a\u0085b", "ΣΑΣ ΟΔΟΣ.", "a\tb c\rd", "\x01 a", "tab \t x", "😀 ok", "ﬁ ½ ²", "Éa, ÉA. straße! ǆ? ªb, ǅ. İ, ı. DON'T. it's, 'S. 's, 'T 'll. a'LL,"]
    texts += [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        mine = Encoder(tokenizer_path(name), limit=50)
        for text, ids in zip(texts, whole(texts, name)):
            assert mine.encode(text).tolist() == ids, (name, text)
