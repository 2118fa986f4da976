import random
import time

import pytest
from tokenizers import Tokenizer

from versara.llm.common import tokenizer_path
from versara.llm.tokens import _MARKS, Encoder

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def seconds(run) -> float:
    times = []
    for _ in range(3):
        start = time.process_time()
        run()
        times.append(time.process_time() - start)
    return min(times)


def test_new_words_cost_little_more_than_their_merges(library):
    draw = random.Random(7)
    words = ["".join(draw.choices("etaoinshrdluüß", k=draw.randint(5, 12))) for _ in range(40_000)]
    texts = [" ".join(words[i : i + 400]) for i in range(0, len(words), 400)]
    coders = [Encoder(PATH) for _ in range(3)]
    mine = seconds(lambda: [*map(coders.pop().raw, texts)])
    assert mine < 1.5 * seconds(lambda: [[t.id for t in library.model.tokenize(w)] for w in words])


def test_every_word_of_the_vocabulary(library):
    words = sorted({library.decode([i]).strip() for i in range(library.get_vocab_size())} - {""})
    coder = Encoder(PATH)
    for word, want in zip(words, library.encode_batch(words, add_special_tokens=False)):
        assert coder.encode(word).tolist() == want.ids, word


def test_random_plain_texts(library):
    draw = random.Random(3)
    plain = [c for i in range(0x250) if (c := chr(i)).isspace() or c.isprintable()]
    pools = [plain, "abc'sStTreveLlmMd  ", "ab12 .,'!-_\n\t", "abcdefghijklmnopqrstuvwxyzßäÖé ,.", _MARKS + "ab1 '<|>", "aİıΣ́ ½²ªǅﬁ日.\x85"]
    texts = ["".join(draw.choices(draw.choice(pools), k=draw.randint(0, 40))) for _ in range(6_000)]
    texts += ["ab" * 50_000, "a" + "." * 5_000, " \t\n", "a<|endoftext|>b"]
    coder = Encoder(PATH)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert coder.encode(text).tolist() == want.ids, text
