import random

from versara.llm import langid
from versara.llm.common import table

UNLEARNED = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita. ",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. ",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. ",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. ",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. ",
]


def test_texts_of_no_training_language_go_and_clean_ones_stay(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    m = langid.train(docs)
    rng = random.Random(2)
    letters = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (8, 20, 100, 1000) for _ in range(50)]
    numbers = [" ".join(f"{rng.getrandbits(128):032x}" for _ in range(40)) for _ in range(100)]
    signs = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(60)) for _ in range(100)]
    for texts in (letters, numbers, signs, [t * 4 for t in UNLEARNED]):
        assert sum(langid.classify(t, m)[2] for t in texts) >= 0.95 * len(texts)
    clean = [r.text for r in docs.where("text is not null").collect()]
    assert sum(langid.classify(t, m)[2] for t in clean) <= 0.005 * len(clean)
    assert sum(langid.classify(" ".join(t.split()[:3]), m)[2] for t in clean) <= 0.1 * len(clean)
