"""Rows that every operator on documents has to stand: nulls, empty and very long texts, ties, copies."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, e long"


def awkward(spark):
    """With extra columns whose names clash with the operators' own."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "s", 43, 0, 0),
        (2, "the quick brown fox jumps over the lazy dog", "en", "s", 43, 0, 0),
        (2, "the quick brown fox jumps over the lazy dog", "en", "s", 43, 0, 0),
        (3, None, None, None, None, None, None),
        (4, "", "en", None, 0, 1, 1),
        (5, "12 34 --- !!", "de", "s", 12, 1, 1),
        (6, "wort " * 60_000, "de", "t", 300_000, 1, 1),
        (7, "  two  spaces\n\nand\ttabs <|endoftext|> x y 日本語 é ΣΣ \U0001f600 ", None, "s", 60, 1, 1),
        (None, "no id here at all", "en", "s", 17, 1, 1),
        (8, "a", "fr", "s", 1, 1, 1),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
