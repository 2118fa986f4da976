"""Text as Column expressions; everything here stays in the JVM.

Each function takes and returns Columns. The Python twins (``fold_text``, ``tokens_of``) serve the planners,
which see literal queries.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What folds before lower-casing, in this order.
FOLDS = (("’", " "), ("æ", "ae"), ("Æ", "Ae"), ("ï", "i"), ("ü", "u"))
#: The shortest token that is indexed.
SHORTEST = 2
#: White space as the source formats count it: the Unicode spaces, line ends and the byte-order mark.
SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def fold(text: Column) -> Column:
    """Typography to plain letters: five characters, before lower-casing."""
    for old, new in FOLDS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def tokenize(text: Column) -> Column:
    """Index terms in order: folded, lower-cased, split at anything but a-z, two letters or more."""
    return F.filter(F.split(F.lower(fold(text)), "[^a-z]+"), lambda t: F.length(t) >= SHORTEST)


def fold_text(text: str) -> str:
    for old, new in FOLDS:
        text = text.replace(old, new)
    return text


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split("[^a-z]+", fold_text(text).lower()) if len(t) >= SHORTEST]


def word_count(text: Column) -> Column:
    """Pieces between single spaces; 0 for empty text. Double spaces count an empty word, as the length
    statistics do."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ", -1)))


def collapse(text: Column, trim: bool = True) -> Column:
    """Runs of white space to one space, and trimmed."""
    out = F.regexp_replace(text, f"[{SPACE}]+", " ")
    return F.trim(out) if trim else out


def decode_entities(text: Column) -> Column:
    """The five named references; ``&amp;`` last, so that nothing is decoded twice."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def attribute(attrs: Column, name: str) -> Column:
    """The value of ``name="..."``; null if there is none."""
    pattern = f'\\b{name}\\s*=\\s*"([^"]*)"'
    return F.when(F.regexp_like(attrs, F.lit(pattern)), F.regexp_extract(attrs, pattern, 1))


def count_of(text: Column, literal: str) -> Column:
    """How often a single character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))


def close_brackets(text: Column) -> Column:
    """Missing closing brackets, appended."""
    missing = F.greatest(F.lit(0), count_of(text, "[") - count_of(text, "]"))
    return F.concat(text, F.repeat(F.lit("]"), missing))


def unbalanced(text: Column) -> Column:
    return count_of(text, "[") != count_of(text, "]")


def open_selah(text: Column) -> Column:
    """A musical mark whose bracket never closes."""
    return F.regexp_like(text, F.lit(r"\[(Selah|Higgaion)[^\]]*$"))


def residual_markup(text: Column) -> Column:
    return F.regexp_like(text, F.lit("[<>]"))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def before_bar(text: Column) -> Column:
    """A word without the attributes after its bar."""
    return F.substring_index(text, "|", 1)


#: The signs by which the Greek text marks variants.
SIGNS = "⸀⸁⸂⸃⸄⸅⟦⟧"


def strip_signs(text: Column) -> Column:
    return F.regexp_replace(text, f"[{SIGNS}]", "")


def count_signs(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SIGNS}]"))


def excerpt(text: Column, limit: int = 120) -> Column:
    """Collapsed, trimmed and cut, with an ellipsis if anything is gone."""
    flat = collapse(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def highlight(text: Column, query: str) -> Column:
    """Marks where a word of the query begins: its first four letters, in any case."""
    stems = sorted({t[:4] for t in tokens_of(query)}, key=lambda s: (-len(s), s))
    return F.regexp_replace(text, f"(?i)({'|'.join(stems)})", "<mark>$1</mark>") if stems else text


def half_up(x: Column, places: int) -> Column:
    """Rounds halves towards positive infinity, below zero too."""
    return F.floor(x * 10**places + 0.5) / float(10**places)


def base36(n: Column) -> Column:
    """A signed integer in base 36; ``conv`` alone would print negatives as unsigned."""
    return F.concat(F.when(n < 0, "-").otherwise(""), F.lower(F.conv(F.abs(n).cast("string"), 10, 36)))


def from_base36(s: Column) -> Column:
    sign = F.when(F.startswith(s, F.lit("-")), -1).otherwise(1)
    return sign * F.conv(F.regexp_replace(s, "^-", ""), 36, 10).cast("long")
