"""Families: groups of a vocabulary's words that share a lemma."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versara.seeds.morphology import LEMMA_OF, REFUSED

#: How many links from a form to its lemma are followed.
HOPS = 4


def irregular_forms(spark: SparkSession) -> DataFrame:
    """``(token, lemma)``, about 130 rows."""
    return spark.createDataFrame(sorted(LEMMA_OF.items()), "token string, lemma string")


def roots(token: Column) -> Column:
    """Candidate roots, best first: suffixes add theirs in a fixed order, the longer root before the
    shorter. A root has three letters or more, differs from its form, is no irregular form itself and no
    refused merge."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    none = F.array().cast("array<string>")
    rules = [
        (F.endswith(token, F.lit("eth")), F.array(cut(2), cut(3))),
        (F.endswith(token, F.lit("est")), F.array(cut(2), cut(3))),
        (F.endswith(token, F.lit("ing")) & (n >= 6), F.array(F.concat(cut(3), F.lit("e")), cut(3))),
        (F.endswith(token, F.lit("ed")), F.array(cut(1), cut(2))),
        (F.endswith(token, F.lit("es")), F.array(cut(1), cut(2))),
        (F.endswith(token, F.lit("s")) & ~F.endswith(token, F.lit("ss")), F.array(cut(1))),
    ]
    found = F.concat(*[F.when(test, made).otherwise(none) for test, made in rules])
    barred = F.array(*[F.lit(x) for x in sorted(LEMMA_OF)])
    refused = F.array(*[F.lit(x) for x in sorted(REFUSED)])
    return F.filter(found, lambda r: (F.length(r) >= 3) & (r != token) & ~F.array_contains(barred, r) & ~F.array_contains(refused, F.concat(token, F.lit(">"), r)))


def lemmas(vocabulary: DataFrame) -> DataFrame:
    """``(token, lemma)`` of each distinct ``token``: an irregular form goes to its lemma if the vocabulary
    has it; any other to its first candidate root that the vocabulary has; and so on for up to four links.
    A token without either is its own lemma."""
    words = vocabulary.select("token").where(F.col("token").isNotNull()).distinct()
    own = words.select(F.col("token").alias("root"))
    irregular = words.join(F.broadcast(irregular_forms(words.sparkSession)), "token").join(own, F.col("lemma") == F.col("root"), "left_semi").select("token", F.col("lemma").alias("irregular"))  # the seed's size is fixed
    rooted = words.select("token", F.posexplode(roots(F.col("token"))).alias("pos", "root")).join(own, "root").groupBy("token").agg(F.min_by("root", "pos").alias("regular"))
    links = irregular.join(rooted, "token", "full").select("token", F.coalesce("irregular", "regular").alias("next"))
    out = words.join(links, "token", "left").select("token", F.coalesce("next", "token").alias("lemma"))
    hop = links.select(F.col("token").alias("lemma"), "next")
    for _ in range(HOPS - 1):
        out = out.join(hop, "lemma", "left").select("token", F.coalesce("next", "lemma").alias("lemma"))
    return out


def families(vocabulary: DataFrame) -> DataFrame:
    """``(lemma, members)``: the families of two words or more, members in order."""
    grouped = lemmas(vocabulary).groupBy("lemma").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return grouped.where(F.size("members") >= 2)
