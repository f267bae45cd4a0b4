"""Frequency lists and comparison of sub-corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.stats import cloud_size, log_likelihood
from quernstone.functions.text import alnum

MOST = 200
#: Scores are put in order at this precision, so that equal ones fall to the lemma.
DIGITS = 6


def frequency_list(counts: DataFrame, drop_zero: bool = False) -> DataFrame:
    """(lemma, cnt) with a letter or digit, most frequent first, then by lemma. Zeros stay unless dropped."""
    kept = counts.filter(alnum(F.col("lemma")))
    return (kept.filter("cnt > 0") if drop_zero else kept).orderBy(F.desc("cnt"), "lemma")


def keyness(first: DataFrame, second: DataFrame, most: int | None = MOST, signed: bool = False) -> DataFrame:
    """(lemma, ll) of two count tables: log-likelihood over 0, largest first, at most the first 200."""
    both = first.select("lemma", F.col("cnt").alias("a")).join(second.select("lemma", F.col("cnt").alias("b")), "lemma", "full")
    return _scored(both.select("lemma", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")), most, signed)


def _scored(counts: DataFrame, most: int | None, signed: bool = False) -> DataFrame:
    """keyness of (lemma, a, b). The totals read the same exchange as the scores: one pass below it."""
    totals = counts.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    # one row of two numbers
    rows = counts.filter("a > 0 AND b > 0").crossJoin(F.broadcast(totals))
    ll = F.round(log_likelihood(F.col("a"), F.col("b"), F.col("n1"), F.col("n2"), signed), DIGITS)
    out = rows.select("lemma", ll.alias("ll")).filter("ll != 0" if signed else "ll > 0").orderBy(F.desc("ll"), "lemma")
    return out if most is None else out.limit(most)


def keyness_in(tokens: DataFrame, first: DataFrame, second: DataFrame | None, most: int | None = MOST) -> DataFrame:
    """keyness of two sub-corpora (doc_id), the second being all documents if None, in one pass over tokens."""
    marked = tokens.filter(F.col("kind") == "word").join(first.select("doc_id").distinct().withColumn("_a", F.lit(1)), "doc_id", "left")
    other = F.lit(1)
    if second is not None:
        marked = marked.join(second.select("doc_id").distinct().withColumn("_b", F.lit(1)), "doc_id", "left")
        other = F.col("_b")
    return _scored(marked.groupBy("lemma").agg(F.count("_a").alias("a"), F.count(other).alias("b")), most)


def word_cloud(scores: DataFrame) -> DataFrame:
    """(lemma, ll, size) of a keyness table; an empty one stays empty."""
    return scores.select("lemma", "ll", F.round(cloud_size(F.col("ll")), DIGITS).alias("size"))
