"""Keyness and index statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def log_likelihood(a: Column, b: Column, n1: Column, n2: Column, signed: bool = False) -> Column:
    """Dunning's G2 of a word with counts a and b in corpora of n1 and n2 words; 0 if either lacks it.

    Unsigned unless asked: signed makes it negative where the word is rarer in the first corpus.
    """
    a, b, n1, n2 = (x.cast("double") for x in (a, b, n1, n2))
    e1, e2 = n1 * (a + b) / (n1 + n2), n2 * (a + b) / (n1 + n2)
    g = F.when((a > 0) & (b > 0), 2 * (a * F.ln(a / e1) + b * F.ln(b / e2))).otherwise(F.lit(0.0))
    return F.when(a * n2 < b * n1, -g).otherwise(g) if signed else g


def cloud_size(ll: Column) -> Column:
    """Word-cloud size: 100 for the largest, in proportion to the square root."""
    return F.sqrt(ll / F.max(ll).over(Window.partitionBy())) * 100


def golomb_parameter(df: Column, n: Column) -> Column:
    """Divisor for Golomb-coding the gaps of a term in df of n documents."""
    return F.ceil(F.lit(math.log(2)) * n / df).cast("long")
