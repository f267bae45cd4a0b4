"""Incremental frequencies: the counting of a corpus carried on as documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import stream


def stream_frequencies(docs: DataFrame, text: str = "text", arrived: str | None = None, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(value, cnt) of the words of a streaming frame, to be written in update or complete mode.

    With an event-time column arrived the counts are by window, and a window's state is dropped
    when rows are late by more than late; without one the vocabulary is the state.
    """
    if arrived:
        docs = docs.withWatermark(arrived, late)
    keys = [F.window(arrived, window).alias("window")] if arrived else []
    words = docs.select(*([arrived] if arrived else []), F.explode(stream(F.col(text))).alias("value")).filter("value IS NOT NULL")
    return words.groupBy(*keys, "value").agg(F.count("*").alias("cnt"))
