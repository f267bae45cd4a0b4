"""Phrases, filters, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import holds, phrase_terms
from quernstone.operators.metadata import dictionary
from quernstone.operators.tokens import words


def phrase_positions(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, start) of every place where the lemmata follow one another, overlaps included.

    Only rows with one of the lemmata are read on, and each is turned into the starts it
    speaks for; a start that all terms speak for is a hit. One shuffle, by document and start.
    """
    if not terms:
        return words(tokens).select("doc_id", F.col("pos").alias("start")).limit(0)
    places: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        places.setdefault(t, []).append(i)
    found = words(tokens).filter(F.col("lemma").isin(*places))
    if len(terms) == 1:
        return found.select("doc_id", F.col("pos").alias("start"))
    offsets = F.element_at(F.create_map(*(x for t, at in places.items() for x in (F.lit(t), F.array(*map(F.lit, at))))), F.col("lemma"))
    starts = found.select("doc_id", "pos", F.explode(offsets).alias("off")).select("doc_id", (F.col("pos") - F.col("off")).alias("start"))
    return starts.groupBy("doc_id", "start").agg(F.count("*").alias("n")).filter(F.col("n") == len(terms)).select("doc_id", "start")


def phrase_documents(tokens: DataFrame, phrase: str | None, documents: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(doc_id) of the documents, of within if given, that hold the phrase; of all without a phrase."""
    scope = (documents if within is None else within).select("doc_id")
    terms = phrase_terms(phrase)
    if not terms:
        return scope.distinct()
    hits = phrase_positions(tokens, terms).select("doc_id").distinct()
    return hits if within is None else hits.join(scope, "doc_id", "left_semi")


def _by_code(wanted) -> bool:
    return not isinstance(wanted, str) and bool(wanted) and all(isinstance(x, int) for x in wanted)


def condition(filters: dict | None) -> Column:
    """All filters by text or values at once; those by codes are left to filtered."""
    parts = []
    for column, wanted in (filters or {}).items():
        if isinstance(wanted, str):
            parts.append(holds(F.col(f"`{column}`").cast("string"), wanted))
        elif not _by_code(wanted):
            parts.append(F.col(f"`{column}`").isin(*wanted) if wanted else F.lit(False))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filtered(rows: DataFrame, filters: dict | None, columns: list[str] | None = None) -> DataFrame:
    """Rows that pass all filters. A text is sought in the values whatever its case; a set holds
    values, or codes of the column's sorted distinct values; the empty set matches nothing.

    Codes are those of all of rows, whatever the other filters; they are joined as a dictionary.
    Unknown columns fail.
    """
    for column in filters or {}:
        if column not in (rows.columns if columns is None else columns):
            raise ValueError(f"no column {column}")
    out = rows.filter(condition(filters))
    for column, wanted in (filters or {}).items():
        if _by_code(wanted):
            values = dictionary(rows, column).filter(F.col("code").isin(*wanted)).select(F.col("value").alias(column))
            out = out.join(values, column, "left_semi")
    return out


def page(df: DataFrame, offset: int = 0, limit: int = 10) -> DataFrame:
    return df.orderBy("doc_id").offset(max(0, offset)).limit(limit)


def page_of(number: int, rows: int) -> tuple[int, int]:
    """Offset and limit of a page, from 0."""
    return max(0, number) * rows, rows


def with_text(filters: dict, column: str, text: str) -> dict:
    """Filters with a text sought in a column; the empty text lifts the column's filter."""
    return {**{c: f for c, f in filters.items() if c != column}, **({column: text} if text else {})}


def with_all(filters: dict, column: str) -> dict:
    """Filters that let every value of a column pass."""
    return {c: f for c, f in filters.items() if c != column}


def with_none(filters: dict, column: str) -> dict:
    """Filters that let no value of a column pass."""
    return {**filters, column: set()}


def toggled(filters: dict, column: str, value, values: list) -> dict:
    """Filters with one value of a column switched; values are all it has, which pass if none is filtered."""
    now = filters.get(column)
    chosen = set(values) if now is None or isinstance(now, str) else set(now)
    return {**filters, column: chosen ^ {value}}
