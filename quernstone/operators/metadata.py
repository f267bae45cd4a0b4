"""Metadata tables: every value a string, types guessed, values listed and numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import datable, intable, row_key
from quernstone.operators.tokens import numbered

#: Columns with fewer distinct values than this list them.
FACET_VALUES = 100


def as_strings(df: DataFrame, *columns: str) -> DataFrame:
    """The columns as strings, missing values empty; the others as they are."""
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def long_form(meta: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value): a row for each cell of the columns."""
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in columns))
    return meta.select(F.inline(cells))


def types(meta: DataFrame, columns: list[str]) -> DataFrame:
    """(name, type): boolean, int, date or string, by one aggregate over all cells.

    Boolean: the values are just 0 and 1, or these and the empty one. Else int or date if all are
    or are empty. A column without rows, or of empty values only, is int.
    """
    value = F.col("value")
    some = lambda v: F.max(value == v)
    facts = long_form(meta, columns).groupBy("name").agg(
        F.max(~value.isin("0", "1", "")).alias("other"), some("0").alias("zero"), some("1").alias("one"), F.min(intable(value)).alias("int"), F.min(datable(value)).alias("date")
    )
    kind = F.when(~F.col("other") & F.col("zero") & F.col("one"), "boolean").when(F.col("int"), "int").when(F.col("date"), "date").otherwise("string")
    names = meta.sparkSession.createDataFrame([(c,) for c in columns], "name string")
    return F.broadcast(names).join(facts.select("name", kind.alias("type")), "name", "left").select("name", F.coalesce("type", F.lit("int")).alias("type"))


def facets(meta: DataFrame, columns: list[str], below: int = FACET_VALUES) -> DataFrame:
    """(name, n, values): distinct values of a column and, if there are few, the values in order.

    Distinct cells are ranked within their column before any list is made, so no list is long.
    """
    cells = long_form(meta, columns).distinct()
    n = cells.groupBy("name").agg(F.count("*").alias("n"))
    few = cells.join(n.filter(F.col("n") < below).select("name"), "name", "left_semi")
    lists = few.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("values"))
    names = meta.sparkSession.createDataFrame([(c,) for c in columns], "name string")
    out = F.broadcast(names).join(n, "name", "left").join(lists, "name", "left")
    return out.select("name", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.col("values")).alias("values"))


def dictionary(meta: DataFrame, column: str) -> DataFrame:
    """(value, code): sorted distinct values numbered from 0."""
    return numbered(meta.select(F.col(f"`{column}`").alias("value")).distinct(), [], "value", "code")


def encoded(meta: DataFrame, columns: list[str]) -> DataFrame:
    """meta with each of the columns replaced by its codes."""
    for c in columns:
        codes = dictionary(meta, c).withColumnsRenamed({"value": c, "code": f"_{c}"})
        meta = meta.join(codes, c).drop(c).withColumnRenamed(f"_{c}", c)
    return meta


def decoded(codes: DataFrame, columns: list[str], dictionaries: dict[str, DataFrame]) -> DataFrame:
    """The inverse of encoded, given each column's dictionary."""
    for c in columns:
        d = dictionaries[c].select(F.col("code").alias(c), F.col("value").alias(f"_{c}"))
        codes = codes.join(d, c).drop(c).withColumnRenamed(f"_{c}", c)
    return codes


def card(meta: DataFrame, doc_id: int, columns: list[str]) -> DataFrame:
    """(name, value) of one document."""
    return long_form(meta.filter(F.col("doc_id") == doc_id), columns)


def label(column: str) -> str:
    """How a column is headed: first letter large, the others small."""
    return column.capitalize()


#: A column is at most this wide unless the corpus says otherwise; one of width 0 takes the rest.
COLUMN_WIDTH = 200


def layout(columns: list[str], custom: dict | None = None, room: int = 1204) -> list[tuple[str, str, float]]:
    """(column, label, width) in a room of that width; custom has {column: {label, width}}."""
    custom = custom or {}
    each = min(COLUMN_WIDTH, room / max(1, len(columns)))
    taken = sum(c.get("width") or 0 for c in custom.values())

    def width(own: dict) -> float:
        if own.get("width") == 0:
            return max(COLUMN_WIDTH, room - taken)
        return own.get("width") or each

    return [(c, custom.get(c, {}).get("label") or label(c), float(width(custom.get(c, {})))) for c in columns]


def filled(template, values: dict[str, str]):
    """A card's template, nested lists and texts, with each "meta/column" replaced by the document's value.

    A column that the document lacks gives None.
    """
    if isinstance(template, str):
        return values.get(template[5:]) if template.startswith("meta/") else template
    return [filled(x, values) for x in template] if isinstance(template, list) else template


def key_index(meta: DataFrame, columns: list[str], to: str = "row") -> DataFrame:
    """(key, row): the least doc_id of each key that the columns make up."""
    return meta.select(row_key(columns).alias("key"), "doc_id").groupBy("key").agg(F.min("doc_id").alias(to))
