"""Token and text expressions. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A chunk falls into runs of letters and ASCII digits, and runs of everything else.
RUNS = r"[\p{L}0-9]+|[^\p{L}0-9]+"
#: Only these separate chunks; a tab or no-break space does not.
SEPARATORS = "[ \n]+"


def stream(text: Column) -> Column:
    """array<string> of a text node: its runs in order, with null (no space) between runs of a chunk."""
    runs = lambda chunk: F.regexp_extract_all(chunk, F.lit(RUNS), F.lit(0))
    marked = lambda s, i: F.when(i == 0, F.array(s)).otherwise(F.array(F.lit(None).cast("string"), s))
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda c: F.flatten(F.transform(runs(c), marked))))


def alnum(word: Column) -> Column:
    """Holds a letter or an ASCII digit."""
    return word.rlike(r"[\p{L}0-9]")


def holds(value: Column, part: str) -> Column:
    """Case-insensitive substring; % and _ are plain signs, the empty part is in every value."""
    return F.contains(F.lower(value), F.lit(part.lower()))


def phrase_terms(phrase: str | None) -> list[str] | None:
    """Terms of a phrase: cut at single spaces, trailing empty ones dropped.

    None for no phrase at all; a leading or double space gives an empty term, which nothing
    matches; only spaces give no terms.
    """
    if not phrase:
        return None
    terms = phrase.split(" ")
    while terms and not terms[-1]:
        terms.pop()
    return terms


def as_int(value: Column) -> Column:
    """The value as a 32-bit integer, null if it isn't one. Signs are allowed, spaces are not."""
    return F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("int"))


def intable(value: Column) -> Column:
    return (value == "") | as_int(value).isNotNull()


def datable(value: Column) -> Column:
    """Looks like a date; the calendar isn't asked."""
    return (value == "") | value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def drop_ext(name: Column) -> Column:
    """File name up to its first dot."""
    return F.regexp_replace(name, r"\..*", "")


def row_key(columns: list[str], sep: str = "/") -> Column:
    """The columns' values as one text; missing ones are left out."""
    return F.concat_ws(sep, *(F.col(f"`{c}`") for c in columns))


def absolute(prefix: str, name: Column) -> Column:
    return F.when(name.startswith("/"), name).otherwise(F.concat(F.lit(prefix.rstrip("/") + "/"), name))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the input's splits are fewer than the cores; else nothing is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Bytes of small files that one task reads.
GATHERED_BYTES = 16 << 20


def gathered(df: DataFrame) -> DataFrame:
    """A scan of many small files in fewer tasks: Spark takes each file for some MB and gives a task a few."""
    parts = df.rdd.getNumPartitions()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, size // GATHERED_BYTES, parts // 1000)
    return df.coalesce(tasks) if tasks < parts else df


def applied(df: DataFrame, *steps) -> DataFrame:
    """The frame after the given steps in turn; None steps are skipped."""
    for step in steps:
        df = df.transform(step) if step else df
    return df
