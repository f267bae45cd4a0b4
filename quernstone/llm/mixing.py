"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Each document has a 60-bit hash of its id. A source that is to give k and a fraction of its words
gives every document k times, and once more those under a hash threshold. The threshold comes from
sums by source and hash bucket: the bucket where the budget ends is cut into smaller buckets, on
its own rows alone, until it holds one hash. Documents are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import Table, read

WEIGHTS = (5, 2, 1)
MOST = 3
HASH_BITS = 60
LEVEL_BITS = 12
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: str, text: str) -> Column:
    """60 bits of the MD5 of the id as text; a null id has those of its text instead."""
    of = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t"), F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(of), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Weights go round the sources in code-point order, null last. Shares of all words stop at most
    times a source's words and the excess is shared again: with sources in rising order of
    bound by weight, the bounded ones are those whose bound is under the level that the rest
    would then share. Works on one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
    s = s.withColumn("bound", F.col("source_size") * most)
    up = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0)))
    s = s.withColumn("open", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("rest") / F.col("open"))
    # the first source at or over its level, and all after it, share that level
    first = F.first(F.when(F.col("bound") >= F.col("w") * F.col("level"), F.col("level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("shared", first).select("source", "source_size", F.when(F.col("shared").isNull(), F.col("bound").cast("double")).otherwise(F.col("w") * F.col("shared")).alias("target"))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Sizes and hashes of all documents, and a row for each source with what it gives:
    (key, source_size, target, copies, edge, with_edge); see copies."""
    rows = docs.select("doc_id", "source", words_in("text").alias("size"), hash60("doc_id", "text").alias("h"))
    sized = Table(rows.withColumn("key", _key()), "sizes").df
    per = Table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets").df
    per = per.withColumn("key", _key()).withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per = per.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    cut = _thresholds(sized, per.select("key", "budget"))
    return sized, Table(per.join(cut, "key", "left").select("key", "source_size", "target", "copies", "edge", "with_edge"), "plan").df


def copies(h: str, of: str = "") -> Column:
    """How often a document with hash h is taken, by its source's row of the plan."""
    edge = F.col(f"{of}edge")
    once_more = F.coalesce((F.col(h) < edge) | ((F.col(h) == edge) & F.col(f"{of}with_edge")), F.lit(False))
    return F.col(f"{of}copies") + once_more.cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Documents (doc_id, text, source, ...) to (doc_id, source, size, source_size, target, taken).

    taken is size times the copies that the mix takes, 0 to most of them. A source's taken words
    are within half a document of its target (half a group, where rows share a doc_id: they share
    its hash and are taken or left together). Null text has size 0; null source is a source of its
    own; without words all targets are 0. No rows give no rows. Other columns are ignored.
    """
    sized, per = plan(docs, weights, most)
    return sized.join(per, "key").select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies("h")).alias("taken"))


def resample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: the rows of docs, each as often as mix takes it, with their columns, whatever their names."""
    _, per = plan(docs, weights, most)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    out = docs.select(whole.alias("row"), hash60("doc_id", "text").alias("h"), _key().alias("key")).join(per, "key")
    times = F.explode(F.array_repeat(F.lit(1), copies("h").cast("int")))
    return out.select("row", times.alias("one")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(key, edge, with_edge): hashes below edge fit the budget, the edge itself if that is nearer."""
    rows, state, shift = sized, budgets, HASH_BITS
    while True:
        shift -= LEVEL_BITS
        bucket = F.shiftright("h", shift)
        sums = rows.groupBy("key", bucket.alias("bucket")).agg(F.sum("size").alias("s"), F.min("h").alias("low"), F.max("h").alias("high"))
        w = Window.partitionBy("key").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("s").over(w)).join(state, "key").filter("upto > budget")
        at = sums.groupBy("key").agg(F.min_by(F.struct("bucket", "s", "low", "high", "upto", "budget"), "bucket").alias("x"))
        edge = Table(at.select("key", "x.*").withColumn("budget", F.expr("budget - (upto - s)")), "edges").df
        if shift == 0 or not edge.filter("low != high").head(1):
            return edge.select("key", F.col("low").alias("edge"), (F.col("s") - F.col("budget") < F.col("budget")).alias("with_edge"))
        inside = rows.join(edge.select("key", "bucket"), "key").filter(bucket == F.col("bucket")).drop("bucket")
        rows, state = Table(inside, "boundary").df, edge.select("key", "budget")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 't' || coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w, source_size * 3 AS bound FROM s),
l AS (SELECT *, row_number() OVER up AS k,
        (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(bound) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW up AS (ORDER BY bound / w, source ASC NULLS LAST)),
f AS (SELECT min(k) AS k FROM l WHERE bound >= w * level),
t AS (SELECT l.source, l.source_size, CASE WHEN l.k < f.k THEN CAST(bound AS DOUBLE) ELSE w * (SELECT level FROM l, f WHERE l.k = f.k) END AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
c AS (SELECT d.doc_id, d.source, d.size, p.source_size, p.target, p.copies, p.target - p.copies * p.source_size AS budget,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
        sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
e AS (SELECT *, min(CASE WHEN upto > budget THEN upto END) OVER (PARTITION BY source) AS over_at FROM c)
SELECT doc_id, size, source_size, target,
  CAST(size * (copies + CASE WHEN upto <= budget AND over_at IS NOT NULL THEN 1
    WHEN upto = over_at AND own - (budget - (upto - own)) < budget - (upto - own) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""
