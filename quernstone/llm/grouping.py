"""Connected groups without all pairs: stars within buckets first, then only what stars left apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import Table, small


def components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) to (node, root): each node that has an edge, and its group's least node.

    Alternates large and small stars (Kiveris et al. 2014): log-many rounds, each of joins and
    minima only, so a node with very many edges is no list in one task. Every round ends in a
    written table. Nulls and self-edges are left out; repeated edges change nothing; no edges
    give no rows.
    """
    now = Table(
        edges.filter("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    seen = _mark(now.df)
    while seen[0]:
        e = now.df
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        merge = large.join(first, "hi").filter("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = Table(merge.union(first.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        was, seen = seen, _mark(new.df)
        now.drop()
        now = new
        if was == seen:
            break
    stars = now.df
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and sum of hashes of all edges: equal for equal sets."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


#: Members of a bucket that go to one task.
TOGETHER = 64


def _salts() -> Column:
    return F.ceil(F.col("n") / TOGETHER)


def _salted(rows: DataFrame) -> DataFrame:
    """Rows (bucket, node, n) of large buckets dealt to as many salts as their members need."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), _salts()))


def _for_salts(rows: DataFrame) -> DataFrame:
    """Rows (bucket, n) once for each salt of the bucket."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), _salts() - 1)))


def grouped(keys: DataFrame, near: Callable[[Column, Column], Column], verified: Callable[[DataFrame], DataFrame] | None = None, attrs: DataFrame | None = None, band: Callable[[Column], Column] | None = None) -> DataFrame:
    """Groups of nodes that meet in a bucket and are linked.

    keys: (bucket long, node long, probe boolean), shuffled once; without probe all nodes probe all
    their buckets. attrs: (node, attr), a row for each node; without it a node is its own attr.
    Two nodes are a candidate pair if they share a bucket, one of them probes it and
    near(attr, attr), which is symmetric, holds; verified takes pairs (a, b) and keeps the true ones.
    band(attr) is a whole number that differs by one at most wherever near holds: then only members
    of such bands are compared among themselves. Returns
    (node, root) for every node with a link; root is the least node reachable. Exactly the
    components of all true pairs:

    1. each bucket's least node is paired with the others (rows in proportion to members);
    2. buckets whose other members are now all in one group, or just one, are done, whatever their size;
    3. elsewhere the others are compared among themselves, in pairs of different groups only: rows are
       made for those outside a bucket's largest group, which may have nearly all members.

    Members of a large bucket are dealt to many tasks, and what they are joined with goes to each.
    """
    verified = verified or (lambda pairs: pairs)
    # keys are made and shuffled once, for the counts and for the members; most buckets have one member
    # and end here, most others two, whose pair their least and greatest node are
    keys = (keys if "probe" in keys.columns else keys.withColumn("probe", F.lit(True))).select("bucket", "node", "probe").repartition("bucket")
    counted = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("probe").alias("any")).filter("lo != hi AND any")
    shared = Table(keys.join(counted.drop("any").hint("shuffle_hash"), "bucket"), "buckets").df
    two = Table(shared.filter("n = 2 AND node = hi").select(F.col("hi").alias("a"), F.col("lo").alias("b")).distinct(), "twos").df
    members = shared.filter("n > 2").select("bucket", "node", "probe", "n")
    if attrs is None:
        members = members.withColumn("attr", F.col("node"))
        two = two.filter(near(F.col("a"), F.col("b")))
    else:
        # what nodes are compared by meets only those that share a bucket
        members = members.join(attrs, "node")
        of = lambda end: attrs.select(F.col("node").alias(end), F.col("attr").alias(f"attr_{end}"))
        two = two.join(of("b"), "b").join(of("a"), "a").filter(near(F.col("attr_a"), F.col("attr_b"))).select("a", "b")
    members = Table(members, "keys")
    heads = members.df.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.first("n").alias("n")).filter("head != last")
    kept = Table(_salted(members.df).join(_for_salts(heads).select("bucket", "salt", "head"), ["bucket", "salt"]), "keys")
    heads = kept.df.filter("node = head").groupBy("bucket").agg(F.min("attr").alias("head_attr"), F.first("n").alias("n"))
    stars = kept.df.filter("node != head").join(_for_salts(heads).drop("n"), ["bucket", "salt"]).filter(near(F.col("attr"), F.col("head_attr")))
    pairs = Table(stars.select(F.col("node").alias("a"), F.col("head").alias("b")).union(two).distinct(), "stars")
    first = Table(components(verified(pairs.df)), "groups")
    k = kept.df.join(first.df.withColumnsRenamed({"root": "g"}), "node", "left").withColumn("g", F.coalesce("g", "node"))
    # a bucket's least node has been compared with all of it: what is left are the others
    rest = Table(k.filter("node != head").drop("head"), "rest")
    mixed = rest.df.groupBy("bucket").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.first("n").alias("n")).filter("g0 != g1")
    left = Table(rest.df.join(_for_salts(mixed).select("bucket", "salt"), ["bucket", "salt"], "left_semi"), "mixed").df
    # of two nodes of different groups one at least isn't in the bucket's largest group: salts are for those
    # others of a band, however large that group; who is near one of them is in its band or beside it
    sizes = left.groupBy("bucket", "g").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("c", "g")).alias("m")).select("bucket", F.col("m.g").alias("largest"))
    left = left.drop("salt", "n").withColumn("band", band(F.col("attr")) if band else F.lit(0)).join(largest, "bucket")
    left = left.withColumn("other", F.col("g") != F.col("largest")).drop("largest")
    others = left.filter("other").groupBy("bucket", "band").agg(F.count("*").alias("n"))
    p = _salted(left.filter("other").join(others, ["bucket", "band"])).select("bucket", "band", "salt", F.col("node").alias("a"), F.col("attr").alias("attr_a"), F.col("g").alias("ga"), F.col("probe").alias("probe_a"))
    beside = left.withColumn("band", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1))))) if band else left
    q = _for_salts(beside.join(others, ["bucket", "band"])).select("bucket", "band", "salt", F.col("node").alias("b"), F.col("attr").alias("attr_b"), F.col("g").alias("gb"), F.col("probe").alias("probe_b"), F.col("other").alias("other_b"))
    # of two others one order is enough
    once = (F.col("ga") != F.col("gb")) & (F.col("probe_a") | F.col("probe_b")) & ((F.col("a") > F.col("b")) | ~F.col("other_b"))
    apart = p.join(q, ["bucket", "band", "salt"]).filter(once).filter(near(F.col("attr_a"), F.col("attr_b")))
    # a pair that was verified as a star and failed needs no second look; both orders are one pair
    apart = apart.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(pairs.df, ["a", "b"], "left_anti")
    fresh = Table(verified(Table(apart, "apart").df).select("a", "b"), "links")
    if fresh.df.isEmpty():
        return first.df
    label = first.df.withColumnsRenamed({"node": "n", "root": "g"})
    lift = lambda df, c: df.join(label, F.col(c) == F.col("n"), "left").withColumn(c, F.coalesce("g", c)).drop("n", "g")
    more = Table(components(lift(lift(fresh.df, "a"), "b")), "groups")
    merged = more.df.withColumnsRenamed({"node": "g", "root": "r"})
    alone = more.df.join(first.df.select("node"), "node", "left_anti").select("node", "root")
    return first.df.join(merged, F.col("root") == F.col("g"), "left").select("node", F.coalesce("r", "root").alias("root")).union(alone)
