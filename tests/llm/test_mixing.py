import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quernstone.llm import mixing as M


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, bound = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in bound)
        free = [s for s in names if s not in bound]
        w = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 3 * sizes[s]]
        if not over:
            return {s: 3.0 * sizes[s] if s in bound else rest * weight[s] / w for s in names}
        bound |= set(over)


def h(doc_id, text):
    return int(hashlib.md5((str(doc_id) if doc_id is not None else "t" + (text or "")).encode()).hexdigest()[:15], 16)


def check(rows, got):
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    target = brute_targets(sizes)
    want = []
    for s in sizes:
        own = sorted((h(r[0], r[1]), r[0], size(r[1])) for r in rows if r[3] == s) if True else []
        copies = int(target[s] // sizes[s]) if sizes[s] else 0
        left, edge, with_edge, upto = target[s] - copies * sizes[s], None, False, 0
        for k in sorted({x[0] for x in own}):
            group = sum(x[2] for x in own if x[0] == k)
            if upto + group > left:
                edge, with_edge = k, group - (left - upto) < left - upto
                break
            upto += group
        for k, doc_id, n in own:
            more = edge is not None and (k < edge or (k == edge and with_edge))
            want.append((doc_id, s, n, sizes[s], round(target[s], 6), n * (copies + more)))
    assert sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == sorted(want, key=str)


def plain(rows):
    return [(r[0] if r[0] is not None else None, *r[1:]) for r in rows]


def test_mix(docs, rows):
    # ids of mixed type can't be sorted: give null ids a number of their own for the brute force only
    out = M.mix(docs).collect()
    ids = [r for r in rows if r[0] is not None]
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    target = brute_targets(sizes)
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    largest = {s: max(len((r[1] or "").split()) for r in rows if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes) and ids
    assert sorted(out, key=str) == sorted(M.mix(docs.repartition(5)).collect(), key=str)


@pytest.mark.parametrize("level_bits", [12, 2])
def test_against_brute_force(spark, rows, monkeypatch, level_bits):
    monkeypatch.setattr(M, "LEVEL_BITS", level_bits)
    some = [r for r in rows if r[0] is not None and r[0] not in (7, 8)]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string, source string")
    check(some, M.mix(df).collect())


def test_sql_twin(spark, rows):
    some = [r for r in rows if r[0] is not None and r[0] not in (7, 8)]
    df = spark.createDataFrame(some, "doc_id long, text string, lang string, source string").toPandas()
    c = duckdb.connect()
    c.register("documents", df)
    want = sorted((a, b, d, round(t, 6), k) for a, b, d, t, k in c.sql(M.ORACLE).fetchall())
    got = M.mix(spark.createDataFrame(some, "doc_id long, text string, lang string, source string"))
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got.collect()) == want


def test_resample(docs):
    out = M.resample(docs)
    assert out.columns == docs.columns
    want = M.mix(docs).filter("size > 0").groupBy("doc_id", "source", "size").agg(F.sum(F.col("taken") / F.col("size")).alias("n")).filter("n > 0")
    got = out.withColumn("size", M.words_in("text")).filter("size > 0").groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((a, b, c, int(n)) for a, b, c, n in want.collect()), key=str)


def test_targets_stop_and_share(spark):
    for sizes in ({"a": 1, "b": 100, "c": 1, "d": 50}, {"a": 10}, {"a": 0, None: 0}, {"a": 5, "b": 0, None: 7}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: round(r.target, 9) for r in M.targets(df).collect()}
        assert got == {s: round(t, 9) for s, t in brute_targets(sizes).items()}


def test_empty(empty):
    assert M.mix(empty).count() == 0 and M.resample(empty).count() == 0
