import numpy as np
import xxhash
from pyspark.sql import functions as F

from quernstone.llm import grouping, simhash
from quernstone.llm.grouping import components, grouped

SPACE = " \t\n\x0b\f\r"


def brute_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in SPACE else c for c in low).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs, rows, groups):
    fps = [brute_fingerprint(r[1]) for r in rows]
    for a in set(fps):
        for b in set(fps):
            if (a ^ b).bit_count() <= 2:
                groups.join(a, b)
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            g = groups.find(f)
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted(((r[0], f"{f:016x}", least.get(groups.find(f))) for r, f in zip(rows, fps, strict=True)), key=str)
    got = sorted((tuple(x) for x in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == want


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_only_null_ids(docs):
    assert simhash.near_duplicates(docs.filter("doc_id IS NULL")).filter("component_id IS NOT NULL").count() == 0


def test_golay_code():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 3000)
    all_keys, new = simhash.golay_keys(words)
    keys = [k[n] for k, n in zip(all_keys, new, strict=True)]
    assert {len(k) for k in keys} == {1, 6} and all(k[0] == a[0] for k, a in zip(keys, all_keys, strict=True))
    codes = np.unique(simhash.codeword_index(np.arange(1 << 16)))
    assert codes.min() >= 0 and codes.max() < 4096
    for bit in range(23):
        near = simhash.codeword_index(words ^ (1 << bit))
        assert all(n in k for n, k in zip(near, keys, strict=True))


def test_every_pair_within_two_bits_meets(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 62, 40)
    fps = {int(c) for c in centre}
    for c in centre:
        for _ in range(12):
            a, b = rng.integers(0, 63, 2)
            fps.add(int(c) ^ (1 << int(a)) ^ (1 << int(b)))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    keys = df.mapInPandas(simhash._buckets, "bucket long, node long, probe boolean")
    got = {r.node: r.root for r in grouped(keys, simhash._near).collect()}
    from tests.llm.conftest import Groups

    want = Groups()
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                want.join(a, b)
    for x in fps:
        assert got.get(x, x) == want.find(x)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (200, 50)] + [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == 0 and got[101] == 100 and all(got[1000 + i] == 1000 for i in range(300))
    assert components(df.filter(F.lit(False))).count() == 0


def test_a_large_group_is_not_compared_with_itself(spark, monkeypatch):
    """A bucket's nodes that are all but few in one group already: rows are made for the few."""
    made = []
    salts = grouping._for_salts
    monkeypatch.setattr(grouping, "_for_salts", lambda rows: made.append(salts(rows)) or made[-1])
    many = list(range(10_000, 11_000))
    rows = [(1, x) for x in [0, *many, 20_000, 20_001, 30_000]] + [(2, x) for x in many] + [(3, x) for x in (5, 30_000, 40_000)]
    keys = spark.createDataFrame(rows, "bucket long, node long")
    of = lambda x: F.floor(x / 10_000) + F.when(x >= 30_000, 30_000).otherwise(0)
    got = {r.node: r.root for r in grouped(keys, lambda a, b: of(a) == of(b), band=of).collect()}
    assert got == {x: 10_000 for x in many} | {20_000: 20_000, 20_001: 20_000}
    assert made[-1].count() <= 2 * len(rows)


def test_groups_of_random_buckets(spark):
    rng = np.random.default_rng(11)
    held = sorted(set(zip(rng.integers(0, 6, 900).tolist(), rng.integers(0, 400, 900).tolist(), strict=True)))
    near = lambda a, b: (a + b) % 97 < 3
    from tests.llm.conftest import Groups

    want, linked = Groups(), set()
    for b, x in held:
        for c, y in held:
            if b == c and x < y and near(x, y):
                want.join(x, y)
                linked |= {x, y}
    got = grouped(spark.createDataFrame(held, "bucket long, node long"), near)
    assert {r.node: r.root for r in got.collect()} == {x: want.find(x) for x in linked}
