"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Of at most two differing bits,
some segment has none and the next one round has at most one (pigeonhole). A bucket is the
first segment's bits with a codeword index of the next: a word is filed under the codewords
that any word within one bit of it decodes to (six of them, or one near a codeword) and probes
under its own, so words one bit apart always meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import Table, ascii_words, dealt, spread
from quernstone.llm.grouping import grouped

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Low bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of a whole text's word shingles, repeats included.

    Fewer words than a shingle: their whole sequence is the one shingle. No words, or no text:
    zero. A bit is 1 if more than half of the shingles' XXH64 have it.
    """
    words = ascii_words(text)
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    bits = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    for at in range(0, n, _BLOCK):
        block = b"".join([digest(join(words[i : i + width]), SEED) for i in range(at, min(n, at + _BLOCK))])
        bits += np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big", signed=True)


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each 23-bit position, and the correction of each of the 2,048 syndromes."""
    rows = []
    for bit in range(23):
        r = 1 << bit
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        rows.append(r)
    syndromes, fix = np.array(rows, np.int64), np.zeros(2048, np.int64)
    for i in range(23):
        fix[rows[i]] = 1 << i
        for j in range(i):
            fix[rows[i] ^ rows[j]] = 1 << i | 1 << j
            for k in range(j):
                fix[rows[i] ^ rows[j] ^ rows[k]] = 1 << i | 1 << j | 1 << k
    return syndromes, fix


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4,095) of the one codeword within three bits of each 23-bit word."""
    return (words ^ _golay()[1][_syndrome(words)]) >> 11


def _syndrome(words: np.ndarray) -> np.ndarray:
    s = np.zeros_like(words)
    for bit, syndrome in enumerate(_golay()[0]):
        s ^= np.where(words >> bit & 1, syndrome, 0)
    return s


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its 24 codeword indices within one bit, its own first, and which of them are new."""
    keys = np.stack([codeword_index(words)] + [codeword_index(words ^ (1 << b)) for b in range(23)], axis=1)
    order = np.argsort(keys, axis=1, kind="stable")
    ordered = np.take_along_axis(keys, order, 1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    new = np.zeros(keys.shape, bool)
    np.put_along_axis(new, order, fresh, 1)
    return keys, new


def decoded(margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of 23 margins (bit set if positive, surer the larger) to codeword indices.

    Of the codewords within one bit's decoding the first is the one that disagrees with the
    smallest margins in sum (the lower index of equals), the second the next; the third array is
    by how much it disagrees more, at most 2^31 - 1. Without a second, that and the first itself.
    """
    _, fix = _golay()
    place = 1 << np.arange(23)
    words = (margins > 0) @ place
    near = np.stack([words] + [words ^ (1 << b) for b in range(23)], axis=1)
    code = near ^ fix[_syndrome(near)]
    index = code >> 11
    cost = np.zeros(code.shape, np.int64)
    weight = np.abs(margins)
    for bit in range(23):
        cost += ((code ^ words[:, None]) >> bit & 1) * weight[:, bit : bit + 1]
    ranked = cost << 12 | index
    best = ranked.min(axis=1)
    ranked[index == (best & 4095)[:, None]] = np.iinfo(np.int64).max
    second = ranked.min(axis=1)
    none = second == np.iinfo(np.int64).max
    gap = np.where(none, (1 << 31) - 1, np.minimum((second >> 12) - (best >> 12), (1 << 31) - 1))
    return best & 4095, np.where(none, best, second) & 4095, gap


def _buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp = pdf["fp"].to_numpy(np.int64)
        unsigned = fp.view(np.uint64)
        part = [((unsigned >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
        for family in range(3):
            keys, new = golay_keys(part[(family + 1) % 3])
            head = np.int64(family) << 34 | part[family] << 12
            own = np.zeros(keys.shape, bool)
            own[:, 0] = True
            nodes = np.broadcast_to(fp[:, None], keys.shape)[new]
            yield pd.DataFrame({"bucket": (head[:, None] | keys)[new], "node": nodes, "probe": own[new]})


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for every row of docs."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": [fingerprint(t, width) for t in pdf["text"]]})

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInPandas(run, "doc_id long, fp long")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """Documents (doc_id, text, ...) to (doc_id, fp long, fingerprint, component_id).

    One row for each input row; other columns are ignored, whatever their names. Documents are
    linked if their fingerprints differ in at most two bits; component_id is the smallest doc_id
    reachable. Equal fingerprints are one node, so copies make no pairs. Null or empty text has
    fingerprint zero and is linked like any other. A null doc_id stays null; a group of only
    such rows has a null component_id. Repeated rows stay repeated. No rows give no rows.
    """
    fp = Table(fingerprints(docs, width), "fingerprints").df
    nodes = fp.groupBy("fp").agg(F.min("doc_id").alias("least"))
    keys = Table(dealt(nodes.select("fp"), "fp").mapInPandas(_buckets, "bucket long, node long, probe boolean"), "codewords").df
    roots = Table(grouped(keys, _near), "roots").df
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    component = labelled.join(first, "root").select("fp", "component_id")
    return fp.join(component, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    from quernstone.llm.common import read

    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
