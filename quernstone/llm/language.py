"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is the product (binding) of its
letters' vectors, rotated (permuted) by their place; a document is the sum (bundle) of its
trigrams, a language the sum of its documents. A document's language is the prototype with the
largest cosine. Sums are of whole numbers, so no order of adding changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import crc_mod, read, spread

DIM = 2048
SEED = 42
FOLDS = 3
HELD_OUT = 1
#: A prototype of each language goes to every task: 16 KB each, so 4,096 bound that at 64 MB.
MOST_LANGUAGES = 4096
_SEP = 32
_SLICE = 1 << 20
_BATCH_CHARS = 1 << 18
_BATCH_DOCS = 64
_GRAMS = 4096


@lru_cache(1)
def _alpha() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(65536)
def letter(code: int, dim: int) -> np.ndarray:
    """The letter's vector: +1 and -1 from a generator seeded with its code point."""
    return (np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, dim, np.int8) * 2 - 1).astype(np.int8)


def _pieces(text: str) -> Iterator[np.ndarray]:
    """The text's letters in lower case with single separators between words and at both ends.

    Long texts come in slices, each but the first with the two symbols before it, so the
    trigrams of all slices are those of the text.
    """
    tail = np.array([_SEP], np.uint32)
    for at in range(0, len(text), _SLICE):
        codes = np.frombuffer(text[at : at + _SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_alpha()[codes], codes, _SEP).astype(np.uint32)
        if at + _SLICE >= len(text):
            codes = np.append(codes, np.uint32(_SEP))
        codes = np.concatenate([tail, codes])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != _SEP) | (codes[:-1] != _SEP)
        codes = codes[keep]
        yield codes
        tail = codes[-2:]


def bundles(texts: list[str | None], dim: int = DIM, group: np.ndarray | None = None, groups: int = 0) -> np.ndarray:
    """A row for each text, or for each group of texts: the sum of its trigram vectors."""
    group = np.arange(len(texts)) if group is None else group
    out = np.zeros((groups or len(texts), dim), np.float64)
    held: list[np.ndarray] = []
    rows: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, rows, size
        if held:
            _add(out, held, np.array(rows), dim)
        held, rows, size = [], [], 0

    for text, row in zip(texts, group.tolist(), strict=True):
        for codes in _pieces(text) if text else ():
            held.append(codes)
            rows.append(row)
            size += len(codes)
            if size >= _BATCH_CHARS or len(held) >= _BATCH_DOCS:
                flush()
    flush()
    return out


def _add(out: np.ndarray, pieces: list[np.ndarray], rows: np.ndarray, dim: int) -> None:
    codes = np.concatenate(pieces)
    piece = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
    present = np.zeros(0x110000, bool)
    present[codes] = True
    letters = np.flatnonzero(present)
    index = np.zeros(0x110000, np.int64)
    index[letters] = np.arange(len(letters))
    at, n = index[codes], len(letters)
    grams = (at[:-2] * n + at[1:-1]) * n + at[2:]
    whole = piece[:-2] == piece[2:]
    grams, piece = grams[whole], piece[:-2][whole]
    if not len(grams):
        return
    if n**3 <= 1 << 22:
        there = np.zeros(n**3, bool)
        there[grams] = True
        known = np.flatnonzero(there)
        place = np.zeros(n**3, np.int64)
        place[known] = np.arange(len(known))
        gram = place[grams]
    else:
        known, gram = np.unique(grams, return_inverse=True)
    near, slot = np.unique(rows, return_inverse=True)
    vectors = np.stack([letter(int(c), dim) for c in letters])
    once, twice = np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)
    order = np.argsort(gram, kind="stable") if len(known) > _GRAMS else None
    owner = slot[piece]
    for start in range(0, len(known), _GRAMS):
        some = known[start : start + _GRAMS]
        if order is None:
            g, o = gram, owner
        else:
            part = order[np.searchsorted(gram, start, sorter=order) : np.searchsorted(gram, start + len(some), sorter=order)]
            g, o = gram[part] - start, owner[part]
        counts = np.bincount(o * len(some) + g, minlength=len(near) * len(some)).reshape(len(near), len(some)).astype(np.float32)
        bound = twice[some // (n * n)] * once[some // n % n] * vectors[some % n]
        out[near] += counts @ bound.astype(np.float32)


def prototypes(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their bundles, from all rows of docs (text, lang).

    Each task sums its rows by language; only those sums are shuffled.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            names, group = np.unique(pdf["lang"].to_numpy(str), return_inverse=True)
            for name, row in zip(names.tolist(), bundles(pdf["text"].tolist(), dim, group, len(names)), strict=True):
                sums[name] = sums[name] + row if name in sums else row
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [x.astype(np.int64) for x in sums.values()]})

    partial = spread(docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")).mapInPandas(run, "lang string, v array<long>")
    rows = partial.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    lists = rows.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(lists) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return [r["lang"] for r in lists], np.array([r["v"] for r in lists], np.float64).reshape(len(lists), dim)


def predict(docs: DataFrame, languages: list[str], sums: np.ndarray, dim: int = DIM) -> DataFrame:
    """Adds lang_pred and score to docs (text, ...); only text is looked at.

    A text that is null or has no letter gets und and score 0. Of languages that are equally near
    the first in the given order is taken. Columns of these names are replaced, all others kept,
    whatever their names; repeated rows stay repeated, no rows give no rows.
    """
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.divide(sums, length, out=np.zeros_like(sums), where=length > 0)

    @F.pandas_udf("struct<lang_pred string, score double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for at in range(0, len(texts), 1024):
            v = bundles([t if isinstance(t, str) else None for t in texts.iloc[at : at + 1024]], dim)
            size = np.sqrt((v * v).sum(axis=1))
            some = (size > 0) & (len(languages) > 0)
            cosine = v @ unit.T / np.where(size > 0, size, 1)[:, None] if languages else np.zeros((len(v), 1))
            best = cosine.argmax(axis=1)
            names += [languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
            scores.append(np.where(some, np.clip(cosine[np.arange(len(v)), best], 0, 1), 0.0))
        return pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else []})

    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(whole.alias("row"), run(F.col("text").cast("string")).alias("p")).select(*kept, "p.lang_pred", "p.score")


def identify(docs: DataFrame, dim: int = DIM, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Documents (doc_id, text, lang, ...) to (doc_id, held_out, lang_pred, score).

    Prototypes come from every row with a lang whose crc32 of doc_id modulo folds is not held_out;
    a null doc_id is in no fold and not learnt from. lang_pred is one of the learnt lang values
    (the first in code-point order on a tie), or und with score 0 if the text is null, has no
    letter, or no language was learnt. score is the cosine, 0 to 1. Whole texts are read. One
    row for each input row; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    fold = crc_mod("doc_id", folds)
    languages, sums = prototypes(rows.filter(fold != held_out), dim)
    out = predict(spread(rows.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "text")), languages, sums, dim)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
