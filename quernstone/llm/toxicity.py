"""Toxicity grades by cumulative-link (ordered logit) regression on sparse word features.

P(grade > k) = sigmoid(w.x - b_k): one weight for each word, shared by all thresholds, and rising
thresholds b_k. x has a 1 for each distinct word of the whole text that the model knows. The
expected severity is the sum of P(grade > k) over the thresholds, in units of the grades' ranks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import Table, read, spread

#: Labelled rows that the model is fitted on: those with the smallest hashes of their ids.
SAMPLE = 8192
#: A word is a feature if this many sampled documents have it and their mean grade is this many
#: standard errors from the mean of all: words that go with the grade by chance stay out.
LEAST_DOCS = 5
LEAST_Z = 6.0
MOST_FEATURES = 4096
RIDGE = 0.002
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """Distinct runs of letters of a whole text, in lower case."""
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: dict[str, float]
    thresholds: np.ndarray

    def severity(self, text: str | None) -> float:
        """Expected rank of the grade, 0 to len(grades) - 1."""
        known = self.weights.keys() & words(text)
        x = sum(sorted(self.weights[w] for w in known))
        return float((1 / (1 + np.exp(np.clip(self.thresholds - x, -700, 700)))).sum())


def moments(ranks: list[int]) -> tuple[float, float]:
    return float(np.mean(ranks)), float(np.std(ranks))


def fit(sample: list[tuple[int, set[str]]], steps: int = 800) -> OrdinalModel:
    """Model of (grade, feature words) rows: maximum likelihood with a small ridge on the weights, by Adam from zero weights.

    No rows, or rows of one grade, give a model without thresholds: severity 0 for every text.
    """
    sample = sorted(((g, sorted(w)) for g, w in sample))
    grades = sorted({g for g, _ in sample})
    if len(grades) < 2:
        return OrdinalModel(grades, {}, np.zeros(0))
    y = np.array([grades.index(g) for g, _ in sample])
    names = sorted(set().union(*(w for _, w in sample)))
    place = {w: j for j, w in enumerate(names)}
    # x as its ones: row and column of each
    row = np.repeat(np.arange(len(y)), [len(ws) for _, ws in sample])
    column = np.array([place[w] for _, ws in sample for w in ws], np.int64)
    k = len(grades) - 1
    share = np.array([(y > j).mean() for j in range(k)])
    # thresholds are the first plus positive steps, which keeps them in order
    first = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(len(names)), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        w, gaps = p[: len(names)], np.exp(p[len(names) + 1 :])
        b = np.concatenate([[-np.inf], p[len(names)] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
        s = np.bincount(row, w[column], len(y))
        over = lambda c: 1 / (1 + np.exp(np.clip(c - s, -700, 700)))  # noqa: E731  P(grade > its index)
        lo, hi = over(b[y]), over(b[y + 1])
        prob = np.maximum(lo - hi, 1e-12)
        dlo, dhi = lo * (1 - lo), hi * (1 - hi)
        gw = -np.bincount(column, ((dlo - dhi) / prob)[row], len(names)) / len(y) + RIDGE * w / len(y)
        gb = np.zeros(k + 2)
        np.add.at(gb, y, dlo / prob)
        np.add.at(gb, y + 1, -dhi / prob)
        gb = gb[1:-1] / len(y)
        g = np.concatenate([gw, [gb.sum()], np.array([gb[j + 1 :].sum() for j in range(k - 1)]) * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    gaps = np.exp(p[len(names) + 1 :])
    return OrdinalModel(grades, dict(zip(names, p[: len(names)].tolist(), strict=True)), p[len(names)] + np.concatenate([[0.0], np.cumsum(gaps)]))


def learn(docs: DataFrame, labels: DataFrame, grade: str = "toxic", sample: int = SAMPLE) -> OrdinalModel:
    """Model from at most sample labelled documents; only words that pass the screen reach the driver.

    Null ids and grades are left out. Of repeated labels of an id the least grade counts, of
    repeated documents the least text.
    """
    known = labels.filter(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(grade).cast("int").alias("grade"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most sample rows of two numbers: small by construction
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def split(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "grade": pdf["grade"], "words": [sorted(words(t)) for t in pdf["text"]]})

    bags = Table(rows.mapInPandas(split, "doc_id long, grade int, words array<string>"), "bags").df
    counts = {r["grade"]: r["n"] for r in bags.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return fit([(g, set()) for g in counts])
    ranks = {g: i for i, g in enumerate(sorted(counts))}
    mean, sd = moments([ranks[g] for g in counts for _ in range(counts[g])])
    rank = F.element_at(F.create_map(*(F.lit(x) for g in ranks for x in (g, ranks[g]))), F.col("grade"))
    per = bags.select(F.explode("words").alias("word"), rank.alias("rank")).groupBy("word").agg(F.count("*").alias("n"), F.avg("rank").alias("mean"))
    z = F.abs(F.col("mean") - mean) * F.sqrt("n") / sd
    names = [r["word"] for r in per.filter((F.col("n") >= LEAST_DOCS) & (z >= LEAST_Z)).orderBy(z.desc(), "word").limit(MOST_FEATURES).collect()]
    seen = bags.select("doc_id", "grade", F.array_intersect("words", F.array(*map(F.lit, names)).cast("array<string>")).alias("words"))
    return fit([(r["grade"], set(r["words"])) for r in seen.collect()])


def graded(docs: DataFrame, model: OrdinalModel, text: str = "text", to: str = "severity") -> DataFrame:
    """Adds the expected severity of every row's whole text; null and empty texts have the base rate.

    Equal texts get equal numbers. A column of that name is replaced, all others are kept, whatever
    their names; repeated rows stay repeated, no rows give no rows.
    """

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.severity(t) for t in texts], dtype="float64")

    return docs.withColumn(to, run(F.col(text).cast("string")))


def score(docs: DataFrame, labels: DataFrame, grade: str = "toxic") -> DataFrame:
    """Documents (doc_id, text, ...) to (doc_id, severity, grade, toxic), a row for each input row.

    grade is the label value whose rank is nearest to severity; toxic says that it isn't the
    lowest. Null doc_ids and repeated rows are kept; other columns are ignored.
    """
    model = learn(docs, labels, grade)
    out = graded(spread(docs.select("doc_id", "text")), model)
    rank = F.floor(F.col("severity") + F.lit(0.5)).cast("int")
    values = F.array(*map(F.lit, model.grades or [0]))
    return out.select("doc_id", "severity", F.element_at(values, rank + 1).alias("grade"), (rank > 0).alias("toxic"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
