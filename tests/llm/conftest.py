"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

WORDS = "the of and to a in is it that thing ring sing bring stone river mountain light heavy green blue one two three four five six seven".split()


def prose(rng, n):
    out = [rng.choice(WORDS) + rng.choice(["", "", "", ",", "er", "ing"]) for _ in range(n)]
    for i in range(9, n, 13):
        out[i] += ".\n"
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(60):
        out.append((i, prose(rng, rng.randrange(3, 120)), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3", None])))
    base = prose(rng, 200)
    out += [(100 + i, base, "en", "s1") for i in range(6)]
    out += [(110, base + " more", "en", "s1"), (111, base.replace("stone", "Stone"), None, "s2")]
    out += [(120, None, "en", "s1"), (121, "", "de", None), (122, " \n\t\n ", None, "s2"), (123, "one", "en", "s2"), (124, "one two", None, None), (125, "é漢字 😀 \x1f　x", "en", "s3"), (126, "...,,, !!", "de", "s4")]
    out += [(None, "text without an id", "en", "s1"), (None, None, None, None), (7, out[7][1], out[7][2], out[7][3]), (8, "another text of id eight", "en", "s1")]
    out += [(130, prose(rng, 9000), "en", "s1"), (131, "x" * 3000, "de", "s2"), (132, "ab " * 2000, "de", "s2")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    for c in ("fp", "rk", "_n", "_gone", "uid", "h", "key", "node", "bucket", "ids_", "row", "n_lines_", "batch"):
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


class Groups:
    """Union-find for brute force."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


@pytest.fixture
def groups():
    return Groups()
