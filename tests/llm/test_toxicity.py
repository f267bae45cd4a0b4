import random

import numpy as np

from quernstone.llm import toxicity as T


def test_grades_in_order():
    """Four grades from words that add up: expected severity rises with them, thresholds are shared and ordered."""
    rng = random.Random(1)
    sample = []
    for _ in range(3000):
        bad = {w for w in "abcdef" if rng.random() < 0.3}
        noise = {f"w{rng.randrange(30)}" for _ in range(4)}
        sample.append((min(3, max(0, len(bad) + rng.choice([0, 0, 0, 0, 1, -1]))), bad | noise))
    m = T.fit(sample)
    assert m.grades == [0, 1, 2, 3] and (np.diff(m.thresholds) > 0).all()
    severity = [m.severity(" ".join("abcdef"[:k])) for k in range(7)]
    assert all(a < b for a, b in zip(severity, severity[1:])) and severity[0] < 0.5 and severity[6] > 2.5
    right = sum(round(m.severity(" ".join(w))) == g for g, w in sample)
    assert right > 0.7 * len(sample)


def test_fit_of_little():
    assert T.fit([]).severity("x") == 0 and T.fit([(1, {"a"})] * 5).severity("a") == 0


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    vocabulary = [w.replace("0", "z").replace("1", "y").replace("2", "x").replace("3", "v").replace("4", "u").replace("5", "t").replace("6", "s").replace("7", "r").replace("8", "q").replace("9", "p") for w in words]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = [rng.choice(vocabulary) for _ in range(40)] + (rng.sample(["nasty", "vile", "foul"], 2) if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text).title() + "!"))
        if i < 600:
            labels.append((i, 1, int(toxic) if rng.random() > 0.03 else 1 - int(toxic)))
    got = T.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.doc_id >= 600]
    assert len(got) == 900 and all(r.toxic == (r.doc_id % 6 == 0) for r in held)


def test_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1), (999, 1)], "doc_id long, toxic int").selectExpr("*", "1 AS text", "2 AS words", "0 AS grade")
    got = T.score(docs, labels)
    assert got.columns == ["doc_id", "severity", "grade", "toxic"] and got.count() == len(rows)
    assert T.score(empty, labels).count() == 0 and T.score(docs, labels.limit(0)).filter("toxic").count() == 0
    assert T.score(docs, labels).filter("severity IS NULL").count() == 0
