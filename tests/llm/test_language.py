import random
import zlib

import numpy as np

from quernstone.llm import language as L


def brute_bundle(text, dim):
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    words = [w for w in low.split(" ") if w]
    line = " " + " ".join(words) + " "
    out = np.zeros(dim)
    if words:
        for i in range(len(line) - 2):
            a, b, c = (L.letter(ord(x), dim).astype(float) for x in line[i : i + 3])
            out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_bundles(monkeypatch):
    texts = ["Stone, river", "a", "", None, "  é漢字 x1y ", "...", "aa\n\nbb" * 40, "x" * 100]
    want = np.array([brute_bundle(t, 256) for t in texts])
    assert (L.bundles(texts, 256) == want).all()
    monkeypatch.setattr(L, "_SLICE", 7)
    monkeypatch.setattr(L, "_BATCH_DOCS", 3)
    monkeypatch.setattr(L, "_GRAMS", 5)
    assert (L.bundles(texts, 256) == want).all()
    assert (L.bundles(texts, 256, np.array([0, 1, 0, 1, 0, 1, 0, 1]), 2) == np.stack([want[::2].sum(0), want[1::2].sum(0)])).all()


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    parts = {"x": "the ing tion and er".split(), "y": "eau que les ment oi".split(), "z": "sch ung der ein ich".split()}
    rows = []
    for i in range(300):
        lang = rng.choice("xyz")
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60))), lang))
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dim=1024).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(held) > 60 and all(got[r[0]].held_out == (r in held) for r in rows)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(docs, rows, empty):
    got = L.identify(docs, dim=256).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 7, 8)}
    assert [(by[i].lang_pred, by[i].score) for i in (120, 121, 122, 126)] == [("und", 0.0)] * 4
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert L.identify(empty, dim=64).count() == 0
    assert {r.lang_pred for r in L.identify(docs.filter("lang IS NULL"), dim=64).collect()} == {"und"}
