import itertools
import random

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from quernstone.llm import sentencepieces as S  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


def chunked(lattice, norm, size):
    around = lattice.longest
    cuts = [*range(0, max(1, len(norm) - around), size), len(norm)]
    chunks = [(norm[max(0, a - around) : b + around], a - max(0, a - around), b - max(0, a - around)) for a, b in itertools.pairwise(cuts)]
    return chunks, [lattice.transfer(t, a, b, k == 0) for k, (t, a, b) in enumerate(chunks)]


CASES = ["  a   b    c" * 9, "漢字かな混じり文😀" * 9, " " * 90, "▁ x" * 30, "a" * 150, "<s></s><0x0A><unk>" * 6, "Is and retitioning ouen, the of.\n" * 9, "thetheringthat" * 12]


@pytest.mark.parametrize("text", CASES)
@pytest.mark.parametrize("size", [40, 97])
def test_chunks_give_the_library_s_ids(text, size):
    sp = S._model(PATH)
    chunks, matrices = chunked(S.lattice(PATH), sp.normalize(text), size)
    states = S.cut_states(matrices)
    ids = []
    for (t, a, b), came, goes in zip(chunks, states, states[1:]):
        ids += S.trace_chunk(PATH, t, a, b, came, goes)
    assert ids == sp.encode(text)


def test_products_are_associative_and_unigram_is_optimal():
    rng = random.Random(2)
    scores = {"a": -1.0, "b": -1.1, "ab": -1.7, "ba": -1.9, "aab": -2.2, "bb": -2.5, "abab": -3.0}
    lat = S.Lattice(scores, bpe=False)
    for _ in range(20):
        text = "".join(rng.choice("ab") for _ in range(60))
        _, matrices = chunked(lat, text, 15)
        left, right = matrices[0], matrices[-1]
        for x in matrices[1:]:
            left = S.combine(left, x)
        for x in matrices[-2::-1]:
            right = S.combine(x, right)
        left, right = ({(i, j): v for i, j, v in S.dense(x)} for x in (left, right))
        assert {k: round(v, 9) for k, v in left.items()} == {k: round(v, 9) for k, v in right.items()}
        best = [0.0] + [S.NEVER] * len(text)
        for i in range(len(text)):
            for p, v in scores.items():
                if text.startswith(p, i):
                    best[i + len(p)] = max(best[i + len(p)], best[i] + v)
        assert abs(max(v for ((_, _), (_, e)), v in left.items() if e == 0) - best[-1]) < 1e-9


def test_word_cache_is_exact():
    e = S.Encoder(PATH)
    for _ in range(2):
        for text in ["a b", " a", "a ", "a  b", "x▁ y", "", " ", "é\n漢 b\n\nc", "the of and " * 50 + "x"]:
            assert e.ids(text).tolist() == e.sp.encode(text)


def test_encode_and_decode(docs, rows):
    sp = S._model(PATH)
    out = S.encode(docs, PATH, giant=400, chunk=150, same="same")
    assert out.columns == [*docs.columns, "ids", "same"] and {r[0] for r in out.select("uid", "row").distinct().collect()} == {"clash"}
    got = sorted(((r.doc_id, r.text, r.ids, r.same) for r in out.collect()), key=str)
    assert got == sorted(((r[0], r[1], None if r[1] is None else sp.encode(r[1]), True) for r in rows), key=str)
    back = S.decode(out, PATH).collect()
    assert all(r.decoded == r.text for r in back)


def test_many_levels_of_chunks(spark):
    """A text of some 120 chunks goes up and down three levels, forced places or none."""
    sp = S._model(PATH)
    texts = ["the of and retitioning " * 200, "thering" * 900, "漢字 かな" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("old"))
    got = {r.doc_id: r.ids for r in S.encode(docs, PATH, giant=100, chunk=40).collect()}
    assert got == {i: sp.encode(t) for i, t in enumerate(texts)}


def test_long_decoding():
    sp = S._model(PATH)
    ids = sp.encode("Is and 漢 the\n" * 100_000)
    assert S.decode_ids(PATH, ids) == sp.decode(ids)


def test_empty(empty):
    assert S.encode(empty, PATH).count() == 0
