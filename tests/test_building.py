"""How corpora and their files are written: by the tasks, in order, each thing once."""

import os

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import render, tokens
from quernstone.plans import service_queries
from quernstone.plans.corpus import Corpus
from quernstone.sources import readers, versions

SF = "/root/testdata/sf0.001"


def test_texts_are_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/1.html", "x"), ("b/2.html", "ż\ny"), ("a/3.html", ""), ("b/2.html", "twice")], "name string, html string")
    for way in ("tasks", "driver"):
        home = tmp_path / way
        for folder in "ab":
            (home / folder).mkdir(parents=True)
        (versions.write_texts if way == "tasks" else versions._renamed_texts)(rows, f"file://{home}")
        found = {str(p.relative_to(home)): p.read_text() for p in home.rglob("*.html")}
        assert found["a/1.html"] == "x\n" and found["a/3.html"] == "\n" and sorted(found["b/2.html"].splitlines()) == ["twice", "y", "ż"]
        assert not [n for _, _, files in os.walk(home) for n in files if not n.endswith((".html", ".crc"))]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_site_needs_no_move_for_each_page(spark, monkeypatch):
    moved, made = [], []
    plain, build = service_queries._moved, service_queries._with_texts
    monkeypatch.setattr(service_queries, "_moved", lambda *a: (moved.append(a), plain(*a)))
    monkeypatch.setattr(service_queries, "_with_texts", lambda *a: (made.append(a), build(*a))[1])
    there = f"{SF}/."  # another name: nothing is kept for it yet
    assert service_queries.QUERIES["csv_metadata"](spark, there).count() == 50 and len(moved) == 1
    assert service_queries.QUERIES["built_file_numbers"](spark, there).count() == 50 and not made


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.html").write_text(f"page {i}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        scan = spark.read.text(str(tmp_path), wholetext=True)
        assert scan.rdd.getNumPartitions() == 40 and text.gathered(scan).rdd.getNumPartitions() <= max(spark.sparkContext.defaultParallelism, 1)
        meta = readers.folder_metadata(spark, str(tmp_path))
        assert meta.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        read = {r.plik: r.html for r in readers.texts(spark, meta, str(tmp_path)).collect()}
        assert read == {f"{i}.html": f"page {i}" for i in range(40)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_postings_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, "the of the " + "ab"[i % 2] * (i % 7)) for i in range(60)], "doc_id long, text string")
    toks = tokens.lemmatized(tokens.text_tokens(docs))
    made = tokens.postings_in_order(toks)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, tokens.postings(toks).collect()))
    assert made.collect() == sorted(made.collect())


@pytest.mark.parametrize("kind", ["texts", "pages"])
def test_documents_are_put_in_order_before_they_are_tokens(spark, tmp_path, kind):
    ids = [(i * 37) % 101 for i in range(101)]
    rows = spark.createDataFrame([(i, "x", f"<p>the of, {i}</p>" if kind == "pages" else f"the of, {i}") for i in ids], "doc_id long, url string, body string").repartition(5)
    made = Corpus.of_texts(rows, [], text="body") if kind == "texts" else Corpus.of_pages(rows, [], "doc_id", "body")
    plan = made.in_order()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate" if kind == "texts" else "MapInArrow") < plan.index("Exchange rangepartitioning")
    written = made.write(str(tmp_path / "c"))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, written.tokens.collect())) == sorted(map(key, made.tokens.collect()))
    for part in written.tokens.select(F.input_file_name().alias("f"), "doc_id", "pos").toPandas().groupby("f"):
        at = list(zip(part[1]["doc_id"], part[1]["pos"], strict=True))
        assert at == sorted(at)


def test_many_tokens_of_pages(spark):
    pages = spark.createDataFrame([(i, f"<p>{'a b ' * i}</p>" if i % 3 else None) for i in range(30)], "doc_id long, html string")
    want = sorted((i, n, k, v) for i in range(30) if i % 3 for n, (k, v) in enumerate(readers.page_stream(f"<p>{'a b ' * i}</p>")) if k == "word")
    assert sorted(tuple(r) for r in readers.page_tokens(pages).filter("kind = 'word'").collect()) == want


TEXTS = ["the of", " the  of\n", "the, of", "the the the of the of", "a<b & the of>c", "the of,the of", "\tthe\nof the", "", " \n ", None, "xthe of the ofx", "the of the of the", ",the of"]


@pytest.mark.parametrize("terms", [None, ["the", "of"], ["the", "the"], ["of"], ["", "of"], ["the", "of", "the"]])
def test_texts_are_shown_without_their_tokens(spark, terms):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    toks = tokens.lemmatized(tokens.text_tokens(docs))
    bodies = lambda df: {r.doc_id: r.body for r in df.collect()}
    want = bodies(render.rendered(toks, terms))
    made = render.rendered_texts(docs, terms=terms)
    assert bodies(made) == want and len(want) == len(TEXTS) - 3
    assert not any(x in made._jdf.queryExecution().executedPlan().toString() for x in ("Exchange hash", "InArrow", "InPandas"))
    if terms:
        assert bodies(render.rendered_texts(docs, terms=terms, hits_only=True)) == {i: b for i, b in want.items() if "match" in b}
    else:
        assert bodies(render.rendered_texts(docs, how="plain")) == bodies(render.rendered(toks, how="plain"))


def test_tokens_are_shown_by_one_shuffle(spark):
    toks = spark.createDataFrame([(1, p, "word", v, v) for p, v in [(0, "a"), (1, "b"), (3, "a"), (5, "b")]] + [(2, 0, "tag", "p", None), (2, 1, "word", "a", "a"), (2, 2, "word", "b", "b"), (2, 3, "end", None, None)], "doc_id long, pos int, kind string, value string, lemma string")
    made = render.rendered(toks.repartition(3), ["a", "b"])
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.doc_id: r.body for r in made.collect()} == {1: '<span class="match">a b</span> a b', 2: '<p><span class="match">a b</span></p>'}


def test_pages_are_shown_without_their_tokens(spark):
    pages = spark.createDataFrame([(1, "<p>a <b>b</b> c</p>"), (2, ""), (3, None), (4, "x &amp; y<br>")], "doc_id long, html string")
    toks = tokens.lemmatized(readers.page_tokens(pages))
    for how in ("plain", "html"):
        made = render.rendered_pages(pages, how=how)
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, render.rendered(toks, how=how).collect()))
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_ids_need_no_sorted_tokens(spark):
    toks = tokens.text_tokens(spark.createDataFrame([(0, "b a, b"), (1, ""), (2, "c\na-a")], "doc_id long, text string"))
    vocab = tokens.vocabulary(toks)
    ids = tokens.encoded_stream(toks, vocab)
    assert "ShuffledHashJoin [kind" in ids._jdf.queryExecution().executedPlan().toString()
    back = tokens.decoded_stream(ids, vocab)
    assert "ShuffledHashJoin [id" in back._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r.doc_id, r.pos, r.kind, r.value)
    assert sorted(map(key, back.collect()), key=str) == sorted(map(key, toks.collect()), key=str)
