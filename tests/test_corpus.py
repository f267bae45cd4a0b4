"""The worked examples of FIXTURES.md, and what holds for any corpus."""

import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions.stats import golomb_parameter, log_likelihood
from quernstone.functions.text import as_int, drop_ext, phrase_terms, row_key, stream
from quernstone.operators import keyness, metadata, render, search, tokens
from quernstone.plans.corpus import Corpus, Engine, Query
from quernstone.sources import readers

F3 = ["kot pies", "kot, pies", "kot kot kot", "Kot  pies", "pies kot"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(F3)), "doc_id long, text string").withColumn("k", F.col("doc_id").cast("string"))


@pytest.fixture(scope="module")
def corpus(docs):
    return Corpus.of_texts(docs, ["k"])


@pytest.fixture(scope="module")
def written(corpus, tmp_path_factory):
    return corpus.write(str(tmp_path_factory.mktemp("written") / "c"))


@pytest.mark.parametrize(
    ("text", "want"),
    [("kot, pies-1", ["kot", None, ",", "pies", None, "-", None, "1"]), ("  a\nb ", ["a", "b"]), ("", []), (None, []), ("éx", ["e", None, "́", None, "x"]), ("a\tb", ["a", None, "\t", None, "b"]), ("a b", ["a", None, " ", None, "b"])],
)
def test_stream(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(stream(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("phrase", "want"),
    [("kot", {0, 1, 2, 4}), ("kot pies", {0}), ("Kot pies", {3}), ("kot kot", {2}), ("kot  pies", set()), (" kot", set()), ("kot ", {0, 1, 2, 4}), ("kot lew", set()), (" ", {0, 1, 2, 3, 4}), ("", {0, 1, 2, 3, 4}), (None, {0, 1, 2, 3, 4})],
)
def test_phrase(corpus, phrase, want):
    assert {r.doc_id for r in corpus.select(Query(phrase)).collect()} == want


def test_phrase_positions_overlap(corpus):
    assert sorted(tuple(r) for r in search.phrase_positions(corpus.tokens, ["kot", "kot"]).collect()) == [(2, 0), (2, 1)]
    assert phrase_terms(" a  b ") == ["", "a", "", "b"]


def test_lexicon(spark):
    docs = spark.createDataFrame([(0, "małego kota")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("kota", "kot"), ("małego", "mały")], "form string, lemma string")
    c = Corpus.of_texts(docs, [], lexicon=lexicon)
    assert c.total(Query("mały kot")) == 1 and c.total(Query("małego kota")) == 0


@pytest.mark.parametrize(
    ("values", "want"),
    [(["0", "1"], "boolean"), (["", "0", "1"], "boolean"), (["0"], "int"), (["0", "1", "2"], "int"), (["", "5"], "int"), (["+5", "-3"], "int"), (["3000000000"], "string"), ([" 5"], "string"), (["1.5"], "string"), ([""], "int"), ([], "int"), (["2016-01-31"], "date"), (["2024-13-99"], "date"), (["", "2016-01-31"], "date"), (["2016-1-31"], "string")],
)
def test_types(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    assert metadata.types(df, ["c"]).first()["type"] == want


def test_filters(spark):
    meta = spark.createDataFrame([(0, "b"), (1, "a"), (2, "B"), (3, "")], "doc_id long, k string")
    hit = lambda f: {r.doc_id for r in search.filtered(meta, f, ["k"]).collect()}
    assert hit({"k": "b"}) == {0, 2} and hit({"k": ""}) == {0, 1, 2, 3} and hit({"k": {3}}) == {0} and hit({"k": {0, 1}}) == {2, 3}
    assert hit({"k": set()}) == set() and hit({}) == {0, 1, 2, 3} and hit({"k": {"a"}}) == {1} and hit({"k": "%"}) == set()
    with pytest.raises(ValueError):
        search.filtered(meta, {"nothing": "x"})


def test_facets_bound(spark):
    df = spark.range(100).select((F.col("id") % 99).cast("string").alias("few"), F.col("id").cast("string").alias("many"))
    got = {r["name"]: r for r in metadata.facets(df, ["few", "many"]).collect()}
    assert len(got["few"]["values"]) == 99 and got["many"]["values"] is None and got["many"]["n"] == 100
    empty = metadata.facets(df.limit(0), ["few"]).first()
    assert (empty["n"], empty["values"]) == (0, [])


def test_dictionary(spark):
    df = spark.createDataFrame([("Potop", "a"), ("Kordian", "b"), ("Kordian", "aa")], "t string, u string")
    d = {c: metadata.dictionary(df, c) for c in df.columns}
    assert sorted(map(tuple, d["t"].collect())) == [("Kordian", 0), ("Potop", 1)]
    back = metadata.decoded(metadata.encoded(df, ["t", "u"]), ["t", "u"], d).select("t", "u")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_frequency_list(corpus):
    assert [tuple(r) for r in corpus.frequency_list().collect()] == [("kot", 6), ("pies", 4), ("Kot", 1)]
    corpus.create_context("zero", Query(filters={"k": {"0"}}))
    assert [tuple(r) for r in corpus.frequency_list("zero").collect()] == [("kot", 1), ("pies", 1), ("Kot", 0)]
    assert [tuple(r) for r in corpus.frequency_list("zero", drop_zero=True, limit=1, offset=1).collect()] == [("pies", 1)]
    assert corpus.counts().agg(F.sum("cnt")).first()[0] == 12


def test_contexts(corpus):
    corpus.create_context("kot", Query("kot"))
    corpus.create_context("inner", Query(filters={"k": {"0", "3"}}, within="kot"))
    assert {r.doc_id for r in corpus.context("inner").collect()} == {0}
    before = corpus.frequency_list("inner").collect()
    corpus.create_context("inner", Query(within="kot"))
    assert corpus.frequency_list("inner").collect() != before
    with pytest.raises(KeyError):
        corpus.context("nothing")
    info = corpus.get_info()
    assert [n for n, _ in info["contexts"]] == sorted(corpus.contexts) and info["metadata"] == [("k", ["0", "1", "2", "3", "4"])]


def test_log_likelihood(spark):
    df = spark.createDataFrame([(10, 20, 100, 1000), (0, 5, 10, 10), (1, 100, 100, 1000)], "a long, b long, n long, m long")
    ll = lambda s: [round(r[0], 6) for r in df.select(log_likelihood(*map(F.col, "abnm"), signed=s)).collect()]
    assert ll(False)[:2] == [13.579463, 0] and ll(False)[2] > 0 > ll(True)[2]
    g = spark.createDataFrame([(1, 10), (5, 10), (10, 10), (3, 100)], "d long, n long").select(golomb_parameter(F.col("d"), F.col("n")))
    assert [r[0] for r in g.collect()] == [7, 2, 1, 24]


def test_word_cloud(spark):
    scores = spark.createDataFrame([("a", 4.0), ("b", 1.0)], "lemma string, ll double")
    assert [r["size"] for r in keyness.word_cloud(scores).collect()] == [100, 50]
    assert keyness.word_cloud(scores.limit(0)).count() == 0


def test_gaps_and_intervals(spark):
    posts = spark.createDataFrame([("x", 0), ("x", 1), ("x", 4)], "lemma string, doc_id long")
    for stretch in (2, 3, 100):
        assert [r.gap for r in tokens.gaps(posts, stretch).orderBy("doc_id").collect()] == [1, 1, 3]
    df = spark.createDataFrame([(0, v) for v in (1, 2, 3, 7, 9, 10, 10)], "k long, v long")
    assert [(r.lo, r.hi) for r in tokens.intervals(df, "k", "v").orderBy("lo").collect()] == [(1, 3), (7, 7), (9, 10)]


def test_page_stream():
    got = readers.page_stream('<html><body><p class="x">kot, pies</p></body></html>')
    assert got == [("tag", "html"), ("tag", "body"), ("tag", "p"), ("attr", "class"), ("text", "x"), ("word", "kot"), ("nospace", None), ("word", ","), ("word", "pies"), ("end", None), ("end", None), ("end", None)]
    assert [t for t in readers.page_stream("<p>a<p>b<br>c<script>x</script><!-- y -->") if t[0] == "word"] == [("word", "a"), ("word", "b"), ("word", "c")]
    assert readers.page_stream(None) == []


def test_references_cut_short(spark):
    """Both ways to read a page take a reference without its semicolon as it stands."""
    page = "<title>a&amp;&amp</title><!-- <script> --><p>b &copy &ampx; &middot; &lt;i&gt; &#39;c&#39 &</p><script>x &amp y</script>"
    got = [v for kind, v in readers.page_stream(page) if kind == "word"]
    pages = spark.createDataFrame([(1, page)], "doc_id long, html string")
    assert got == [r.value for r in tokens.html_words(pages).orderBy("pos").collect()]
    assert got[:3] == ["a", "&&", "amp"]
    assert ("text", "?a=1&copy=2&amp") in readers.page_stream('<a href="?a=1&copy=2&amp">')
    assert [v for kind, v in readers.page_stream("<script>x &amp y</script>", raw=True) if kind == "word"] == ["x", "&", "amp", "y"]


def test_plain_text():
    plain = lambda h: render.plain_text(readers.page_stream(h))
    assert plain("<p>ala ma</p><p>kota</p>") == "ala ma\n\nkota\n\n"
    assert plain("<p>a <b>b</b> c</p>") == "abc\n\n"


def test_highlight():
    doc = [("word", w) for w in "ababc"]
    got = render.highlighted(doc, {0, 2}, 2)
    assert [i for i, t in enumerate(got) if t[0] == "tag"] == [1, 9] and render.highlighted(doc, set(), 2) == doc
    nested = render.to_html(render.tree([("tag", "p"), *got, ("end", None)]))
    assert nested.count('<span class="match">a b</span>') == 2
    assert render.next_match(0, -1, 3) == 0 and render.next_match(2, 1, 3) == 2


def test_tree_round_trip():
    page = '<html><body><p class="x">kot, pies</p>a &amp; b<br></body></html>'
    assert render.to_html(render.tree(readers.page_stream(page))) == page


def test_paging(spark):
    c = Corpus.of_texts(spark.range(25).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")), [])
    ids = lambda **q: [r.doc_id for r in c.get_documents(Query(**q)).collect()]
    assert ids(offset=20) == [20, 21, 22, 23, 24] and ids(offset=100) == [] and ids(offset=-5, limit=1) == [0] and ids() == list(range(10))
    assert sum((ids(offset=o, limit=7) for o in range(0, 28, 7)), []) == list(range(25)) and search.page_of(2, 10) == (20, 10)


def test_small_helpers(spark):
    df = spark.createDataFrame([("a.tar.gz", "+5", "x", "y", "z")], "a string, b string, c string, d string, e string")
    assert tuple(df.select(drop_ext(F.col("a")), as_int(F.col("b")), row_key([df.columns[i] for i in (0, 1, 2, 4)])).first()) == ("a", 5, "a.tar.gz/+5/x/z")
    assert metadata.label("tYTUŁ") == "Tytuł"


def test_files_and_engine(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/potop.html").write_text("<html><body><p>Mały kot, mały pies</p></body></html>")
    (tmp_path / "in/sub/kordian.HTM").write_text("<html><body><h1>Pies</h1>kot</body></html>")
    (tmp_path / "in/note.txt").write_text("no page")
    (tmp_path / "in/all.csv").write_text('file,autor,tytuł\npotop.html,"Sienkiewicz, Henryk",Potop\nsub/kordian.HTM,Juliusz Słowacki,\n')
    e = Engine(spark, str(tmp_path / "home"))
    assert e.get_corpora().count() == 0
    by_csv = e.create_corpus("csv", str(tmp_path / "in/all.csv"))
    e.create_corpus("folder", str(tmp_path / "in"))
    assert [tuple(r) for r in e.get_corpora().collect()] == [(0, "csv", 2), (1, "folder", 2)] and e.get_task_info() is None
    assert by_csv.columns == ["autor", "tytuł"] and e.corpus("folder").columns == ["plik"]
    rows = e.get_documents("csv", Query("kot")).collect()
    assert [(r["autor"], r["tytuł"]) for r in rows] == [("Sienkiewicz, Henryk", "Potop"), ("Juliusz Słowacki", "")]
    shown = e.document("csv", rows[0]["path"], "mały pies")
    assert '<span class="match">mały pies</span>' in shown and e.document("csv", "nothing") is None
    e.create_context("csv", "pies", Query("Pies"))
    again = Engine(spark, e.home)
    assert {r.doc_id for r in again.corpus("csv").context("pies").collect()} == {1}
    assert [r.lemma for r in again.frequency_list("csv", "pies").filter("cnt > 0").collect()] == ["Pies", "kot"]
    assert again.compare_contexts("csv", "pies", None).columns == ["lemma", "ll"] and e.tree(str(tmp_path / "in")) == [("all.csv", False), ("sub", True)]
    again.corpus("csv").frequency_csv(str(tmp_path / "list"))
    assert (tmp_path / "list").exists() and len(again.corpus("csv").postings_of("kot").collect()) == 2


def test_any_corpus(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab ,\nż1") for _ in range(rng.randrange(40))) for _ in range(30)]
    c = Corpus.of_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [])
    counts = {r.lemma: r.cnt for r in c.counts().collect()}
    assert sum(counts.values()) == tokens.words(c.tokens).count()
    c.create_context("a", Query("a"))
    inside = {r.doc_id for r in c.select(Query("b", within="a")).collect()}
    assert inside <= {r.doc_id for r in c.context("a").collect()}
    assert all(r.ll > 0 for r in c.compare_contexts("a").collect())


def test_stream_counts(spark, tmp_path):
    from quernstone.streaming import stream_frequencies

    (tmp_path / "in").mkdir()
    for i, text in enumerate(F3):
        (tmp_path / f"in/{i}.txt").write_text(text)
    docs = spark.readStream.option("maxFilesPerTrigger", 2).text(str(tmp_path / "in")).withColumnRenamed("value", "text")
    q = stream_frequencies(docs).writeStream.outputMode("complete").format("memory").queryName("stream_words").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    q.awaitTermination(60)
    assert {r.value: r.cnt for r in spark.table("stream_words").collect()} == {"kot": 6, "pies": 4, "Kot": 1, ",": 1}


def test_filter_toggles():
    f = search.toggled({}, "k", "b", ["a", "b"])
    assert f == {"k": {"a"}} and search.toggled(f, "k", "b", ["a", "b"]) == {"k": {"a", "b"}}
    assert search.with_none(f, "k") == {"k": set()} and search.with_all(f, "k") == {} and search.with_text({"z": "y"}, "k", "b") == {"z": "y", "k": "b"}
    assert search.with_text({"k": "b"}, "k", "") == {}


def test_files_of_many_lines_are_one_document(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<html><body><p>kot\npies</p>\n<p>lew</p>\n</body></html>\n")
    (tmp_path / "in/all.csv").write_text("file,k\na.html,x\nmissing.html,y\n")
    for source in ("in", "in/all.csv"):
        c = Corpus.of_files(spark, str(tmp_path / source))
        assert [r.lemma for r in c.tokens.filter("kind = 'word' AND doc_id = 0").orderBy("pos").collect()] == ["kot", "pies", "lew"]
        assert c.documents.count() == (1 if source == "in" else 2)


@pytest.mark.parametrize("rows", [1, 3, 1 << 20])
def test_ranks_of_texts_that_begin_alike(spark, rows):
    """No group of the cut is larger than asked, whatever all texts have in common."""
    rng = random.Random(4)
    paths = {f"/data/corpora/novels/part-{rng.randrange(4)}/{'x' * rng.randrange(3)}{rng.randrange(60)}.html" for _ in range(80)} | {"/data", "/data/corpora/novels/part-", "b", ""}
    df = spark.createDataFrame([(p, 1) for p in paths], "file string, k int").repartition(3)
    got = {r.file: r.n for r in tokens.ranked(df, "file", "n", rows).collect()}
    assert got == {p: i for i, p in enumerate(sorted(paths))}


def test_versions(spark, corpus, tmp_path):
    """A corpus that is written again is replaced at once; who has the old one open can still read it."""
    at = str(tmp_path / "c")
    old = corpus.write(at)
    old.create_context("a", Query("kot"))
    old.create_context("a", Query("pies"))
    assert {r.doc_id for r in Corpus.open(spark, at).context("a").collect()} == {0, 1, 3, 4}
    new = Corpus.of_texts(spark.createDataFrame([(9, "lew", "z")], "doc_id long, text string, k string"), ["k"]).write(at)
    assert new.documents.count() == 1 and Corpus.open(spark, at).contexts == {} and old.documents.count() == 5
    assert [r.form for r in new.lexicon().collect()] == ["lew"]


@pytest.mark.parametrize("phrase", ["kot", "kot pies", "kot kot", "kot kot kot", "kot lew", "pies kot", " kot", "Kot pies"])
def test_written_phrases(corpus, written, phrase):
    """Documents by postings first are those of a scan of all tokens."""
    assert {r.doc_id for r in written.select(Query(phrase)).collect()} == {r.doc_id for r in corpus.select(Query(phrase)).collect()}


def test_counts_are_let_go(corpus):
    corpus.create_context("v", Query("kot"))
    first = corpus.counts("v")
    first.count()
    corpus.create_context("v", Query("pies"))
    assert not first.is_cached and corpus.counts("v") is not first
    corpus.close()
    with pytest.raises(KeyError):
        corpus.select(Query(within="nowhere"))


def test_cards_and_columns():
    assert metadata.filled(["b", "meta/k", ["i", "text", 5]], {"k": "v"}) == ["b", "v", ["i", "text", 5]]
    assert metadata.layout([]) == [] and metadata.layout(["a"], {"a": {"width": 50}}) == [("a", "A", 50.0)]
