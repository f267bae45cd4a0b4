"""Registered queries over the driver's tables, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.stats import golomb_parameter
from quernstone.functions.text import drop_ext, holds, phrase_terms, spread
from quernstone.operators import keyness, metadata, render, search, tokens
from quernstone.plans.corpus import Corpus, Query

Frame = DataFrame


def _read(spark: SparkSession, sf_dir: str, table: str) -> Frame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _docs(spark, d) -> Corpus:
    return Corpus.of_texts(_read(spark, d, "documents"), ["lang", "source", "n_chars"])


def _toks(spark, d) -> Frame:
    return tokens.lemmatized(tokens.text_tokens(_read(spark, d, "documents").select("doc_id", "text")))


def _pages(spark, d) -> Frame:
    return tokens.lemmatized(tokens.html_words(_read(spark, d, "pages"), "page_id"))


def _lexicon(spark) -> Frame:
    return spark.createDataFrame([("The", "the"), ("Of", "of"), ("And", "and"), ("De", "de"), ("La", "la")], "form string, lemma string")


def _lang(spark, d, lang: str) -> Frame:
    return _read(spark, d, "documents").filter(F.col("lang") == lang).select("doc_id")


def _labelled(spark, d) -> Frame:
    """Documents with their labels as text, empty where there is none."""
    docs = _read(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return metadata.as_strings(docs.join(_read(spark, d, "labels"), "doc_id", "left"), "lang", "source", "n_chars", "quality", "toxic")


_META = ["lang", "source", "n_chars", "quality", "toxic"]


def _frequency(t: Frame, within: Frame | None = None) -> Frame:
    return keyness.frequency_list(tokens.lemma_counts(t, within))


def _starts(spark, d, phrase: str) -> Frame:
    return search.phrase_positions(_toks(spark, d), phrase_terms(phrase)).select("doc_id", F.col("start").cast("long").alias("start"))


def _phrase(spark, d, phrase: str, within: Frame | None = None) -> Frame:
    return search.phrase_documents(_toks(spark, d), phrase, _read(spark, d, "documents").select("doc_id"), within)


def _codes(spark, d) -> Frame:
    dictionary = metadata.dictionary(_labelled(spark, d), "source")
    return dictionary.select("value", "code")


def _types(spark, d) -> Frame:
    return metadata.types(_labelled(spark, d), _META)


def _facets(spark, d) -> Frame:
    return metadata.facets(_labelled(spark, d), _META).select("name", "n", F.array_join("values", "|").alias("vals"))


def _nested(spark, d) -> Frame:
    c = _docs(spark, d)
    c.create_context("en", Query(filters={"lang": {"en"}}))
    c.create_context("en with the of", Query(phrase="the of", within="en"))
    return c.select(Query(filters={"source": "src1"}, within="en with the of")).select("doc_id")


def _page_tags(spark, d) -> Frame:
    from quernstone.sources.readers import page_tokens

    t = page_tokens(spread(_read(spark, d, "pages")), "page_id")
    return tokens.token_frequencies(t.filter("kind = 'tag'")).select("value", "cnt")


def _rle(spark, d) -> Frame:
    t = tokens.words(_toks(spark, d)).filter(F.col("value").isin("the", "of", "and"))
    return tokens.intervals(t, "doc_id", "pos").select("doc_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


def _catalog(spark, d) -> Frame:
    names = ("benchmark", "conversations", "documents", "pages")
    rows = [_read(spark, d, n).agg(F.count("*").alias("num_documents")).withColumn("name", F.lit(n)) for n in names]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("name", "num_documents").orderBy("name")


def _posting_ids(spark, d) -> Frame:
    return tokens.postings(_toks(spark, d).filter(F.col("lemma") == "the")).select("doc_id", "tf").orderBy("doc_id")


def _golomb(spark, d) -> Frame:
    n = _read(spark, d, "documents").agg(F.count("*").alias("n"))
    df = tokens.document_frequency(tokens.postings(_toks(spark, d)))
    # one row of one number
    return df.crossJoin(F.broadcast(n)).select("lemma", "df", golomb_parameter(F.col("df"), F.col("n")).alias("b"))


def _incremental(spark, d) -> Frame:
    t = _toks(spark, d).filter("kind = 'word'")
    start = tokens.token_frequencies(t.filter("doc_id % 2 = 0"))
    return tokens.token_frequencies(t.filter("doc_id % 2 = 1"), start).select("value", "cnt")


def _highlight(spark, d) -> Frame:
    return render.rendered_texts(_read(spark, d, "documents"), terms=["the", "of"], hits_only=True)


def _plain(spark, d) -> Frame:
    return render.rendered_pages(spread(_read(spark, d, "pages")), "page_id", "html", "plain")


QUERIES = {
    "token_frequency": lambda s, d: tokens.token_frequencies(_toks(s, d)).filter("kind = 'word'").select("value", "cnt"),
    "token_frequency_incremental": _incremental,
    "frequency_list": lambda s, d: _frequency(_toks(s, d)),
    "frequency_list_lexicon": lambda s, d: _frequency(tokens.lemmatized(tokens.text_tokens(_read(s, d, "documents")), _lexicon(s))),
    "frequency_list_en": lambda s, d: _frequency(_toks(s, d), _lang(s, d, "en")),
    "frequency_page": lambda s, d: _frequency(_toks(s, d)).offset(20).limit(50),
    "vocabulary_ids": lambda s, d: tokens.vocabulary(tokens.words(_toks(s, d))).select("value", "id"),
    "postings": lambda s, d: tokens.postings(_toks(s, d)),
    "posting_list": _posting_ids,
    "document_frequency": lambda s, d: tokens.document_frequency(tokens.postings(_toks(s, d))),
    "posting_gaps": lambda s, d: tokens.gaps(tokens.postings(_toks(s, d))),
    "golomb_parameter": _golomb,
    "stream_entropy": lambda s, d: tokens.entropy(tokens.token_frequencies(tokens.words(_toks(s, d)))).select("tokens", "symbols", F.round("bits", 6).alias("bits")),
    "word_documents": lambda s, d: _phrase(s, d, "the"),
    "phrase_documents": lambda s, d: _phrase(s, d, "the of"),
    "phrase_documents_en": lambda s, d: _phrase(s, d, "the of", _lang(s, d, "en")),
    "phrase_positions": lambda s, d: _starts(s, d, "the of"),
    "phrase_three_words": lambda s, d: _starts(s, d, "the the the"),
    "phrase_repeated_word": lambda s, d: _starts(s, d, "the the"),
    "phrase_unknown": lambda s, d: _phrase(s, d, "the qqqq"),
    "phrase_double_space": lambda s, d: _phrase(s, d, "the  of"),
    "phrase_only_spaces": lambda s, d: _phrase(s, d, "   "),
    "match_numbers": lambda s, d: render.matches(_toks(s, d), ["the", "of"]).select("doc_id", "match", F.col("start").cast("long").alias("start")),
    "search_page": lambda s, d: _docs(s, d).get_documents(Query(phrase="the", offset=20)).select("doc_id", "lang", "source"),
    "search_filter_text": lambda s, d: _docs(s, d).select(Query(filters={"source": "SRC1"})).select("doc_id", "source"),
    "search_filter_set": lambda s, d: _docs(s, d).select(Query(filters={"lang": {"de", "fr"}})).select("doc_id", "lang"),
    "search_filter_codes": lambda s, d: _docs(s, d).select(Query(filters={"lang": {0, 2}})).select("doc_id", "lang"),
    "search_filter_empty_set": lambda s, d: _docs(s, d).select(Query(filters={"lang": set()})).select("doc_id", "lang"),
    "search_combined": lambda s, d: _docs(s, d).select(Query("the of", {"lang": {"en"}, "source": "src1"})).select("doc_id", "lang", "source"),
    "context_nested": _nested,
    "keyness_two_contexts": lambda s, d: keyness.keyness_in(_toks(s, d), _lang(s, d, "en"), _lang(s, d, "de")),
    "keyness_lang_vs_all": lambda s, d: keyness.keyness_in(_toks(s, d), _lang(s, d, "en"), None),
    "word_cloud_sizes": lambda s, d: keyness.word_cloud(keyness.keyness_in(_toks(s, d), _lang(s, d, "fr"), None)),
    "meta_types": _types,
    "meta_facets": _facets,
    "meta_codes": _codes,
    "meta_encoded": lambda s, d: metadata.encoded(_labelled(s, d).select("doc_id", "lang", "source"), ["lang", "source"]).select("doc_id", "lang", "source"),
    "meta_card": lambda s, d: metadata.card(_labelled(s, d), 7, _META),
    "meta_contains": lambda s, d: _read(s, d, "part").filter(holds(F.col("p_type"), "Medi")).select("p_partkey", "p_type"),
    "page_words": lambda s, d: tokens.token_frequencies(_pages(s, d)).select("value", "cnt"),
    "page_phrase_documents": lambda s, d: search.phrase_documents(_pages(s, d), "the of", _read(s, d, "pages").select(F.col("page_id").alias("doc_id"))),
    "page_tags": _page_tags,
    "page_names": lambda s, d: _read(s, d, "pages").select("page_id", drop_ext(F.element_at(F.split("url", "/"), -1)).alias("name")),
    "highlight_documents": _highlight,
    "page_plain_text": _plain,
    "document_neighbours": lambda s, d: _docs(s, d).neighbours(),
    "interval_runs": _rle,
    "catalog_counts": _catalog,
}

# ---- SQL ---------------------------------------------------------------------------------------

_STREAM = r"flatten(list_transform(string_split_regex({}, '[ \n]+'), lambda c: flatten(list_transform(regexp_extract_all(c, '[\pL0-9]+|[^\pL0-9]+'), lambda s, i: CASE WHEN i = 1 THEN [s] ELSE [chr(1), s] END))))"
_T = "WITH s AS (SELECT doc_id, " + _STREAM.format("text") + " AS s FROM documents), u AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS v FROM s), w AS (SELECT doc_id, pos, v FROM u WHERE v <> chr(1)) "
_ALL = "SELECT v AS lemma, count(*) AS cnt FROM w GROUP BY v"
_WORD = r"regexp_matches(lemma, '[\pL0-9]')"


def _phrase_sql(*terms: str) -> str:
    first, *more = terms
    joins = "".join(f" JOIN w w{i} ON w{i}.doc_id = w0.doc_id AND w{i}.pos = w0.pos + {i} AND w{i}.v = '{t}'" for i, t in enumerate(more, 1))
    return f"SELECT w0.doc_id, w0.pos AS start FROM w w0{joins} WHERE w0.v = '{first}'"


def _ll_sql(first: str, second: str) -> str:
    return (
        _T
        + f""", c AS (SELECT v AS lemma, CAST(count(*) FILTER ({first}) AS DOUBLE) AS a, CAST(count(*) FILTER ({second}) AS DOUBLE) AS b FROM w JOIN documents USING (doc_id) GROUP BY v),
n AS (SELECT sum(a) AS n1, sum(b) AS n2 FROM c),
g AS (SELECT lemma, round(2 * (a * ln(a / (n1 * (a + b) / (n1 + n2))) + b * ln(b / (n2 * (a + b) / (n1 + n2)))), 6) AS ll FROM c, n WHERE a > 0 AND b > 0),
k AS (SELECT lemma, ll FROM g WHERE ll > 0 ORDER BY ll DESC, lemma LIMIT 200) """
    )


_LAB = "WITH m AS (SELECT d.doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(CAST(n_chars AS VARCHAR), '') AS n_chars, coalesce(CAST(quality AS VARCHAR), '') AS quality, coalesce(CAST(toxic AS VARCHAR), '') AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)), cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS value FROM m" for c in _META) + ") "
_HTML = r"regexp_replace(regexp_replace(html, '<!--.*?-->', '<!>', 'gs'), '<(script\b[^>]*>.*?</script\s*|style\b[^>]*>.*?</style\s*)>', '<!>', 'gsi')"
_NODE = "replace(replace(replace(replace(replace(replace(replace(replace(n, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_P = (
    f"WITH h AS (SELECT page_id AS doc_id, string_split_regex({_HTML}, '<[^>]*>') AS ns FROM pages), n AS (SELECT doc_id, unnest(range(len(ns))) AS k, unnest(ns) AS n FROM h), "
    f"x AS (SELECT doc_id, k, {_NODE} AS n FROM n WHERE trim(translate(n, chr(10) || chr(9) || chr(13), '   ')) <> ''), s AS (SELECT doc_id, k, " + _STREAM.format("n") + " AS s FROM x), "
    "u AS (SELECT doc_id, k, unnest(range(len(s))) AS i, unnest(s) AS v FROM s), w AS (SELECT doc_id, k * 1000000 + i AS pos, v FROM u WHERE v <> chr(1)) "
)

ORACLES = {
    "token_frequency": _T + "SELECT v AS value, count(*) AS cnt FROM w GROUP BY v",
    "token_frequency_incremental": _T + "SELECT v AS value, count(*) AS cnt FROM w GROUP BY v",
    "frequency_list": _T + f"SELECT lemma, cnt FROM ({_ALL}) WHERE {_WORD} ORDER BY cnt DESC, lemma",
    "frequency_list_lexicon": _T + f"SELECT lemma, count(*) AS cnt FROM (SELECT CASE WHEN v IN ('The', 'Of', 'And', 'De', 'La') THEN lower(v) ELSE v END AS lemma FROM w) WHERE {_WORD} GROUP BY lemma",
    "frequency_list_en": _T + f"SELECT lemma, cnt FROM (SELECT v AS lemma, count(*) FILTER (lang = 'en') AS cnt FROM w JOIN documents USING (doc_id) GROUP BY v) WHERE {_WORD}",
    "frequency_page": _T + f"SELECT lemma, cnt FROM ({_ALL}) WHERE {_WORD} ORDER BY cnt DESC, lemma LIMIT 50 OFFSET 20",
    "vocabulary_ids": _T + "SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT DISTINCT v AS value FROM w)",
    "postings": _T + "SELECT v AS lemma, doc_id, count(*) AS tf FROM w GROUP BY v, doc_id",
    "posting_list": _T + "SELECT doc_id, count(*) AS tf FROM w WHERE v = 'the' GROUP BY doc_id ORDER BY doc_id",
    "document_frequency": _T + "SELECT v AS lemma, count(DISTINCT doc_id) AS df FROM w GROUP BY v",
    "posting_gaps": _T + "SELECT v AS lemma, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY v ORDER BY doc_id), -1) AS gap FROM (SELECT DISTINCT v, doc_id FROM w)",
    "golomb_parameter": _T + "SELECT v AS lemma, count(DISTINCT doc_id) AS df, CAST(ceil(ln(2) * (SELECT count(*) FROM documents) / count(DISTINCT doc_id)) AS BIGINT) AS b FROM w GROUP BY v",
    "stream_entropy": _T + f"SELECT CAST(sum(cnt) AS BIGINT) AS tokens, count(*) AS symbols, round(log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt), 6) AS bits FROM ({_ALL})",
    "word_documents": _T + "SELECT DISTINCT doc_id FROM w WHERE v = 'the'",
    "phrase_documents": _T + f"SELECT DISTINCT doc_id FROM ({_phrase_sql('the', 'of')})",
    "phrase_documents_en": _T + f"SELECT DISTINCT doc_id FROM ({_phrase_sql('the', 'of')}) JOIN documents USING (doc_id) WHERE lang = 'en'",
    "phrase_positions": _T + _phrase_sql("the", "of"),
    "phrase_three_words": _T + _phrase_sql("the", "the", "the"),
    "phrase_repeated_word": _T + _phrase_sql("the", "the"),
    "phrase_unknown": "SELECT doc_id FROM documents WHERE false",
    "phrase_double_space": "SELECT doc_id FROM documents WHERE false",
    "phrase_only_spaces": "SELECT doc_id FROM documents",
    "match_numbers": _T + f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS match, start FROM ({_phrase_sql('the', 'of')})",
    "search_page": _T + "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM w WHERE v = 'the') ORDER BY doc_id LIMIT 10 OFFSET 20",
    "search_filter_text": "SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src1')",
    "search_filter_set": "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')",
    "search_filter_codes": "SELECT doc_id, lang FROM (SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS c FROM documents) WHERE c IN (0, 2)",
    "search_filter_empty_set": "SELECT doc_id, lang FROM documents WHERE false",
    "search_combined": _T + f"SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND contains(lower(source), 'src1') AND doc_id IN (SELECT doc_id FROM ({_phrase_sql('the', 'of')}))",
    "context_nested": _T + f"SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower(source), 'src1') AND doc_id IN (SELECT doc_id FROM ({_phrase_sql('the', 'of')}))",
    "keyness_two_contexts": _ll_sql("lang = 'en'", "lang = 'de'") + "SELECT lemma, ll FROM k",
    "keyness_lang_vs_all": _ll_sql("lang = 'en'", "true") + "SELECT lemma, ll FROM k",
    "word_cloud_sizes": _ll_sql("lang = 'fr'", "true") + "SELECT lemma, ll, round(sqrt(ll / max(ll) OVER ()) * 100, 6) AS size FROM k",
    "meta_types": _LAB
    + r"SELECT name, CASE WHEN bool_and(value IN ('0', '1', '')) AND bool_or(value = '0') AND bool_or(value = '1') THEN 'boolean' WHEN bool_and(value = '' OR (regexp_full_match(value, '[+-]?[0-9]+') AND TRY_CAST(value AS INTEGER) IS NOT NULL)) THEN 'int' WHEN bool_and(value = '' OR regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) THEN 'date' ELSE 'string' END AS type FROM cells GROUP BY name",
    "meta_facets": _LAB + "SELECT name, count(DISTINCT value) AS n, CASE WHEN count(DISTINCT value) < 100 THEN array_to_string(list_sort(list(DISTINCT value)), '|') END AS vals FROM cells GROUP BY name",
    "meta_codes": _LAB + "SELECT source AS value, row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM m)",
    "meta_encoded": _LAB + "SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS lang, dense_rank() OVER (ORDER BY source) - 1 AS source FROM m",
    "meta_card": _LAB.replace("FROM m)", "FROM m WHERE doc_id = 7)").replace("FROM m UNION", "FROM m WHERE doc_id = 7 UNION") + "SELECT name, value FROM cells",
    "meta_contains": "SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'medi')",
    "page_words": _P + "SELECT v AS value, count(*) AS cnt FROM w GROUP BY v",
    "page_phrase_documents": _P + f"SELECT DISTINCT doc_id FROM ({_phrase_sql('the', 'of')})",
    "page_tags": f"SELECT value, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<script[^>]*>).*?</script>|(<style[^>]*>).*?</style>', '\\1\\2', 'gsi'), '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS value FROM pages) GROUP BY value",
    "page_names": r"SELECT page_id, regexp_replace(string_split(url, '/')[-1], '\..*', '') AS name FROM pages",
    "document_neighbours": "SELECT doc_id, lag(doc_id) OVER (ORDER BY doc_id) AS previous, lead(doc_id) OVER (ORDER BY doc_id) AS next FROM documents",
    "interval_runs": _T + "SELECT doc_id, min(pos) AS lo, max(pos) AS hi FROM (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM w WHERE v IN ('the', 'of', 'and')) GROUP BY doc_id, g",
    "catalog_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS num_documents FROM {t}" for t in ("benchmark", "conversations", "documents", "pages")),
}
