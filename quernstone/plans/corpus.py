"""A corpus: documents with metadata, their tokens, and named sub-corpora; written once, read lazily.

Layout of a written corpus, one Parquet table each: documents (doc_id, path, metadata columns),
tokens (doc_id, pos, kind, value, lemma) in doc_id order, postings (lemma, doc_id, tf) in lemma
order, so that row groups can be skipped by either key; lexicon (form, lemma); info; contexts. A
corpus and each of its contexts are folders of versions, of which the newest is read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Thread
from urllib.parse import quote, unquote

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import phrase_terms
from quernstone.operators import keyness, metadata, render, search, tokens
from quernstone.sources import readers, versions

#: Names that mean the whole corpus.
WHOLE = (None, "")
#: How marked hits look unless a corpus's own header says otherwise; fixed values.
DEFAULT_STYLE = "<style>.match { background-color: yellow; } .selected { font-size: 150%; }</style>"


@dataclass
class Query:
    """Phrase, metadata filters, a sub-corpus to look in, and a page of the result."""

    phrase: str | None = None
    filters: dict = field(default_factory=dict)
    within: str | None = None
    offset: int = 0
    limit: int = 10


def _by_key(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows in ranges of the key and in its order, before they become many tokens."""
    return rows.select(key, value).repartitionByRange(F.col(key).cast("long")).sortWithinPartitions(F.col(key).cast("long"))


class Corpus:
    def __init__(self, documents: DataFrame, toks: DataFrame, columns: list[str], path: str | None = None, posts: DataFrame | None = None, info: dict | None = None):
        self.documents, self.tokens, self.columns, self.path = documents, toks, columns, path
        self.posts, self.info = posts, info or {}
        #: The tokens in document order without a sort of their own, where there is such a way.
        self.in_order: Callable[[], DataFrame] | None = None
        #: (doc_id, body) of all documents with a phrase's terms marked, where their sources are at hand.
        self.shown_from: Callable[[list[str] | None], DataFrame] | None = None
        self.unknown_is_whole = False
        self.contexts: dict[str, tuple[str, DataFrame]] = {}
        self._counts: dict[tuple[str, int], DataFrame] = {}
        self._version: dict[str, int] = {}

    # -- making ------------------------------------------------------------------------------

    @classmethod
    def of_texts(cls, docs: DataFrame, columns: list[str], key: str = "doc_id", text: str = "text", path: str | None = None, lexicon: DataFrame | None = None) -> Corpus:
        """From rows of plain text; columns become metadata, path (or the key) names a document."""
        named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(path or key).cast("string").alias("path"), *columns)
        corpus = cls(metadata.as_strings(named, *columns), tokens.lemmatized(tokens.text_tokens(docs, key, text), lexicon), columns)
        if lexicon is None:
            corpus.in_order = lambda: tokens.lemmatized(tokens.text_tokens(_by_key(docs, key, text), key, text, dealt=True))
            corpus.shown_from = lambda terms: render.rendered_texts(docs, key, text, terms)
        return corpus

    @classmethod
    def of_pages(cls, pages: DataFrame, columns: list[str], key: str = "page_id", html: str = "html", path: str = "url", lexicon: DataFrame | None = None, trees: bool = True) -> Corpus:
        """From rows of HTML: with trees by the parser, so that pages can be shown, else words alone."""
        named = pages.select(F.col(key).cast("long").alias("doc_id"), F.col(path).cast("string").alias("path"), *columns)
        toks = readers.page_tokens(pages, key, html) if trees else tokens.html_words(pages, key, html)
        corpus = cls(metadata.as_strings(named, *columns), tokens.lemmatized(toks, lexicon), columns)
        if lexicon is None and trees:
            corpus.in_order = lambda: tokens.lemmatized(readers.page_tokens(_by_key(pages, key, html), key, html))
        return corpus

    @classmethod
    def of_files(cls, spark: SparkSession, source: str, lexicon: DataFrame | None = None) -> Corpus:
        """From a CSV with a file column, or a folder of HTML files. Documents are numbered by path order."""
        meta = readers.metadata(spark, source)
        columns = [c for c in meta.columns if c != "file"]
        # paths alone are numbered; the texts join them afterwards
        numbers = tokens.ranked(meta.select("file").distinct(), "file", "doc_id")
        read = readers.texts(spark, meta, source if readers.is_folder(spark, source) else None)
        pages = read.join(numbers, "file").withColumnRenamed("file", "path")
        return cls.of_pages(pages, columns, "doc_id", "html", "path", lexicon)

    def write(self, path: str) -> Corpus:
        """Writes the corpus and opens what is written: a new version, seen only when complete."""
        spark = self.documents.sparkSession
        staging = versions.staging(path)
        self.documents.write.parquet(f"{staging}/documents")
        toks = self.in_order() if self.in_order else self.tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "pos")
        toks.write.parquet(f"{staging}/tokens")
        written = spark.read.parquet(f"{staging}/tokens")
        tokens.postings_in_order(written).write.parquet(f"{staging}/postings")
        written.filter("kind = 'word'").select(F.col("value").alias("form"), "lemma").distinct().write.parquet(f"{staging}/lexicon")
        spark.createDataFrame([(json.dumps({"columns": self.columns, **self.info}),)], "value string").coalesce(1).write.text(f"{staging}/info")
        versions.publish(spark, staging, path)
        return Corpus.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Corpus:
        path = versions.latest(spark, path) or path
        info = json.loads(spark.read.text(f"{path}/info").first()[0])
        columns = info.pop("columns")
        table = lambda t: spark.read.parquet(f"{path}/{t}")
        corpus = cls(table("documents"), table("tokens"), columns, path, table("postings"), info)
        for safe, _ in versions.names(spark, f"{path}/contexts"):
            at = versions.latest(spark, f"{path}/contexts/{safe}")
            if at:
                note = json.loads(spark.read.text(f"{at}/note").first()[0])
                corpus.contexts[unquote(safe)] = (note["description"], spark.read.parquet(f"{at}/ids"))
        return corpus

    def lexicon(self) -> DataFrame:
        """(form, lemma, id): each form of the corpus with its lemma and the lemma's number."""
        if self.path:
            pairs = self.documents.sparkSession.read.parquet(f"{self.path}/lexicon")
        else:
            pairs = tokens.words(self.tokens).select(F.col("value").alias("form"), "lemma").distinct()
        return tokens.lemma_ids(pairs.select("form"), pairs)

    # -- sub-corpora -------------------------------------------------------------------------

    def context(self, name: str | None) -> DataFrame | None:
        """Document ids of a sub-corpus, None for the whole corpus.

        An unknown name is an error, or the whole corpus if unknown_is_whole is set.
        """
        if name in WHOLE or (self.unknown_is_whole and name not in self.contexts):
            return None
        if name not in self.contexts:
            raise KeyError(f"no context {name}")
        return self.contexts[name][1]

    def create_context(self, name: str, query: Query) -> DataFrame:
        """Names a query's documents, all pages of them. In a written corpus the context is written."""
        ids = self.select(query).select("doc_id")
        if self.path:
            spark = ids.sparkSession
            home = f"{self.path}/contexts/{quote(name, safe='')}"
            staging = versions.staging(home)
            ids.write.parquet(f"{staging}/ids")
            note = json.dumps({"description": repr(query)})
            spark.createDataFrame([(note,)], "value string").coalesce(1).write.text(f"{staging}/note")
            ids = spark.read.parquet(f"{versions.publish(spark, staging, home)}/ids")
        self.contexts[name] = (repr(query), ids)
        old = self._counts.pop((name, self._version.get(name, 0)), None)
        if old is not None:
            old.unpersist()
        self._version[name] = self._version.get(name, 0) + 1
        return ids

    def close(self) -> None:
        """Lets go of the kept counts."""
        for df in self._counts.values():
            df.unpersist()
        self._counts.clear()

    # -- questions ---------------------------------------------------------------------------

    def select(self, query: Query) -> DataFrame:
        """All documents of a query, unordered: sub-corpus, then phrase, then filters."""
        rows = search.filtered(self.documents, query.filters, self.columns)
        within = self.context(query.within)
        terms = phrase_terms(query.phrase)
        if terms:
            rows = rows.join(self.phrase_documents(terms, within), "doc_id", "left_semi")
        return rows if within is None else rows.join(within, "doc_id", "left_semi")

    def phrase_documents(self, terms: list[str], within: DataFrame | None = None) -> DataFrame:
        """(doc_id) of the documents that hold the phrase.

        In a written corpus the documents of all terms come from the postings, which are sorted by
        lemma; only these documents' tokens of the terms are read on. A single term needs no tokens.
        """
        if self.posts is None:
            return search.phrase_positions(self.tokens, terms).select("doc_id")
        distinct = sorted(set(terms))
        found = self.posts.filter(F.col("lemma").isin(*distinct))
        if len(distinct) == 1:
            documents = found.filter(F.col("tf") >= len(terms)).select("doc_id")
        else:
            documents = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(distinct)).select("doc_id")
        if within is not None:
            documents = documents.join(within, "doc_id", "left_semi")
        if len(terms) == 1:
            return documents
        toks = self.tokens.filter(F.col("lemma").isin(*distinct)).join(documents, "doc_id", "left_semi")
        return search.phrase_positions(toks, terms).select("doc_id")

    def get_documents(self, query: Query) -> DataFrame:
        """A page of a query's documents in doc_id order: (doc_id, path, metadata)."""
        return search.page(self.select(query), query.offset, query.limit)

    def total(self, query: Query) -> int:
        return self.select(query).count()

    def neighbours(self) -> DataFrame:
        """(doc_id, previous, next) of every document."""
        from pyspark.sql import Window

        # ids are cut into ranges; only each range's ends meet in one task
        ids = self.documents.select("doc_id").withColumn("r", F.floor(F.col("doc_id") / 4096))
        w, ends = Window.partitionBy("r").orderBy("doc_id"), Window.orderBy("r")
        edge = ids.groupBy("r").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        edge = edge.select("r", F.lag("hi").over(ends).alias("p"), F.lead("lo").over(ends).alias("n"))
        near = ids.select("r", "doc_id", F.lag("doc_id").over(w).alias("a"), F.lead("doc_id").over(w).alias("b"))
        return near.join(edge, "r").select("doc_id", F.coalesce("a", "p").alias("previous"), F.coalesce("b", "n").alias("next"))

    def postings_of(self, lemma: str) -> DataFrame:
        posts = self.posts if self.posts is not None else tokens.postings(self.tokens.filter(F.col("lemma") == lemma))
        return posts.filter(F.col("lemma") == lemma).select("doc_id", "tf").orderBy("doc_id")

    def counts(self, name: str | None = None) -> DataFrame:
        """Lemma counts of a sub-corpus, kept for as long as its name isn't given anew."""
        key = (name or "", self._version.get(name or "", 0))
        if key not in self._counts:
            self._counts[key] = tokens.lemma_counts(self.tokens, self.context(name)).cache()
        return self._counts[key]

    def frequency_list(self, name: str | None = None, limit: int | None = None, offset: int = 0, drop_zero: bool = False) -> DataFrame:
        out = keyness.frequency_list(self.counts(name), drop_zero).offset(max(0, offset))
        return out if limit is None else out.limit(limit)

    def compare_contexts(self, first: str | None, second: str | None = None, signed: bool = False) -> DataFrame:
        return keyness.keyness(self.counts(first), self.counts(second), signed=signed)

    def word_cloud(self, name: str | None) -> DataFrame:
        """Key lemmata of a sub-corpus against the whole corpus, with their sizes."""
        return keyness.word_cloud(self.compare_contexts(name, None))

    def get_info(self) -> dict:
        """Facets, custom presentation, and sub-corpora by name with their descriptions."""
        rows = {r["name"]: r["values"] for r in metadata.facets(self.documents, self.columns).collect()}
        return {"metadata": [(c, rows[c]) if rows[c] is not None else (c,) for c in self.columns], "custom": self.info, "contexts": sorted((n, d) for n, (d, _) in self.contexts.items())}

    def document(self, path: str, phrase: str | None = None) -> str | None:
        """HTML of the first document of a path, hits of phrase marked; None if there is none."""
        first = self.documents.filter(F.col("path") == path).agg(F.min("doc_id")).first()[0]
        if first is None:
            return None
        rows = self.views(phrase, self.tokens.filter(F.col("doc_id") == first)).collect()
        return rows[0]["body"] if rows else self.style()

    def style(self) -> str:
        """What stands before a shown document: the default style, then the corpus's own header."""
        return DEFAULT_STYLE + self.info.get("html-header", "")

    def views(self, phrase: str | None = None, toks: DataFrame | None = None) -> DataFrame:
        """(doc_id, body) of all documents, or those of toks, as shown: style, then HTML with hits marked."""
        if toks is None and self.shown_from is not None:
            shown = self.shown_from(phrase_terms(phrase))
        else:
            shown = render.rendered(self.tokens if toks is None else toks, phrase_terms(phrase), "html")
        return shown.select("doc_id", F.concat(F.lit(self.style()), "body").alias("body"))

    def first_of_paths(self) -> DataFrame:
        """(path, doc_id): the document that a path stands for, the first of those that share it."""
        return self.documents.groupBy("path").agg(F.min("doc_id").alias("doc_id"))

    def layout(self) -> list[tuple[str, str, float]]:
        return metadata.layout(self.columns, self.info.get("columns-shown"))

    def card(self, doc_id: int):
        """The document's card: the corpus's vignette filled in, or a row for each column."""
        values = {r["name"]: r["value"] for r in metadata.card(self.documents, doc_id, self.columns).collect()}
        template = self.info.get("vignette")
        return metadata.filled(template, values) if template else [[c, values.get(c)] for c in self.columns]

    def frequency_csv(self, path: str, name: str | None = None) -> None:
        """Writes the frequency list as one CSV without a header."""
        self.frequency_list(name).coalesce(1).write.mode("overwrite").csv(path)


class Engine:
    """A folder of corpora, and the service's operations on it."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")
        self._open: dict[str, Corpus] = {}
        self._ids: list[str] = []
        self.task: str | None = None

    def get_corpora(self) -> DataFrame:
        """(corpus_id, name, num_documents) by name. Counts come from file footers; ids last for the session."""
        found = {n: versions.latest(self.spark, f"{self.home}/{n}") for n, folder in versions.names(self.spark, self.home) if folder}
        names = sorted(n for n, at in found.items() if at)
        self._ids += [n for n in names if n not in self._ids]
        rows = [(self._ids.index(n), n, self.spark.read.parquet(f"{found[n]}/documents").count()) for n in names]
        return self.spark.createDataFrame(rows, "corpus_id int, name string, num_documents long").orderBy("name")

    def corpus(self, name: str | int | None) -> Corpus | None:
        """An open corpus by name or id, opened once."""
        if name is None:
            return None
        if isinstance(name, int) or (isinstance(name, str) and re.fullmatch(r"\d+", name) and name not in self._ids):
            name = self._ids[int(name)]
        if name not in self._open:
            self._open[name] = Corpus.open(self.spark, f"{self.home}/{name}")
        return self._open[name]

    def create_corpus(self, name: str, source: str, lexicon: DataFrame | None = None) -> Corpus:
        """Builds a corpus from a CSV or a folder. Progress shows as the job description and in get_task_info."""
        sc = self.spark.sparkContext
        self.task = f"Building {name}"
        sc.setJobDescription(self.task)
        try:
            self._open[name] = Corpus.of_files(self.spark, source, lexicon).write(f"{self.home}/{name}")
        finally:
            self.task = None
            sc.setJobDescription(None)
        return self._open[name]

    def start_corpus(self, name: str, source: str, lexicon: DataFrame | None = None) -> Thread:
        """create_corpus in the background; get_task_info tells of it, and the corpus appears when done."""
        self.task = f"Building {name}"
        thread = InheritableThread(target=self.create_corpus, args=(name, source, lexicon))
        thread.start()
        return thread

    def get_task_info(self) -> dict | None:
        """What is being built and how many tasks are under way; None if nothing is."""
        if self.task is None:
            return None
        tracker = self.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        return {"task": self.task, "done": sum(s.numCompletedTasks for s in stages if s), "of": sum(s.numTasks for s in stages if s)}

    def get_documents(self, name, query: Query) -> DataFrame:
        return self.corpus(name).get_documents(query)

    def get_corpus_info(self, name) -> dict:
        return self.corpus(name).get_info()

    def frequency_list(self, name, context: str | None = None) -> DataFrame:
        return self.corpus(name).frequency_list(context)

    def create_context(self, name, context: str, query: Query) -> DataFrame:
        return self.corpus(name).create_context(context, query)

    def compare_contexts(self, name, first: str | None, second: str | None) -> DataFrame:
        return self.corpus(name).compare_contexts(first, second)

    def tree(self, path: str) -> list[tuple[str, bool]]:
        return readers.listing(self.spark, path)

    def document(self, name, path: str, phrase: str | None = None) -> str | None:
        return self.corpus(name).document(path, phrase)
