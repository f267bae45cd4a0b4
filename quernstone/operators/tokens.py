"""From texts to token rows (doc_id, pos, kind, value), and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import spread, stream
from quernstone.sources.readers import text_nodes

#: A lexicon up to this many rows and bytes is sent to every task, a larger one is joined by shuffle.
LEXICON_ROWS = 500_000
LEXICON_BYTES = 32 << 20
KINDS = ("word", "text", "attr", "tag", "nospace", "end")


def text_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", dealt: bool = False) -> DataFrame:
    """Tokens of plain texts, each one text node. Positions count the no-space marks too.

    Documents that are dealt already stay where they are.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_t"))
    rows = rows if dealt else spread(rows)
    flat = rows.select("doc_id", F.posexplode(stream(F.col("_t"))).alias("pos", "value"))
    return flat.select("doc_id", "pos", F.when(F.col("value").isNull(), "nospace").otherwise("word").alias("kind"), "value")


def html_words(pages: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """Words of HTML pages without parsing them into trees: text nodes by pattern.

    Between nodes the position jumps by one more, as a tag stands there: no phrase runs across.
    """
    rows = spread(pages.select(F.col(key).cast("long").alias("doc_id"), F.col(html).alias("_h")))
    nodes = F.transform(text_nodes(F.col("_h")), lambda n: F.concat(stream(n), F.array(F.lit(None).cast("string"))))
    flat = rows.select("doc_id", F.posexplode(F.flatten(nodes)).alias("pos", "value"))
    return flat.filter(F.col("value").isNotNull()).select("doc_id", "pos", F.lit("word").alias("kind"), "value")


def words(tokens: DataFrame) -> DataFrame:
    return tokens.filter(F.col("kind") == "word")


def lemmatized(tokens: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Adds lemma: of a word its lexicon entry or the word itself, of any other token null.

    lexicon (form, lemma) has one row a form; without one, every form is its own lemma.
    """
    word = F.when(F.col("kind") == "word", F.col("value"))
    if lexicon is None:
        return tokens.withColumn("lemma", word)
    entries = lexicon.groupBy("form").agg(F.min("lemma").alias("_lemma"))
    size = lexicon.limit(LEXICON_ROWS + 1).agg(F.count("*").alias("n"), F.sum(F.length("form") + F.length("lemma")).alias("chars")).first()
    if size["n"] <= LEXICON_ROWS and 4 * (size["chars"] or 0) <= LEXICON_BYTES:
        entries = F.broadcast(entries)
    joined = tokens.withColumn("form", word).join(entries, "form", "left")
    return joined.withColumn("lemma", F.coalesce("_lemma", "form")).drop("form", "_lemma")


def token_frequencies(tokens: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(kind, value, cnt) over all tokens, added to the counts of start if given."""
    counts = tokens.groupBy("kind", "value").agg(F.count("*").alias("cnt"))
    if start is None:
        return counts
    return counts.unionByName(start.select("kind", "value", "cnt")).groupBy("kind", "value").agg(F.sum("cnt").alias("cnt"))


def lemma_ids(forms: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(form, lemma, id) of words (form): ids number the distinct lemmata from 0 in code-point order."""
    words_ = forms.select("form").distinct().select(F.lit("word").alias("kind"), F.col("form").alias("value"))
    pairs = lemmatized(words_, lexicon).select(F.col("value").alias("form"), "lemma")
    return pairs.join(numbered(pairs.select("lemma").distinct(), [], "lemma", "id"), "lemma").select("form", "lemma", "id")


def encoded_stream(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, pos, id): tokens as ids of a vocabulary (kind, value, id).

    A part of the vocabulary, its rows distinct, is hashed where the tokens are dealt to: these aren't sorted.
    """
    keyed = tokens.select("doc_id", "pos", "kind", F.coalesce("value", F.lit("")).alias("value"))
    return keyed.join(vocab.hint("shuffle_hash"), ["kind", "value"]).select("doc_id", "pos", "id")


def decoded_stream(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """The inverse of encoded_stream: (doc_id, pos, kind, value)."""
    return ids.join(vocab.hint("shuffle_hash"), "id").select("doc_id", "pos", "kind", F.when(F.col("kind").isin("nospace", "end"), F.lit(None)).otherwise(F.col("value")).alias("value"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(kind, value, id): distinct tokens numbered from 0, by kind, then in code-point order."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    distinct = tokens.select("kind", F.coalesce("value", F.lit("")).alias("value")).distinct().withColumn("k", rank)
    return numbered(distinct, ["k"], "value", "id").drop("k")


def numbered(df: DataFrame, before: list[str], value: str, to: str) -> DataFrame:
    """Number distinct rows from 0 in the order of (*before, value), without sorting all in one task.

    Rows are sorted within groups of one two-letter prefix; only the groups' sizes meet in one task.
    """
    return _within_prefixes(df.withColumn("_p", F.substring(value, 1, 2)), before, value, to)


def _within_prefixes(df: DataFrame, before: list[str], value: str, to: str) -> DataFrame:
    group = [*before, "_p"]
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n"))
    upto = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(*group)) - F.col("_n")).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*group).orderBy(value))
    return df.withColumn("_i", inner).join(upto, group).withColumn(to, (F.col("_before") + F.col("_i") - 1).cast("long")).drop("_p", "_i", "_before")


#: Rows of one prefix that are sorted in one task.
PREFIX_ROWS = 1 << 20


def ranked(df: DataFrame, value: str, to: str, rows: int = PREFIX_ROWS) -> DataFrame:
    """Number rows with distinct texts from 0 in their order, also where most begin alike, as paths do.

    Rows are sorted within groups of a common prefix. A group of more than rows rows is cut
    further: its prefix grows by what all of it have in common and two letters, until no group is
    larger. Only the groups' sizes meet in one task. df is read once for each growth.
    """
    df = df.withColumn("_p", F.substring(value, 1, 2))
    while True:
        large = df.filter(F.length(value) > F.length("_p")).groupBy("_p").agg(F.count("*").alias("n"), F.min(value).alias("a"), F.max(value).alias("b")).filter(F.col("n") > rows).limit(LEXICON_ROWS).collect()
        if not large:
            break
        grown = df.sparkSession.createDataFrame([(r["_p"], len(_common(r["a"], r["b"])) + 2) for r in large], "_p string, _l int")
        df = df.join(F.broadcast(grown), "_p", "left").withColumn("_p", F.when(F.col("_l").isNull(), F.col("_p")).otherwise(F.expr(f"substring(`{value}`, 1, _l)"))).drop("_l")
    return _within_prefixes(df, [], value, to)


def _common(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def lemma_counts(tokens: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(lemma, cnt) for every lemma of the corpus; counts are of the documents in within, or of all.

    Lemmata that within lacks have count 0. Punctuation counts.
    """
    lemmata = words(tokens)
    if within is None:
        return lemmata.groupBy("lemma").agg(F.count("*").alias("cnt"))
    # one pass over the tokens: rows outside add 0
    marked = lemmata.join(within.select("doc_id").distinct().withColumn("_in", F.lit(1)), "doc_id", "left")
    return marked.groupBy("lemma").agg(F.count("_in").alias("cnt"))


def postings(tokens: DataFrame) -> DataFrame:
    """(lemma, doc_id, tf): a row for each document a lemma is in. Never one list per lemma."""
    return words(tokens).groupBy("lemma", "doc_id").agg(F.count("*").alias("tf"))


def postings_in_order(tokens: DataFrame) -> DataFrame:
    """postings in the order of lemma and document, ranges of both. One shuffle: what is counted lies together in a range."""
    dealt = words(tokens).select("lemma", "doc_id").repartitionByRange("lemma", "doc_id")
    return dealt.groupBy("lemma", "doc_id").agg(F.count("*").alias("tf")).sortWithinPartitions("lemma", "doc_id")


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("lemma").agg(F.count("*").alias("df"))


#: Documents of one lemma are put in order in stretches of so many ids.
STRETCH = 1 << 20


def gaps(posts: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(lemma, doc_id, gap) to the lemma's document before; the first gap is the id and one.

    A lemma in very many documents is cut into stretches of ids; only the last id of each
    stretch is carried to the next.
    """
    rows = posts.select("lemma", "doc_id", F.floor(F.col("doc_id") / stretch).alias("_s"))
    inner = F.lag("doc_id").over(Window.partitionBy("lemma", "_s").orderBy("doc_id"))
    last = rows.groupBy("lemma", "_s").agg(F.max("doc_id").alias("_last"))
    carried = last.select("lemma", "_s", F.lag("_last").over(Window.partitionBy("lemma").orderBy("_s")).alias("_before"))
    return rows.withColumn("_p", inner).join(carried, ["lemma", "_s"]).select("lemma", "doc_id", (F.col("doc_id") - F.coalesce("_p", "_before", F.lit(-1))).alias("gap"))


def intervals(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, lo, hi): runs of whole numbers that follow one another."""
    w = Window.partitionBy(key).orderBy(value)
    island = F.col(value) - F.row_number().over(w)
    return rows.select(key, value).distinct().withColumn("_i", island).groupBy(key, "_i").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).drop("_i")


def entropy(frequencies: DataFrame) -> DataFrame:
    """(tokens, symbols, bits): size of the stream under an ideal code of its symbols, in bits a token."""
    total = F.sum("cnt")
    each = F.sum(F.col("cnt") * F.log2("cnt"))
    return frequencies.agg(total.alias("tokens"), F.count("*").alias("symbols"), (F.log2(total) - each / total).alias("bits"))
