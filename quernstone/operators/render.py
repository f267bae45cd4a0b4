"""Token streams back to text: plain, as HTML, with phrase hits marked."""

from __future__ import annotations

import html as markup
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import SEPARATORS, spread, stream
from quernstone.operators.search import phrase_positions
from quernstone.sources.readers import VOID, page_stream

Token = tuple[str, str | None]
_BREAKS = {"p": "\n\n"} | dict.fromkeys(("br", "h1", "h2", "h3", "h4", "h5", "h6"), "\n")
_MARK: list[Token] = [("space", None), ("tag", "span"), ("attr", "class"), ("text", "match")]


def plain_text(tokens: Iterable[Token]) -> str:
    """Words with single spaces; paragraphs end in an empty line, headings and breaks in a new line.

    Any tag, start or end, takes the space before the next word: words glue across inline tags.
    """
    out, tags, space = [], [], False
    for kind, value in tokens:
        if kind == "word":
            out.append(f" {value}" if space else value)
            space = True
        elif kind == "tag":
            tags.append(value)
            space = False
        elif kind == "end":
            out.append(_BREAKS.get(tags.pop() if tags else "", ""))
            space = False
        elif kind == "nospace":
            space = False
    return "".join(out)


def highlighted(tokens: list[Token], starts: set[int], length: int) -> list[Token]:
    """The stream with a span around each hit; where one ends and one begins, the end comes first."""
    out: list[Token] = []
    for i, token in enumerate(tokens):
        if i - length in starts:
            out += [("end", None), ("space", None)]
        if i in starts:
            out += _MARK
        out.append(token)
    if len(tokens) - length in starts:
        out += [("end", None)]
    return out


def tree(tokens: list[Token]):
    """Nested [tag, {attributes}, child, ...] of a stream; text outside any tag stands alone."""
    top: list = []
    stack, text, space, attr = [top], [], False, None

    def flush() -> None:
        if text:
            stack[-1].append("".join(text))
            text.clear()

    for kind, value in tokens:
        if kind == "word":
            text.append(f" {value}" if space else value)
            space = True
        elif kind == "nospace":
            space = False
        elif kind == "space":
            if space:
                text.append(" ")
            space = True
        elif kind == "tag":
            flush()
            node = [value, {}]
            stack[-1].append(node)
            stack.append(node)
            space = False
        elif kind == "attr":
            attr = value
        elif kind == "text":
            stack[-1][1][attr] = value
        elif kind == "end":
            flush()
            if len(stack) > 1:
                stack.pop()
            space = False
    flush()
    return top


def to_html(nodes: list, header: str = "") -> str:
    """HTML of a tree, with header put into the head element, or before all without one."""

    def one(node) -> str:
        if isinstance(node, str):
            return markup.escape(node, quote=False)
        tag, attrs, *inner = node
        head = "".join(f' {k}="{markup.escape(v)}"' for k, v in attrs.items())
        if tag in VOID:
            return f"<{tag}{head}>"
        return f"<{tag}{head}>{header if tag == 'head' else ''}{''.join(map(one, inner))}</{tag}>"

    body = "".join(map(one, nodes))
    return body if "<head" in body else header + body


def _body(stream: list[Token], starts: set[int], length: int, how: str, header: str) -> str:
    stream = highlighted(stream, starts, length) if length else stream
    return plain_text(stream) if how == "plain" else to_html(tree(stream), header)


def _bodies(rows: DataFrame, made: Callable[..., str | None]) -> DataFrame:
    """(doc_id, body) of rows of doc_id and what made takes; None gives no row. Nothing is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = [], []
            for key, *parts in zip(*batch.columns, strict=True):
                body = made(*(part.as_py() for part in parts))
                if body is not None:
                    ids.append(key.as_py())
                    bodies.append(body)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.string())], ["doc_id", "body"])

    return rows.mapInArrow(run, "doc_id long, body string")


def rendered(tokens: DataFrame, terms: list[str] | None = None, how: str = "html", header: str = "") -> DataFrame:
    """(doc_id, body) for every document of tokens (doc_id, pos, kind, value, lemma).

    how is html or plain. With terms each hit is marked. A document is put together in one task;
    tokens are shuffled once, and hits are found in the document. Of whole texts or pages see
    rendered_texts and rendered_pages, which shuffle nothing.
    """
    lemma = F.when(F.col("kind") == "word", F.col("lemma")) if terms else F.lit(None).cast("string")
    token = F.struct("pos", "kind", "value", lemma.alias("lemma"))
    rows = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(token)).alias("t")).select("doc_id", "t.pos", "t.kind", "t.value", *(["t.lemma"] if terms else []))
    terms = terms or []

    def made(pos: list, kinds: list, values: list, lemmata: list = ()) -> str:
        n = len(terms)
        starts = {i for i, v in enumerate(lemmata) if v == terms[0] and list(lemmata[i : i + n]) == terms and pos[i + n - 1] == pos[i] + n - 1}
        return _body(list(zip(kinds, values, strict=True)), starts, n, how, header)

    return _bodies(rows, made)


def rendered_pages(pages: DataFrame, key: str = "doc_id", html: str = "html", how: str = "html", header: str = "") -> DataFrame:
    """rendered of the tokens of whole pages, each parsed and put together at once."""

    def made(source: str | None) -> str | None:
        stream = page_stream(source)
        return _body(stream, set(), 0, how, header) if stream else None

    return _bodies(pages.select(F.col(key).cast("long"), F.col(html).cast("string")), made)


def _escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def _marked(s: Column, terms: list[str]) -> tuple[Column, Column]:
    """HTML of a plain text's token array with hits marked, and whether there is a hit."""
    length = len(terms)
    hit = lambda i: reduce(Column.__and__, (F.coalesce(F.get(s, i + j) == t, F.lit(False)) for j, t in enumerate(terms)))
    some = lambda condition, text: F.when(condition, text).otherwise("")

    def one(v: Column, i: Column) -> Column:
        word = F.concat(some(F.get(s, i - 1).isNotNull(), " "), some(hit(i), '<span class="match">'), _escaped(v))
        return F.concat(some(hit(i - length), "</span>"), F.coalesce(word, F.lit("")))

    body = F.concat(F.array_join(F.transform(s, one), ""), some(hit(F.size(s) - length), "</span>"))
    return body, F.size(F.filter(s, lambda _, i: hit(i))) > 0


def rendered_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", terms: list[str] | None = None, how: str = "html", hits_only: bool = False) -> DataFrame:
    """rendered of the tokens of whole plain texts whose forms are their lemmata; with hits_only of those with a hit.

    A text's tokens in turn are the text with single spaces, so only texts that may hold a hit are
    cut into them. Nothing is moved. Documents without a token or an id give no row.
    """
    if how == "plain" and terms:
        raise ValueError("hits are marked in html")
    rows = spread(docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t")).filter("doc_id IS NOT NULL"))
    plain = F.trim(F.regexp_replace("_t", SEPARATORS, " "))
    body = plain if how == "plain" else _escaped(plain)
    shown = plain != ""
    if terms:
        may = reduce(Column.__and__, (F.contains(F.col("_t"), F.lit(t)) for t in terms))
        rows = rows.withColumn("_s", F.when(may, stream(F.col("_t"))))
        marked, found = _marked(F.col("_s"), terms)
        shown = F.col("_s").isNotNull() & found if hits_only else shown
        body = marked if hits_only else F.when(F.col("_s").isNotNull(), marked).otherwise(body)
    # a filter would be worked out below the tokens, and they twice
    return rows.select("doc_id", F.explode(F.when(shown, F.array(body))).alias("body"))


def matches(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, match, start): hits of a document numbered from 0."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("start")
    return phrase_positions(tokens, terms).withColumn("match", (F.row_number().over(w) - 1).cast("long")).select("doc_id", "match", "start")


def next_match(at: int, step: int, n: int) -> int:
    """The hit that many steps on, held within the first and the last."""
    return max(0, min(n - 1, at + step))
