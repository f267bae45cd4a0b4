"""SentencePiece encoding and decoding, with giant documents split and encoded in parallel.

A segmentation of a text is a path of pieces, and its score a sum over neighbouring pieces, so
encoding is a product of max-plus matrices. A giant document is cut into chunks wherever the
cuts fall. The state at a cut is the piece that covers the character before it. Each chunk on
its own yields the transfer matrix from the states at its left cut to those at its right cut;
the matrices of a document are combined (the product is associative), which fixes the one state
at every cut; then each chunk is traced back on its own between its two states.

For a unigram model a step weighs the score of its piece. For a BPE model, such as the public
one, a step weighs 0 if encoding the two pieces' text gives just these two, else minus infinity:
a text's BPE encoding is the one path in which all neighbours pass that test.

No piece holds a word mark behind another sign, so every word mark behind another sign begins a
piece. Between the first and the last such place of a chunk the matrix is one number, and the
library encodes that stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.llm.common import Table, dealt, read, spread

GIANT_CHARS = 1 << 15
CHUNK_CHARS = 1 << 14
#: Neighbouring matrices that are combined at a time.
FAN = 8
MARK = "▁"
NEVER = float("-inf")

#: A state: how far before and behind the cut its piece reaches.
State = tuple[int, int]


class Lattice:
    """Pieces and the weight of one following another, for a BPE or a unigram model."""

    def __init__(self, scores: dict[str, float], bpe: bool = True, unknown: float = -100.0):
        self.scores, self.bpe, self.unknown = scores, bpe, unknown
        self.longest = max(map(len, scores), default=1)
        self.closed = not any(MARK in p.lstrip(MARK) for p in scores)
        self._pairs: dict[tuple[str, str], float] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored neighbours are joined, the leftmost of equals first."""
        parts = list(text)
        while True:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def step(self, before: str, piece: str) -> float:
        """Weight of piece behind before ("" at the start)."""
        if not self.bpe:
            return self.scores.get(piece, self.unknown * len(piece))
        key = before, piece
        if key not in self._pairs:
            if len(self._pairs) > 200_000:
                self._pairs.clear()
            self._pairs[key] = 0.0 if self.merged(before + piece) == ([before, piece] if before else [piece]) else NEVER
        return self._pairs[key]

    def ends(self, text: str, at: int, stop: int) -> list[int]:
        """Where pieces that begin at a place end. A sign of no piece stands alone."""
        return [e for e in range(at + 1, min(len(text), stop, at + self.longest) + 1) if e == at + 1 or text[at:e] in self.scores]

    def paths(self, text: str, first: tuple[int, int], until: int) -> dict[tuple[int, int], tuple[float, tuple[int, int] | None]]:
        """Best scores of pieces (start, end) reached from one piece, with the piece before each.

        Followed up to the pieces that end at or beyond until.
        """
        best: dict[tuple[int, int], tuple[float, tuple[int, int] | None]] = {first: (0.0, None)}
        by_end: dict[int, list[tuple[int, int]]] = {first[1]: [first]}
        for at in range(first[1], until):
            for prior in by_end.get(at, ()):
                score = best[prior][0]
                for end in self.ends(text, at, len(text)):
                    s = score + self.step(text[prior[0] : at], text[at:end])
                    if s > best.get((at, end), (NEVER, None))[0]:
                        if (at, end) not in best:
                            by_end.setdefault(end, []).append((at, end))
                        best[at, end] = s, prior
        return best

    def states(self, text: str, cut: int) -> list[State]:
        """All pieces that cover the character before a cut."""
        return [(cut - a, e - cut) for a in range(max(0, cut - self.longest), cut) for e in self.ends(text, a, len(text)) if e >= cut]

    def forced(self, text: str, start: int, stop: int) -> tuple[int, int] | None:
        """First and last place in a stretch where a piece must begin."""
        if not self.closed:
            return None
        there = [i for i in _marks(text, start, stop) if i > 0 and text[i - 1] != MARK]
        return (there[0], there[-1]) if there else None

    def transfer(self, text: str, left: int, right: int, begins: bool) -> dict:
        """Matrix of the chunk text[left:right]; text has enough around it for pieces over its cuts.

        Given as {"in": [(state, score)], "out": [(state, score)]} if some place is forced, so
        that the matrix is their outer sum, else {"all": [(state in, state out, score)]}.
        """
        entries = [(0, 0)] if begins else self.states(text, left)
        place = self.forced(text, left, right)
        if place is None:
            return {"all": [(s, (right - a, e - right), v) for s in entries for (a, e), (v, _) in self._from(text, left, s, right).items() if a < right <= e and v > NEVER]}
        came = []
        for s in entries:
            if s == (0, 0) and place[0] == left:
                came.append((s, 0.0))
                continue
            reached = [v for (a, e), (v, _) in self._from(text, left, s, place[0]).items() if e == place[0]]
            if reached:
                came.append((s, max(reached)))
        gone = [((right - a, e - right), v) for (a, e), (v, _) in self.paths(text, (place[1], place[1]), right).items() if a < right <= e and v > NEVER]
        return {"in": came, "out": gone}

    def _from(self, text: str, left: int, state: State, until: int) -> dict:
        return self.paths(text, (left - state[0], left + state[1]), until)

    def trace(self, text: str, first: tuple[int, int], last: tuple[int, int]) -> list[tuple[int, int]]:
        """Pieces of the best path behind first up to and with last."""
        found = self.paths(text, first, last[0] + 1)
        out, at = [], last
        while at != first:
            out.append(at)
            at = found[at][1]
        return out[::-1]


def _marks(text: str, start: int, stop: int) -> Iterator[int]:
    at = text.find(MARK, start, stop)
    while at >= 0:
        yield at
        at = text.find(MARK, at + 1, stop)


def combine(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices. Where one is an outer sum, so is the product."""
    if "all" in a and "all" in b:
        rows: dict[State, list[tuple[State, float]]] = {}
        for i, j, v in b["all"]:
            rows.setdefault(i, []).append((j, v))
        best: dict[tuple[State, State], float] = {}
        for i, j, v in a["all"]:
            for k, w in rows.get(j, ()):
                if v + w > best.get((i, k), NEVER):
                    best[i, k] = v + w
        return {"all": [(i, k, v) for (i, k), v in best.items()]}
    if "all" in a:
        return {"in": _best((i, v + w) for i, j, v in a["all"] for k, w in b["in"] if k == j), "out": b["out"]}
    if "all" in b:
        goes = dict(a["out"])
        return {"in": a["in"], "out": _best((j, goes[i] + v) for i, j, v in b["all"] if i in goes)}
    goes = dict(a["out"])
    link = max((goes[i] + v for i, v in b["in"] if i in goes), default=NEVER)
    return {"in": a["in"], "out": [(j, v + link) for j, v in b["out"]] if link > NEVER else []}


def _best(weighed) -> list[tuple[State, float]]:
    best: dict[State, float] = {}
    for s, v in weighed:
        if v > best.get(s, NEVER):
            best[s] = v
    return list(best.items())


def dense(m: dict) -> list[tuple[State, State, float]]:
    return m["all"] if "all" in m else [(i, j, v + w) for i, v in m["in"] for j, w in m["out"]]


def cut_states(matrices: list[dict], came: State = (0, 0), goes: State | None = None) -> list[State]:
    """The state at every cut on the best path from came to goes, from a few matrices in order.

    Without goes the last cut is the text's end, where a piece must end.
    """
    ahead: list[dict[State, tuple[float, State]]] = []
    now = {came: 0.0}
    for m in matrices:
        after: dict[State, tuple[float, State]] = {}
        for i, j, v in dense(m):
            if i in now and now[i] + v > after.get(j, (NEVER, i))[0]:
                after[j] = now[i] + v, i
        ahead.append(after)
        now = {j: v for j, (v, _) in after.items()}
    at = max((s for s in now if s[1] == 0), key=lambda s: now[s]) if goes is None else goes
    out = [at]
    for after in reversed(ahead):
        at = after[at][1]
        out.append(at)
    return out[::-1]


# ---- the library's model ----------------------------------------------------------------------


@lru_cache(2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(2)
def lattice(path: str) -> Lattice:
    sp = _model(path)
    skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return Lattice({sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not skip(i)})


class Encoder:
    """The library's ids of a text from cached ids of its words.

    No piece holds a word mark behind another sign, so a text's words, each with the spaces before
    it, have the ids that they have in it. Texts with repeated or outer spaces, or with a word
    mark of their own, are given to the library whole. The cache is bounded: a full one takes no
    more, and is emptied once it misses a fifth of a text's words.
    """

    MOST, LONGEST = 400_000, 48

    def __init__(self, path: str):
        self.sp = _model(path)
        self.whole = not lattice(path).closed
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        if self.whole or "  " in text or MARK in text or text[:1] == " " or text[-1:] == " " or not text:
            return np.array(self.sp.encode(text), np.int32)
        known, words = self.known, text.split(" ")
        found = list(map(known.get, words))
        holes = found.count(None)
        if holes:
            if len(known) > self.MOST and 5 * holes > len(words) > 100:
                known.clear()
            at = -1
            for _ in range(holes):
                at = found.index(None, at + 1)
                word = words[at]
                got = found[at] = np.array(self.sp.encode(word), np.int32).tobytes()
                if len(word) <= self.LONGEST and len(known) <= self.MOST:
                    known[word] = got
        return np.frombuffer(b"".join(found), np.int32)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _ids(path: str, pieces: list[str]) -> list[int]:
    sp, known = _model(path), lattice(path).scores
    out: list[int] = []
    for p in pieces:
        if p in known:
            out.append(sp.piece_to_id(p))
        else:
            out += [sp.piece_to_id(f"<0x{b:02X}>") for b in p.encode("utf-8", "surrogatepass")]
    return out


def trace_chunk(path: str, text: str, left: int, right: int, came: State, goes: State) -> list[int]:
    """Ids of the pieces that begin in text[left:right], between its two states."""
    lat = lattice(path)
    first, last = (left - came[0], left + came[1]), (right - goes[0], right + goes[1])
    place = lat.forced(text, left, right)
    cover = lambda found: [text[a:b] for a, b in found if left <= a < right]
    if place is None or last[0] < place[1]:
        return _ids(path, cover(lat.trace(text, first, last)))
    out: list[int] = []
    if first[1] < place[0]:
        found = lat.paths(text, first, place[0])
        end = max((k for k in found if k[1] == place[0]), key=lambda k: found[k][0])
        out += _ids(path, cover(lat.trace(text, first, end)))
    if place[0] < place[1]:
        out += encoder(path).ids(text[place[0] + 1 : place[1]].replace(MARK, " ")).tolist()
    return out + _ids(path, cover(lat.trace(text, (place[1], place[1]), last)))


def decode_ids(path: str, ids) -> str:
    """The library's text of ids, also for a document of very many: in runs, each behind a letter."""
    sp, run = _model(path), 1 << 20
    ids = ids if isinstance(ids, list) else [int(i) for i in ids]
    if len(ids) <= run:
        return sp.decode(ids)
    guard, parts, at = sp.piece_to_id("a"), [], 0
    while at < len(ids):
        end = min(len(ids), at + run)
        while end < len(ids) and sp.is_byte(ids[end]):
            end += 1
        parts.append(sp.decode(([guard] if at else []) + ids[at:end])[1 if at else 0 :])
        at = end
    return "".join(parts)


# ---- DataFrames -------------------------------------------------------------------------------

_STATE = "struct<before: int, behind: int>"
_MATRIX = f"uid long, chunk int, whole boolean, came array<struct<s: {_STATE}, v: double>>, goes array<struct<s: {_STATE}, v: double>>, cells array<struct<i: {_STATE}, j: {_STATE}, v: double>>"


def _chunk_rows(path: str, size: int):
    def run(batches):
        sp = _model(path)
        around = lattice(path).longest
        for pdf in batches:
            for uid, text in zip(pdf["uid"], pdf["text"], strict=True):
                norm = sp.normalize(text)
                # what a model makes of the whole text's start, it makes of no other place
                cuts = [*range(0, max(1, len(norm) - around), size), len(norm)]
                rows = [(uid, k, max(0, a - around), a, b, norm[max(0, a - around) : b + around], len(cuts) - 1) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                for at in range(0, len(rows), 256):
                    yield pd.DataFrame(rows[at : at + 256], columns=["uid", "chunk", "offset", "left", "right", "piece", "chunks"])

    return run


_CHUNK = "uid long, chunk int, offset long, left long, right long, piece string, chunks int"


def _row(uid: int, chunk: int, m: dict) -> tuple:
    pair = lambda s: {"before": s[0], "behind": s[1]}
    side = lambda k: [{"s": pair(s), "v": v} for s, v in m.get(k, [])]
    return uid, chunk, "all" in m, side("in"), side("out"), [{"i": pair(i), "j": pair(j), "v": v} for i, j, v in m.get("all", [])]


def _state(s) -> State:
    return int(s["before"]), int(s["behind"])


def _matrix(r) -> dict:
    if r.whole:
        return {"all": [(_state(c["i"]), _state(c["j"]), c["v"]) for c in r.cells]}
    return {"in": [(_state(c["s"]), c["v"]) for c in r.came], "out": [(_state(c["s"]), c["v"]) for c in r.goes]}


_COLUMNS = ["uid", "chunk", "whole", "came", "goes", "cells"]


def _matrices(path: str):
    def run(batches):
        lat = lattice(path)
        for pdf in batches:
            rows = [_row(r.uid, r.chunk, lat.transfer(r.piece, r.left - r.offset, r.right - r.offset, r.chunk == 0)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    """One matrix of up to FAN neighbours."""
    rows = list(pdf.sort_values("chunk").itertuples(index=False))
    m = reduce(combine, map(_matrix, rows))
    return pd.DataFrame([_row(rows[0].uid, rows[0].chunk // FAN, m)], columns=_COLUMNS)


def _inner(pdf: pd.DataFrame) -> pd.DataFrame:
    """The states at the cuts of up to FAN neighbours, from those at their ends (none given: a whole text)."""
    rows = list(pdf.sort_values("chunk").itertuples(index=False))
    ends = ((int(rows[0].a), int(rows[0].b)), (int(rows[0].c), int(rows[0].d))) if rows[0].known else ((0, 0), None)
    at = cut_states([_matrix(r) for r in rows], *ends)
    return pd.DataFrame({"uid": rows[0].uid, "chunk": [r.chunk for r in rows], "a": [s[0] for s in at[:-1]], "b": [s[1] for s in at[:-1]], "c": [s[0] for s in at[1:]], "d": [s[1] for s in at[1:]]})


_CUTS = "uid long, chunk int, a int, b int, c int, d int"


def _scan(matrices: DataFrame, most: int) -> DataFrame:
    """(uid, chunk, a, b, c, d): the states at both cuts of every chunk of texts of at most most chunks.

    Up: FAN neighbours at a time are combined, level by level, until a text is one group of
    matrices. Down: each group's inner cuts follow from the states at its ends. Both take
    log-many rounds, and no task has more than FAN matrices of a group at once.
    """
    levels = [matrices]
    while most > FAN:
        up = levels[-1].withColumn("up", F.expr(f"chunk div {FAN}")).groupBy("uid", "up").applyInPandas(_product, _MATRIX)
        levels.append(Table(up, "products").df)
        most = -(-most // FAN)
    blank = [F.lit(0).alias(c) for c in ("a", "b", "c", "d")]
    cuts = levels.pop().select("*", *blank, F.lit(False).alias("known")).groupBy("uid").applyInPandas(_inner, _CUTS)
    while levels:
        ends = Table(cuts, "cuts").df.withColumnRenamed("chunk", "up").withColumn("known", F.lit(True))
        level = levels.pop().withColumn("up", F.expr(f"chunk div {FAN}").cast("int")).join(ends, ["uid", "up"])
        cuts = level.groupBy("uid", "up").applyInPandas(_inner, _CUTS)
    return cuts


def _traced(path: str):
    def run(batches):
        for pdf in batches:
            ids = [trace_chunk(path, r.piece, r.left - r.offset, r.right - r.offset, (r.a, r.b), (r.c, r.d)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"uid": pdf["uid"], "chunk": pdf["chunk"], "ids": [np.array(x, np.int32) for x in ids]})

    return run


def _appended(path: str, of: str, encoding: bool, checked: bool):
    """Batches with ids of the texts, and with whether they decode to the texts, put behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path) if encoding else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = some.column(some.schema.get_field_index(of)).to_pylist()
                columns = list(some.columns)
                if encoding:
                    ids = [None if t is None else made.ids(t) for t in texts]
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                else:
                    ids = columns[-1].to_pylist()
                if checked:
                    columns.append(pa.array([t is None or decode_ids(path, x if isinstance(x, list) else x.tolist()) == t for t, x in zip(texts, ids, strict=True)]))
                names = [*some.schema.names, *["_ids"] * encoding, *["_same"] * checked]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "ids", giant: int = GIANT_CHARS, chunk: int = CHUNK_CHARS, same: str | None = None) -> DataFrame:
    """Adds the ids (array<int>) of a text column; all others stay, whatever their names, but for one of that name.

    Texts of up to giant characters are encoded whole, longer ones by chunks as above; the ids
    are the library's for either. Null text has null ids, empty text none. Repeated rows stay
    repeated. With same, a column of that name says whether decoding the ids gives the text
    back. No rows give no rows. Columns that have the added ones' names are replaced.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in (to, same)))
    added = T.StructType([T.StructField(to, T.ArrayType(T.IntegerType())), *([T.StructField(same, T.BooleanType())] if same else [])])
    docs = docs.withColumn(text, F.col(text).cast("string"))
    long = F.coalesce(F.length(text) > giant, F.lit(False))
    usual = spread(docs).filter(~long).mapInArrow(_named(_appended(path, text, True, bool(same)), [*docs.columns, *added.names]), T.StructType([*docs.schema, *added]))
    rows = docs.filter(long).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"))
    held = Table(rows.withColumn("uid", F.monotonically_increasing_id()), "giants").df
    texts = held.select("uid", "text")
    chunks = Table(texts.mapInPandas(_chunk_rows(path, chunk), _CHUNK), "chunks").df
    most = chunks.agg(F.max("chunks")).first()[0] or 0
    matrices = Table(dealt(chunks, "uid", "chunk").mapInPandas(_matrices(path), _MATRIX), "matrices").df
    cuts = _scan(matrices, most)
    traced = dealt(chunks.join(cuts, ["uid", "chunk"]), "uid", "chunk").mapInPandas(_traced(path), "uid long, chunk int, ids array<int>")
    ids = traced.groupBy("uid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda s: s["ids"])).alias(to))
    big = held.join(ids, "uid").select("row.*", to)
    if same:
        big = big.mapInArrow(_named(_appended(path, text, False, True), [*docs.columns, *added.names]), T.StructType([*docs.schema, *added]))
    return usual.unionByName(big)


def _named(run, names: list[str]):
    """run with its columns called names, in their order."""

    def renamed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names)

    return renamed


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of an array of ids. Null ids give null text, no ids an empty one."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode_ids(path, x.tolist()) for x in lists], dtype=object)

    return df.withColumn(to, run(ids))


def query(spark, sf_dir: str) -> DataFrame:
    """Per document its ids, how many, and whether decoding gives the text back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path, same="round_trip")
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")
