"""Token ids in Re-Pair compressed shards, readable at random.

A shard is one row of the written table: the document ids in order, their token counts, a
grammar (pairs of symbols, each a nonterminal) and the sequence left after replacement.
Expansion lengths of the rules are stored, and offsets of every 1,024th symbol, so a reader finds any
token range from the offset before it and expands only the symbols that cover it.

The grammar is built in rounds. Classic Re-Pair replaces one pair at a time, always the most
frequent; here a round takes every pair at or over the round's frequency threshold, most
thresholds high to low, and replaces their occurrences left to right without overlap. Symbols
of a round may pair again in later rounds, and rounds go on until no pair occurs LEAST times. The
stored text is the same for any number of rounds.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import Table, read

SHARD_TOKENS = 1 << 20
END_ID = 2
#: None: as many as there are pairs for.
ROUNDS = None
#: A pair that occurs less often stays as it is, for a rule costs room too. Of 3,156,842 ids, 3.77 MB by
#: zstd alone, the stored grammar and sequence take 3.43 MB by zstd at 16, 3.47 at 8, 3.45 at 4 and 3.64 at 2,
#: where no pair is left that repeats.
LEAST = 16
#: Symbols of the sequence between two stored offsets.
STRIDE = 1024
_CACHE_WORDS = 1_000_000
_CACHE_CHARS = 48
_HASH_BITS = 20
#: So few pairs are sorted without counting their hashes before.
_FEW = 1 << 14

SCHEMA = "part int, shard int, first_token long, n_tokens long, base long, doc_ids array<long>, doc_tokens binary, offsets binary, rules binary, lengths binary, sequence binary"


# ---- grammar ----------------------------------------------------------------------------------


def compress(ids: np.ndarray, base: int, rounds: int | None = ROUNDS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (below base) to (rules n x 2, expansion length of each rule, sequence).

    Symbol base + i is rule i. Without frequent pairs the sequence is ids itself. Without a bound
    on rounds no pair of the sequence occurs least times: a round replaces at least half of the
    occurrences that reach its bar, so one that replaces nothing at the last bar leaves none.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    known = base
    lengths = np.zeros(0, np.int64)
    bar = max(least, len(seq) // 1024)
    fresh = None
    for _ in count() if rounds is None else range(rounds):
        if len(seq) < 2:
            break
        left, right = (seq[:-1], seq[1:]) if fresh is None else (seq[fresh], seq[fresh + 1])
        if len(left) >= _FEW:
            slot = (left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _HASH_BITS)
            often = np.flatnonzero((np.bincount(slot, minlength=1 << _HASH_BITS) >= bar)[slot])
            often = often if fresh is None else fresh[often]
        else:
            often = np.arange(len(left)) if fresh is None else fresh
        code = seq[often].astype(np.int64) << 32 | seq[often + 1]
        ordered = np.sort(code)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(code) else np.zeros(0, np.int64)
        pairs = ordered[first][np.diff(first, append=len(code)) >= bar]
        which = np.searchsorted(pairs, code)
        which[which == len(pairs)] = 0
        live = pairs[which] == code if len(pairs) else np.zeros(len(code), bool)
        hits, which = often[live], which[live]
        at = hits
        # in a run of neighbouring hits every other one is replaced, from the left
        run = np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.zeros(0, bool)
        rank = np.arange(len(at))
        even = (rank - np.maximum.accumulate(np.where(run, rank, 0))) % 2 == 0
        at, which = at[even], which[even]
        used = np.bincount(which, minlength=len(pairs)) >= 2
        keep = used[which] if len(which) else np.zeros(0, bool)
        at, which = at[keep], which[keep]
        if len(at):
            number = np.cumsum(used) - 1
            made = pairs[used]
            rule = np.stack([made >> 32, made & 0xFFFFFFFF], axis=1)
            size = np.where(rule < base, 1, lengths[np.maximum(rule - base, 0)] if len(lengths) else 1)
            rules.append(rule)
            lengths = np.concatenate([lengths, size.sum(axis=1)])
            seq[at] = known + number[which]
            gone = np.ones(len(seq), bool)
            gone[at + 1] = False
            seq = seq[gone]
            known += len(made)
            if bar == least:
                # from here on the bar stays: only pairs of a new symbol, and those that reached the bar and are left, can reach it
                place = np.cumsum(gone, dtype=np.int32) - 1
                fresh = np.zeros(len(seq), bool)
                fresh[place[hits[gone[hits]]]] = True
                fresh[place[at]] = True
                fresh[np.maximum(place[at] - 1, 0)] = True
                fresh = np.flatnonzero(fresh[:-1])
        elif bar == least:
            break
        bar = max(least, bar // 4)
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), lengths, seq


def expand(rules: np.ndarray, lengths: np.ndarray, seq: np.ndarray, base: int) -> np.ndarray:
    """All ids of symbols seq. Every symbol's text is laid out once, then copied by position."""
    flat = np.arange(base, dtype=np.int32)
    starts, sizes = flat, np.ones(base, np.int32)
    done = 0
    while done < len(rules):
        # the rules up to the next that refers to one of these: their parts are laid out already
        later = np.flatnonzero(rules[done:].max(axis=1) >= base + done)
        end = done + int(later[0]) if len(later) else len(rules)
        laid = _copied(flat, starts, sizes, rules[done:end].ravel())
        size = lengths[done:end].astype(np.int32)
        starts = np.concatenate([starts, len(flat) + np.cumsum(size) - size]).astype(np.int32)
        sizes = np.concatenate([sizes, size])
        flat = np.concatenate([flat, laid])
        done = end
    return _copied(flat, starts, sizes, seq)


def _copied(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seq: np.ndarray) -> np.ndarray:
    size = sizes[seq]
    ends = np.cumsum(size)
    at = np.repeat(starts[seq] - (ends - size), size)
    at += np.arange(len(at))
    return flat[at]


def _sizes(symbols: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    out = np.ones(len(symbols), np.int64)
    rule = symbols >= base
    out[rule] = lengths[symbols[rule] - base]
    return out


def token_range(shard: dict, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a shard.

    Of the sequence only the stretches of STRIDE symbols that hold them are measured, by the stored
    offsets, and of the rules only those that their symbols lead to are expanded.
    """
    base, n = shard["base"], shard["n_tokens"]
    start, stop = max(0, start), min(stop, n)
    if start >= stop:
        return np.zeros(0, np.int32)
    offsets, seq, lengths = np.frombuffer(shard["offsets"], "<u8"), np.frombuffer(shard["sequence"], "<u4"), np.frombuffer(shard["lengths"], "<u4")
    rules = np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    first, last = np.searchsorted(offsets, start, "right") - 1, np.searchsorted(offsets, stop, "left")
    part = seq[first * STRIDE : last * STRIDE].astype(np.int64)
    ends = int(offsets[first]) + np.cumsum(_sizes(part, lengths, base))
    lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skip = start - (int(ends[lo - 1]) if lo else int(offsets[first]))
    some = part[lo:hi]
    reached = fresh = np.unique(some[some >= base] - base)
    while len(fresh):
        below = rules[fresh].astype(np.int64).ravel()
        fresh = np.setdiff1d(below[below >= base] - base, reached)
        reached = np.union1d(reached, fresh)
    renumbered = lambda x: np.where(x >= base, base + np.searchsorted(reached, x - base), x)
    return expand(renumbered(rules[reached].astype(np.int64)), lengths[reached].astype(np.int64), renumbered(some), base)[skip : skip + stop - start]


def arrays(shard: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(shard[k], "<u4").astype(np.int64).reshape(s) for k, s in (("rules", (-1, 2)), ("lengths", -1), ("sequence", -1)))


# ---- tokens -----------------------------------------------------------------------------------


def pieces(text: str) -> list[str]:
    """Pieces of a text whose ids, put together, are the text's ids.

    The tokenizer composes characters, lowers case, drops white space and takes letters apart
    from other signs. Pieces are cut at spaces and line feeds. A text that is composed already
    and holds no mark of a special token and no letter whose lower case hangs on its neighbours
    is lowered first, so that fewer pieces differ.
    """
    if "<|" not in text and "\u03a3" not in text:
        low = text.lower()
        if text.isascii() or (is_normalized("NFC", text) and is_normalized("NFC", low)):
            text = low
    return text.replace("\n", " ").split(" ")


class WordEncoder:
    """Whole-text ids from cached ids of the text's pieces.

    The cache is bounded: a full one takes no more, and is emptied once it misses a fifth of a
    call's pieces.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.plain = self._for_letters(path)
        self.known: dict[str, bytes] = {"": b""}
        self.stops = {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes() for c in ",."}
        #: Which ids end a word.
        self.last = np.zeros(self.size, bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _for_letters(self, path: str):
        """The tokenizer without what does nothing to composed words of small letters, if that holds."""
        from tokenizers import Tokenizer, pre_tokenizers

        plain = Tokenizer.from_file(path)
        plain.normalizer = None
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "the retitioning hall\u00e5\u00e9\u00df \u6f22\u5b57 \u043c\u0438\u0440 a zyxwvutsrqponmlkjihgfedcba"
        same = plain.encode(probe, add_special_tokens=False).ids == self.tokenizer.encode(probe, add_special_tokens=False).ids
        return plain if same else self.tokenizer

    def encode(self, texts: list[str | None], end: bytes) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, each with end appended."""
        known = self.known
        split = [pieces(t) if t else [] for t in texts]
        found = [list(map(known.get, words)) for words in split]
        new: dict[str, bytes | None] = {}
        holes: list[tuple[list, int, str]] = []
        for words, ids in zip(split, found, strict=True):
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                ids[at] = b""
                new[words[at]] = None
                holes.append((ids, at, words[at]))
        if new:
            names = list(new)
            if len(known) > _CACHE_WORDS and 5 * len(holes) > sum(map(len, split)):
                known.clear()
                known[""] = b""
            # a comma or full stop behind a letter is a token of its own
            stems = {w: w[:-1] for w in names if w[-1] in self.stops and w[-2:-1].isalpha()}
            lack = dict.fromkeys(w for w in names if w not in stems)
            lack |= dict.fromkeys(w for w in stems.values() if w not in known)
            self._fill(lack)
            for word, stem in stems.items():
                new[word] = (known.get(stem) or lack[stem]) + self.stops[word[-1]]
            new |= lack
            for word in new:
                if len(word) <= _CACHE_CHARS and len(known) <= _CACHE_WORDS:
                    known[word] = new[word]
            for ids, at, word in holes:
                ids[at] = new[word]
        return [b"".join(ids) + end for ids in found]


    def _fill(self, new: dict[str, bytes | None]) -> None:
        """Ids of all words. Plain words go in lines of many, cut where a word's last token ends."""
        plain = [w for w in new if w.isalpha() and (w.isascii() or (is_normalized("NFC", w) and w == w.lower() and w.lower().isalpha()))]
        rest = list(new.keys() - plain) if len(plain) < len(new) else []
        for at in range(0, len(plain), 256):
            some = plain[at : at + 256]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some).lower()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                rest += some
                continue
            data, start = ids.tobytes(), 0
            for word, end in zip(some, (ends * 4).tolist(), strict=True):
                new[word] = data[start:end]
                start = end
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for word, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                new[word] = np.array(e.ids, "<u4").tobytes()


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _shards(path: str, end_id: int, shard_tokens: int, rounds: int | None, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(path)
        base = max(encoder.size, end_id + 1)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        state = {"shard": 0, "first": 0}

        def flush(ids, texts):
            seq = np.frombuffer(b"".join(texts), "<u4")
            rules, lengths, left = compress(seq, base, rounds, least)
            row = {
                "part": [part], "shard": [state["shard"]], "first_token": [state["first"]], "n_tokens": [len(seq)], "base": [base], "doc_ids": [ids],
                "doc_tokens": [np.array([len(t) // 4 for t in texts], "<u4").tobytes()],
                "offsets": [(np.cumsum(size := _sizes(left.astype(np.int64), lengths, base)) - size)[::STRIDE].astype("<u8").tobytes()],
                "rules": [rules.astype("<u4").tobytes()], "lengths": [lengths.astype("<u4").tobytes()], "sequence": [left.astype("<u4").tobytes()],
            }
            state["shard"] += 1
            state["first"] += len(seq)
            return pa.RecordBatch.from_pydict(row, schema=_ARROW)

        # strings, bytes and flat lists: no cycles, and walks over the cache cost
        gc.disable()
        ids, texts, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for i, t in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist(), end), strict=True):
                    ids.append(i)
                    texts.append(t)
                    held += len(t) // 4
                    if held >= shard_tokens:
                        yield flush(ids, texts)
                        ids, texts, held = [], [], 0
        if ids:
            yield flush(ids, texts)
        gc.enable()

    return run


_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("base", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.binary()), ("offsets", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary())])


def encode_shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, rounds: int | None = ROUNDS, least: int = LEAST) -> DataFrame:
    """Documents (doc_id, text, ...) to shards in ascending doc_id order.

    Rows are dealt by doc_id ranges and sorted (null doc_ids first, equal ones by text), so
    part, shard and position in a shard are the global order. Null text is empty and has just
    the end id. Repeated rows are kept. A shard closes at the document that fills it, so only a
    single document can exceed shard_tokens by much. No rows give no shards.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_shards(tokenizer_path, end_id, shard_tokens, rounds, least), SCHEMA)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            ids = expand(*arrays(shard), shard["base"]).astype("<u4").tobytes()
            n = np.frombuffer(shard["doc_tokens"], "<u4").astype(np.int64)
            ends = np.cumsum(n)
            view = memoryview(ids)
            crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([shard["part"]] * len(n), pa.int32()), "doc_id": pa.array(shard["doc_ids"], pa.int64()), "at": pa.array(shard["first_token"] + ends - n, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            )


def documents_of(shards: DataFrame) -> DataFrame:
    """Shards to (doc_id, start, n_tokens, ids_crc32), all decoded from the stored grammar.

    start counts the ids of all documents before. Only one total for each part (a range of the
    sort, not a document) meets in one task to be summed up.
    """
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    docs = shards.mapInArrow(_read_back, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards = Table(encode_shards(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), "shards")
    return documents_of(shards.df)
