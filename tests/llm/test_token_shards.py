import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from quernstone.llm import token_shards as T  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 20000):
        for v in (1, 3, 300):
            ids = (rng.zipf(1.3, n) % v).astype(np.uint32)
            rules, lengths, seq = T.compress(ids, v, rounds=6, least=2)
            assert (T.expand(rules, lengths, seq, v) == ids).all()
            size = np.where(seq < v, 1, lengths[np.maximum(seq.astype(int) - v, 0)] if len(lengths) else 1)
            offsets = (np.cumsum(size) - size)[:: T.STRIDE].astype("<u8")
            shard = {"base": v, "n_tokens": n, "offsets": offsets.tobytes(), "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "sequence": seq.astype("<u4").tobytes()}
            for a, b in ((0, n), (n // 3, n // 2), (n, n), (n - 1, n), (n // 2, n // 2 + 1), (n - 3, n + 9)):
                a = max(0, a)
                assert (T.token_range(shard, a, b) == ids[a:b]).all()
    rules, lengths, seq = T.compress(np.tile(np.arange(8, dtype=np.uint32), 4000), 8)
    assert len(seq) < 8000 and lengths.max() > 2


def test_a_range_expands_only_what_it_reaches(monkeypatch):
    rng = np.random.default_rng(3)
    passages = [rng.integers(0, 30000, 60) for _ in range(300)]
    ids = np.concatenate([passages[k] for k in rng.integers(0, 300, 12000)]).astype(np.uint32)
    rules, lengths, seq = T.compress(ids, 30000)
    size = np.where(seq < 30000, 1, lengths[np.maximum(seq.astype(int) - 30000, 0)])
    offsets = (np.cumsum(size) - size)[:: T.STRIDE].astype("<u8")
    shard = {"base": 30000, "n_tokens": len(ids), "offsets": offsets.tobytes(), "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "sequence": seq.astype("<u4").tobytes()}
    used, plain = [], T.expand
    monkeypatch.setattr(T, "expand", lambda r, *rest: (used.append(len(r)), plain(r, *rest))[1])
    for at in rng.integers(0, len(ids) - 90, 40).tolist():
        assert (T.token_range(shard, at, at + 90) == ids[at : at + 90]).all()
    assert len(rules) > 3000 and max(used) < 400


def test_no_frequent_pair_is_left():
    """Whatever the length, rules are as deep as repeated passages need."""
    rng = np.random.default_rng(2)
    passage = rng.integers(0, 1000, 200)
    copies = np.concatenate([np.concatenate([passage, rng.integers(0, 1000, 30)]) for _ in range(100)])
    for ids in (copies, rng.zipf(1.3, 3 << 20) % 40000, np.zeros(100_000, np.int64)):
        rules, lengths, seq = T.compress(ids.astype(np.uint32), 40000)
        assert (T.expand(rules, lengths, seq, 40000) == ids).all()
        pairs, often = np.unique(seq[:-1].astype(np.int64) << 32 | seq[1:], return_counts=True)
        assert len(pairs) == 0 or often.max() < T.LEAST
    rules, lengths, seq = T.compress(copies.astype(np.uint32), 40000)
    assert lengths.max() > 100


def test_word_cache_is_exact():
    e = T.WordEncoder(PATH)
    texts = ["A.,B... x,y'S don't <|endoftext|>. É, é. ,a .b", "ΣΑΣ, abc.", "<|ENDOFTEXT|>", "", ".", "a. \x1f b　c", "İstanbul, éx", "word " * 300, "x" * 500, None]
    for _ in range(2):
        for text, ids in zip(texts, e.encode(texts, b""), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_shards(docs, rows):
    e = T.WordEncoder(PATH)
    got = [tuple(r) for r in T.documents_of(T.encode_shards(docs, PATH, shard_tokens=500)).orderBy("start").collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for (doc_id, at, n, crc), r in zip(got, order, strict=True):
        ids = [*e.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        assert (doc_id, at, n, crc) == (r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n


def test_empty(empty):
    assert T.documents_of(T.encode_shards(empty, PATH)).count() == 0


def test_rounds_at_the_last_bar_count_only_what_can_reach_it(monkeypatch):
    """Once the bar stays, pairs that no replacement touched aren't counted again; none that reaches the bar is left."""
    rng = np.random.default_rng(8)
    odds = 1 / np.arange(1, 2001)
    ids = np.concatenate([rng.choice(2000, 200_000, p=odds / odds.sum()), np.full(1000, 7), np.tile([3, 4, 5, 3, 4], 300)]).astype(np.uint32)
    sizes, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: (sizes.append(len(x)) if k.get("minlength") == 1 << T._HASH_BITS else None, plain(x, *a, **k))[1])
    rules, lengths, seq = T.compress(ids, 2000)
    # over 1,024, then by four down to 16
    assert sum(n >= len(seq) - 1 for n in sizes) <= 4 and len(rules) > 500
    assert (T.expand(rules, lengths, seq.astype(np.int64), 2000) == ids).all()
    pairs, n = np.unique(seq[:-1].astype(np.int64) << 32 | seq[1:], return_counts=True)
    same = pairs >> 32 == pairs & 0xFFFFFFFF
    assert (n[~same] < T.LEAST).all()
