import hashlib
import struct
import zlib

import pytest

from quernstone.llm import media as M


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 65536, 200_000])
def test_round_trip(n):
    raw = bytes(i * 31 % 251 for i in range(n))
    payload = M.pad(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(raw) and len(payload) < n + 65
    blob = M.mux(payload)
    about = M.describe(blob)
    assert about["error"] is None and about["codec"] == "raw " and (about["duration"], about["timescale"]) == (len(payload), 8000)
    assert b"".join(blob[s : s + k] for s, k in about["samples"]) == payload
    assert about["keyframes"] == about["samples"][::8] and about["n_samples"] == -(-len(payload) // 4096)


def test_other_layouts():
    """Sizes of 64 bits, a box to the end, version 0 headers, co64, no sync table, runs of chunks."""
    data = b"abcdefghij"
    ints = lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = M._box(b"stbl", M._full(b"stsd", ints(1), M._box(b"avc1", bytes(8))), M._full(b"stts", ints(1, 4, 1)), M._full(b"stsc", ints(2), ints(1, 1, 1), ints(3, 2, 1)), M._full(b"stsz", ints(0, 4), ints(1, 2, 3, 4)), M._full(b"co64", ints(3), struct.pack(">3Q", 24, 25, 27)))
    mdia = M._box(b"mdia", M._full(b"mdhd", ints(0, 0, 25, 4), bytes(4)), M._box(b"minf", stbl))
    blob = M._box(b"ftyp", b"isom") [:8] + struct.pack(">I4sQ", 1, b"mdat", 26) + data
    blob = struct.pack(">I4s", 8, b"free") + blob[8:] + struct.pack(">I4s", 0, b"moov") + M._box(b"trak", mdia)
    about = M.describe(blob)
    assert about["error"] is None and about["codec"] == "avc1" and (about["timescale"], about["duration"]) == (25, 4)
    assert about["samples"] == [(24, 1), (25, 2), (27, 3), (30, 4)] == about["keyframes"]


@pytest.mark.parametrize("blob", [b"", b"abc", b"\0\0\0\x08moov", b"\xff\xff\xff\xff" * 9, M.mux(M.pad(b"x" * 9000))[:-30], M.mux(M.pad(b"x"))[40:], b"\0\0\0\x04free"])
def test_broken(blob):
    about = M.describe(blob)
    assert about["error"] and about["samples"] is None


def _track(stsz, stss=b"", stsc=((1, 1, 1),), offsets=(24,)):
    ints = lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = M._box(b"stbl", M._full(b"stsd", ints(1), M._box(b"avc1", bytes(8))), M._full(b"stsc", ints(len(stsc)), *(ints(*x) for x in stsc)), stsz, M._full(b"stco", ints(len(offsets)), ints(*offsets)), stss)
    mdia = M._box(b"mdia", M._full(b"mdhd", ints(0, 0, 25, 4), bytes(4)), M._box(b"minf", stbl))
    return M._box(b"trak", M._full(b"tkhd", ints(0, 0, 7, 0)), mdia)


def test_false_tables_are_errors():
    ints = lambda *x: struct.pack(f">{len(x)}I", *x)
    wrap = lambda trak: M._box(b"ftyp", b"isom") + M._box(b"mdat", b"0123456789") + M._box(b"moov", trak)
    one = M._full(b"stsz", ints(0, 1), ints(3))
    assert M.describe(wrap(_track(one)))["samples"] == [(24, 3)]
    huge = M._full(b"stsz", ints(1, 0xFFFFFFFF))
    deep = b""
    for _ in range(3000):
        deep = M._box(b"udta", deep)
    for trak in (_track(huge), _track(M._full(b"stsz", ints(0, 0xFFFFFFFF))), _track(one, M._full(b"stss", ints(1), ints(0))), _track(one, M._full(b"stss", ints(1), ints(2))), _track(one, stsc=((0, 1, 1),)), _track(one, stsc=((2, 1, 1), (1, 1, 1))), _track(one, offsets=(10**6,)), M._box(b"trak", deep)):
        about = M.describe(wrap(trak))
        assert about["error"] and about["samples"] is None


def test_fragments():
    """Two fragments of the track behind an empty sample table, one of another track; keyframes by flags."""
    ints = lambda *x: struct.pack(f">{len(x)}I", *x)
    empty = _track(M._full(b"stsz", ints(0, 0)), M._full(b"stss", ints(0)), (), ())
    head = M._box(b"ftyp", b"isom") + M._box(b"moov", empty, M._box(b"mvex", M._full(b"trex", ints(7, 1, 5, 4, 0x10000))))

    def moof(track, trun, data, flags=0, *own):
        make = lambda shift: M._box(b"moof", M._full(b"mfhd", ints(1)), M._box(b"traf", M._full(b"tfhd", ints(track), *map(ints, own), flags=flags), trun(shift)))
        return make(len(make(0)) + 8) + M._box(b"mdat", data)

    first = moof(7, lambda at: M._full(b"trun", ints(3), ints(at), ints(0), flags=1 | 4), b"aaaabbbbcccc")
    other = moof(8, lambda at: M._full(b"trun", ints(1), ints(at), flags=1), b"zzzz")
    last = moof(7, lambda at: M._full(b"trun", ints(2), ints(at), ints(9, 2, 0x10000), ints(9, 3, 0), flags=1 | 0x700), b"ddeee", 0x20, 0)
    blob = head + first + other + last
    about = M.describe(blob)
    assert about["error"] is None and [blob[s : s + n] for s, n in about["samples"]] == [b"aaaa", b"bbbb", b"cccc", b"dd", b"eee"]
    assert [blob[s : s + n] for s, n in about["keyframes"]] == [b"aaaa", b"eee"] and about["duration"] == 4
    lie = head + moof(7, lambda at: M._full(b"trun", ints(0xFFFFFFFF), ints(at), flags=1), b"x")
    assert M.describe(lie)["error"]


def test_every_cut_is_defined():
    blob = M.mux(M.pad(b"some text" * 30))
    for n in range(0, len(blob), 7):
        assert M.describe(blob[:n])["error"]


def test_columns(spark):
    df = spark.createDataFrame([(1, bytearray(M.mux(M.pad(b"x")))), (2, None), (3, bytearray(b"no"))], "about_ long, media binary").selectExpr("*", "'clash' AS codec")
    got = {r["about_"]: r for r in M.media_columns(df).collect()}
    assert got[1]["about"]["codec"] == "raw " and got[2]["about"] is None and got[3]["about"]["error"] and got[3]["codec"] == "clash"


def test_features(docs, rows, empty):
    got = sorted((tuple(r) for r in M.features(M.store(docs)).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        p = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        want.append((doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert [r[:5] for r in got] == sorted(want, key=str)
    same = {}
    for r in got:
        assert same.setdefault(r[3], r[5:]) == r[5:]
    assert M.features(M.store(empty)).count() == 0
