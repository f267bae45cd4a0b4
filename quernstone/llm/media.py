"""Media columns: ISO base media containers, described from their boxes and sample tables alone."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import Table, read, spread

PAD = 64
SAMPLE_BYTES = 4096
CHUNK_SAMPLES = 16
SYNC_EVERY = 8
TIMESCALE = 8000
#: Boxes that hold boxes.
NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}

MEDIA = "struct<codec string, timescale long, duration long, n_samples long, media_start long, samples array<struct<start: long, length: long>>, keyframes array<struct<start: long, length: long>>, error string>"


# ---- writing ----------------------------------------------------------------------------------


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _ints(values: list[int], size: str = "I") -> bytes:
    return struct.pack(f">{len(values)}{size}", *values)


_MATRIX = _ints([0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000])


def pad(payload: bytes) -> bytes:
    """Payload and zero bytes up to a positive multiple of 64."""
    return payload + bytes((-len(payload)) % PAD or (0 if payload else PAD))


def mux(payload: bytes, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A container with one track of 8-bit unsigned PCM whose samples are the payload's bytes.

    A sample of the table is a run of up to sample_bytes PCM samples; every eighth is a sync
    sample. Sample data come first (mdat), tables after (moov), as in a recorded file.
    """
    n = len(payload)
    sizes = [sample_bytes] * (n // sample_bytes) + [n % sample_bytes] * (n % sample_bytes > 0)
    ftyp = _box(b"ftyp", b"isom", _ints([512]), b"isomiso2")
    mdat = _box(b"mdat", payload)
    start = len(ftyp) + len(mdat) - n
    offsets = list(range(start, start + n, sample_bytes * CHUNK_SAMPLES))
    full, last = divmod(len(sizes), CHUNK_SAMPLES)
    runs = ([[1, CHUNK_SAMPLES, 1]] if full else []) + ([[full + 1, last, 1]] if last else [])
    wide = bool(offsets) and offsets[-1] >= 1 << 32
    times = ([[n // sample_bytes, sample_bytes]] if n >= sample_bytes else []) + ([[1, n % sample_bytes]] if n % sample_bytes else [])
    even = len(set(sizes)) == 1
    entry = _box(b"raw ", bytes(6), _ints([1], "H"), bytes(8), _ints([1, 8, 0, 0], "H"), _ints([TIMESCALE << 16]))
    stbl = _box(
        b"stbl",
        _full(b"stsd", _ints([1]), entry),
        _full(b"stts", _ints([len(times)]), *(_ints(x) for x in times)),
        _full(b"stss", _ints([(len(sizes) + SYNC_EVERY - 1) // SYNC_EVERY]), _ints(list(range(1, len(sizes) + 1, SYNC_EVERY)))),
        _full(b"stsc", _ints([len(runs)]), *(_ints(x) for x in runs)),
        _full(b"stsz", _ints([sizes[0] if even else 0, len(sizes)]), b"" if even else _ints(sizes)),
        _full(b"co64" if wide else b"stco", _ints([len(offsets)]), _ints(offsets, "Q" if wide else "I")),
    )
    long_n = struct.pack(">QQIQ", 0, 0, TIMESCALE, n)
    mdia = _box(
        b"mdia",
        _full(b"mdhd", long_n, _ints([0x55C4, 0], "H"), version=1),
        _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
        _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", _ints([1]), _full(b"url ", flags=1))), stbl),
    )
    tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n), bytes(8), _ints([0, 0, 0x100, 0], "H"), _MATRIX, bytes(8), version=1, flags=3)
    mvhd = _full(b"mvhd", long_n, _ints([0x10000]), _ints([0x100, 0], "H"), bytes(8), _MATRIX, bytes(24), _ints([2]), version=1)
    return ftyp + mdat + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


# ---- reading ----------------------------------------------------------------------------------


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, end) of the boxes in data[start:end]; a body is not looked into."""
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box is cut off")
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} is longer than what holds it")
        yield kind, start + head, start + size
        start += size


#: Boxes within boxes that are followed; a track's tables are five deep.
MOST_DEPTH = 32


def _find(data: memoryview, start: int, end: int) -> dict[bytes, list[tuple[int, int]]]:
    """Bodies of all boxes by kind, in the order of the file, those within others included."""
    found: dict[bytes, list[tuple[int, int]]] = {}
    open_ = [boxes(data, start, end)]
    while open_:
        box = next(open_[-1], None)
        if box is None:
            open_.pop()
            continue
        kind, a, b = box
        found.setdefault(kind, []).append((a, b))
        if kind in NESTS:
            if len(open_) == MOST_DEPTH:
                raise ValueError("boxes are nested too deep")
            open_.append(boxes(data, a, b))
    return found


def _fields(data: memoryview, at: tuple[int, int], fields: str, skip: int = 0) -> tuple[int, ...]:
    """Numbers of a box, which must hold them."""
    if at[0] + skip + struct.calcsize(f">{fields}") > at[1]:
        raise ValueError("a box is cut off")
    return struct.unpack_from(f">{fields}", data, at[0] + skip)


def _entries(data: memoryview, at: tuple[int, int] | None, fields: str, skip: int = 4) -> list[tuple[int, ...]]:
    """Rows of a table box: a count behind skip bytes, then as many entries."""
    if at is None:
        return []
    (n,) = _fields(data, at, "I", skip)
    step = struct.calcsize(f">{fields}")
    if at[0] + skip + 4 + n * step > at[1]:
        raise ValueError("a table is cut off")
    return list(struct.iter_unpack(f">{fields}", data[at[0] + skip + 4 : at[0] + skip + 4 + n * step]))


def _tabled(data: memoryview, found: dict[bytes, list[tuple[int, int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Byte ranges of a track's samples by its sample tables, and the numbers of those that are keyframes."""
    first = {kind: at[0] for kind, at in found.items()}
    fixed, n = _fields(data, first[b"stsz"], "II", 4)
    if fixed and fixed * n > len(data):
        raise ValueError("more samples than bytes")
    sizes = [fixed] * n if fixed else [x for (x,) in _entries(data, first[b"stsz"], "I", skip=8)]
    offsets = [x for (x,) in (_entries(data, first[b"co64"], "Q") if b"co64" in first else _entries(data, first.get(b"stco"), "I"))]
    runs = _entries(data, first.get(b"stsc"), "III")
    samples, k = [], 0
    for i, (chunk, per, _) in enumerate(runs):
        stop = runs[i + 1][0] if i + 1 < len(runs) else len(offsets) + 1
        if not 1 <= chunk <= stop <= len(offsets) + 1:
            raise ValueError("a run of chunks is outside the table")
        for start in offsets[chunk - 1 : stop - 1]:
            for size in sizes[k : k + per]:
                samples.append((start, size))
                start += size
            k += per
    if len(samples) != n:
        raise ValueError("the chunks don't hold all samples")
    sync = [x for (x,) in _entries(data, first[b"stss"], "I")] if b"stss" in first else list(range(1, n + 1))
    if any(not 1 <= i <= n for i in sync):
        raise ValueError("a sync sample is outside the table")
    return samples, sync


def _fragments(data: memoryview, top: list[tuple[bytes, int, int]], track: int, defaults: tuple[int, int, int]) -> tuple[list[tuple[int, int]], list[bool], int]:
    """Byte ranges of a track's samples in movie fragments, whether each is a keyframe, and their duration in sum.

    defaults: duration, size and flags of a sample that neither its run nor its fragment gives.
    """
    samples, keys, lasts = [], [], 0
    for kind, a, b in top:
        if kind != b"moof":
            continue
        begin = a - 8 if struct.unpack_from(">I4s", data, a - 8)[1] == b"moof" else a - 16
        for part, c, d in boxes(data, a, b):
            if part != b"traf":
                continue
            found = _find(data, c, d)
            head = found[b"tfhd"][0]
            flags, number = _fields(data, head, "II")
            if number != track:
                continue
            at, base, own = 8, begin, list(defaults)
            if flags & 1:
                (base,), at = _fields(data, head, "Q", at), at + 8
            at += 4 if flags & 2 else 0
            for k, bit in enumerate((8, 16, 32)):
                if flags & bit:
                    (own[k],), at = _fields(data, head, "I", at), at + 4
            place = base
            for run in found.get(b"trun", []):
                flags, n = _fields(data, run, "II")
                at, opening = 8, None
                if flags & 1:
                    (shift,), at = _fields(data, run, "i", at), at + 4
                    place = base + shift
                if flags & 4:
                    (opening,), at = _fields(data, run, "I", at), at + 4
                step = 4 * sum(1 for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit)
                if run[0] + at + n * step > run[1] or (not step and n * own[1] > len(data)) or (not step and n > len(data)):
                    raise ValueError("a run of samples is cut off")
                for i in range(n):
                    length, size, mark = own
                    if flags & 0x100:
                        (length,), at = _fields(data, run, "I", at), at + 4
                    if flags & 0x200:
                        (size,), at = _fields(data, run, "I", at), at + 4
                    if flags & 0x400:
                        (mark,), at = _fields(data, run, "I", at), at + 4
                    elif i == 0 and opening is not None:
                        mark = opening
                    at += 4 if flags & 0x800 else 0
                    samples.append((place, size))
                    keys.append(not mark & 0x10000)
                    place += size
                    lasts += length
    return samples, keys, lasts


_FIELDS = ("codec", "timescale", "duration", "n_samples", "media_start", "samples", "keyframes", "error")


def describe(blob: bytes | None) -> dict | None:
    """Codec, duration and byte ranges of the first track with a sample table, those of fragments behind its own.

    None for None. A container that can't be followed, or whose tables speak of samples that it
    doesn't hold, gives its error and nulls, never an exception: counts are held against the boxes
    that carry them before anything is laid out. Without a sync table all samples of the tables
    are keyframes, as the format has it.
    """
    if blob is None:
        return None
    out = dict.fromkeys(_FIELDS)
    try:
        data = memoryview(blob)
        top = list(boxes(data, 0, len(data)))
        moov = next(((a, b) for kind, a, b in top if kind == b"moov"), None)
        if moov is None:
            raise ValueError("no moov box")
        for kind, a, b in boxes(data, *moov):
            if kind == b"trak" and b"stbl" in (found := _find(data, a, b)):
                break
        else:
            raise ValueError("no track with a sample table")
        head = found[b"mdhd"][0]
        wide = _fields(data, head, "B")[0] == 1
        timescale, duration = _fields(data, head, "IQ", 20) if wide else _fields(data, head, "II", 12)
        (codec,) = _fields(data, found[b"stsd"][0], "4s", 12)
        samples, sync = _tabled(data, found)
        number = _fields(data, found[b"tkhd"][0], "I", 20 if _fields(data, found[b"tkhd"][0], "B")[0] == 1 else 12)[0] if b"tkhd" in found else 1
        extends = [_fields(data, at, "IIIII", 4) for at in _find(data, *moov).get(b"trex", [])]
        defaults = next(((e[2], e[3], e[4]) for e in extends if e[0] == number), (0, 0, 0))
        more, keys, lasts = _fragments(data, top, number, defaults)
        keyframes = [samples[i - 1] for i in sync] + [s for s, key in zip(more, keys, strict=True) if key]
        samples += more
        if any(start < 0 or start + size > len(data) for start, size in samples):
            raise ValueError("a sample is past the end")
        return out | {"codec": codec.decode("latin-1"), "timescale": timescale, "duration": duration or lasts, "n_samples": len(samples), "media_start": min((s for s, _ in samples), default=0), "samples": samples, "keyframes": keyframes}
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return out | {"error": str(e) or type(e).__name__}


def media_columns(df: DataFrame, blob: str = "media", to: str = "about") -> DataFrame:
    """Adds a struct column that describes each container of a binary column; payloads stay as they are.

    Null blobs give null. Broken ones give their error. All other columns are kept.
    """

    @F.pandas_udf(MEDIA)
    def run(blobs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(b) or dict.fromkeys(_FIELDS) for b in blobs], columns=list(_FIELDS))

    return df.withColumn(to, F.when(F.col(blob).isNotNull(), run(blob)))


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every text's padded UTF-8 in a container, a row for each input row.

    Null text is empty, a null id stays null, repeated rows stay repeated, other columns are
    ignored, whatever their names. No rows give no rows.
    """

    def run(batches):
        for pdf in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [len(x) for x in raw], "media": [mux(pad(x)) for x in raw]})

    return spread(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """Digest of stored containers (doc_id, n_bytes, media), all but n_bytes from their bytes: see the query's columns.

    A row for each input row; a container that can't be followed fails, since store wrote it.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, n_bytes, blob in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"], strict=True):
                about = describe(blob)
                if about["error"]:
                    raise ValueError(f"document {doc_id}: {about['error']}")
                payload = b"".join(blob[s : s + k] for s, k in about["samples"])
                keys = ",".join(f"{s}+{k}" for s, k in about["keyframes"])
                feature = f"codec={about['codec'].strip()};duration={about['duration']}/{about['timescale']};samples={about['n_samples']};keyframes={keys}"
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return stored.mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark, sf_dir: str) -> DataFrame:
    return features(Table(store(read(spark, sf_dir, "documents")), "media").df)
