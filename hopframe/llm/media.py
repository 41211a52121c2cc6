"""ISO media containers: writing 8-bit sample tracks, and reading any file's boxes and sample tables.

:func:`store` puts a payload into a file of one sound track: ``ftyp``, ``moov`` with a full
sample table, ``mdat`` with the payload as unsigned 8-bit samples, which is lossless.
:func:`probe` walks the nested boxes of a file, decodes the sample tables and movie fragments of
every track and returns codec, duration and the byte ranges of samples, chunks and keyframes. It
reads no sample. What a table claims is held against the file's size before anything is
allocated, so memory is bounded by some multiple of the file, whatever its bytes say.

Cases: null and empty payloads of texts are 64 bytes 0; bytes that hold no valid container
give nulls and the reason in ``error``; repeated rows and equal texts give equal values; texts
of any length are stored whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import map_rows

#: Samples a second of stored payloads; bytes of one sample, a block of the payload.
RATE, BLOCK = 8000, 64
#: Samples in a chunk of the stored track, and between its keyframes.
CHUNK, KEY = 64, 16
#: Boxes that hold boxes, and how deep they may.
_NESTED, DEEPEST = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}, 32
_IDENTITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


class Malformed(ValueError):
    """A container that contradicts itself or ends early."""


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def store(payload: bytes) -> bytes:
    """The payload, of a multiple of 64 bytes, as an ISO media file."""
    if not payload or len(payload) % BLOCK:
        raise ValueError(f"a payload has a positive multiple of {BLOCK} bytes")
    n = len(payload) // BLOCK
    chunks, last = -(-n // CHUNK), n % CHUNK or CHUNK
    keys = range(1, n + 1, KEY)
    runs = [(1, CHUNK, 1)] if last == CHUNK else [(1, last, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, last, 1)]
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, BLOCK)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", BLOCK, n)),
            _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *(first + i * CHUNK * BLOCK for i in range(chunks)))),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        head = struct.pack(">IIII", 0, 0, RATE, len(payload))
        mdia = _box(b"mdia", _full(b"mdhd", head, struct.pack(">HH", 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">hhHH", 0, 0, 256, 0), _IDENTITY, bytes(8), flags=7)
        mvhd = _full(b"mvhd", head, struct.pack(">IH", 0x10000, 256), bytes(10), _IDENTITY, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head, wide = ftyp + moov(0), len(payload) + 8 >= 1 << 32
    first = len(head) + (16 if wide else 8)
    size = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")
    return ftyp + moov(first) + size + payload


def boxes(data: bytes, lo: int = 0, hi: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte, end) of the bodies of the boxes in a range; 64-bit and open sizes too."""
    hi = len(data) if hi is None else hi
    while lo < hi:
        if hi - lo < 8:
            raise Malformed("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, lo)
        head = 8
        if size == 1:
            if hi - lo < 16:
                raise Malformed("a large box header is cut off")
            size, head = struct.unpack_from(">Q", data, lo + 8)[0], 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            raise Malformed(f"box {kind!r} leaves its parent")
        yield kind, lo + head, lo + size
        lo += size


def tree(data: bytes) -> Iterator[tuple[tuple, int, int]]:
    """(path of kinds, first byte, end) of every box, depth first."""
    walks, path = [boxes(data)], ()
    while walks:
        got = next(walks[-1], None)
        if got is None:
            walks.pop()
            path = path[:-1]
            continue
        kind, a, b = got
        yield (*path, kind), a, b
        if kind in _NESTED:
            if len(walks) >= DEEPEST:
                raise Malformed(f"boxes are nested deeper than {DEEPEST}")
            walks.append(boxes(data, a, b))
            path = (*path, kind)


def _table(data: bytes, at: tuple[int, int], columns: int, wide: bool = False) -> np.ndarray:
    """Rows of a table box that has a version, a count and rows of unsigned numbers."""
    a, b = at
    n, size = struct.unpack_from(">I", data[a:b], 4)[0], 8 if wide else 4
    if a + 8 + n * columns * size > b:
        raise Malformed("a table has fewer rows than it says")
    return np.frombuffer(data, f">u{size}", n * columns, a + 8).astype(np.int64).reshape(n, columns)


def _even(size: int, n: int, data: bytes) -> np.ndarray:
    if n > len(data) // max(1, size):
        raise Malformed("samples lie outside the file")
    return np.full(n, size, np.int64)


def _sizes(data: bytes, part: dict) -> np.ndarray:
    """The size of each sample of a sample table."""
    if b"stsz" in part:
        a, b = part[b"stsz"]
        same, n = struct.unpack_from(">II", data[a:b], 4)
        return _even(same, n, data) if same else _table(data, (a + 4, b), 1)[:, 0]
    a, b = part[b"stz2"]
    bits, n = struct.unpack_from(">II", data[a:b], 4)
    if bits not in (4, 8, 16) or a + 12 + (n * bits + 7) // 8 > b:
        raise Malformed("compact sample sizes are cut off")
    if bits == 4:
        pairs = np.frombuffer(data, np.uint8, (n + 1) // 2, a + 12)
        return np.stack((pairs >> 4, pairs & 15), 1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, f">u{bits // 8}", n, a + 12).astype(np.int64)


def _placed(data: bytes, runs: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """First bytes of all samples, and the ranges of the runs, given each run's first byte and sample sizes."""
    starts, ranges = [], []
    for at, sizes in runs:
        end = at + np.cumsum(sizes)
        if len(sizes) and not 0 <= at <= int(end[-1]) <= len(data):
            raise Malformed("samples lie outside the file")
        starts.append(end - sizes)
        ranges.append((at, int(sizes.sum())))
    return np.concatenate(starts) if starts else np.zeros(0, np.int64), ranges


def _chunks(data: bytes, part: dict, sizes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(first byte, sample sizes) of each chunk of a sample table."""
    offsets = (_table(data, part[b"co64"], 1, True) if b"co64" in part else _table(data, part[b"stco"], 1))[:, 0].tolist()
    runs, out, s = _table(data, part[b"stsc"], 3)[:, :2].tolist(), [], 0
    for (first, count), (after, _) in zip(runs, [*runs[1:], [len(offsets) + 1, 0]], strict=True):
        if not 1 <= first < after:
            raise Malformed("chunks are out of order")
        for at in offsets[first - 1 : after - 1]:
            if s == len(sizes):
                return out
            out.append((at, sizes[s : s + count]))
            s = min(len(sizes), s + count)
    if s < len(sizes):
        raise Malformed("samples have no chunk")
    return out


def _fragment(data: bytes, moof: int, boxes_: list, defaults: dict, before: int) -> tuple[int, list[tuple[int, np.ndarray, np.ndarray]], int, int]:
    """A track fragment: its track, its runs (first byte, sample sizes, which are keyframes), its duration, the end of its data."""
    (a, b), track, runs, duration = boxes_[0][1], 0, [], 0
    head = data[a:b]
    flags, track = struct.unpack_from(">II", head)
    told, at = dict(zip(("time", "size", "flags"), defaults.get(track, (0, 0, 0)), strict=True)), 8
    base = moof if flags & 0x20000 else before
    for bit, name, form in ((1, "base", ">Q"), (2, None, ">I"), (8, "time", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
        if flags & bit:
            told[name] = struct.unpack_from(form, head, at)[0]
            at += struct.calcsize(form)
    base = told.get("base", base)
    place = base
    for _, (a, b) in boxes_[1:]:
        flags, n = struct.unpack_from(">II", data[a:b])
        at, first = a + 8, None
        if flags & 1:
            place = base + struct.unpack_from(">i", data[a:b], at - a)[0]
            at += 4
        if flags & 4:
            first = struct.unpack_from(">I", data[a:b], at - a)[0]
            at += 4
        fields = [x for x, bit in (("time", 256), ("size", 512), ("flags", 1024), ("shift", 2048)) if flags & bit]
        if at + 4 * n * len(fields) > b:
            raise Malformed("a run has fewer samples than it says")
        rows = np.frombuffer(data, ">u4", n * len(fields), at).astype(np.int64).reshape(n, len(fields)) if fields else None
        column = lambda x: rows[:, fields.index(x)] if x in fields else None  # noqa: B023, E731
        sizes = column("size") if "size" in fields else _even(told["size"], n, data)
        marks = column("flags") if "flags" in fields else np.full(len(sizes), told["flags"], np.int64)
        if first is not None and n:
            marks = np.append(first, marks[1:])
        duration += int(column("time").sum()) if "time" in fields else n * told["time"]
        runs.append((place, sizes, marks & 0x10000 == 0))
        place += int(sizes.sum())
    return track, runs, duration, place


def _track(data: bytes, part: dict, fragments: list) -> dict:
    a, b = part[b"mdhd"]
    head = data[a:b]
    scale, duration = struct.unpack_from(">IQ", head, 20) if head[0] == 1 else struct.unpack_from(">II", head, 12)
    a, b = part[b"stsd"]
    codec = data[a + 12 : a + 16].decode("latin-1") if b - a >= 16 else None
    sizes = _sizes(data, part)
    runs = _chunks(data, part, sizes) if len(sizes) else []
    keys = np.ones(len(sizes), bool)
    if b"stss" in part:
        marked = _table(data, part[b"stss"], 1)[:, 0] - 1
        if len(marked) and not (0 <= marked.min() and marked.max() < len(sizes)):
            raise Malformed("a keyframe is no sample")
        keys[:] = False
        keys[marked] = True
    times = _table(data, part[b"stts"], 2).tolist()
    took = sum(n * step for n, step in times)
    for more, lasted in fragments:
        runs += [(at, some) for at, some, _ in more]
        keys = np.concatenate([keys, *(k for _, _, k in more)])
        took += lasted
    starts, chunks = _placed(data, runs)
    sizes = np.concatenate([sizes[:0], *(some for _, some in runs)])
    frames = list(zip(starts[keys].tolist(), sizes[keys].tolist(), strict=True))
    return {"codec": codec, "timescale": scale, "duration": took if fragments else duration or took, "samples": len(sizes), "chunks": chunks, "keyframes": frames}


def _tracks(data: bytes) -> list[dict]:
    tracks: list[dict] = []
    defaults, loose, moof = {}, [], 0  # loose: (first byte of the moof, boxes of a traf)
    for path, a, b in tree(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({})
        elif kind == b"moof":
            moof = data.rfind(b"moof", 0, a) - 4 if a >= 8 else 0
        elif kind == b"traf":
            loose.append((moof, []))
        elif b"trak" in path:
            tracks[-1].setdefault(kind, (a, b))
        elif kind == b"trex":
            _, track, _, time, size, flags = struct.unpack_from(">6I", data[a:b])
            defaults[track] = (time, size, flags)
        elif b"traf" in path and (kind == b"tfhd" or (kind == b"trun" and loose[-1][1])):
            loose[-1][1].append((kind, (a, b)))
    fragments: dict[int, list] = {}
    last = (-1, 0)
    for moof, found in loose:
        if not found or found[0][0] != b"tfhd":
            raise Malformed("a fragment names no track")
        track, runs, lasted, end = _fragment(data, moof, found, defaults, last[1] if last[0] == moof else moof)
        fragments.setdefault(track, []).append((runs, lasted))
        last = (moof, end)
    out = []
    for part in tracks:
        if b"stsz" in part or b"stz2" in part:
            a, b = part[b"tkhd"]
            number = struct.unpack_from(">I", data[a:b], 20 if data[a] == 1 else 12)[0]
            out.append({"track": number} | _track(data, part, fragments.get(number, [])))
    if not out:
        raise Malformed("no track has a sample table")
    return out


def probe(data: bytes | None) -> tuple[list[dict], str | None]:
    """Every track's number, codec, time scale, duration, samples, chunk ranges and keyframe ranges; or no track and the reason."""
    try:
        return _tracks(data or b""), None
    except Exception as e:  # noqa: BLE001 - any bytes may come here, and one row must not end the job
        return [], f"{type(e).__name__}: {e}"


_PROBED = [("track", "long"), ("codec", "string"), ("timescale", "long"), ("duration", "decimal(20,0)"), ("samples", "long"), ("chunks", "array<struct<at:long,size:long>>"), ("keyframes", "array<struct<at:long,size:long>>"), ("error", "string")]


def _pairs(ranges: list) -> list:
    return [{"at": a, "size": b} for a, b in ranges]


def probed(files: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row per track of binary column ``media_col``: the row's id and what :func:`probe` says; one row with ``error`` where there is none."""

    def run(batches):
        for ids, media in batches:
            rows = []
            for i, m in zip(ids, media, strict=True):
                tracks, error = probe(m)
                rows += [(i, t["track"], t["codec"], t["timescale"], Decimal(t["duration"]), t["samples"], _pairs(t["chunks"]), _pairs(t["keyframes"]), None) for t in tracks]
                if error:
                    rows.append((i, *[None] * 7, error))
            if rows:
                yield tuple(zip(*rows, strict=True))

    kind = files.schema[id_col].dataType
    return map_rows(files, [(id_col, kind.simpleString()), (media_col, "binary")], [(id_col, kind), *_PROBED], run)


def payload(text: bytes | None) -> bytes:
    """The text's bytes and bytes 0 up to a positive multiple of 64."""
    text = text or b""
    return text + bytes(max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def texts_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a media file."""

    def run(batches):
        for ids, texts in batches:
            for lo in range(0, len(ids), 100):
                part = texts[lo : lo + 100]
                yield ids[lo : lo + 100], [len(t or b"") for t in part], [store(payload(t)) for t in part]

    kind = docs.schema[id_col].dataType
    return map_rows(docs, [(id_col, kind.simpleString()), (text_col, "binary")], [("doc_id", kind), ("n_bytes", "long"), ("media", "binary")], run)


def read_back(files: DataFrame) -> DataFrame:
    """Digests of the stored bytes and of the payload found in them by their sample tables, and codec, seconds and keyframe ranges."""

    def run(batches):
        for ids, sizes, media in batches:
            rows = []
            for i, n, m in zip(ids, sizes, media, strict=True):
                tracks, error = probe(m)
                if error:
                    raise Malformed(error)
                p = tracks[0]
                data = b"".join(m[a : a + size] for a, size in p["chunks"])
                keys = ";".join(f"{a}+{k}" for a, k in p["keyframes"])
                codec, seconds = p["codec"].strip(), p["duration"] / p["timescale"]
                what = f"{codec}|{seconds:.6f}|{p['samples']}|{len(p['keyframes'])}|{hashlib.sha256(keys.encode()).hexdigest()[:16]}"
                rows.append((i, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), what, codec, seconds, _pairs(p["keyframes"])))
            if rows:
                yield tuple(zip(*rows, strict=True))

    kind = files.schema["doc_id"].dataType
    out = [("doc_id", kind), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    out += [("codec", "string"), ("seconds", "double"), ("keyframes", "array<struct<at:long,size:long>>")]
    return map_rows(files, [("doc_id", kind.simpleString()), ("n_bytes", "long"), ("media", "binary")], out, run)
