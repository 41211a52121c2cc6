import hashlib
import struct
import tracemalloc
import zlib

import pytest

from hopframe.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 4097, 64 * 64, 64 * 65, 64 * 129 + 5, 300_000])
def test_round_trip(n):
    text = bytes(i * 7 % 251 for i in range(n))
    data = media.payload(text)
    assert len(data) % 64 == 0 < len(data) < n + 65 and data[:n] == text and not any(data[n:])
    file = media.store(data)
    (p,), error = media.probe(file)
    assert error is None and p["track"] == 1 and p["codec"] == "raw " and p["duration"] == len(data) and p["samples"] == len(data) // 64
    assert b"".join(file[a : a + k] for a, k in p["chunks"]) == data
    assert [file[a : a + k] for a, k in p["keyframes"]] == [data[i : i + 64] for i in range(0, len(data), 64 * media.KEY)]
    assert [".".join(x.decode() for x in path) for path, _, _ in media.tree(file)][-1] == "mdat"


def test_cut_files_are_reported():
    file = media.store(media.payload(b"abc" * 500))
    assert all(media.probe(file[:n])[1] for n in range(0, len(file), 13))
    assert media.probe(None)[1] and media.probe(b"not a container at all")[1]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_hostile_files_are_answered():
    deep = b""
    for _ in range(2000):
        deep = box(b"moov", deep)
    assert "deeper" in media.probe(deep)[1]
    file = media.store(media.payload(b"abc" * 50))
    tracemalloc.start()
    for i in range(len(file)):
        for v in (0, 1, 127, 255):
            tracks, error = media.probe(file[:i] + bytes([v]) + file[i + 1 :])
            assert (error is None) == bool(tracks)
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def track(number, codec, tables):
    head = struct.pack(">IIII", 0, 0, 1000, 0)
    full = lambda kind, *parts: box(kind, bytes(4), *parts)
    stsd = full(b"stsd", struct.pack(">I", 1), box(codec, bytes(28)))
    mdia = box(b"mdia", full(b"mdhd", head, bytes(4)), box(b"minf", box(b"stbl", stsd, *(full(k, *v) for k, v in tables))))
    return box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, number, 0, 0), bytes(60)), mdia)


def test_every_track_compact_sizes_and_fragments():
    u = lambda *x: struct.pack(f">{len(x)}I", *x)
    data = bytes(range(200))
    ftyp = box(b"ftyp", b"isom", bytes(4))

    def tables(at, sizes, bits):
        packed = bytes(sizes[i] << 4 | (sizes + [0])[i + 1] for i in range(0, len(sizes), 2)) if bits == 4 else bytes(sizes)
        return [(b"stts", (u(1, len(sizes), 40),)), (b"stsc", (u(1, 1, len(sizes), 1),)), (b"stz2", (u(bits, len(sizes)), packed)), (b"stco", (u(1, at),))]

    def movie(at):
        empty = [(b"stts", (u(0),)), (b"stsc", (u(0),)), (b"stsz", (u(0, 0),)), (b"stco", (u(0),))]
        trex = box(b"trex", u(0, 3, 1, 20, 6, 0x10000))
        return box(b"moov", track(1, b"avc1", tables(at, [3, 5, 7], 4)), track(2, b"mp4a", tables(at + 15, [10, 200 - 160], 8)), track(3, b"hvc1", empty), box(b"mvex", trex))

    at = len(ftyp) + len(movie(0)) + 8
    mdat = box(b"mdat", data)
    # two runs: default sizes with a leading keyframe, then own sizes and flags right behind
    body = lambda off: box(b"moof", box(b"mfhd", u(0, 1)), box(b"traf", box(b"tfhd", u(0x20000, 3)), box(b"trun", u(5, 4, off, 0)), box(b"trun", u(0x600, 2, 9, 0, 4, 0x10000))))
    moof = body(len(body(0)) + 8)
    file = ftyp + movie(at) + mdat + moof + mdat
    tracks, error = media.probe(file)
    assert error is None and [t["codec"] for t in tracks] == ["avc1", "mp4a", "hvc1"]
    assert [file[a : a + n] for a, n in tracks[0]["keyframes"]] == [data[:3], data[3:8], data[8:15]] and tracks[0]["duration"] == 120
    assert [file[a : a + n] for a, n in tracks[1]["chunks"]] == [data[15:65]]
    assert tracks[2]["samples"] == 6 and tracks[2]["duration"] == 120
    assert [file[a : a + n] for a, n in tracks[2]["keyframes"]] == [data[:6], data[24:33]]
    assert [file[a : a + n] for a, n in tracks[2]["chunks"]] == [data[:24], data[24:37]]
    for i in range(len(file)):
        media.probe(file[:i] + bytes([file[i] ^ 0xFF]) + file[i + 1 :])


def test_documents(spark):
    docs = [(1, "héllo", "m"), (2, None, "m"), (3, "", None), (None, "héllo", None), (5, "x" * 70_000, "y"), (1, "héllo", "m")]
    d = spark.createDataFrame(docs, "doc_id long, text string, media string")
    got = media.read_back(media.texts_to_media(d)).collect()
    assert len(got) == 6
    for r in got:
        text = next(t for i, t, _ in docs if i == r.doc_id) or ""
        data = media.payload(text.encode())
        assert (r.n_bytes, r.payload_bytes) == (len(text.encode()), len(data))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        file = media.store(data)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        (p,), _ = media.probe(file)
        assert [tuple(k) for k in r.keyframes] == p["keyframes"] and r.codec == "raw" and r.seconds == len(data) / media.RATE
        keys = ";".join(f"{a}+{k}" for a, k in p["keyframes"])
        assert r.feature == f"raw|{r.seconds:.6f}|{len(data) // 64}|{len(p['keyframes'])}|{hashlib.sha256(keys.encode()).hexdigest()[:16]}"
    assert len({r.feature for r in got if r.n_bytes == 6}) == 1
    probed = media.probed(media.texts_to_media(d), "doc_id", "media").collect()
    assert all(r.codec == "raw " and r.keyframes[0].size == 64 and r.error is None for r in probed)
    assert media.read_back(media.texts_to_media(d.limit(0))).count() == 0
