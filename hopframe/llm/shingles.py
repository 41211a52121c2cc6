"""Word-shingle sets of whole texts as 64-bit hashes, computed in numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes of text that are hashed together; a longer text is hashed alone.
BLOCK_BYTES = 1 << 18

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1 << 60, 1 << 62, dtype=np.uint64)) | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers of the base and of its inverse modulo 2**64, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES + 4096)
            self.up, self.down = _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))
        return self.up, self.down


_TABLES = _Tables()


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser after which all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words between white space in UTF-8 bytes."""
    up, down = _TABLES.upto(len(data) + 1)
    gap = np.concatenate(([True], _SPACE[data], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def blocks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts that are hashed together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > lo and size + n > BLOCK_BYTES:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def shingle_sets(texts: list[bytes | None], k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes.

    A-Z count as a-z. A text of fewer words has one shingle, the whole sequence; a text
    without words, or null, has none.
    """
    for lo, hi in blocks(texts):
        part = [(t or b"").lower() for t in texts[lo:hi]]
        data = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        words, start = word_hashes(data)
        ends = np.cumsum([len(t) + 1 for t in part])
        last = np.searchsorted(start, ends)  # words before the end of each text
        n = len(words) - k + 1
        if n > 0:
            h = words[:n].copy()
            for j in range(1, k):
                h = h * np.uint64(_BASE) + words[j : j + n]
            h = mix(h)
        at = 0
        for to in last.tolist():
            if to - at >= k:
                yield np.unique(h[at : to - k + 1])
            elif to > at:
                short = np.array([to - at], np.uint64)
                for j in range(at, to):
                    short = mix(short * np.uint64(_BASE) + words[j : j + 1])
                yield short
            else:
                yield np.zeros(0, np.uint64)
            at = to


def digests(s: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two signed 64-bit digests of a sorted set."""
    raw = xxhash.xxh3_128_digest(s.tobytes(), seed)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)
