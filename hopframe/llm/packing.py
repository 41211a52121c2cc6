"""Harmonic packing: reciprocal-capacity classes, each filling its bins with a fixed count.

A document of n tokens that fits belongs to the class of the largest count k with k * n <=
capacity; a bin of class k takes exactly k whole documents. Counts are 1 to 16 and the powers of
two above, so a class holds lengths from about capacity/(k+1) to capacity/k. What room a full bin
has left is filled with tokens of documents that are longer than the capacity and must be cut in
any case; what such a document has beyond that is cut into whole sequences, and its rest is
stock for further rooms.

Every task fills the bins of its own rows and needs no other task: no shuffle, no lock, and a
lost task is simply run again. It holds at most ``WAITING`` bins with room, one open bin a class
and ``STOCK`` sequences of stock. Where more wait and no stock comes, one is dissolved and
its documents fill the others' rooms, whole where one fits, else cut. At a task's end open
bins are dissolved in the same way. What is left is laid end to end; the last, partial sequence
is divided into sequences whose lengths are powers of two. So nothing is padded.

Cases: null and empty texts are one end token; documents of any length are cut, not shortened;
repeated rows are packed once each; a null id stays null; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import map_rows
from hopframe.llm.tokens import PieceEncoder, vocabulary

#: A task numbers its sequences from its partition's number times this.
SEQUENCES_A_TASK = 1 << 40
#: Bins of a task that wait for their room to be filled, and its stock in sequences.
WAITING, STOCK = 256, 64

#: A run of one document's tokens: (document, first token, ids, tokens of the document).
Piece = tuple[object, int, bytes, int]


def size(p: Piece) -> int:
    return len(p[2]) // 4


def split(p: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = p
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


def counts(capacity: int) -> list[int]:
    """The counts of the classes."""
    return [*range(1, min(16, capacity) + 1), *(1 << i for i in range(5, capacity.bit_length()))]


class Bins:
    """The bins of one task. Methods give the rows (sequence, offset, piece) of the bins that they complete."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.counts = capacity, first, counts(capacity)
        self.open: dict[int, list[Piece]] = {}
        self.waiting: list[tuple[int, int, list[Piece]]] = []  # by room: (room, number, pieces)
        self.number, self.stock, self.stocked = 0, [], 0

    def add(self, piece: Piece) -> list[tuple]:
        """Put in one whole document."""
        out: list[tuple] = []
        n = size(piece)
        if n > self.capacity:
            rest = self._fill(piece, out)
            while rest and size(rest) >= self.capacity:
                head, rest = split(rest, self.capacity)
                self._emit([head], out)
            if rest and size(rest):
                self._keep(rest, out)
            return out
        k = self.counts[bisect_right(self.counts, self.capacity // n) - 1]
        got = self.open.setdefault(k, [])
        got.append(piece)
        if len(got) == k:
            del self.open[k]
            self._full(got, out)
        return out

    def close(self) -> list[tuple]:
        out: list[tuple] = []
        left = sorted((p for got in self.open.values() for p in got), key=size, reverse=True)
        self.open = {}
        for p in left:
            if not self._place(p, out):
                self.stock.append(p)
        while self.waiting and self.stock:
            if rest := self._fill(self.stock.pop(0), out):
                self.stock.insert(0, rest)
        while self.waiting:
            self._dissolve(out)
        self.stocked = sum(map(size, self.stock))
        while self.stocked:
            self._lay(min(self.capacity, 1 << (self.stocked.bit_length() - 1)), out)
        return out

    def _emit(self, pieces: list[Piece], out: list[tuple]) -> None:
        at = 0
        for p in pieces:
            out.append((self.next, at, p))
            at += size(p)
        self.next += 1

    def _full(self, pieces: list[Piece], out: list[tuple]) -> None:
        """A bin has its count: fill its room from the stock, or let it wait."""
        room = self.capacity - sum(map(size, pieces))
        while room and self.stock:
            p = self.stock.pop()
            if size(p) > room:
                p, rest = split(p, room)
                self.stock.append(rest)
            pieces.append(p)
            room -= size(p)
            self.stocked -= size(p)
        self._wait(room, pieces, out)
        while len(self.waiting) > WAITING:
            self._dissolve(out)

    def _wait(self, room: int, pieces: list[Piece], out: list[tuple]) -> None:
        if room:
            self.number += 1
            insort(self.waiting, (room, self.number, pieces))
        else:
            self._emit(pieces, out)

    def _fill(self, p: Piece, out: list[tuple]) -> Piece | None:
        """Fill rooms with a piece's tokens, the largest first; what is left of it, if bins no longer wait."""
        while self.waiting:
            room, _, pieces = self.waiting.pop()
            if size(p) <= room:
                self._wait(room - size(p), [*pieces, p], out)
                return None
            head, p = split(p, room)
            self._emit([*pieces, head], out)
        return p

    def _place(self, p: Piece, out: list[tuple]) -> bool:
        """Put a piece whole into the smallest room that has it."""
        at = bisect_left(self.waiting, (size(p), 0))
        if at == len(self.waiting):
            return False
        room, _, pieces = self.waiting.pop(at)
        self._wait(room - size(p), [*pieces, p], out)
        return True

    def _dissolve(self, out: list[tuple]) -> None:
        """Take a waiting bin apart to fill others: one whose largest piece fits whole into the largest room, else the emptiest."""
        at, largest = min(enumerate(max(map(size, b[2])) for b in self.waiting), key=lambda x: x[1])
        others = self.waiting[-1 if at < len(self.waiting) - 1 else -2][0] if len(self.waiting) > 1 else 0
        _, _, pieces = self.waiting.pop(at if largest <= others else -1)
        for p in sorted(pieces, key=size, reverse=True):
            if not self._place(p, out) and (rest := self._fill(p, out)):
                self._keep(rest, out)

    def _keep(self, p: Piece, out: list[tuple]) -> None:
        self.stock.append(p)
        self.stocked += size(p)
        while self.stocked > STOCK * self.capacity:
            self._lay(self.capacity, out)

    def _lay(self, n: int, out: list[tuple]) -> None:
        """Lay n tokens of the stock end to end as a sequence."""
        pieces, room = [], n
        while room:
            p = self.stock.pop(0)
            if size(p) > room:
                p, rest = split(p, room)
                self.stock.insert(0, rest)
            pieces.append(p)
            room -= size(p)
        self.stocked -= n
        self._emit(pieces, out)


def pack(
    docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``capacity`` is a power of two. ``tokenizer`` is the path of a tokenizer file, by default a byte-level BPE.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path, end = tokenizer or vocabulary(), np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = PieceEncoder(path)
        bins = Bins(capacity, TaskContext.get().partitionId() * SEQUENCES_A_TASK)

        def columns(rows):
            seq, off, pieces = zip(*rows, strict=True)
            doc, start, ids, total = zip(*pieces, strict=True)
            return doc, start, list(map(size, pieces)), pa.array(ids, pa.binary()), total, seq, off

        for docs_, texts in batches:
            for lo in range(0, len(texts), 250):
                rows = []
                for doc, ids in zip(docs_[lo : lo + 250], encoder.encode(texts[lo : lo + 250]), strict=True):
                    ids += end
                    rows += bins.add((doc, 0, ids, len(ids) // 4))
                if rows:
                    yield columns(rows)
        rows = bins.close()
        if rows:
            yield columns(rows)

    kind = docs.schema[id_col].dataType
    out = [("doc_id", kind), ("start", "long"), ("length", "long"), ("ids", "binary"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")]
    return map_rows(docs, [(id_col, kind.simpleString()), (text_col, "string")], out, run)


def digest(pieces: DataFrame) -> DataFrame:
    """Packed pieces with their ids' CRC-32 in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
