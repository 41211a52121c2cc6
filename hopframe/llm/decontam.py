"""Benchmark decontamination with a generalised suffix automaton over benchmark words.

Arrays hold the automaton of all items. Every task reads it, streams a document's words through it
and keeps the longest match that ends at each word. Where that length reaches ``window`` the
matched words are hit; an item shorter than the window is hit where it occurs whole.

Items are at most ``shard_bytes`` of text an automaton, and at most ``round_bytes`` of text are
broadcast at a time, which is checked: a larger benchmark is dealt into rounds, and documents
pass one round after the other with the spans found so far in a written table.

Cases: null texts have no words; items without words or without an id are ignored; repeated
items and documents count once per row; texts of any length are streamed whole; extra columns,
whatever their names, stay or are ignored; empty tables give no hits.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import Scratch, alnum_words, column, fresh, map_rows

#: Text of the items in one automaton. About 10 bytes of memory a byte of text, and its distinct words.
SHARD_BYTES = 4_000_000
#: Text of the items whose automata are broadcast together.
ROUND_BYTES = 16_000_000

#: An odd number that spreads the keys of the hash table.
_SPREAD, _64 = 0x9E3779B97F4A7C15, (1 << 64) - 1

#: The same words in a text whose letters are still as they were.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Suffix automaton of several word sequences, in arrays over word numbers; state 0 is the empty match.

    Most states have one way on, which two arrays hold. Further ways are in a hash table of two
    arrays with open addressing, those of state 0 in an array by word.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.names = window, [name for name, _ in items]
        self.word: dict[bytes, int] = {}
        texts = [array("i", [self.word.setdefault(w, len(self.word)) for w in words]) for _, words in items]
        self.root = array("i", [-1]) * len(self.word)
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.way, self.to = array("i", [-1]), array("i", [-1])
        self._more: dict[int, dict[int, int]] = {}
        for words in texts:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._mark(texts)
        self._freeze()

    def _go(self, s: int, w: int) -> int:
        if not s:
            return self.root[w]
        if self.way[s] == w:
            return self.to[s]
        more = self._more.get(s)
        return more.get(w, -1) if more else -1

    def _lead(self, s: int, w: int, to: int) -> None:
        if not s:
            self.root[w] = to
        elif self.way[s] in (-1, w):
            self.way[s], self.to[s] = w, to
        else:
            self._more.setdefault(s, {})[w] = to

    def _new(self, length: int, link: int, like: int | None = None) -> int:
        n = len(self.link)
        self.link.append(link)
        self.length.append(length)
        self.way.append(-1 if like is None else self.way[like])
        self.to.append(-1 if like is None else self.to[like])
        if like in self._more:
            self._more[n] = dict(self._more[like])
        return n

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], q)
        self.link[q] = copy
        while p >= 0 and self._go(p, w) == q:
            self._lead(p, w, copy)
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self._go(last, w)
        if q >= 0:  # an earlier item has these words
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._new(self.length[last] + 1, 0)
        p = last
        while p >= 0 and self._go(p, w) < 0:
            self._lead(p, w, new)
            p = self.link[p]
        if p >= 0:
            q = self._go(p, w)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _mark(self, texts: list[array]) -> None:
        """The items of each window, and the states at which short items end."""
        n, window = len(self.link), self.window
        order = np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[1:].tolist()
        #: The number of the state that holds the last ``window`` words of a state's words.
        self.at_window, windows = array("i", [-1]) * n, 0
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                if self.length[up] < window:
                    self.at_window[s], windows = windows, windows + 1
                else:
                    self.at_window[s] = self.at_window[up]
        #: For each short item's end: (words, items) that end there.
        self.short: dict[int, dict[int, set]] = {}
        pairs = array("q")
        for item, words in enumerate(texts):
            s = 0
            for i, w in enumerate(words):
                s = self._go(s, w)
                if i + 1 >= window:
                    pairs.append(self.at_window[s] * len(texts) + item)
            if 0 < len(words) < window:
                while self.length[self.link[s]] >= len(words):
                    s = self.link[s]
                self.short.setdefault(s, {}).setdefault(len(words), set()).add(item)
        told = np.unique(np.frombuffer(pairs, np.int64)) if len(pairs) else np.zeros(0, np.int64)
        #: Items of the windows, one window after the other, and where each window's begin.
        self.items = array("i", (told % max(1, len(texts))).astype(np.int32).tobytes())
        self.first = array("i", np.searchsorted(told // max(1, len(texts)), np.arange(windows + 1)).astype(np.int32).tobytes())
        #: The nearest state at or above a state at which short items end.
        self.near_short = array("i", [-1]) * n
        if self.short:
            for s in order:
                self.near_short[s] = s if s in self.short else self.near_short[self.link[s]]

    def _freeze(self) -> None:
        n = sum(map(len, self._more.values()))
        self.slots, words = n + n // 2 + 1, len(self.root)
        self.keys, self.values = array("q", [-1]) * self.slots, array("i", [-1]) * self.slots
        self.many = bytearray(len(self.link))
        for s, ways in self._more.items():
            self.many[s] = 1
            for w, to in ways.items():
                key = s * words + w
                at = (key * _SPREAD & _64) * self.slots >> 64
                while self.keys[at] >= 0:
                    at = (at + 1) % self.slots
                self.keys[at], self.values[at] = key, to
        del self._more

    def bytes(self) -> int:
        """Bytes of the arrays."""
        return sum(x.itemsize * len(x) for x in vars(self).values() if isinstance(x, array)) + len(self.many)

    def spans(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged spans [first, last] of hit words, and the items found."""
        root, way, to, many, keys, values, slots, every = self.root, self.way, self.to, self.many, self.keys, self.values, self.slots, len(self.root)
        link, length, window, near, short, at_window = self.link, self.length, self.window, self.near_short, self.short, self.at_window
        spans, windows, found, s, n = [], set(), set(), 0, 0
        for i, w in enumerate(map(self.word.get, words)):
            if w is None:
                s = n = 0
                continue
            while s:
                if way[s] == w:
                    s = to[s]
                    break
                if many[s]:
                    key = s * every + w
                    at = (key * _SPREAD & _64) * slots >> 64
                    while keys[at] >= 0 and keys[at] != key:
                        at = (at + 1) % slots
                    if keys[at] == key:
                        s = values[at]
                        break
                s = link[s]
                n = length[s]
            else:
                s = root[w]
            n, cover = n + 1, 0
            if n >= window:
                cover = n
                windows.add(at_window[s])
            a = near[s]
            while a > 0:
                for m, items in short[a].items():
                    if m <= n:
                        found |= items
                        cover = max(cover, m)
                a = near[link[a]]
            if cover:
                at = i - cover + 1
                while spans and spans[-1][1] >= at - 1:
                    at = min(at, spans.pop()[0])
                spans.append([at, i])
        for k in windows:
            found.update(self.items[self.first[k] : self.first[k + 1]])
        return spans, {self.names[x] for x in found}


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def automata(benchmark: DataFrame, window: int, shard_bytes: int = SHARD_BYTES) -> list:
    """Broadcast automata over the items, each over at most shard_bytes of text or one item."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("item_id is not null and text is not null")
    shards, size = [[]], 0
    for item, text in items.orderBy("item_id").toLocalIterator():
        if shards[-1] and size + len(text) > shard_bytes:
            shards.append([])
            size = 0
        size += len(text)
        if words := alnum_words(bytes(text)):
            shards[-1].append((item, words))
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(SuffixAutomaton(x, window)) for x in shards]


def rounds(benchmark: DataFrame, round_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about round_bytes of text; itself where it has no more."""
    total = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("binary")))).first()[0] or 0
    n = -(-total // round_bytes)
    return [benchmark.where(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n)) == i) for i in range(n)] if n > 1 else [benchmark]


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """Per document: doc_id, n_words, spans (array of [first word, last word]), items (sorted ids as strings)."""
    kind = docs.schema[id_col].dataType
    found = [("n_words", "long"), ("spans", "array<array<int>>"), ("items", "array<string>")]
    parts = rounds(benchmark, round_bytes)
    each = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("binary").alias("text"))
    tables = Scratch()
    try:
        for i, part in enumerate(parts):
            shards, last = automata(part, window, shard_bytes), i == len(parts) - 1

            def run(batches, shards=shards, last=last):
                for ids, texts, *before in batches:
                    count, spans, items = [], [], []
                    for j, text in enumerate(texts):
                        words = alnum_words(text)
                        got = [x.value.spans(words) for x in shards]
                        if before:
                            got.append((before[0][j], set(before[1][j])))
                        count.append(len(words))
                        spans.append(got[0][0] if len(got) == 1 else _merge([x for s, _ in got for x in s]))
                        items.append(sorted(set(chain.from_iterable(i for _, i in got))))
                    yield (ids, count, spans, items) if last else (ids, texts, spans, items)

            before = [("spans", "array<array<int>>"), ("items", "array<string>")] if i else []
            out = [("doc_id", kind), *(found if last else [("text", "binary"), *found[1:]])]
            each = map_rows(each, [("doc_id", kind.simpleString()), ("text", "binary"), *before], out, run)
            if not last:
                each = tables(each)
                _drop_all_but_last(tables)
    except BaseException:
        tables.__exit__()
        raise
    return each


def _drop_all_but_last(tables: Scratch) -> None:
    """What a round has read goes once its own table is written; the last one is read by the result and goes with the application."""
    for t in tables.tables[:-1]:
        tables.drop(t)


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of what :func:`matches` found."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0] + 1).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_spans(text: str, spans: list[list[int]]) -> str:
    """The text without the words of these spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b][1]
    return "".join(out) + text[last:]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, most_coverage: float = 0.5, shard_bytes: int = SHARD_BYTES, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut out of a text, n_chars follows, and a
    document of whose words more than ``most_coverage`` are hit goes. Others stay as they are.
    """
    names = docs.columns
    where, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    fields = [(f.name, f.dataType) for f in docs.schema]
    columns = [(n, t.simpleString()) for n, t in fields]
    parts = rounds(benchmark, round_bytes)
    mark, tables = fresh(names, "_spans"), Scratch()
    try:
        for i, part in enumerate(parts):
            shards, first, last = automata(part, window, shard_bytes), i == 0, i == len(parts) - 1

            def run(batches, shards=shards, first=first, last=last):
                for cols in batches:
                    rows = []
                    for row in zip(*cols, strict=True):
                        words = alnum_words(row[where].encode()) if row[where] else []
                        spans = _merge([x for s in shards for x in s.value.spans(words)[0]] + ([] if first else row[-1]))
                        row = row[: len(names)]
                        if not last:
                            rows.append((*row, spans))
                            continue
                        if spans:
                            if sum(b - a + 1 for a, b in spans) > most_coverage * len(words):
                                continue
                            row = list(row)
                            row[where] = without_spans(row[where], spans)
                            if chars is not None:
                                row[chars] = len(row[where])
                        rows.append(row)
                    if rows:
                        yield tuple(zip(*rows, strict=True))

            before = [] if first else [(mark, "array<array<int>>")]
            after = [] if last else [(mark, "array<array<int>>")]
            docs = map_rows(docs, [*columns, *before], [*fields, *after], run)
            if not last:
                docs = tables(docs)
                _drop_all_but_last(tables)
    except BaseException:
        tables.__exit__()
        raise
    return docs
