"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The field labels each white-space word with a kind or ``-``. A word counts by its shape, length,
character classes and, if it is one of a few cue words, itself, and by its neighbours' features.
It is trained in numpy from a small labelled table, whose values are invented. Emissions depend
on words alone, so they are cached for each set of features that the training knows.

Decoding is exact Viterbi over whole texts. A word whose ``-`` leads all other labels by more
than transitions can ever give back is ``-`` on the best path whatever surrounds it, so it cuts
the chain; the few short runs between such words are decoded together in numpy batches.

Pattern spans stay as they are. A span of the field counts where it overlaps none of them.

Cases: null and empty texts have no spans; texts and words of any length are read whole; repeated
rows are answered each; a null id stays null; extra columns, whatever their names, are ignored, or
kept by :func:`redact`; an empty table gives no rows.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import map_rows

#: Kinds in the order in which spans of one start are listed; the last is the field's own.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("-", *KINDS)
#: Words whose text itself is a feature.
CUES = frozenset("token key secret password passwd pwd apikey api_key bearer auth call phone tel fax mail email e-mail contact ip host server address card visa pin ssn iban = : is".split())

#: Labelled sentences: [kind words] marks personal data.
LABELLED = """
Please write to [email anna.berg@mail.example.org] before Friday .
Contact : [email j.doe+news@example.com] or call [phone +1 (212) 555-0147] now .
You can mail [email support@shop.example.net] for help with orders
Mein Kontakt ist [email max_muster@beispiel.example.de] oder [phone +49 30 1234 5678] heute
Son adresse est [email lea.martin@exemple.example.fr], merci beaucoup .
Mi correo es [email pablo99@correo.example.es] y nada de otra cosa .
call [phone +44 20 7946 0958] after nine and ask for the manager
Tel : [phone +1 (303) 555-0199] fax [phone +1 (303) 555-0198]
Her phone is [phone (415) 555-0132] and his is [phone 555-0170-22] at home
Appelez le [phone +33 1 70 18 99 00] ou bien venez nous voir .
the old house on the hill was sold in 1987 for a good price
He paid 1200 dollars and 50 cents in 2019 , then 3 more .
Server [ip 10.0.0.12] refused the connection at 12:30 today
Requests from [ip 192.168.4.77] went to [ip 203.0.113.9], as the log says
version 2.4.1 was released on 3.5.2021 with many changes
The host is [ip 198.51.100.23]. It is down .
Visa card [card 4111 1111 1111 1111] expires soon and must be changed
I paid with [card 5500-0000-0000-0004] last week in the shop .
the number [card 4012888888881881] was on the receipt they found
order 20231145 has shipped and item 778 is out of stock
api_key = [secret "9f8e7d6c5b4a39281706f5e4d3c2b1a0"] in the file
token = [secret "5d2c9a7e1b80f346ac91de73b5f02846c7e3a915"] and more text here
token = [secret "0be47f1c93d8a52667fe31b09c84d2a75e1f60b3"] le reste du texte
secret : [secret 7c4a8d09ca3762af61e59520943dc26494f8941b] must not be shown
key = [secret "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY"] appears in the log
password is [secret hX93kd82Lq1zP0vT5w] please change it at once
bearer [secret eyJhbGciOi9JIUzI1Ni1sInR5cCI6IkpXVCJ9x] was sent with the call
und dann token = [secret "a8f03b6d2194ce75d70b15f8e3926ac4419d5e07"] stand dort
en la casa hay una token de metro y nada mas
the key is under the mat and the token is lost for ever
a secret garden is a place where nobody goes any more
NOTICE *** closed until further notice ... ring the bell (twice) & wait ###
STOP!!! READ THIS FIRST!!! YES, YOU!! THANKS!!
apples / pears / plums ~ 3 for 2 ; cash only :-)
rows #1-#12 @home = 50% off >> ask inside <<
Internationalization and counterrevolutionaries are very long words indeed
Die Donaudampfschifffahrtsgesellschaft hat einen Kapitän in Straßburg gesucht
El niño comió una manzana y después se durmió en la habitación
Les élèves étaient à l'école près de la forêt où ils jouèrent
see http://www.example.com/en/825?page=2 for the full list
Released under the MIT License. All rights are kept by the authors .
Licensed under the Apache License, Version 2.0. See the file for terms .
Copyright 2020-2024 by its many authors , who keep what is theirs
The The The The The of of of of and and and and
"Well," said she, "it's not (quite) done - yet; but soon."
It costs $4,500.00 or 12% less on 04/07/2022 at noon
"""

_EMAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"\S+")
#: What may stand around a value and is no part of it.
_AROUND = string.punctuation.replace("+", "")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns' matches, by start, then kind."""
    out = []
    if "@" in text:
        free = 0
        for m in _EMAIL.finditer(text):  # what stands before the sign is read backwards: linear in any text
            a = m.start()
            while a > free and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, m.end(), 0))
                free = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((*m.span(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


_SHAPES = [(re.compile(p), r) for p, r in ((r"[A-Z]+", "X"), (r"[a-z]+", "x"), (r"[0-9]+", "d"), (r"[^\x00-\x7F]+", "u"))]


def features(word: str) -> tuple[str, ...]:
    """What a word says of itself: shape, core shape, length, character classes, cue."""
    core = word.strip(_AROUND)
    short = core
    for p, r in _SHAPES:
        short = p.sub(r, short)
    short = re.sub(r"((?:dx|xd|dX|Xd|xX|Xx)){2,}[dxX]*", "M", short) if len(short) > 6 else short
    digits, letters, n = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core), max(1, len(core))
    size = min(len(word), 40) // 4
    out = [f"s:{short}", f"n:{size}", f"w:{min(9, 10 * digits // n)}"]
    if digits >= 3 and letters >= 2 and n >= 16 and digits + letters == n:
        out.append("mixed")
    if n >= 16 and re.fullmatch(r"[0-9a-fA-F]+", core) and letters:
        out.append("hex")
    if "@" in core:
        out.append("at")
    if core.count(".") == 3 and digits + 3 == n:
        out.append("dots")
    if word.lower() in CUES:
        out.append(f"cue:{word.lower()}")
    if word[:1] in "\"'" and word[-1:] in "\"',." and n >= 12:
        out.append("quoted")
    return tuple(out)


def labelled_rows(table: str = LABELLED) -> list[tuple[list[str], list[int]]]:
    """Words and label numbers of each sentence of a labelled table."""
    rows = []
    for line in table.strip().splitlines():
        words, tags = [], []
        for part in re.split(r"(\[\w+ [^\]]*\]\S*)", line):
            m = re.fullmatch(r"\[(\w+) ([^\]]*)\](\S*)", part)
            got = (m[2] + m[3]).split() if m and m[1] in KINDS else part.split()
            words += got
            tags += [LABELS.index(m[1]) if m and m[1] in KINDS else 0] * len(got)
        rows.append((words, tags))
    return rows


@dataclass
class Field:
    """Weights of features for the word itself and for its neighbours, and of transitions."""

    index: dict[str, int]
    weights: np.ndarray  # (3, features, labels): own, of the word before, of the word after
    moves: np.ndarray  # (labels, labels)

    def known(self, word: str) -> tuple[int, ...]:
        """The numbers of a word's features that the field was trained on: its class."""
        return tuple(self.index[f] for f in features(word) if f in self.index)

    def emission(self, known: tuple[int, ...]) -> np.ndarray:
        return self.weights[:, list(known)].sum(1) if known else np.zeros((3, self.moves.shape[0]))


def train(rows: list[tuple[list[str], list[int]]], rounds: int = 300, rate: float = 0.3, decay: float = 0.02) -> Field:
    """Maximum penalised likelihood by Adagrad over all sentences at once."""
    index: dict[str, int] = {}
    for words, _ in rows:
        for w in words:
            for f in features(w):
                index.setdefault(f, len(index))
    n, m, k, v = len(rows), max(len(w) for w, _ in rows), len(LABELS), len(index)
    x, y, mask = np.zeros((n, m + 2, v)), np.zeros((n, m), int), np.zeros((n, m), bool)
    for i, (words, tags) in enumerate(rows):
        for t, w in enumerate(words):
            x[i, t + 1, [index[f] for f in features(w)]] = 1
        y[i, : len(words)], mask[i, : len(words)] = tags, True
    views = (x[:, 1:-1], x[:, :-2], x[:, 2:])
    gold = np.eye(k)[y] * mask[..., None]
    before = np.concatenate((np.zeros((n, 1), int), y[:, :-1]), 1)
    weights, moves = np.zeros((3, v, k)), np.zeros((k, k))
    seen_w, seen_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (before[mask], y[mask]), 1)
    for i, (words, tags) in enumerate(rows):  # a sentence ends as if "-" followed
        gold_moves[tags[len(words) - 1], 0] += 1
    for _ in range(rounds):
        e = sum(a @ w for a, w in zip(views, weights, strict=True))
        e = np.where(mask[..., None], e, np.where(np.arange(k) == 0, 0.0, -1e9))
        alpha, beta = np.zeros((n, m, k)), np.zeros((n, m, k))
        alpha[:, 0] = e[:, 0] + moves[0]
        for t in range(1, m):
            alpha[:, t] = e[:, t] + _lse(alpha[:, t - 1, :, None] + moves, 1)
        beta[:, -1] = moves[:, 0]
        for t in range(m - 2, -1, -1):
            beta[:, t] = _lse(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1] + beta[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        gap = node - gold
        g_w = np.stack([np.einsum("ntv,ntk->vk", a, gap) for a in views]) + decay * weights
        pair = np.exp(alpha[:, :-1, :, None] + moves + (e + beta)[:, 1:, None, :] - z[:, None, None, None])
        last = mask & ~np.concatenate((mask[:, 1:], np.zeros((n, 1), bool)), 1)
        expected = (pair * mask[:, 1:, None, None]).sum((0, 1))
        expected[0] += node[:, 0].sum(0)
        expected[:, 0] += node[last].sum(0)
        g_m = expected - gold_moves + decay * moves
        for p, g, s in ((weights, g_w, seen_w), (moves, g_m, seen_m)):
            s += g * g
            p -= rate * g / np.sqrt(s)
    return Field(index, weights, moves)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


def viterbi(e: np.ndarray, moves: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best labels of sequences padded to one length, each with "-" before and after it."""
    n, m, k = e.shape
    best, back = e[:, 0] + moves[0], np.zeros((n, m, k), np.int8)
    ends = np.where((size == 1)[:, None], best + moves[:, 0], -np.inf)
    for t in range(1, m):
        step = best[:, :, None] + moves
        back[:, t] = step.argmax(1)
        best = step.max(1) + e[:, t]
        ends = np.where((size == t + 1)[:, None], best + moves[:, 0], ends)
    out, now = np.zeros((n, m), np.int8), ends.argmax(1)
    rows = np.arange(n)
    for t in range(m - 1, -1, -1):
        inside = t < size
        out[:, t] = np.where(inside, now, 0)
        now = np.where(inside & (t > 0), back[rows, t, now], now)
    return out


class Tagger:
    """Labels of all words of texts, with bounded caches."""

    def __init__(self, field: Field, most: int = 200_000):
        self.field, self.most = field, most
        moves = field.moves
        k = len(LABELS)
        gain = moves[:, None, :] + moves.T[None, :, :]  # into b from a, then on to c: gain[a, c, b]
        self.safe = float((gain[:, :, 1:] - gain[:, :, :1]).max()) if k > 1 else 0.0
        self.words: dict[str, int] = {}
        self.classes: dict[tuple, int] = {}  # number 0: no word
        self.rows = [np.zeros((3, k))]
        self.table = np.stack(self.rows)

    def _learn(self, new: list[str]) -> None:
        for w in new:
            f = self.field.known(w)
            c = self.classes.get(f)
            if c is None:
                c = self.classes[f] = len(self.rows)
                self.rows.append(self.field.emission(f))
            self.words[w] = c
        if len(self.table) < len(self.rows):
            self.table = np.stack(self.rows)

    def labels(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each list of words: (numbers of the words that are not "-", their labels)."""
        if len(self.words) > self.most:
            self.words.clear()
        new = set().union(*texts).difference(self.words)
        if new:
            self._learn(list(new))
        size = np.array([len(t) + 1 for t in texts])
        at = np.concatenate(([0], np.cumsum(size)))
        ids = np.zeros(at[-1] + 1, np.int32)
        get = self.words.__getitem__
        for a, t in zip(at.tolist(), texts, strict=False):
            if t:
                ids[a + 1 : a + 1 + len(t)] = np.fromiter(map(get, t), np.int32, len(t))
        # each text: a gap, then its words
        lead = self.table[:, :, 1:].max(2) - self.table[:, :, 0]  # bound of any label's lead over "-", by class
        open_ = lead[ids, 0] >= -self.safe - 1e-9
        near = lead[ids[:-2], 1] + lead[ids[1:-1], 0] + lead[ids[2:], 2]
        open_[1:-1] = near >= -self.safe - 1e-9
        open_ &= ids > 0
        places = np.flatnonzero(open_)
        found = np.zeros(len(ids), np.int8)
        if len(places):
            cut = np.flatnonzero(np.diff(places, prepend=-2) != 1)
            n = np.diff(np.append(cut, len(places)))
            first = places[cut]
            for lo, hi in ((0, 4), (4, 16), (16, 256), (256, 1 << 62)):
                some = np.flatnonzero((n > lo) & (n <= hi))
                for part in np.array_split(some, max(1, len(some) * min(hi, int(n.max())) // 200_000)):
                    if not len(part):
                        continue
                    m = int(n[part].max())
                    where = np.minimum(first[part, None] + np.arange(m), len(ids) - 1)
                    e = self.table[ids[where], 0] + self.table[ids[where - 1], 1] + self.table[ids[np.minimum(where + 1, len(ids) - 1)], 2]
                    got = viterbi(e, self.field.moves, n[part])
                    inside = np.arange(m) < n[part, None]
                    found[where[inside]] = got[inside]
        hits = np.flatnonzero(found)
        who = np.searchsorted(at, hits, "right") - 1
        out = [(np.zeros(0, int), np.zeros(0, int))] * len(texts)
        for i in np.unique(who):
            h = hits[who == i]
            out[i] = (h - at[i] - 1, found[h])
        return out


def field_spans(text: str, numbers: np.ndarray, labels: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of runs of one label, without the punctuation around them."""
    where = {int(n): int(k) for n, k in zip(numbers, labels, strict=True)}
    last, out = max(where, default=-1), []
    for i, m in enumerate(_TOKEN.finditer(text)):
        if i > last:
            break
        k = where.get(i)
        if k:
            if where.get(i - 1) == k and out:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end(), k - 1])
    trimmed = []
    for a, b, k in out:
        around = _AROUND if k != 3 else _AROUND.replace("(", "").replace(")", "")
        while a < b and text[a] in around:
            a += 1
        while b > a and text[b - 1] in around:
            b -= 1
        if a < b:
            trimmed.append((a, b, k))
    return trimmed


def plausible(kind: int, text: str) -> bool:
    """Whether a span of the field can be of its kind: what a pattern's own test refuses is refused here too."""
    digits = _NOT_DIGIT.sub("", text)
    if kind in (2, 3) and any(c.isalpha() for c in text):
        return False
    if kind == 0:
        return "@" in text
    if kind == 1:
        return text.count(".") == 3 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in text.split("."))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != 3 or 7 <= len(digits) <= 15


class Finder:
    """All spans of texts: (start, end, kind number, whether a pattern's)."""

    def __init__(self, field: Field):
        self.tagger = Tagger(field)

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, bool]]]:
        texts = [t or "" for t in texts]
        out = []
        for text, (numbers, labels) in zip(texts, self.tagger.labels([t.split() for t in texts]), strict=True):
            base = base_spans(text)
            spans = [(*s, True) for s in base]
            if len(numbers):
                reach, taken = 0, []
                for a, b, _ in base:
                    taken.append((a, b))
                for a, b, k in field_spans(text, numbers, labels):
                    if not plausible(k, text[a:b]):
                        continue
                    while reach < len(taken) and taken[reach][1] <= a:
                        reach += 1
                    if not any(x < b and a < y for x, y in taken[max(0, reach - 8) : reach + 64]):
                        spans.append((a, b, k, False))
                spans.sort(key=lambda s: (s[0], s[2], s[1]))
            out.append(spans)
        return out


def detect(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, spans (array of kind, start, end, base; characters are code points)."""
    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(field or train(labelled_rows()))

    def run(batches):
        finder = Finder(shared.value)
        for ids, texts in batches:
            yield ids, [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, b, k, base in spans] for spans in finder.find(texts)]

    out = [("doc_id", kind), ("spans", "array<struct<kind:string,start:int,end:int,base:boolean>>")]
    return map_rows(docs, [(id_col, kind.simpleString()), (text_col, "string")], out, run)


def report(found: DataFrame) -> DataFrame:
    """Counts of pattern spans by kind, their digest, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == F.lit(k)))).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind, as ``[EMAIL]``; n_chars follows. Other rows stay as they are."""
    names = docs.columns
    where, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    shared = docs.sparkSession.sparkContext.broadcast(field or train(labelled_rows()))

    def run(batches):
        finder = Finder(shared.value)
        for cols in batches:
            cols = list(cols)
            texts, sizes = list(cols[where]), list(cols[chars]) if chars is not None else []
            for i, spans in enumerate(finder.find(texts)):
                if spans:
                    text, out, last = texts[i], [], 0
                    for a, b, k, _ in spans:
                        if b > last:
                            out += [text[last : max(a, last)], f"[{KINDS[k].upper()}]" if a >= last else ""]
                            last = b
                    texts[i] = "".join(out) + text[last:]
                    if chars is not None:
                        sizes[i] = len(texts[i])
            cols[where] = texts
            if chars is not None:
                cols[chars] = sizes
            yield tuple(cols)

    fields = [(f.name, f.dataType) for f in docs.schema]
    return map_rows(docs, [(n, t.simpleString()) for n, t in fields], fields, run)
