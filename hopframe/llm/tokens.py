"""Token ids of whole texts, with a cache of space-led pieces where the file allows it.

Ids are those of the ``tokenizers`` file. A file whose definition is plainly byte-level (see
``PLAIN``) never joins what stands before a single space with what follows it, so texts are cut
there and each distinct piece is encoded once; where its merges also stand in the order of
their ids, the ids of a piece follow from its vocabulary alone, and ``tiktoken`` computes them
from that vocabulary some three times faster. With any other file, and for texts that cannot be
cut at their spaces, ``tokenizers`` itself encodes whole texts, without truncation or padding.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: What a file says besides vocabulary, merges and added tokens where texts may be cut at their spaces.
PLAIN = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}

#: A space before other white space, or at the end, is no safe place to cut a text.
_UNSAFE = re.compile(r" (?:\s|\Z)")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1
    characters for themselves, the other bytes in order for the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def is_plain(told: dict) -> bool:
    """Whether a tokenizer file is byte-level and nothing in it looks beyond a space-led piece."""
    model = {k: v for k, v in told["model"].items() if k not in ("vocab", "merges")}
    added = told.get("added_tokens") or []
    return (
        all(told.get(k) == v for k, v in PLAIN.items())
        and PLAIN_MODEL | model == PLAIN_MODEL
        and told["model"].get("merges") is not None
        and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added)
    )


def _joined(text: str, pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(b) // 4 for _, b in pieces], np.int64)
    chars = np.array([c for c, _ in pieces], np.int64)
    told = np.frombuffer(b"".join(b for _, b in pieces), "<u4").astype(np.int64)
    begin = (told >> 1) + np.repeat(np.cumsum(chars) - chars, n)
    return begin, np.append(begin + (told & 1), len(text))[1:] if len(begin) else begin


class PieceEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Where the file is plain, a text is the sequence of its space-led pieces, and each distinct
    piece is encoded once while it stays in a cache of about ``most`` pieces. With ``spans``, a
    token is given, instead of by its id, by twice the index of its first character, plus 1 if
    the token before it has bytes of that character too.
    """

    def __init__(self, path: str, most: int = 200_000, spans: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.spans = Tokenizer.from_file(path), most, spans
        self.cache, self.first, self.core = {}, {}, None
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special, self.plain = [x["content"] for x in told.get("added_tokens") or []], is_plain(told)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if not self.plain:
            return
        model = told["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        letters = _byte_of_letter()
        if len(model["vocab"]) >= 256 + len(merges) and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
            import public_tokenizers
            import tiktoken

            ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in self.special}
            self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.size = np.zeros(len(model["vocab"]), np.int64)
            for word, i in ranks.items():
                self.size[i] = len(word)

    def _value(self, e) -> bytes:
        if not self.spans:
            return np.array(e.ids, dtype="<u4").tobytes()
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        inside = np.append(0, at[:-1, 1])[: len(at)] > at[:, 0]
        return (2 * at[:, 0] + inside).astype("<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Cache what a space and each of these words give."""
        pieces = [" " + w for w in words]
        if self.core is None:
            self.cache.update(zip(words, map(self._value, self.tokenizer.encode_batch(pieces, add_special_tokens=False)), strict=True))
            return
        ids = self.core.encode_to_numpy("".join(pieces)).astype("<u4")
        raw = [p.encode() for p in pieces]
        last = np.cumsum([len(r) for r in raw])
        to = np.cumsum(self.size[ids])
        cut = np.searchsorted(to, last) + 1
        if self.spans:
            starts = (np.frombuffer(b"".join(raw), np.uint8) & 0xC0) != 0x80  # bytes that begin a character
            lead, first = np.cumsum(starts) - 1, to - self.size[ids]
            begin = np.concatenate(([0], cut[:-1]))
            at = lead[first]
            ids = (2 * (at - np.repeat(at[begin], cut - begin)) + ~starts[first]).astype("<u4")
        flat, at = ids.tobytes(), 0
        for w, n in zip(words, (4 * cut).tolist(), strict=True):
            self.cache[w] = flat[at:n]
            at = n

    def _whole(self, text: str) -> bytes:
        if self.core is None or self.spans or any(x in text for x in self.special):
            return self._value(self.tokenizer.encode(text, add_special_tokens=False))
        return self.core.encode_to_numpy(text).astype("<u4").tobytes()

    def _start(self, text: str) -> bytes:
        """What stands before the first space."""
        got = self.first.get(text)
        if got is None:
            got = self.first[text] = self._whole(text) if text else b""
        return got

    def offsets(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its tokens' first characters and ends."""
        if not self.plain:
            got = (np.array(e.offsets, np.int64).reshape(-1, 2) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False))
            return [(x[:, 0], x[:, 1]) for x in got]
        return [_joined(t, p) for t, p in zip(texts, self.encode(texts), strict=True)]

    def encode(self, texts: list[str | None]) -> list:
        """For each text its ids as little-endian bytes (null: none) or, with spans, pairs of a piece's characters and its tokens."""
        if not self.plain:
            got = [self._value(e) for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            return [[(len(t or ""), x)] for t, x in zip(texts, got, strict=True)] if self.spans else got
        if len(self.cache) > self.most:
            self.cache.clear()
        if len(self.first) > self.most:
            self.first.clear()
        cut = [None if not t or _UNSAFE.search(t) or any(x in t for x in self.special) else t.split(" ") for t in texts]
        new = set().union(*(c[1:] for c in cut if c)).difference(self.cache)
        if new:
            self._learn(list(new))
        get, out = self.cache.__getitem__, []
        for text, words in zip(texts, cut, strict=True):
            if not text:
                out.append([] if self.spans else b"")
            elif words is None:
                out.append([(len(text), self._whole(text))] if self.spans else self._whole(text))
            else:
                start = self._start(words[0])
                if self.spans:
                    out.append([(len(words[0]), start), *((len(w) + 1, get(w)) for w in words[1:])])
                else:
                    out.append(start + b"".join(map(get, words[1:])))
        return out
