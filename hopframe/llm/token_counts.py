"""Token counts by offset-mapped attribution.

A whole document is encoded once; with a plainly byte-level file that is done by its distinct
space-led pieces, with equal offsets. Its tokens' character spans are joined, as intervals, with
the spans of its fields or sections, in one pass over both sorted lists. A token that crosses a
boundary goes by an explicit rule:

- ``start``: to the section that holds its first character;
- ``most``: to the section with most of its characters, of equals the earlier one;
- ``share``: to each section in proportion to the characters it has there.

A token none of whose characters lies in a section counts for section -1. The counts of a
document's sections and of section -1 add up to its tokens.

Cases: null and empty texts have no sections and no tokens, and so no rows; a null id stays
null; repeated rows are counted each; a text of any length is encoded whole; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from hopframe.llm.common import map_rows
from hopframe.llm.tokens import PieceEncoder, vocabulary

_LINE = re.compile(r"[^\n]+")
RULES = ("start", "most", "share")


def lines(text: str) -> list[tuple[int, int]]:
    """Sections of a text: its lines that are not empty, without their ends."""
    return [m.span() for m in _LINE.finditer(text)]


def allocate(begin: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section and, last, of none. Sections are sorted and do not overlap."""
    k = len(sections)
    out = np.zeros(k + 1)
    if not k:
        out[0] = len(begin)
        return out
    lo, hi = sections[:, 0], sections[:, 1]
    first = np.searchsorted(hi, begin, "right")  # the first section that ends after the token begins
    last = np.searchsorted(lo, end, "left")  # sections from here on begin at or after the token's end
    if rule == "start":
        inside = (first < k) & (lo[np.minimum(first, k - 1)] <= begin)
        np.add.at(out, np.where(inside, first, k), 1)
        return out
    one = last - first == 1
    whole = one & (lo[np.minimum(first, k - 1)] <= begin) & (hi[np.minimum(first, k - 1)] >= end)
    np.add.at(out, first[whole], 1)
    out[k] += (last <= first).sum()
    for i in np.flatnonzero(~whole & (last > first)):
        j = np.arange(first[i], last[i])
        part = np.minimum(hi[j], end[i]) - np.maximum(lo[j], begin[i])
        if rule == "most":
            out[j[part.argmax()]] += 1
        else:
            out[j] += part / (end[i] - begin[i])
            out[k] += 1 - part.sum() / (end[i] - begin[i])
    return out


def attribute(
    docs: DataFrame,
    rule: str = "start",
    sections: Callable[[str], list[tuple[int, int]]] = lines,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row per section: doc_id, section, start, end, tokens, doc_tokens; one for section -1 where it has tokens."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    path = tokenizer or vocabulary()

    def run(batches):
        encoder = PieceEncoder(path, spans=True)
        for ids, texts in batches:
            for at in range(0, len(ids), 250):
                part = texts[at : at + 250]
                rows = []
                for doc, text, (begin, end) in zip(ids[at : at + 250], part, encoder.offsets([t or "" for t in part]), strict=True):
                    if not text:
                        continue
                    spans = sections(text)
                    got = allocate(begin, end, np.array(spans, np.int64).reshape(-1, 2), rule).tolist()
                    rows += [(doc, i, a, b, got[i], len(begin)) for i, (a, b) in enumerate(spans)]
                    if got[-1]:
                        rows.append((doc, -1, None, None, got[-1], len(begin)))
                if rows:
                    yield tuple(zip(*rows, strict=True))

    kind = docs.schema[id_col].dataType
    out = [("doc_id", kind), ("section", "int"), ("start", "long"), ("end", "long"), ("tokens", "double"), ("doc_tokens", "long")]
    return map_rows(docs, [(id_col, kind.simpleString()), (text_col, "string")], out, run)
