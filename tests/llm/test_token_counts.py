import random

import numpy as np
import pytest

from hopframe.llm import token_counts
from hopframe.llm.tokens import vocabulary


def brute(text, sections, rule):
    from tokenizers import Tokenizer

    out = [0.0] * (len(sections) + 1)
    offsets = Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).offsets
    for a, b in offsets:
        parts = [max(0, min(b, hi) - max(a, lo)) for lo, hi in sections]
        if rule == "start":
            out[next((i for i, (lo, hi) in enumerate(sections) if lo <= a < hi), -1)] += 1
        elif rule == "most":
            out[parts.index(max(parts)) if any(parts) else -1] += 1
        else:
            for i, p in enumerate(parts):
                out[i] += p / (b - a)
            out[-1] += 1 - sum(parts) / (b - a)
    return out, len(offsets)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts_equal_brute_force(spark, rule):
    r = random.Random(6)
    docs = [(i, "".join(r.choice(["the ", "Haus", "\n", "\n\n", " ", "words,", "漢字", "é", "x\ny"]) for _ in range(r.randint(0, 30))), "c") for i in range(60)]
    docs += [(100, None, "c"), (101, "", "c"), (102, "\n\n", "c"), (None, "a b\nc", "c"), (103, "long word " * 20_000, "c")]
    got = {}
    for x in token_counts.attribute(spark.createDataFrame(docs, "doc_id long, text string, tokens string"), rule).collect():
        got.setdefault(x.doc_id, {})[x.section] = (x.start, x.end, x.tokens, x.doc_tokens)
    for i, text, _ in docs:
        if not text:
            assert i not in got
            continue
        spans = token_counts.lines(text)
        want, n = brute(text, spans, rule)
        rows = got[i]
        assert [rows[j][:2] for j in range(len(spans))] == spans and {x[3] for x in rows.values()} == {n}
        assert np.allclose([rows[j][2] for j in range(len(spans))] + [rows.get(-1, (0, 0, 0.0))[2]], want)
        assert abs(sum(x[2] for x in rows.values()) - n) < 1e-6


def test_empty_table(spark):
    assert token_counts.attribute(spark.createDataFrame([], "doc_id long, text string")).count() == 0
