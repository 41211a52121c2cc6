import hashlib
import itertools
import random
import re

import numpy as np

from hopframe.llm import pii

FIELD = pii.train(pii.labelled_rows())
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]
            if ok:
                out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_patterns_equal_plain_regular_expressions():
    r = random.Random(8)
    for _ in range(6000):
        text = "".join(r.choice(["a", "B", ".", "@", "1", "2", "0", "-", " ", "+", "(", ")", "%", "é", "\n", "25", "1.2.3.4", "4111 1111 1111 1111", "x@y.z"]) for _ in range(r.randint(0, 24)))
        assert pii.base_spans(text) == plain(text), repr(text)
    for long in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 150_000, "a.b@c" * 60_000):
        pii.base_spans(long)


def test_field_learns_its_table_and_finds_new_secrets():
    t = pii.Tagger(FIELD)
    rows = pii.labelled_rows()
    got = t.labels([w for w, _ in rows])
    wrong = sum(dict(zip(n.tolist(), k.tolist())).get(i, 0) != tag for (w, tags), (n, k) in zip(rows, got, strict=True) for i, tag in enumerate(tags))
    assert wrong <= 2
    new = 'so ist token = "8a1f0c3e5b7d9f2a4c6e8b0d1f3a5c7e9b2d4f6a" und weiter'
    (span,) = pii.Finder(FIELD).find([new])[0]
    assert new[span[0] : span[1]] == "8a1f0c3e5b7d9f2a4c6e8b0d1f3a5c7e9b2d4f6a" and pii.KINDS[span[2]] == "secret"
    assert pii.Finder(FIELD).find(["The key to it was a token of love, and the secret is out", "", None]) == [[], [], []]
    assert pii.Finder(FIELD).find(["the number 4012888888881882 fails its test , 300.1.1.1 too"]) == [[]]


def test_all_of_a_long_word_counts():
    h = "8a1f0c3e5b7d9f2a4c6e8b0d1f3a5c7e9b2d4f6a" * 5
    assert {"mixed", "hex"} <= set(pii.features(h + h)) and not {"mixed", "hex"} & set(pii.features(h + "-stone,river"))
    assert "at" in pii.features("x" * 200 + "@mail") and "dots" in pii.features("1" * 200 + ".2.3.4") and "w:4" in pii.features("x" * 250 + "1" * 200)
    find = lambda w: [(a, b, pii.KINDS[k]) for a, b, k, _ in pii.Finder(FIELD).find([f'so ist token = "{w}" und weiter'])[0]]
    assert find(h + h) == [(16, 416, "secret")] and find(h + "zz/zz!x") == []


def test_cut_chains_give_the_best_path():
    r, k = np.random.default_rng(2), len(pii.LABELS)
    f = pii.Field({}, np.zeros((3, 0, k)), r.normal(0, 1, (k, k)))
    t = pii.Tagger(f)
    words = [f"w{i}" for i in range(30)]
    for i, w in enumerate(words):
        row = r.normal(0, 2, (3, k))
        row[0, 0] += 12 * (i % 3 == 0)
        t.words[w] = len(t.rows)
        t.rows.append(row)
    t.table = np.stack(t.rows)
    rnd = random.Random(1)
    texts = [[rnd.choice(words) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 5, 5)]
    for text, (numbers, labels) in zip(texts, t.labels(texts), strict=True):
        ids = [0, *(t.words[w] for w in text), 0]
        e = [t.table[ids[i], 0] + t.table[ids[i - 1], 1] + t.table[ids[i + 1], 2] for i in range(1, len(text) + 1)]
        score = lambda p: sum(e[i][x] for i, x in enumerate(p)) + sum(f.moves[a, b] for a, b in itertools.pairwise((0, *p, 0)))  # noqa: E731, B023
        best = max(itertools.product(range(k), repeat=len(text)), key=score)
        mine = np.zeros(len(text), int)
        mine[numbers] = labels
        assert tuple(mine) == best


def test_documents(spark):
    docs = [(1, "mail é a.b@c.de and 10.0.0.1 x", "s"), (2, None, None), (3, "", "s"), (None, "+1 (303) 555-0199", "s"), (1, "mail é a.b@c.de and 10.0.0.1 x", "s"), (5, "word " * 50_000, "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, spans string")
    rows = pii.report(pii.detect(df, FIELD)).collect()
    assert len(rows) == 6
    one = next(r for r in rows if r.doc_id == 1)
    text = "email:7:15,ip:20:28"
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone, one.spans) == (1, 1, 0, 0, text)
    assert one.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert next(r for r in rows if r.doc_id == 2).base_sha256 == hashlib.sha256(b"").hexdigest()
    out = {r.doc_id: r for r in pii.redact(df, FIELD).collect()}
    assert out[1].text == "mail é [EMAIL] and [IP] x" and out[None].text == "[PHONE]" and out[2].text is None and out[5].text == "word " * 50_000
    assert pii.detect(df.limit(0), FIELD).count() == 0


def test_the_labelled_table_is_not_taken_from_documents_and_unseen_secrets_are_found():
    """Quoted secrets of the test documents, none of which the field has seen."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    shown = [w for m in re.findall(r"\[\w+ ([^\]]*)\]", pii.LABELLED) for w in m.split() if len(w) > 12]
    whole = "\n".join(t for t in texts if t)
    assert len(shown) > 15 and not any(w.strip('"') in whole for w in shown)
    found = wanted = 0
    for t, spans in zip(texts, pii.Finder(FIELD).find(texts), strict=True):
        got = {(a, b) for a, b, k, _ in spans if pii.KINDS[k] == "secret"}
        asked = {m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")}
        found, wanted = found + len(got & asked), wanted + len(asked)
    assert wanted > 10 and found / wanted > 0.95


def test_spans_of_the_field_are_those_of_a_plain_search():
    """The whole way from text to spans, with features, emissions and the best path computed plainly."""
    r = random.Random(4)
    words = ["the", "token", "=", '"8a1f0c3e5b7d9f2a4c6e8b0d1f3a5c7e9b2d4f6a"', "call", "(415)", "555-0132", "x@y", "1234", "Mr.", "api_key", "aB3dE5fG7hJ9kL1mN3pQ"]
    e = lambda a, w: FIELD.weights[a][[FIELD.index[f] for f in pii.features(w) if f in FIELD.index]].sum(0)
    for _ in range(150):
        ws = [r.choice(words) for _ in range(r.randint(1, 5))]
        score = [e(0, w) + (e(1, ws[i - 1]) if i else 0) + (e(2, ws[i + 1]) if i + 1 < len(ws) else 0) for i, w in enumerate(ws)]
        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(ws)), key=lambda p: sum(s[x] for s, x in zip(score, p, strict=True)) + sum(FIELD.moves[a, b] for a, b in itertools.pairwise((0, *p, 0))))  # noqa: B023
        ((numbers, labels),) = pii.Tagger(FIELD).labels([ws])
        assert dict(zip(numbers.tolist(), labels.tolist(), strict=True)) == {i: k for i, k in enumerate(best) if k}
