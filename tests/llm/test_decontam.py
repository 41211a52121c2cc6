import hashlib
import random
import re

from hopframe.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, spans string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    windows = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - k + 1) if ws else 0):
            windows.setdefault(tuple(ws[i : i + k]), set()).add(str(item))
    out = {}
    for doc, text, *_ in docs:
        ws, hit, found = words(text), set(), set()
        for w, who in windows.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found |= who
        out[doc] = (len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def check(spark, docs, items, **more):
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in decontam.report(decontam.matches(d, b, **more)).collect()}
    assert got == brute(docs, items)


def test_random_words_over_a_small_alphabet(spark):
    r = random.Random(1)
    text = lambda n, k: " ".join(r.choice("abc"[:k]) for _ in range(n))
    items = [(i, text(r.randint(0, 18), 2)) for i in range(25)] + [(7, "A b"), (99, None), (98, " ,, ")]
    docs = [(i, text(r.randint(0, 80), r.choice((2, 3))), "x") for i in range(60)] + [(1000, None, None), (1001, "", "y")]
    check(spark, docs, items)
    check(spark, docs, items, shard_bytes=60)
    check(spark, docs, items, shard_bytes=60, round_bytes=300)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b")])
    check(spark, [(1, "a b c", None)], [])


def test_spans_go_and_clean_documents_stay(spark):
    item = "one two three four five six seven eight nine ten eleven"
    own = " ".join(f"w{i}" for i in range(30))
    docs = [(1, f"Intro {own}, {item.upper()}! end", "s"), (2, own, "t"), (3, item, "u"), (4, None, "v")]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(5, item)], "item_id long, text string")
    other = spark.createDataFrame([(5, item), (6, "nothing of this is there"), (None, own)], "item_id long, text string")
    rounds = {r.doc_id: r for r in decontam.decontaminate(d, other, round_bytes=70).collect()}
    got = {r.doc_id: r for r in decontam.decontaminate(d, b).collect()}
    assert rounds == got
    assert set(got) == {1, 2, 4} and got[1].text == f"Intro {own}, ! end" and got[2].text == own and got[4].text is None
    assert got[1].spans == "s"


def test_the_automaton_is_small_and_long_texts_and_odd_names_are_fine(spark):
    r = random.Random(7)
    zipf = [f"word{int(r.paretovariate(0.7)) % 20_000}" for _ in range(60_000)]
    items = [(str(i), [w.encode() for w in zipf[i * 60 : i * 60 + 60]]) for i in range(1000)]
    text = sum(len(w) + 1 for _, ws in items for w in ws)
    a = decontam.SuffixAutomaton(items, 10)
    assert a.bytes() < 12 * text
    for i in (0, 17, 999):
        spans, found = a.spans([b"x", *items[i][1][5:30], b"y"])
        assert str(i) in found and spans == [[1, 25]]
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(400)) for _ in range(100_000))
    cut = long.split()[50_000:50_012]
    docs = [(1, long, 1, "s"), (2, "clean words only", 2, "s"), (2, "clean words only", 2, "s")]
    d = spark.createDataFrame(docs, "doc_id long, text string, _spans int, `a``b` string")
    b = spark.createDataFrame([(5, " ".join(cut)), (6, "q " * 30)], "item_id long, text string")
    for more in ({}, {"round_bytes": 60}):
        rows = sorted(decontam.decontaminate(d, b, **more).collect())
        assert [x[0] for x in rows] == [1, 2, 2] and rows[1][1] == "clean words only"
        assert rows[0].text.split() == long.split()[:50_000] + long.split()[50_012:]
    (one,) = decontam.report(decontam.matches(d.where("doc_id = 1"), b)).collect()
    assert (one.n_words, one.n_hit, one.n_items) == (100_000, 12, 1)
