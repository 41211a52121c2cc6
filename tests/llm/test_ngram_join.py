import random
import re

import pytest

from hopframe.llm import common
from hopframe.llm import components as components_of
from hopframe.llm import ngram_join
from hopframe.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, tokens string"


def shingles(text, k=5):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(docs):
    ids = sorted({d[0] for d in docs})
    sets = {d[0]: shingles(d[1]) for d in docs}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "w" + str(int(r.paretovariate(0.4)) % 3000)
    docs, base = [], [[word() for _ in range(r.choice((1, 4, 5, 6, 12, 40, 90)))] for _ in range(25)]
    passage = [word() for _ in range(30)]
    for i in range(220):
        ws = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 1, 2, 3, 5))):
            ws[r.randrange(len(ws))] = word()
        if r.random() < 0.2:
            ws += passage
        docs.append((i * 3 + 1, " ".join(w.upper() if r.random() < 0.3 else w for w in ws), "t"))
    # a chain: each links with its neighbours alone
    chain = [f"c{i}" for i in range(160)]
    docs += [(5000 + i, " ".join(chain[4 * i : 4 * i + 64]), "c") for i in range(20)]
    r.shuffle(docs)
    return docs


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_TOKENS", 300)
    monkeypatch.setattr(ngram_join, "RUN_TOKENS", 2000)
    monkeypatch.setattr(ngram_join, "TOKEN_ENTRIES", 3)
    docs = [*corpus(1), (9001, None, None), (9002, "", None), (9003, " \t\n", None), (9004, "Ä b", None), (9005, "ä b", None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == brute(docs)


def test_links_missed_by_the_groups_are_found(spark, monkeypatch):
    """With no groups at all, the matrix alone gives the same components."""
    docs = corpus(3)
    monkeypatch.setattr(ngram_join, "AGREE", 4000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == brute(docs)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = [(4, "a b c d e f", "x"), (4, "a b c d e f", "x"), (3, "A b c d e f", "y"), (None, "a b c d e f", "z"), (None, None, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(docs, DOCS)).collect())
    assert got == [(0, 0, None), (0, 2, None), (3, 2, 3), (4, 2, 3), (4, 2, 3)]
    assert ngram_join.join(spark.createDataFrame([], DOCS)).count() == 0
    kept = ngram_join.one_of_each(spark.createDataFrame([*docs, (2, "z y x w v", "q"), (2, "z y x w v", "q")], DOCS)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, "a b c d e f"), (2, "z y x w v"), (3, "A b c d e f")]


def test_rows_of_one_id_with_different_texts(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    near = text("n") + " more"
    docs = [(5, text("a"), "x"), (5, text("b"), "x"), (3, text("a").upper(), "y"), (7, text("b") + " more", "z"), (8, text("c"), "x"), (8, near, "x"), (8, text("c").upper(), "x"), (9, text("n"), "w"), (8, near, "x")]
    kept = ngram_join.one_of_each(spark.createDataFrame(docs, DOCS)).collect()
    got = sorted((r.doc_id, r.text.lower(), r.tokens) for r in kept)
    assert got == [(3, text("a"), "y"), (5, text("b"), "x"), (8, text("c"), "x"), (8, near, "x")]


def near_groups(n):
    """Two groups of n near copies; their bases are three words of 100 apart."""
    r = random.Random(n)
    base = [f"w{i}" for i in range(100)]
    other = list(base)
    for i in (20, 50, 80):
        other[i] = f"other{i}"
    docs = [(0, " ".join(base), "x"), (n, " ".join(other), "x")]
    for g, words in enumerate((base, other)):
        for i in range(1, n):
            ws = list(words)
            ws[r.choice((0, 1, 2, 97, 98, 99))] = f"{g}-{i}"
            docs.append((g * n + i, " ".join(ws), "x"))
    return docs


def test_work_grows_with_the_groups_not_with_their_pairs(spark, monkeypatch):
    """All pairs would grow four times from 120 to 240 members; met classes and led classes grow about twice."""
    monkeypatch.setattr(ngram_join, "PART_TOKENS", 2000)
    seen = []
    led, opened = ngram_join.led, ngram_join.opened
    monkeypatch.setattr(ngram_join, "led", lambda df, p: seen.append(df.count()) or led(df, p))
    monkeypatch.setattr(ngram_join, "opened", lambda df, p: seen.append(df.where("meets = 1").select("d1").distinct().count()) or opened(df, p))
    total = {}
    for n in (120, 240):
        seen.clear()
        docs = near_groups(n)
        got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(docs, DOCS)).collect()}
        assert got == {i: c for i, (_, c) in brute(docs).items()}
        total[n] = sum(seen)
    assert total[120] <= 6 * 240 and total[240] <= 2.5 * total[120]


def test_string_ids_clashing_names_long_texts_and_reused_ids(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [("b", "one two three four five six", 1, 1), ("a", "One two three four five six", 1, 1), ("c", "q w e r t y", 1, 1), ("c", long, 1, 1), ("d", long + " end", 1, 1), (None, "q w e r t y", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _gone int, `a``b` int")
    got = sorted((r.doc_id or "", r.n_shingles, r.component_id) for r in ngram_join.join(df).collect())
    assert got == [("", 2, None), ("a", 2, "a"), ("b", 2, "a"), ("c", 2, "c"), ("c", 59_996, "c"), ("d", 59_997, "c")]
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or "", len(r.text)) for r in kept.collect()) == [("", 11), ("a", 27), ("c", 11), ("c", len(long))]
    unique = ngram_join.one_of_each(spark.createDataFrame(rows[:3], df.schema))
    assert unique.columns == df.columns and {r.doc_id for r in unique.collect()} == {"a", "c"}


def test_nothing_is_left_behind(spark, tmp_path, monkeypatch):
    names = iter(range(1000))
    monkeypatch.setattr(common, "shared_dir", lambda _: f"{tmp_path}/{next(names)}")
    ngram_join.join(spark.createDataFrame(corpus(4)[:40], DOCS))
    assert len(list(tmp_path.iterdir())) == 1  # the result
    with pytest.raises(Exception):
        ngram_join.join(spark.range(5).selectExpr("id as doc_id", "cast(raise_error('no') as string) as text"))
    assert len(list(tmp_path.iterdir())) == 1


def test_components_in_few_turns_in_any_order(spark, monkeypatch):
    turns = []
    turn = components_of.turn
    monkeypatch.setattr(components_of, "turn", lambda e: turns.append(1) or turn(e))
    ids = list(range(400))
    random.Random(1).shuffle(ids)
    links = [(ids[i], ids[i + 1]) for i in range(399)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == dict.fromkeys(range(400), 0) and len(turns) <= 10


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}}
