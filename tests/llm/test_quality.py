import random

import numpy as np
from pyspark.sql import functions as F

from hopframe.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeionrst") for _ in range(r.randint(2, 8)))
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        ws = [word() for _ in range(r.randint(20, 200))]
        text = " ".join(ws) + "." if good else r.choice([" ".join(w.upper() + "!!" for w in ws), " ".join(w + r.choice(["%%%", "***"]) for w in ws), " ".join([ws[0]] * 50)])
        docs.append((i, text, r.choice(["en", "de"]), r.choice(["a", "b"]) if good else r.choice(["b", "c"]), len(text), "clash"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(500, 1)
    docs += [(9000, None, None, None, None, None), (None, "", "en", "a", 0, "x")]
    d = spark.createDataFrame(docs, DOCS)
    some = spark.createDataFrame([*labels[:250], (None, 1, 0), (3, None, 0), (77_777, 0, 0)], "doc_id long, quality int, toxic int")
    m = quality.fit(d, some)
    assert m.trust[0] > m.trust[1] > 0 and sum(m.taught) > 0
    got = {r.doc_id: r.score for r in quality.score(d, m).collect()}
    assert len(got) == 502 and all(0 <= s <= 1 for s in got.values())
    right = np.mean([(got[i] >= 0.5) == bool(q) for i, q, _ in labels[250:]])
    assert right > 0.95
    kept = quality.keep_good(d, m)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}


def test_without_labels_or_rows(spark):
    docs, labels = corpus(20, 2)
    d = spark.createDataFrame(docs, DOCS)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in quality.score(d, quality.fit(d, empty)).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score > 0.99 for r in quality.score(d, quality.fit(d, one)).collect()} == {True}
    assert quality.score(d.limit(0), quality.fit(d.limit(0), empty)).count() == 0


def test_the_bound_on_labelled_rows_leaves_the_base_rate(spark):
    """A cut at 0.5 means the same whether the bound on rows of a class binds or not."""
    r = random.Random(6)
    docs, labels = [], []
    for i in range(2400):
        good = r.random() < 0.85
        loud = r.random() < (0.35 if good else 0.65)  # the classes overlap
        text = " ".join(("WORD" if loud else "word") + r.choice("abc") for _ in range(r.randint(20, 60)))
        docs.append((i, text, "en", "a", len(text), "x"))
        labels.append((i, int(good)))
    d, some = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    share = np.mean([q for _, q in labels])
    means = []
    for most_rows in (200, 100_000):
        m = quality.fit(d, some, most_rows=most_rows)
        s = m.scores([x[1] for x in docs], [(x[3], x[2]) for x in docs])
        means.append(s.mean())
        assert abs(m.prior - np.log(share / (1 - share))) < 1e-6
        assert (s >= 0.5).all()  # either form is mostly good
    assert abs(means[0] - share) < 0.06 and abs(means[1] - share) < 0.06


def test_all_unlabelled_rows_are_offered(spark):
    """A rare source whose rows come last by hash of id, after 2,100 others, is pseudo-labelled too."""
    docs, labels = corpus(250, 3)
    order = [r.id for r in spark.range(1000, 3120).selectExpr("id").orderBy(F.xxhash64(F.lit(2), "id"), "id").collect()]
    r = random.Random(4)
    for n, i in enumerate(order):
        words = [r.choice(["stone", "river", "an", "other", "house"]) for _ in range(r.randint(20, 80))]
        text = " ".join(words) + "." if n < 2100 else " ".join(w.upper() + "!!" for w in words)
        docs.append((i, text, "en", "a" if n < 2100 else "rare", len(text), "x"))
    m = quality.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    at = quality.metadata(("rare", "en"))[0]
    assert at not in {x for d in docs if d[3] != "rare" for x in quality.metadata((d[3], d[2]))}
    assert m.meta[at] < 0


def auc(scores, y):
    pos, neg = [s for s, t in zip(scores, y, strict=True) if t], [s for s, t in zip(scores, y, strict=True) if not t]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_exchange_helps_the_view_that_knows_less(spark):
    """40 labelled rows; the metadata view learns of sources it has seen no label of. Held-out AUC before and after."""
    r = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        good = r.random() < 0.6
        source = f"good{r.randrange(40)}" if good else f"bad{r.randrange(40)}"
        text = " ".join(r.choice(["stone", "river", "house", "an"]) for _ in range(r.randint(20, 60))) + "."
        docs.append((i, text if good else text.upper() + "!!", "en", source, 1, "x"))
        labels.append((i, int(good)))
    d, some = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:40], "doc_id long, quality int")
    y, found = [q for _, q in labels[40:]], []
    for rounds in (0, 4):
        m = quality.fit(d, some, rounds=rounds)
        metas = [quality.metadata((x[3], x[2])) for x in docs[40:]]
        found.append(auc([m.meta[a].sum() + m.meta[-1] for a in metas], y))
        assert auc(m.scores([x[1] for x in docs[40:]], [(x[3], x[2]) for x in docs[40:]]), y) > 0.99
    assert found[1] > found[0] + 0.1


def test_scores_and_rows_handed_over_equal_plain_loops(spark):
    docs, labels = corpus(160, 9)
    docs += [docs[120], docs[121], (None, None, None, None, None, None), (9001, "", "", "", 0, "x"), (9002, "Ä x! " * 20_000, "en", "a", 1, "x")]
    d = spark.createDataFrame(docs, DOCS)
    m = quality.fit(d, spark.createDataFrame(labels[:80], "doc_id long, quality int, toxic int"))
    got = sorted((r.doc_id or -1, r.score) for r in quality.score(d, m).collect())
    want = []
    for i, text, lang, source, *_ in docs:
        x = [(a - b) / c for a, b, c in zip(quality.form(text), m.mean, m.spread, strict=True)]
        leads = sum(a * b for a, b in zip(x, m.text, strict=True)), sum(m.meta[j] for j in quality.metadata((source, lang))) + m.meta[-1]
        odds = m.prior + sum(t * (a * z + b - m.prior) for t, (a, b), z in zip(m.trust, m.curves, leads, strict=True))
        want.append((i or -1, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))))
    assert len(got) == len(docs) and all(a == c and abs(b - e) < 1e-9 for (a, b), (c, e) in zip(got, sorted(want), strict=True))
    known = spark.createDataFrame([(i,) for i, *_ in docs[:100]], "_id long")
    pool = quality.unlabelled(d, known)
    rows = {r["_key"]: (bytes(r.x), bytes(r.m)) for r in pool.collect()}
    assert pool.count() == len(rows) + 2
    views = quality.Views([m.text, m.meta], m.mean, m.spread)
    lead = {k: [float(z[0]) for z in views.leads(np.frombuffer(x)[None], [np.frombuffer(b, "<u2").tolist()])] for k, (x, b) in rows.items()}
    taken = [set(list(rows)[:5]), set()]
    told = quality.told_by(pool, views, taken, [4, 9])
    for v in (0, 1):
        left = [k for k in rows if k not in taken[v]]
        sure = sorted(left, key=lambda k: (-lead[k][v], k))[:9]
        assert [k for k, *_ in told[v, 1]] == sure
        assert [k for k, *_ in told[v, 0]] == [k for k in sorted(left, key=lambda k: (lead[k][v], k))[:4] if k not in sure]


def test_measures_of_form_are_what_they_say():
    f = quality.form("AB cd!! - 12\ncd cd\n")
    assert f[4] == 2 / 19 and f[15] > 0 and quality.form(None) == quality.form("")
    assert f[17] == 1 / 6 and f[18] == 1 / 6 and f[12] == 1 / 6 and f[9] == 5 / 6
