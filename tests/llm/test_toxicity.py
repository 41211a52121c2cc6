import math
import random
import re
import zlib

import numpy as np

from hopframe.llm import toxicity


def corpus(n):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        ws = [word() for _ in range(r.randint(10, 150))]
        bad = r.random() < 0.3
        for _ in range(3 * bad):
            ws[r.randrange(len(ws))] = r.choice(["stupid", "idiot", "worthless", "pathetic", "loser"])
        docs.append((i, " ".join(ws), "x"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_misspellings(spark):
    docs, labels = corpus(600)
    extra = [(5000, "an onan stupiid the", "x"), (5001, None, "x"), (5002, "", "x"), (None, "an on", "x"), (5003, "an the on re " * 20_000 + "worthles idiott", "x")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (4, 1, None), (77_777, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_all(d, known).collect()
    assert len(rows) == 605 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    got = {r.doc_id: r for r in rows}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert got[5000].score > got[None].score and got[5003].predicted == 1 and got[5001].score == got[5002].score


def test_one_class_no_labels_no_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score_all(d, none).collect()} == {0.5}
    assert toxicity.score_all(d.limit(0), none).count() == 0


def test_the_bound_on_rows_leaves_the_base_rate(spark):
    """A word of either class has the same score whether the bound on rows of a class binds or not."""
    r = random.Random(5)
    docs, labels = [], []
    for i in range(2400):
        bad = r.random() < 0.12
        rude = r.random() < (0.6 if bad else 0.2)  # the classes overlap: some 29% of rude texts are toxic
        docs.append((i, "the on an here" + (" idiot" if rude else "")))
        labels.append((i, int(bad)))
    d, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    means = []
    for most_rows in (150, 100_000):
        rows = toxicity.score_all(d, known, most_rows).collect()
        means.append(sum(x.score for x in rows) / len(rows))
        assert not any(x.predicted for x in rows)
    assert abs(means[0] - 0.12) < 0.04 and abs(means[1] - 0.12) < 0.04


def plain_score(model, text):
    """The score by plain loops over words, n-grams and runs."""
    lead = []
    for w in re.findall("[0-9a-z\\x80-\\U0010ffff]+", (text or "").lower()):
        raw, grams = b"<%b>" % w.encode(), []
        for n in toxicity.GRAMS:
            for i in range(len(raw) - n + 1):
                h = n
                for c in raw[i : i + n]:
                    h = ((h ^ c) * 0x100000001B3 + 0x9E3779B97F4A7C15) % 2**64
                grams.append(model.gram[((h ^ h >> 29) * 0x7FB5D329728EA185 % 2**64) >> 47])
        lead.append(sum(grams) / len(grams))
    runs = [lead[i : i + toxicity.RUN] for i in range(max(1, len(lead) - toxicity.RUN + 1))] if lead else [[0.0]]
    z = model.scale * (max(sum(r) / len(r) for r in runs) + model.bias) + model.shift
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_scores_equal_plain_loops():
    docs, labels = corpus(200)
    model = toxicity.train([t for _, t, _ in docs], [y for *_, y in labels], rounds=30)
    texts = [t for _, t, _ in docs[:40]] + ["", None, "Idiot", "IDIOT idiot the", "ÄÖ öde 漢字 x1", "the an " * 3000]
    assert np.allclose(toxicity.Scorer(model).scores(texts), [plain_score(model, t) for t in texts])


def test_the_place_of_a_passage_does_not_matter():
    docs, labels = corpus(400)
    model = toxicity.train([t for _, t, _ in docs], [y for *_, y in labels])
    calm = [t for (_, t, _), (*_, y) in zip(docs, labels, strict=True) if not y][0].split()
    texts = [" ".join([*calm[:i], "stupid", "worthless", "idiot", *calm[i:]]) for i in range(3, 11)]
    s = toxicity.Scorer(model).scores(texts)
    assert (s >= 0.7).all() and toxicity.Scorer(model).scores([" ".join(calm)])[0] < 0.5


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(3)
    bags, value = [r.integers(0, 9, n) for n in (1, 3, 4, 9, 30)], r.normal(0, 1, 9)
    y, weight = np.array([0.0, 1, 0, 1, 1]), r.random(5)

    def loss(v):
        out, sharp = 0.0, 0.0
        for b, t, w in zip(bags, y, weight, strict=True):
            means = toxicity.run_means(v[b]) + 0.1
            z = (np.exp(sharp * means) * means).sum() / np.exp(sharp * means).sum()
            out += w * (np.log1p(np.exp(z)) - t * z)
        return out

    got = np.zeros(9)
    toxicity._block_step(bags, value, 0.1, y, weight, 0.0, got)
    want = [(loss(value + 1e-6 * e) - loss(value - 1e-6 * e)) / 2e-6 for e in np.eye(9)]
    assert np.allclose(got, want, atol=1e-6)
