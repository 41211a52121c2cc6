"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, with its boundaries, hashed into a
table, so a misspelling that was never seen shares most of its vectors with what was. Every run
of ``RUN`` successive words is averaged and goes through one linear softmax over the two classes;
a document is what its most toxic run says, so a few words count in a text of any length, and
where in the text they stand does not matter. The n-gram table and the
softmax are trained together, with the document's label alone; runs weigh equally at first and
the leading one more and more.

The model is linear over n-grams once trained, so the table shrinks to one number an n-gram,
and the scorer keeps each word's number in a cache.

Fitting uses at most ``most_rows`` labelled rows of each class, those of the smallest hashes of
their ids, and calibration weights them to the classes' shares of all labels not held out; scoring
reads every whole text of every row.

Cases: null, empty and wordless texts score the model's prior for an empty run; rows with a null
id are scored and count as held out; a repeated row is scored each time; labels that are null, or of
ids outside the table, are ignored; an id on several rows is a labelled row by each text; texts of
any length are read whole; extra columns are ignored; an empty table gives no rows; with no or one
class of labels every score is that class's share, 0.5 where there is none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import map_rows

#: Labelled rows of each class that the fit reads at most.
MOST_ROWS = 4000
#: Hashed n-grams, their lengths, and words of a run.
BUCKETS, GRAMS, RUN = 1 << 17, (3, 4, 5, 6), 4
#: Words of the documents that the fit computes together.
BLOCK_WORDS = 400_000
#: A score from which a document is predicted toxic.
THRESHOLD = 0.7

_SEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words, runs of letters and digits, in order."""
    return text.lower().encode().translate(_SEP).split() if text else []


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, and where each word's begin. Every word has at least one."""
    data = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    owner = np.repeat(np.arange(len(words)), size)
    end = (first + size)[owner]
    at = np.arange(len(data))
    own, found = [], []
    for n in GRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = (h ^ data[j : j + m]) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
        ok = at[:m] + n <= end[:m]
        found.append((((h[ok] ^ (h[ok] >> np.uint64(29))) * np.uint64(0x7FB5D329728EA185)) >> np.uint64(64 - 17)).astype(np.int64))
        own.append(owner[:m][ok])
    own, found = np.concatenate(own), np.concatenate(found)
    order = np.argsort(own, kind="stable")
    count = np.bincount(own, minlength=len(words))
    return found[order], np.concatenate(([0], np.cumsum(count)[:-1]))


def run_means(value: np.ndarray) -> np.ndarray:
    """The mean of each run of RUN successive values; of all of them where there are fewer."""
    n = min(RUN, len(value))
    total = value[: len(value) - n + 1].copy()
    for j in range(1, n):
        total += value[j : len(value) - n + 1 + j]
    return total / n


@dataclass
class Model:
    """What n-grams add to the toxic class's lead, the lead of an empty run, and calibration."""

    gram: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, lead: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * lead + self.shift, -30, 30)))


class Scorer:
    """Scores of texts, with a bounded cache of words."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most, self.cache = model, most, {}

    def leads(self, texts: list[str | None]) -> np.ndarray:
        if len(self.cache) > self.most:
            self.cache.clear()
        words = [words_of(t) for t in texts]
        new = list(set().union(*words).difference(self.cache))
        if new:
            flat, at = subwords(new)
            value = np.add.reduceat(self.model.gram[flat], at) / np.diff(np.append(at, len(flat)))
            self.cache.update(zip(new, value.tolist(), strict=True))
        out = np.full(len(texts), self.model.bias)
        get = self.cache.__getitem__
        for i, ws in enumerate(words):
            if ws:
                out[i] += run_means(np.fromiter(map(get, ws), float, len(ws))).max()
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.model.probability(self.leads(texts))


def train(
    texts: list[str], toxic: list[int], dims: int = 8, rounds: int = 80, rate: float = 0.2, seed: int = 1, share: float | None = None
) -> Model:
    """The n-gram table and the softmax, fitted together by Adagrad over all texts.

    ``share`` is the share of toxic rows among all labels, to which scores are calibrated; without it, that of the texts.
    """
    y = np.array(toxic, float)
    if not len(y) or y.min() == y.max():
        p = min(max(y.mean() if len(y) else 0.5, 1e-4), 1 - 1e-4)
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(p / (1 - p))))
    known: dict[bytes, int] = {}
    bags = [np.fromiter((known.setdefault(w, len(known)) for w in words_of(t)), np.int32) for t in texts]
    keep = np.array([i for i, b in enumerate(bags) if len(b)])
    sampled = np.ones(len(y)) if share is None else class_weights(y, share)
    y, sampled = y[keep], sampled[keep]
    bags = [bags[i] for i in keep]
    blocks, lo, held = [], 0, 0  # documents whose runs are computed together: bounded working memory
    for i, b in enumerate(bags):
        if held and held + len(b) > BLOCK_WORDS:
            blocks.append((lo, i))
            lo, held = i, 0
        held += len(b)
    blocks.append((lo, len(bags)))
    vocabulary, n_words = list(known), len(known)
    del known
    parts = []  # (first word, n-grams of some words, where each word's begin, their number)
    for lo in range(0, n_words, 20_000):
        flat, at = subwords(vocabulary[lo : lo + 20_000])
        parts.append((lo, flat.astype(np.int32), at.astype(np.int32), np.diff(np.append(at, len(flat))).astype(np.int32)))
    del vocabulary, flat

    def word_values(gram: np.ndarray) -> np.ndarray:
        return np.concatenate([np.add.reduceat(gram[f], at) / n for _, f, at, n in parts])

    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, dims)).astype(np.float32)
    soft = rng.normal(0, 0.1, (dims, 2)).astype(np.float32)
    bias = np.zeros(2)
    seen = [np.full_like(table, 1e-6), np.full_like(soft, 1e-6), np.full_like(bias, 1e-6)]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    for step in range(rounds):
        sharp = max(0.0, (step - rounds // 6) / (rounds / 6))
        w, b = soft[:, 1] - soft[:, 0], bias[1] - bias[0]
        value, by_word, slips = word_values(table @ w), np.zeros(n_words), 0.0
        for lo, hi in blocks:
            slips += _block_step(bags[lo:hi], value, b, y[lo:hi], weight[lo:hi], sharp, by_word)
        by_gram = np.zeros(BUCKETS)
        for lo, f, at, n in parts:
            by_gram += np.bincount(f, np.repeat(by_word[lo : lo + len(at)] / n, n), BUCKETS)
        by_gram = by_gram.astype(np.float32)
        d_w = table.T @ by_gram
        gradients = [np.outer(by_gram, w), np.stack([-d_w, d_w], 1), np.array([-1, 1]) * slips]
        for p, g, s in zip((table, soft, bias), gradients, seen, strict=True):
            s += g * g
            p -= rate * g / np.sqrt(s)
    w, b = soft[:, 1] - soft[:, 0], float(bias[1] - bias[0])
    model = Model((table @ w).astype(float), b, 1.0, 0.0)
    value = word_values(model.gram)
    top = np.array([run_means(value[x]).max() for x in bags]) + b
    model.scale, model.shift = calibrate(top, y, weight=sampled)
    return model


def _block_step(bags: list[np.ndarray], value: np.ndarray, bias: float, y: np.ndarray, weight: np.ndarray, sharp: float, by_word: np.ndarray) -> float:
    """Add a block's gradient by word to ``by_word``; its gradient of the bias.

    Runs of a document weigh by exp(sharp * lead); from a sharpness of 4 on the leading runs alone count.
    """
    word, size = np.concatenate(bags), np.array([len(x) for x in bags])
    n_runs = np.maximum(size - RUN + 1, 1)
    doc_at = np.concatenate(([0], np.cumsum(n_runs)[:-1]))
    doc = np.repeat(np.arange(len(bags)), n_runs)
    length = np.minimum(size, RUN)[doc]
    first = np.arange(len(doc)) - doc_at[doc] + np.concatenate(([0], np.cumsum(size)[:-1]))[doc]
    total = np.concatenate(([0.0], np.cumsum(value[word])))
    lead = (total[first + length] - total[first]) / length + bias
    top = np.maximum.reduceat(lead, doc_at)
    gap = lead - top[doc]
    share = (gap > -1e-9).astype(float) if sharp > 4 else np.exp(sharp * gap)
    share /= np.add.reduceat(share, doc_at)[doc]
    z = np.add.reduceat(share * lead, doc_at)
    slip = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
    each = share * slip[doc] / length
    edges = np.bincount(first, each, len(word) + 1) - np.bincount(first + length, each, len(word) + 1)
    by_word += np.bincount(word, np.cumsum(edges)[:-1], len(by_word))
    return float(slip.sum())


def class_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Weights under which class 1 has this share of the rows; all 1 where the rows are of one class."""
    mean = float(y.mean()) if len(y) else 0.0
    return np.where(y > 0, share / mean, (1 - share) / (1 - mean)) if 0 < mean < 1 else np.ones(len(y))


def calibrate(lead: np.ndarray, y: np.ndarray, rounds: int = 60, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through the leads, by damped Newton steps with a weak prior."""
    weight = np.ones(len(y)) if weight is None else weight
    unit = max(float(np.std(lead)), 1e-6)
    x = np.stack([lead / unit, np.ones_like(lead)], 1)
    goal = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    theta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (goal - p)) - 0.01 * theta)
        theta += step / max(1.0, float(np.abs(step).max()))
    return float(theta[0]) / unit, float(theta[1])


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, held_out=None) -> tuple[list[str], list[int], float | None]:
    """Texts and labels of at most ``most`` rows of each class, by the smallest hashes of their ids, and the share of class 1 in all of them."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    if held_out is not None:
        known = known.where(~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    share = known.agg(F.avg("_y")).first()[0]
    picked = [known.where(f"_y = {y}").orderBy(F.xxhash64(F.lit(1), "_id"), "_id").limit(most) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).join(F.broadcast(picked), "_id").select("_id", "_t", "_y").collect()
    rows = sorted({(i, t or "", y) for i, t, y in rows})
    return [t for _, t, _ in rows], [y for _, _, y in rows], share


def fold(doc_id) -> F.Column:
    """Whether a document is held out: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, score, predicted."""
    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for ids, texts in batches:
            s = scorer.scores(texts)
            yield ids, s.tolist(), (s >= threshold).astype(int).tolist()

    return map_rows(docs, [(id_col, kind.simpleString()), (text_col, "string")], [("doc_id", kind), ("score", "double"), ("predicted", "int")], run)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """A model of ``labels.toxic`` that has seen no held-out row."""
    texts, toxic, share = labelled(docs, labels, "toxic", most_rows, fold)
    return train(texts, toxic, share=share)


def score_all(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels, most_rows)).select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score", "predicted")
