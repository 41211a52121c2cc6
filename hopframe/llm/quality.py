"""Quality by co-training: a text view and a metadata view teach each other.

The text view is a logistic classifier over measures of a text's form; the metadata view is one
over source and language and their pair, hashed, and sees nothing of the text. Both start from
labelled rows. In each round either view scores all unlabelled rows in Spark, and those that it is
surest of, as many of each class as the labels' shares ask for, become training rows of the other
view. A pseudo-label weighs by how well its teacher separates the classes on labelled rows that
it did not train on, so a view that knows little teaches little.
At the end each view is calibrated on one part of the labelled rows that neither trained on,
weighted to the classes' shares of all labels, and a document's score adds both views' log odds,
each weighted by how well that view did on another such part.

The fit in numpy reads at most ``most_rows`` labelled rows of each class, those of the smallest
hashes of their ids, and the pseudo-labelled rows; every document is then scored on its whole text.

Cases: null and empty texts have the form of an empty text; null metadata is a value of its own;
texts of any length are read whole; repeated rows are scored each, and handed over once; of equally
sure rows the smallest hashes go first; rows with a null id are unlabelled, and scored; null labels
and unknown ids are ignored; extra columns, whatever their names, are ignored or kept; an empty
table gives no rows; with no or one class of labels every score is that class's share, 0.5 where
there is none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import Scratch, map_rows
from hopframe.llm.toxicity import calibrate, class_weights

MOST_ROWS = 2000
#: Rounds of exchange, and pseudo-labels that a view hands over in a round.
ROUNDS, EXCHANGED = 4, 200
#: The weight of a pseudo-label whose teacher tells the classes apart perfectly.
TOLD_WEIGHT = 0.3
META_BUCKETS = 512
META = ("source", "lang")

_CLASSES = np.zeros(256, np.int64)  # 0 other bytes
for _c in range(256):
    _CLASSES[_c] = 1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if _c in b".,;:?'\"-" else 5 if 33 <= _c <= 126 else 6 if _c in b" \t" else 7 if _c in b"\r\n" else 0
_UPPER = re.compile(rb"\xc3[\x80-\x9e]")


def form(text: str | None) -> list[float]:
    """Measures of a text's form: shares of characters, of words and lines that repeat, lengths."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    data = np.frombuffer(raw, np.uint8)
    kinds = _CLASSES[data]
    by = np.bincount(kinds, minlength=8) / n
    mark, gap = (kinds == 4) | (kinds == 5), kinds >= 6
    doubled = (mark[1:] & (data[1:] == data[:-1])).sum()
    alone = (mark[1:-1] & gap[:-2] & gap[2:]).sum()
    upper = by[2] + 2 * len(_UPPER.findall(raw)) / n
    words = raw.split()
    w = max(1, len(words))
    distinct = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / w
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, len(words) - 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    return [
        1.0, by[0], by[1], upper, by[3], by[4], by[5], by[6], by[7],
        distinct / w, np.log1p(w) / 10, distinct / w * np.log1p(w) / 5, same, pairs, len(set(lines)) / k, np.log1p(k) / 5,
        min(3.0, sum(map(len, words)) / w / 10), min(2.0, doubled / w), min(2.0, alone / w), upper / max(1e-3, upper + by[1]),
        float(not words), min(2.0, np.log1p(len(raw) / k) / 6),
    ]


def metadata(values: tuple) -> list[int]:
    """Hashed features: each value, and the pair."""
    told = [f"{i}={v}" for i, v in enumerate(values)]
    told.append("&".join(told))
    return [xxhash.xxh32_intdigest(x) % META_BUCKETS for x in told]


def _dense(rows: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(rows), META_BUCKETS + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r] = 1
    return x


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-3, rounds: int = 25) -> np.ndarray:
    """Penalised logistic regression by Newton steps."""
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (weight * (p - y)) / len(y) + decay * theta
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x / len(y) + decay * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        theta -= step / max(1.0, float(np.abs(step).max()) / 5)
        if np.abs(step).max() < 1e-6:
            break
    return theta


@dataclass
class Model:
    """Both views' weights and calibrations, their weights in a score, and the centre of text measures."""

    text: np.ndarray
    meta: np.ndarray
    curves: tuple[tuple[float, float], tuple[float, float]]
    trust: tuple[float, float]
    prior: float
    mean: np.ndarray
    spread: np.ndarray
    taught: tuple[int, int] = (0, 0)

    def scores(self, texts: list[str | None], metas: list[tuple]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        x = (np.array([form(t) for t in texts]) - self.mean) / self.spread
        m = np.array([self.meta[r].sum() for r in map(metadata, metas)]) + self.meta[-1]
        (a, b), (c, d) = self.curves
        odds = self.prior + self.trust[0] * (a * (x @ self.text) + b - self.prior) + self.trust[1] * (c * m + d - self.prior)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _separation(lead: np.ndarray, y: np.ndarray) -> float:
    """2 AUC - 1, at least 0: the trust in a view."""
    order = np.argsort(lead, kind="stable")
    rank = np.empty(len(lead))
    rank[order] = np.arange(1, len(lead) + 1)
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    if not pos or not neg:
        return 0.0
    return max(0.0, 2 * (rank[y > 0].sum() - pos * (pos + 1) / 2) / (pos * neg) - 1)


@dataclass
class Views:
    """Both views in a round: weights, and the centre of text measures."""

    theta: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray

    def leads(self, forms: np.ndarray, metas: list[list[int]]) -> list[np.ndarray]:
        m = np.array([self.theta[1][r].sum() for r in metas]) + self.theta[1][-1]
        return [((forms - self.mean) / self.spread) @ self.theta[0], m]


#: (row, measures of its text, hashed metadata) of each row that a view hands over, by (view, class).
Told = dict[tuple[int, int], list[tuple[int, bytes, bytes]]]


def co_train(
    texts: list, metas: list, y: list[int], share: float, ask: Callable[[Views, list[set], list[int]], Told] | None = None, rounds: int = ROUNDS, exchanged: int = EXCHANGED
) -> Model:
    """Fit both views. ``share`` is the share of class 1 among all labels; ``ask`` as in :func:`told_by`."""
    y = np.array(y, float)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        k = len(form(""))
        return Model(np.zeros(k), np.zeros(META_BUCKETS + 1), ((0.0, 0.0), (0.0, 0.0)), (0.0, 0.0), float(np.log(p / (1 - p))), np.zeros(k), np.ones(k))
    raw = np.array([form(t) for t in texts])
    mean, spread = raw.mean(0), raw.std(0) + 1e-3
    mean[0], spread[0] = 0, 1  # the constant stays
    views = [(raw - mean) / spread, _dense([metadata(m) for m in metas])]
    place = np.arange(len(y)) % 8
    train, drawn, judged = np.flatnonzero(place % 4 > 0), np.flatnonzero(place == 0), np.flatnonzero(place == 4)
    extra: list[dict[int, tuple]] = [{}, {}]  # row: its class, weight and features in the view
    decay = (1e-3, 1e-2)
    balance = lambda v: np.where(v > 0, share / max(v.mean(), 1e-3), (1 - share) / max(1 - v.mean(), 1e-3))

    def fit(v: int) -> np.ndarray:
        tags, told, rows = zip(*extra[v].values(), strict=True) if extra[v] else ((), (), np.zeros((0, views[v].shape[1])))
        goal = np.concatenate((y[train], np.array(tags, float)))
        weight = np.concatenate((balance(y[train]), np.array(told, float)))
        return logistic(np.concatenate((views[v][train], np.array(rows))), goal, weight, decay[v])

    theta = [fit(0), fit(1)]
    for _ in range(rounds if ask else 0):
        worth = [TOLD_WEIGHT * _separation(views[v][drawn] @ theta[v], y[drawn]) for v in (0, 1)]
        got = ask(Views(theta, mean, spread), [set(extra[1]), set(extra[0])], [max(1, round(exchanged * (1 - share))), max(1, round(exchanged * share))])
        if not any(got.values()):
            break
        for (v, tag), rows in got.items():
            for key, x, m in rows:
                extra[1 - v][key] = (tag, worth[v], _dense([np.frombuffer(m, "<u2").tolist()])[0] if v == 0 else (np.frombuffer(x) - mean) / spread)
        theta = [fit(0), fit(1)]
    curves = tuple(calibrate(views[v][drawn] @ theta[v], y[drawn], weight=class_weights(y[drawn], share)) for v in (0, 1))
    trust = [_separation(views[v][judged] @ theta[v], y[judged]) for v in (0, 1)]
    total = trust[0] ** 2 + trust[1] ** 2  # a weak view counts by the square of what it knows
    trust = tuple(t**2 / total if total else 0.0 for t in trust)
    prior = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    return Model(theta[0], theta[1], curves, trust, prior, mean, spread, (len(extra[0]), len(extra[1])))


def unlabelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """All rows without a label: _key (a hash of the row), x (text measures), m (hashed metadata)."""

    def run(batches):
        for keys, ids, texts, *metas in batches:
            x = [np.array(form(t)).tobytes() for t in texts]
            m = [np.array(metadata(v), "<u2").tobytes() for v in zip(*metas, strict=True)]
            yield keys, ids, x, m

    keyed = docs.select(F.xxhash64("doc_id", "text", *META).alias("_key"), "doc_id", "text", *META)
    kind = docs.schema["doc_id"].dataType
    columns = [("_key", "long"), ("doc_id", kind.simpleString()), ("text", "string"), *((c, "string") for c in META)]
    out = [("_key", "long"), ("_id", kind), ("x", "binary"), ("m", "binary")]
    return map_rows(keyed, columns, out, run).join(known.select("_id"), "_id", "left_anti").drop("_id")


def told_by(pool: DataFrame, views: Views, taken: list[set], most: list[int]) -> Told:
    """What either view hands over of all rows of ``pool``: those of the highest leads as class 1, of the lowest as class 0.

    ``taken``: rows that a view has handed over before. ``most``: how many it hands over of each class.
    A task keeps no more than could be chosen; of equal leads the smaller hashes.
    """
    shared = pool.sparkSession.sparkContext.broadcast((views, taken, most))

    def run(batches):
        views, taken, most = shared.value
        best: dict[tuple[int, int], dict] = {(v, tag): {} for v in (0, 1) for tag in (0, 1)}
        for keys, xs, ms in batches:
            leads = views.leads(np.frombuffer(b"".join(xs)).reshape(len(xs), -1), np.frombuffer(b"".join(ms), "<u2").reshape(len(ms), -1).tolist())
            for (v, tag), some in best.items():
                sure = leads[v] if tag else -leads[v]
                for i in np.lexsort((keys, -sure))[: most[tag] + len(taken[v])].tolist():
                    if keys[i] not in taken[v]:
                        some[keys[i]] = (float(sure[i]), xs[i], ms[i])
                best[v, tag] = dict(sorted(some.items(), key=lambda r: (-r[1][0], r[0]))[: most[tag]])
        rows = [(v, tag, key, *r) for (v, tag), some in best.items() for key, r in some.items()]
        for lo in range(0, len(rows), 1000):
            yield tuple(zip(*rows[lo : lo + 1000], strict=True))

    out = [("v", "int"), ("tag", "int"), ("_key", "long"), ("sure", "double"), ("x", "binary"), ("m", "binary")]
    told: Told = {}
    with Scratch() as keep:
        found = keep(map_rows(pool, [("_key", "long"), ("x", "binary"), ("m", "binary")], out, run))
        for v in (0, 1):
            for tag in (1, 0):
                rows = found.where(f"v = {v} and tag = {tag}").dropDuplicates(["_key"]).orderBy(F.col("sure").desc(), "_key").limit(most[tag]).collect()
                once = {key for key, *_ in told.get((v, 1), [])}  # in a small table a row may be among both
                told[v, tag] = [(r["_key"], bytes(r.x), bytes(r.m)) for r in rows if r["_key"] not in once]
    shared.unpersist()
    return told


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, rounds: int = ROUNDS) -> Model:
    """A model of ``labels.quality`` over the columns text, source and lang of ``docs``, after some rounds of exchange."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    share = known.agg(F.avg("_y")).first()[0]
    by_hash = [F.xxhash64(F.lit(2), "_id"), F.col("_id")]
    picked = [known.where(f"_y = {y}").orderBy(*by_hash).limit(most_rows) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(F.col("doc_id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in ("text", *META))).join(chosen, "_id").collect()
    rows = sorted({(r[0], r[-1], r[1] or "", tuple(r[2:-1])) for r in rows}, key=lambda r: (r[0], r[1], r[2], str(r[3])))
    told = [r[2] for r in rows], [r[3] for r in rows], [r[1] for r in rows]
    if len(set(told[2])) < 2 or not rounds:
        return co_train(*told, float(share or 0.5))
    with Scratch() as keep:
        pool = keep(unlabelled(docs, known))
        return co_train(*told, float(share), lambda *asked: told_by(pool, *asked), rounds)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Per document: doc_id and score, the probability of class 1."""
    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for ids, texts, *metas in batches:
            yield ids, shared.value.scores(texts, list(zip(*metas, strict=True))).tolist()

    return map_rows(docs, [(id_col, kind.simpleString()), ("text", "string"), *((c, "string") for c in META)], [("doc_id", kind), ("score", "double")], run)


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for cols in batches:
            s = shared.value.scores(cols[names.index("text")], list(zip(*(cols[names.index(c)] for c in META), strict=True)))
            good = np.flatnonzero(s >= least).tolist()
            if good:
                yield tuple([c[i] for i in good] for c in cols)

    fields = [(f.name, f.dataType) for f in docs.schema]
    return map_rows(docs, [(n, t.simpleString()) for n, t in fields], fields, run)
