"""Document quality from a linear-chain conditional random field over lines.

Every line is good (1) or bad (0). Its features are bins of what it looks like (shares of symbols, capitals, digits,
column bars, repeated words, its length, whether the text had that line before), and the same bins of the lines beside it.
The field has a weight for each feature and for each pair of neighbouring labels. Forward-backward gives each line's
probability of being good; a document's quality is their mean, weighted by length.

Only documents have labels, so lines are partly observed: of a document labelled 1 the length-weighted mean of its lines'
probabilities of being good is to be at least ``good``, of one labelled 0 at most ``bad``. Each round tilts the line scores of
the documents that break their bound, by one number a document, until they keep it; the field's weights then climb towards
the tilted probabilities of lines and of pairs of lines, every document counting the same (posterior regularisation, an
expectation-maximisation with the labels as constraints). So a good document may have bad lines, and a bad one good lines.

Fitting is on the driver, over a bounded sample of labelled rows (``max_docs`` a class, texts up to ``max_chars``). Scoring is one pass over all whole texts in Arrow batches, without a
shuffle; the model has a fixed size.

Edge cases: a NULL or empty text, and one of white space only, has no line and scores the share of label 1 in the sample
(Laplace-smoothed); with no labelled row or one class only all texts score so; repeated rows are scored each; NULL labels
aren't learnt from.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, held_out, labelled_sample, read


@dataclass(frozen=True)
class Settings:
    """``max_docs`` and ``max_chars`` bound the training sample."""

    max_docs: int = 3000
    max_chars: int = 60_000
    rounds: int = 120
    rate: float = 0.1
    good: float = 0.8
    bad: float = 0.05
    tilt: float = 1.0
    shrink: float = 1e-3
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    """``weight``: each feature's weight for good against bad. ``pair[a, b]``: for label b after label a."""

    weight: np.ndarray
    pair: np.ndarray
    prior: float


#: Bytes of each class that shares are taken of.
CLASSES = (b"#$%&*@^~_=+<>{}[]\\/", b"!?", b"|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789")
#: Upper ends of the bins of a share, and of a line's length in bytes.
SHARES = np.array([0.0, 0.01, 0.03, 0.08, 0.15, 0.3, 0.6])
LENGTHS = np.array([3, 10, 30, 80, 200, 1000])
KINDS = len(CLASSES) + 1
BINS = KINDS * (len(SHARES) + 1)
#: Own bins, those of the line before and after (with one more each for "none"), length, first seen or seen before.
FEATURES = BINS + 2 * (BINS + 1) + len(LENGTHS) + 1 + 2


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """For each line with a word: its features' numbers, and its length."""
    shares, lengths, seen, before = [], [], set(), []
    for line in text.encode("utf-8", "replace").split(b"\n") if text else ():
        words = line.split()
        if not words:
            continue
        size = len(line)
        again = sum(map(eq, words, islice(words, 1, None))) / len(words)
        shares.append([1 - len(line.translate(None, c)) / size for c in CLASSES] + [again])
        lengths.append(size)
        before.append(line in seen)
        seen.add(line)
    n = len(lengths)
    if not n:
        return np.zeros((0, 0), np.int64), np.zeros(0)
    size = np.array(lengths)
    own = np.searchsorted(SHARES, np.array(shares) - 1e-12) + np.arange(KINDS) * (len(SHARES) + 1)
    none = np.full((1, KINDS), BINS)
    rest = np.stack([np.searchsorted(LENGTHS, size), len(LENGTHS) + 1 + np.array(before, np.int64)], 1)
    beside = (np.concatenate([none, own[:-1]]) + BINS, np.concatenate([own[1:], none]) + 2 * BINS + 1)
    return np.concatenate([own, *beside, rest + 3 * BINS + 2], 1), size.astype(np.float64)


class Packed:
    """Documents' lines by place: place t has the t-th lines of all documents with so many, longest documents first."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        ordered = sizes[self.order]
        steps = int(ordered[0]) if len(ordered) else 0
        self.active = np.searchsorted(-ordered, -np.arange(steps), "left")  # documents with more than t lines
        self.at = np.append(0, np.cumsum(self.active))
        first = np.append(0, np.cumsum(sizes))[:-1][self.order]
        self.line = np.concatenate([first[:k] + t for t, k in enumerate(self.active)]) if steps else np.zeros(0, np.int64)


def marginals(score: np.ndarray, pair: np.ndarray, p: Packed, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each packed line, expected label pairs, and the log partition, by forward-backward over all documents.

    ``share`` weighs the pair that ends at each packed line.
    """
    n = len(score)
    node = np.stack([np.zeros(n), score], 1)
    ahead, back = np.empty((n, 2)), np.zeros((n, 2))
    steps = len(p.active)
    for t in range(steps):
        a, b = p.at[t], p.at[t + 1]
        ahead[a:b] = node[a:b]
        if t:
            came = ahead[p.at[t - 1] : p.at[t - 1] + b - a]
            ahead[a:b] += np.logaddexp(came[:, :1] + pair[0], came[:, 1:] + pair[1])
    for t in range(steps - 2, -1, -1):
        a, k = p.at[t], p.active[t + 1]
        nxt = node[p.at[t + 1] : p.at[t + 1] + k] + back[p.at[t + 1] : p.at[t + 1] + k]
        back[a : a + k] = np.logaddexp(nxt[:, :1] + pair[:, 0], nxt[:, 1:] + pair[:, 1])
    both = ahead + back
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    pairs = np.zeros((2, 2))
    for t in range(1, steps):
        a, b = p.at[t], p.at[t + 1]
        left, right = ahead[p.at[t - 1] : p.at[t - 1] + b - a], (node[a:b] + back[a:b])
        joint = left[:, :, None] + pair[None] + right[:, None, :] - total[a:b, None, None]
        joint = np.exp(joint)
        pairs += joint.sum(0) if share is None else np.einsum("nij,n->ij", joint, share[a:b])
    return good, pairs, float(total[: p.active[0]].sum()) if steps else 0.0


def train(texts: list[str], labels: list[int], s: Settings = Settings()) -> Model:
    """Gradient ascent (Adam) on the likelihood of the lines as the documents' labels allow them to be."""
    prior = (sum(labels) + 1) / (len(labels) + 2)
    made = [(f, n, y) for (f, n), y in ((line_features(t), y) for t, y in zip(texts, labels, strict=True)) if len(f)]
    weight, pair = np.zeros(FEATURES), np.zeros((2, 2))
    if len({y for _, _, y in made}) < 2:
        return Model(weight, pair, prior)
    sizes = np.array([len(f) for f, _, _ in made])
    p = Packed(sizes)
    features = np.concatenate([f for f, _, _ in made])[p.line]
    doc = np.repeat(np.arange(len(made)), sizes)[p.line]
    y = np.array([y for _, _, y in made])
    length = np.concatenate([n for _, n, _ in made])[p.line]
    part = length / np.bincount(doc, length)[doc]
    # each document counts the same, however many lines it has
    share = (1 / sizes)[doc] / len(made)
    bound, side = np.where(y == 1, s.good, s.bad), np.where(y == 1, 1.0, -1.0)
    tilt = np.zeros(len(made))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weight, pair)]
    for step in range(1, s.rounds + 1):
        score = weight[features].sum(1)
        good, pairs, _ = marginals(score, pair, p, share)
        wanted, wanted_pairs, _ = marginals(score + tilt[doc], pair, p, share)
        # pushes the tilt where the bound is broken, and takes it back where it is kept
        tilt = side * np.maximum(0, side * tilt + s.tilt * side * (bound - np.bincount(doc, wanted * part)))
        up = np.bincount(features.ravel(), np.repeat((wanted - good) * share, features.shape[1]), FEATURES) - s.shrink * weight
        for value, g, (m, v) in zip((weight, pair), (up, wanted_pairs - pairs - s.shrink * pair), state, strict=True):
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.999 * v + 0.001 * g * g
            value += s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(weight, pair, prior)


def quality(texts: list[str | None], model: Model) -> np.ndarray:
    """Length-weighted mean probability of good lines, of each text."""
    made = [line_features(t) for t in texts]
    sizes = np.array([len(n) for _, n in made], np.int64)
    out = np.full(len(texts), model.prior)
    full = np.flatnonzero(sizes)
    if not len(full) or not model.weight.any():
        return out
    p = Packed(sizes[full])
    features = np.concatenate([made[i][0] for i in full])[p.line]
    packed, _, _ = marginals(model.weight[features].sum(1), model.pair, p)
    good = np.empty(len(packed))
    good[p.line] = packed
    length = np.concatenate([made[i][1] for i in full])
    starts = np.append(0, np.cumsum(sizes[full]))[:-1]
    out[full] = np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts)
    return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learns from ``docs (doc_id, text)`` and ``labels (doc_id, quality)``, over a bounded sample of each class."""
    sample = labelled_sample(docs, labels, "quality", s.max_docs, s.max_chars)
    return train([text for text, _ in sample], [y for _, y in sample], s)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with ``quality_score`` (double, 0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[list], list]:
        return lambda texts: [quality(texts, shared.value)]

    return add_columns(docs, text, {"quality_score": "double"}, start, keep)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from the folds other than 0 of 5."""
    s, docs = Settings(), read(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 5, 0)
    model = fit(docs, read(spark, sf_dir, "labels").where(~out), s)
    found = score(docs, model, keep=["doc_id"]).select("doc_id", out.alias("held_out"), F.col("quality_score").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))
