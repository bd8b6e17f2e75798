"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the mean vector of its hashed character n-grams (3 to 6 bytes, with word edges) and of itself. A document is the
average of its words' vectors, and a linear softmax reads its class. Words weigh in the average by the softmax of a linear
function of their vectors, equal for all words at first and sharper in texts of over ``long`` words, so that a short insult
isn't averaged away in a text of any length. Vectors, weights and softmax are trained jointly in NumPy on the driver, over a
bounded sample of labelled rows (``max_docs`` a class, texts up to ``max_chars``). As n-gram vectors are shared, unseen misspellings get the score of what they resemble.

Scoring is one pass over all whole texts in Arrow batches, without a shuffle. The model (two numbers a bucket once the
vectors are folded with the softmax and the weights) has a fixed size.

Edge cases: a NULL or empty text, and one without a word, scores as the bias alone (the class prior); repeated rows are
scored each; NULL labels aren't learnt from; with no labelled row, or one class only, the score is the Laplace-smoothed
share of label 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, held_out, labelled_sample, plain_words, read, where_text


@dataclass(frozen=True)
class Settings:
    """``max_docs`` and ``max_chars`` bound the training sample; the rest sets the model's size and training."""

    buckets: int = 1 << 16
    dim: int = 8
    long: int = 1000
    max_docs: int = 3000
    max_chars: int = 60_000
    steps: int = 250
    batch: int = 64
    rate: float = 0.03
    shrink: float = 1e-5
    seed: int = 7
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    """Of each bucket's vector: its product with the difference of the softmax's two rows, and with the weights' vector."""

    bucket_score: np.ndarray
    bucket_weight: np.ndarray
    bias: float
    long: int


#: Bytes of the longest n-gram.
LONGEST = 6


def subwords(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all words' n-grams and of the words themselves, with the index of the word that each belongs to."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    buffer = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    ids, owners = [], []

    def put(h: np.ndarray, own: np.ndarray) -> None:
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        ids.append((h >> np.uint64(40)).astype(np.int64) % buckets)
        owners.append(own)

    h = buffer.copy()
    for n in range(2, LONGEST + 1):
        h = h[:-1] * np.uint64(257) + buffer[n - 1 :]
        if n > 2 and len(h):
            inside = owner[: len(h)] == owner[n - 1 :]
            put(h[inside] + np.uint64(n), owner[: len(h)][inside])
    starts = np.cumsum(lengths) - lengths
    place = (np.arange(len(buffer)) - starts[owner]).astype(np.uint64)
    whole = np.add.reduceat((buffer + np.uint64(1)) * (place * np.uint64(2) + np.uint64(1)) ** np.uint64(5), starts)
    put(whole, np.arange(len(words)))
    return np.concatenate(ids), np.concatenate(owners)


def sharpness(words: np.ndarray | int, long: int) -> np.ndarray:
    """What the logarithms of the words' weights are multiplied by: 1 up to ``long`` words, then as the logarithm of their number."""
    return np.maximum(1.0, np.log1p(words) / np.log1p(long))


class _Sample:
    """The training texts as word numbers; ``ids`` of word w are ``ids[first[w]:first[w + 1]]``."""

    def __init__(self, texts: list[str], s: Settings):
        known: dict[bytes, int] = {}
        tokens = [np.fromiter((known.setdefault(w, len(known)) for w in plain_words(text)), np.int32) for text in texts]
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.token = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        ids, count, names = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], list(known)
        for k in range(0, len(names), 20_000):  # so that what hashing needs beside the ids is bounded
            some, owner = subwords(names[k : k + 20_000], s.buckets)
            ids.append(some[np.argsort(owner, kind="stable")].astype(np.int32))
            count.append(np.bincount(owner))
        self.ids, self.count = np.concatenate(ids), np.concatenate(count)
        self.first = np.append(0, np.cumsum(self.count))

    def bag(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For some documents: counts of their distinct words (dense), those words' ids in a row, and how many each word has."""
        size = self.size[docs]
        line = np.repeat(np.arange(len(docs)), size)
        at = self.token[np.arange(size.sum()) + np.repeat(self.start[docs] - np.cumsum(size) + size, size)]
        words, back = np.unique(at, return_inverse=True)
        counts = np.bincount(line * len(words) + back, minlength=len(docs) * len(words)).reshape(len(docs), -1)
        each = self.count[words]
        inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each - self.first[words], each)
        return counts.astype(np.float32), self.ids[inner], each


def train(texts: list[str], labels: list[int], s: Settings = Settings()) -> Model:
    """Joint training by Adam on mini-batches of documents."""
    y = np.asarray(labels, np.int64)
    prior = (y.sum() + 1) / (len(y) + 2)
    bias0 = float(np.log(prior / (1 - prior)))
    sample = _Sample(texts, s)
    docs = np.flatnonzero(sample.size)
    if len(set(y[docs].tolist())) < 2:
        return Model(np.zeros(s.buckets), np.zeros(s.buckets), bias0, s.long)
    rng = np.random.default_rng(s.seed)
    emb = rng.normal(0, 0.1, (s.buckets, s.dim)).astype(np.float32)
    soft = rng.normal(0, 0.5, (s.dim, 2)).astype(np.float32)
    bias, weigh = np.array([0, bias0], np.float32), np.zeros(s.dim, np.float32)
    params = (emb, soft, bias, weigh)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in params]
    epochs = -(-s.steps // -(-len(docs) // s.batch))  # a small sample is gone over more often
    steps, step = epochs * -(-len(docs) // s.batch), 0
    for _ in range(epochs):
        order = rng.permutation(docs)
        for k in range(0, len(order), s.batch):
            chosen = order[k : k + s.batch]
            counts, ids, each = sample.bag(chosen)
            begin = np.cumsum(each) - each
            used, back = np.unique(ids, return_inverse=True)
            size = each[:, None].astype(np.float32)
            word = np.add.reduceat(emb[ids], begin) / size
            sharp = sharpness(sample.size[chosen], s.long).astype(np.float32)[:, None]
            share = np.where(counts > 0, sharp * (word @ weigh), -np.inf)
            share = counts * np.exp(share - share.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            bag = share @ word
            logit = bag @ soft + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(p)), y[chosen]] -= 1
            p /= len(chosen)
            to_bag = p @ soft.T
            to_weight = (sharp * share * (to_bag @ word.T - (to_bag * bag).sum(1, keepdims=True))).sum(0)
            to_word = (share.T @ to_bag + to_weight[:, None] * weigh) / size
            spread = np.repeat(to_word, each, axis=0)
            grad = np.stack([np.bincount(back, spread[:, j], len(used)) for j in range(s.dim)], 1).astype(np.float32)
            step += 1
            rate = s.rate * (1 - step / (steps + 1))
            grads = (grad + s.shrink * emb[used], bag.T @ p, p.sum(0), word.T @ to_weight)
            for value, part, g, (m, v) in zip(params, (used, *[slice(None)] * 3), grads, state, strict=True):
                m[part] = 0.9 * m[part] + 0.1 * g
                v[part] = 0.999 * v[part] + 0.001 * g**2
                value[part] -= rate * (m[part] / (1 - 0.9**step)) / (np.sqrt(v[part] / (1 - 0.999**step)) + 1e-8)
    return Model((emb @ (soft[:, 1] - soft[:, 0])).astype(np.float64), (emb @ weigh).astype(np.float64), float(bias[1] - bias[0]), s.long)


class Scorer:
    """Scores texts with a model; keeps the scores and weights of words seen before, up to ``keep`` of them."""

    def __init__(self, model: Model, keep: int = 300_000):
        self.model, self.keep, self.known = model, keep, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        docs = [plain_words(t) for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
        new = list(set().union(*docs).difference(self.known))
        if new:
            ids, owner = subwords(new, len(self.model.bucket_score))
            many = np.bincount(owner, minlength=len(new))
            score, weight = (np.bincount(owner, x[ids], len(new)) / many for x in (self.model.bucket_score, self.model.bucket_weight))
            self.known.update(zip(new, zip(score.tolist(), weight.tolist(), strict=True), strict=True))
        out = np.full(len(docs), self.model.bias)
        for i, words in enumerate(docs):
            if words:
                score, weight = np.array(list(map(self.known.__getitem__, words))).T
                weight = np.exp(sharpness(len(words), self.model.long) * (weight - weight.max()))
                out[i] += (score @ weight) / weight.sum()
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learns from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``, over a bounded sample of each class."""
    sample = labelled_sample(docs, labels, "toxic", s.max_docs, s.max_chars)
    return train([text for text, _ in sample], [y for _, y in sample], s)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "toxicity") -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with ``toxicity`` (double, 0 to 1), or another ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[list], list]:
        scorer = Scorer(shared.value)
        return lambda texts: [scorer(texts)]

    return add_columns(docs, text, {name: "double"}, start, keep)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the folds other than 1 of 3."""
    s, docs = Settings(), read(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out("doc_id", 3, 1)
    model = fit(docs, read(spark, sf_dir, "labels").where(~out), s)
    narrow = score(docs, model, keep=["doc_id"]).select("doc_id", out.alias("held_out"), F.col("toxicity").alias("score"))
    return narrow.withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents whose toxicity stays under the threshold."""
    s = Settings()
    shared = spark.sparkContext.broadcast(fit(docs, read(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)), s))

    def start() -> Callable[[list], list[bool]]:
        scorer = Scorer(shared.value)
        return lambda texts: (scorer(texts) < s.threshold).tolist()

    return where_text(docs, start)
