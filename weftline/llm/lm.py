"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(leaf | class, history) + log P(word | leaf). The class of a word is a
hash of how it ends; the end of a text has a class too. A leaf is one word, for the most frequent words of each class; the
other words of the head share a few leaves, by frequency, and all further words share leaf 0 with the unknown ones. Both
softmaxes are maximum-entropy models over the hashed word before, the two words before, and the word before that skipped to,
in the second one together with the class. Their table has a row of ``leaves`` weights a bucket, and as many buckets as the
counted tokens call for (``per_bucket``), from ``least_buckets`` to ``most_buckets``. Inside a leaf words have add-one
frequencies, with a place for an unknown word in leaf 0, so that the probabilities of all known words and of one unknown word
a class sum to 1.

1. Counts: every task counts its training tokens; one grouped sum gives the vocabulary of the corpus.
2. Training: in each of ``rounds`` rounds all tasks go over their part of a slice of the training documents, starting from
   the same broadcast weights, taking gradient steps on blocks of tokens. Tasks follow the data. Their changes are averaged in
   a tree of grouped means over slices of the table, each row weighted by how often a task met it. Every training document is
   used, in one of the rounds.
3. Scoring: sparse NumPy batches add up the rows of the features. Words are hashed for a whole batch at a time. What depends
   on the counts is a sum over a text's words of log10(c + 1): words with a large count (at most ``head`` of them, so their
   table may be broadcast) are looked up by hash in the task, all others are joined with the vocabulary by a shuffle and
   added up by document.

Edge cases: NULL counts as empty, and an empty text is the end token alone; rows without id aren't learnt from and count as
held out; repeated rows are scored each; without training documents the vocabulary is empty, the base score 0 and every
class equally likely.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, checkpointed, fold, held_out, read, slices

#: The end of a text, in the vocabulary: no word has white space.
END = " "


@dataclass(frozen=True)
class Settings:
    """``head`` bounds what is broadcast of the vocabulary, ``most_buckets`` (up to 2^16) the weights: two buckets a leaf row each."""

    least_buckets: int = 1 << 12
    most_buckets: int = 1 << 16
    per_bucket: int = 50
    classes: int = 32
    leaves: int = 32
    shared_leaves: int = 6
    rounds: int = 2
    block: int = 16_384
    rate: float = 1.0
    caution: float = 1.0
    damping: float = 0.2
    slices: int = 64
    least_trainers: int = 8
    per_trainer: int = 38
    fan_in: int = 32
    head: int = 65_536


def tokens(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words of a text as UTF-8 bytes."""
    return text.encode("utf-8", "replace").lower().split() if text else []


# --- words of a batch as numbers

#: An odd base: powers of it have inverses modulo 2^64, so a word's hash doesn't depend on where the word stands.
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ENDINGS = np.array([zlib.crc32(bytes((a, b))) for a in range(256) for b in range(256)], np.uint32)
SHORT = np.array([zlib.crc32(bytes((a,))) for a in range(256)], np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse, made longer when a longer stretch comes up."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        return self.up, self.down


@dataclass(frozen=True)
class Words:
    """The words of some texts in a row: where they stand in ``data``, their hashes and classes, and each text's number of words."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    cls: np.ndarray
    sizes: np.ndarray


def words_of(texts: list[str | None], powers: Powers, s: Settings, block: int = 1 << 20) -> Words:
    """Hashes stretches of about ``block`` bytes at a time, so that what a long text needs beside it is bounded."""
    encoded = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    data = b" ".join([b"", *encoded, b""])
    bytes_ = np.frombuffer(data, np.uint8)
    gap = SPACE[bytes_]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    bounds = np.cumsum([1, *(len(x) + 1 for x in encoded)])
    sizes = np.diff(np.searchsorted(start, bounds))
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(start, start[at] + block)))
        low = start[at]
        stretch = bytes_[low : end[stop - 1]]
        up, down = powers.upto(len(stretch) + 1)
        total = np.empty(len(stretch) + 1, np.uint64)
        total[0] = 0
        np.cumsum((stretch.astype(np.uint64) + np.uint64(1)) * up[: len(stretch)], out=total[1:])
        h = (total[end[at:stop] - low] - total[start[at:stop] - low]) * down[start[at:stop] - low]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        hashes[at:stop] = h ^ (h >> np.uint64(32))
        at = stop
    last = bytes_[end - 1].astype(np.int64)
    crc = np.where(end - start > 1, ENDINGS[bytes_[end - 2].astype(np.int64) * 256 + last], SHORT[last])
    return Words(data, start, end, hashes, 1 + crc.astype(np.int64) % (s.classes - 1), sizes)


def hash_of(words: list[str], powers: Powers, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and classes of single words."""
    w = words_of(words, powers, s)
    return w.hash, w.cls


def class_column(token: str, s: Settings) -> F.Column:
    """The class of a word, as :func:`words_of` has it."""
    return (F.lit(1) + F.crc32(F.substring(F.encode(token, "utf-8"), -2, 2)) % F.lit(s.classes - 1)).cast("int")


# --- the model


@dataclass(frozen=True)
class Head:
    """The words whose counts are broadcast, by sorted hash: log10(c + 1), and the leaf. ``end`` is the end token's count."""

    hash: np.ndarray
    log_c: np.ndarray
    leaf: np.ndarray
    end: int


@dataclass(frozen=True)
class Model:
    """``table``: rows of the class features, of the leaf features, the class bias and each class's leaf bias.

    ``offset``: log10 of what a word's c + 1 is divided by, by class and leaf.
    """

    table: np.ndarray
    head: Head
    offset: np.ndarray
    words: int
    tokens: int

    @property
    def buckets(self) -> int:
        return (len(self.table) - 1 - len(self.offset)) // 2


def events(w: Words, leaf: np.ndarray, buckets: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The decisions of some texts: for every token its class, then for every word its leaf.

    Returns the rows of the table that each adds up (3 features and the bias, by events), what was decided, and the text of
    the tokens and of the words.
    """
    ends = np.cumsum(w.sizes + 1) - 1
    n = len(w.hash) + len(w.sizes)
    word = np.ones(n, bool)
    word[ends] = False
    h, cls = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    h[word], cls[word] = w.hash, w.cls
    text = np.repeat(np.arange(len(w.sizes)), w.sizes + 1)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    one[1:], two[2:] = h[:-1], h[:-2]
    first = ends - w.sizes
    one[first] = two[first] = 1  # before the text
    two[(first + 1)[w.sizes > 0]] = 1
    salt = cls[word].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    kinds = (one * np.uint64(3), one * np.uint64(0x9E3779B1) + two * np.uint64(0x85EBCA77), two * np.uint64(5))
    rows = np.empty((4, n + len(w.hash)), np.int32)
    for k, mix in enumerate(kinds):
        for part, x, base in ((slice(0, n), mix, 0), (slice(n, None), mix[word] + salt, buckets)):
            x = (x + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            rows[k, part] = ((x >> np.uint64(33)) & np.uint64(buckets - 1)).astype(np.int32) + base
    rows[3, :n], rows[3, n:] = 2 * buckets, 2 * buckets + 1 + w.cls
    return rows, np.concatenate([cls, leaf]), text, text[word]


#: Events whose logits are made at a time: their arrays stay in a core's cache.
CACHED = 2048


def logits(table: np.ndarray, rows: np.ndarray, block: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of events, of at most ``CACHED``, with the logits of all outcomes, their exponentials, and the sums of these."""
    ones, block = np.ones(table.shape[1], np.float32), min(block, CACHED)
    for k in range(0, rows.shape[1], block):
        part = slice(k, min(k + block, rows.shape[1]))
        x = table.take(rows[0, part], axis=0)
        for more in rows[1:, part]:
            x += table.take(more, axis=0)
        np.minimum(x, 60, out=x)
        e = np.exp(x)
        yield part, x, e, e @ ones


def picked_log_probs(table: np.ndarray, rows: np.ndarray, target: np.ndarray, block: int) -> np.ndarray:
    """Natural log-probability of what was decided, of each event."""
    out = np.empty(len(target))
    for part, x, _, total in logits(table, rows, block):
        out[part] = x[np.arange(len(x)), target[part]] - np.log(total)
    return out


def run_sums(values: np.ndarray, order: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of the rows of each run of ``order``: most runs are short, so all k-th rows are added at a time; the few long ones follow."""
    out, k = values.take(order[first], axis=0), 1
    longer = np.flatnonzero(count > k)
    while len(longer) > 64:
        out[longer] = out.take(longer, axis=0) + values.take(order[first[longer] + k], axis=0)
        k += 1
        longer = longer[count[longer] > k]
    ones = np.ones(int(count.max(initial=0)), values.dtype)
    for i in longer:
        out[i] += ones[: count[i] - k] @ values.take(order[first[i] + k : first[i] + count[i]], axis=0)
    return out


class Trainer:
    """Gradient steps from given weights; a row's steps shrink with the squares of its gradients.

    They are also at most about the mean gradient of the row's events, which for a row met often is little but noise.
    """

    def __init__(self, table: np.ndarray, buckets: int, s: Settings):
        self.table, self.buckets, self.s = table.copy(), buckets, s
        self.squares = np.full(len(table), s.caution, np.float32)
        self.met = np.zeros(len(table), np.float32)

    def learn(self, rows: np.ndarray, target: np.ndarray) -> None:
        """One pass; the events of both softmaxes are apart, so that row numbers within each fit 16 bits, which sort fast."""
        for k in range(0, len(target), self.s.block):
            of, wanted = rows[:, k : k + self.s.block], target[k : k + self.s.block]
            gradient = np.empty((len(wanted), self.table.shape[1]), np.float32)
            for part, _, e, total in logits(self.table, of, self.s.block):
                np.multiply(e, (np.float32(-1) / total)[:, None], out=gradient[part])
            gradient[np.arange(len(wanted)), wanted] += 1
            for kind, row in enumerate(of):
                low = int(row.min())
                order = np.argsort((row - low).astype(np.uint16), kind="stable") if int(row.max()) - low < 1 << 16 else np.argsort(row, kind="stable")
                ordered = row[order]
                first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                count = np.diff(np.append(first, len(ordered)))
                self.change(ordered[first], run_sums(gradient, order, first, count), count.astype(np.float32), 1 if kind == 3 else 3)

    def change(self, rows: np.ndarray, sums: np.ndarray, count: np.ndarray, share: int) -> None:
        """A step of distinct rows, by the sums of their events' gradients and the events' number."""
        rate = np.float32(self.s.rate / share)
        for k in range(0, len(rows), CACHED):
            row, g, n = rows[k : k + CACHED], sums[k : k + CACHED], count[k : k + CACHED]
            squares = self.squares.take(row) + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
            self.squares[row] = squares
            g *= (rate / (np.sqrt(squares) + rate * np.float32(self.s.damping) * n))[:, None]
            g += self.table.take(row, axis=0)
            self.table[row] = g
            self.met[row] += n


# --- counts


def count_words(docs: DataFrame, text: str = "text", flush: int = 500_000) -> DataFrame:
    """``(token, c)`` over all of ``docs``, the end of each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])
            total.clear()
            return rows

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                total.update(tokens(t))
            total[END.encode()] += b.num_rows
            if len(total) > flush:
                yield out()
        yield out()

    return docs.select(text).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


def head_words(vocabulary: DataFrame, head: int) -> dict[str, int]:
    """The words with at least some count, the least for which they are at most ``head``; found from a histogram of counts."""
    bin_of = F.floor(F.log2("c") * 8)
    bins = {r["b"]: r["n"] for r in vocabulary.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n")).collect()}
    least, total = None, 0
    for b in sorted(bins, reverse=True):
        if (total := total + bins[b]) > head:
            break
        least = b
    return {} if least is None else {r["token"]: r["c"] for r in vocabulary.where(bin_of >= least).collect()}


def leaves_of(cls: np.ndarray, count: np.ndarray, s: Settings) -> np.ndarray:
    """The leaf of each word of the head, given in order of falling counts: the first of each class have their own, the others
    share leaves 1 to ``shared_leaves`` - 1, each with about the same count in all."""
    leaf = np.zeros(len(cls), np.int64)
    for k in range(1, s.classes):
        at = np.flatnonzero(cls == k)
        own, rest = at[: s.leaves - s.shared_leaves], at[s.leaves - s.shared_leaves :]
        leaf[own] = s.shared_leaves + np.arange(len(own))
        below = np.cumsum(count[rest]) - count[rest]
        leaf[rest] = 1 + (below * (s.shared_leaves - 1) // max(1, int(count[rest].sum())))
    return leaf


# --- fitting


def _mean(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean change of each row weighted by how often it was met, and how often."""
    met = sum(m for _, m in parts)
    total = sum(c.astype(np.float32) * m[:, None] for c, m in parts)
    return total / np.maximum(met, 1)[:, None], met


def averaged(parts: DataFrame, table: np.ndarray, tasks: int, s: Settings) -> np.ndarray:
    """``table`` plus the mean of the tasks' changes ``(slice, task, change, met)``, taken in a tree: a group has at most ``fan_in`` parts."""
    width, schema = table.shape[1], parts.schema

    def unpack(change: list[bytes], met: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.frombuffer(c, np.float16).reshape(-1, width), np.frombuffer(m, np.float32)) for c, m in zip(change, met, strict=True)]

    def merge(t: pa.Table) -> pa.Table:
        change, met = _mean(unpack(t.column("change").to_pylist(), t.column("met").to_pylist()))
        return pa.table({"slice": t.column("slice").slice(0, 1), "task": t.column("task").slice(0, 1), "change": pa.array([change.astype(np.float16).tobytes()], pa.binary()), "met": pa.array([met.astype(np.float32).tobytes()], pa.binary())})

    while tasks > 1:
        grouped = parts.withColumn("task", F.floor(F.col("task") / s.fan_in).cast("int"))
        parts, tasks = grouped.groupBy("slice", "task").applyInArrow(merge, schema), -(-tasks // s.fan_in)
    height, out = -(-len(table) // s.slices), table.copy()
    for r in parts.collect():
        change, _ = unpack([r["change"]], [r["met"]])[0]
        out[r["slice"] * height : r["slice"] * height + len(change)] += change
    return out


def fit(docs: DataFrame, vocabulary: DataFrame, s: Settings = Settings()) -> Model:
    """The model learnt from ``docs (doc_id, text)`` and their ``vocabulary``."""
    spark = docs.sparkSession
    head = head_words(vocabulary, s.head)
    head.pop(END, None)
    names = sorted(head, key=lambda w: (-head[w], w))
    count = np.array([head[w] for w in names], np.int64)
    hashes, cls = hash_of(names, Powers(), s)
    leaf = leaves_of(cls, count, s)
    n, v = np.zeros((s.classes, s.leaves)), np.zeros((s.classes, s.leaves))
    sums = vocabulary.groupBy(F.when(F.col("token") == END, 0).otherwise(class_column("token", s)).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    for r in sums:
        n[r["k"], 0], v[r["k"], 0] = r["n"], r["v"]
    tokens_, words, by_class, end = int(n.sum()), int(v.sum()), n.sum(1), int(n[0, 0])
    np.add.at(n, (cls, leaf), count)
    np.add.at(v, (cls, leaf), 1)
    n[:, 0] -= n[:, 1:].sum(1)  # leaf 0 has what the head doesn't
    v[:, 0] -= v[:, 1:].sum(1)
    offset = np.log10(np.maximum(n + v + (np.arange(s.leaves) == 0), 1))
    order = np.argsort(hashes)
    known = Head(hashes[order], np.log10(count + 1.0)[order], leaf[order], end)
    wanted = 1 << (tokens_ // s.per_bucket).bit_length()
    buckets = min(s.most_buckets, max(s.least_buckets, wanted))
    table = np.zeros((2 * buckets + 1 + s.classes, s.leaves), np.float32)
    table[2 * buckets, : s.classes] = np.log(by_class + 1)
    table[2 * buckets, s.classes :] = -60
    table[2 * buckets + 1 :] = np.where(v > 0, np.log(np.maximum(n, 1)), -60)
    table[2 * buckets + 1 :, 0] = np.log(n[:, 0] + 1)
    height = -(-len(table) // s.slices)
    shared_head = spark.sparkContext.broadcast(known)

    def learn(batches: Iterator[pa.RecordBatch], start) -> Iterator[pa.RecordBatch]:
        trainer, powers, head = Trainer(start.value, buckets, s), Powers(), shared_head.value
        for b in slices(batches, 256):
            w = words_of(b.column(0).to_pylist(), powers, s)
            rows, target, _, _ = events(w, looked_up(w, head)[1], buckets, s.classes)
            apart = len(target) - len(w.hash)
            trainer.learn(rows[:, :apart], target[:apart])
            trainer.learn(rows[:, apart:], target[apart:])
        change = (trainer.table - start.value).astype(np.float16)
        cuts = range(0, len(change), height)
        task = TaskContext.get().partitionId()
        columns = [pa.array(range(len(cuts)), pa.int32()), pa.array([task] * len(cuts), pa.int32()), pa.array([change[k : k + height].tobytes() for k in cuts], pa.binary()), pa.array([trainer.met[k : k + height].tobytes() for k in cuts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["slice", "task", "change", "met"])

    for r in range(s.rounds if tokens_ else 0):
        start = spark.sparkContext.broadcast(table)
        part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(s.rounds)) == r).select("text")
        # a task's table is about as large as the text it learns from, so that the changes are not more than the input
        tasks = min(part.rdd.getNumPartitions(), max(s.least_trainers, tokens_ // (s.per_trainer * buckets)))
        changes = part.coalesce(tasks).mapInArrow(lambda it, start=start: learn(it, start), "slice int, task int, change binary, met binary")
        table = averaged(changes, table, tasks, s)
    return Model(table, known, offset, words, tokens_)


# --- scoring


def looked_up(w: Words, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: whether the head has it, its leaf (0 if not), and its place in the head."""
    if not len(head.hash):
        zero = np.zeros(len(w.hash), np.int64)
        return zero.astype(bool), zero, zero
    at = np.minimum(np.searchsorted(head.hash, w.hash), len(head.hash) - 1)
    known = head.hash[at] == w.hash
    return known, np.where(known, head.leaf[at], 0), at


class Scorer:
    """Scores lists of texts; what hangs on words outside the head is left to the join."""

    def __init__(self, model: Model, s: Settings):
        self.model, self.s, self.powers = model, s, Powers()

    def __call__(self, texts: list[str | None]) -> list:
        """Of each text: tokens, known tokens, sum of log10(c + 1), model score, and the words left with their numbers."""
        model, s, docs = self.model, self.s, len(texts)
        w = words_of(texts, self.powers, s)
        known, leaf, at = looked_up(w, model.head)
        rows, target, text, of_word = events(w, leaf, model.buckets, s.classes)
        log_p = picked_log_probs(model.table, rows, target, s.block) / np.log(10)
        log_c = np.zeros(len(at))
        log_c[known] = model.head.log_c[at[known]]
        counts = np.bincount(of_word, log_c, docs)
        value = np.bincount(text, log_p[: len(text)], docs) + np.bincount(of_word, log_p[len(text) :] - model.offset[w.cls, leaf], docs) + counts
        end_known = int(model.head.end > 0)
        seen = np.bincount(of_word[known], minlength=docs) + end_known
        if end_known:
            counts = counts + np.log10(model.head.end + 1)
        rest: list[list[tuple[str, int]]] = [[] for _ in texts]
        left = np.flatnonzero(~known)
        if len(left):
            order = left[np.lexsort((w.hash[left], of_word[left]))]
            new = np.append(True, (np.diff(of_word[order]) != 0) | (np.diff(w.hash[order].view(np.int64)) != 0))
            first = np.flatnonzero(new)
            some, data = order[first], w.data
            names = [data[a:b].decode() for a, b in zip(w.start[some].tolist(), w.end[some].tolist(), strict=True)]
            pairs = list(zip(names, np.diff(np.append(first, len(order))).tolist(), strict=True))
            bounds = np.searchsorted(of_word[some], np.arange(docs + 1)).tolist()
            rest = [pairs[bounds[d] : bounds[d + 1]] for d in range(docs)]
        return [w.sizes + 1, seen, counts, value, rest]


def score(docs: DataFrame, vocabulary: DataFrame, model: Model, s: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """Columns of ``docs`` with n_tokens, n_known, base_score and score (log10 probabilities of the texts)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[list], list]:
        return Scorer(shared.value, s)

    kinds = {"n_tokens": "long", "__known": "long", "__log": "double", "score": "double", "__rest": "array<struct<w:string,k:long>>"}
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    first = checkpointed(add_columns(rows, "text", kinds, start, [*(docs.columns if keep is None else keep), "__row"], rows=256))
    tail = first.select("__row", F.explode("__rest").alias("x")).select("__row", F.col("x.w").alias("token"), F.col("x.k").alias("k"))
    # a word that isn't known has log10(c + 1) = 0, so only the known ones meet
    joined = tail.join(vocabulary.select("token", "c"), "token")
    sums = joined.groupBy("__row").agg(F.sum("k").alias("__k"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("__a"))
    all_of = first.join(sums, "__row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return all_of.select(
        *[F.col(c) for c in (docs.columns if keep is None else keep)],
        "n_tokens",
        (F.col("__known") + zero("__k")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("__log") + zero("__a") - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.words + 1)))).alias("base_score"),
        (F.col("score") + zero("__a")).alias("score"),
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model score, learnt from the folds other than 2 of 7."""
    s, docs = Settings(), read(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = docs.where(fold("doc_id", 7) != 2)
    vocabulary = checkpointed(count_words(learnt))
    found = score(docs, vocabulary, fit(learnt, vocabulary, s), s, keep=["doc_id"])
    return found.withColumn("held_out", held_out("doc_id", 7, 2)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
