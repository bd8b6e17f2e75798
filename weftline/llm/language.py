"""Language identification by inference in a multilingual mixture.

Each language is a model of byte trigrams inside words (hashed, smoothed). A document is a mixture: every word was written
in one of its languages, and expectation-maximisation finds the proportions from the words' trigram likelihoods. Which
languages a document has is chosen by penalised likelihood: starting from the best single language, the language that
raises the log-likelihood most joins while the gain exceeds a penalty (BIC); languages that by a bound can't gain more than
the best one tried aren't tried. The prediction is the language with the
largest proportion, its proportion the score.

Learning: trigram counts over a bounded sample of labelled rows (about ``max_docs`` a language, by a hash of the row; texts
up to ``max_chars``), in tasks, summed by language and bucket there; the driver gets one row of at most ``buckets`` counts a
language. No language is left out: with very many, buckets are fewer (``max_cells``). Inference is one pass over all whole texts, without a shuffle.

Edge cases: ``und`` with score 0 for NULL, empty and letterless texts, and for all where no language was learnt; ties go
to the language that sorts first; repeated rows are predicted each; rows with a NULL language aren't learnt from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, checkpointed, held_out, read, sized_broadcast, where_text

UNDETERMINED = "und"
#: Bytes of digits and ASCII punctuation become spaces: they tell no language.
LETTER_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """``max_docs`` and ``max_chars`` bound the training sample. A model has ``buckets`` numbers a language; from ``max_cells`` in
    all on, buckets are halved rather than languages left out."""

    buckets: int = 1 << 16
    max_docs: int = 2000
    max_chars: int = 100_000
    max_cells: int = 1 << 26
    smooth: float = 0.5
    rounds: int = 12
    penalty: float = 1.0
    tempering: float = 0.5


@dataclass(frozen=True)
class Model:
    """``log_prob``: languages by buckets, float32."""

    langs: list[str]
    log_prob: np.ndarray


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def trigrams(buffer: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the trigram that starts at each byte (two fewer than bytes)."""
    a = buffer.astype(np.uint32)
    h = (a[:-2] * np.uint32(65_599) + a[1:-1]) * np.uint32(65_599) + a[2:]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(16)).astype(np.int64) % buckets


def _normal(text: str) -> bytes:
    """Lower-case letters with single spaces around words."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(LETTER_BYTES).split()) + b" "


def _counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, bucket, n) of a task, without zeros."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = np.frombuffer(_normal(text), np.uint8)
            if len(data) > 3:
                if lang not in total and len(total) >= 64:  # what a task holds doesn't grow with the languages
                    yield from _rows(total)
                    total.clear()
                total.setdefault(lang, np.zeros(buckets, np.int64))
                total[lang] += np.bincount(trigrams(data, buckets), minlength=buckets)
    yield from _rows(total)


def _rows(total: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Learns from ``docs (doc_id, text, lang)``."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.length("text") <= s.max_chars).select("text", "lang", F.xxhash64("doc_id", "text").alias("at"))
    sizes = checkpointed(rows.groupBy("lang").count())
    languages = sizes.count()
    # the share of the hashes that holds about max_docs rows of the language
    share = F.least(F.lit(1_000_000.0), F.ceil(F.lit(1e6 * s.max_docs) / F.col("count"))).alias("share")
    chosen = rows.join(sized_broadcast(sizes.select("lang", share)), "lang").where(F.pmod("at", F.lit(1_000_000)) < F.col("share"))
    buckets = s.buckets
    while languages * buckets > s.max_cells and buckets > 256:
        buckets //= 2
    parts = chosen.select("text", "lang").mapInArrow(lambda it: _counts(it, buckets), "lang string, bucket int, n bigint")
    summed = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("c"))
    table = summed.orderBy("lang").toArrow()
    log_prob = np.empty((table.num_rows, buckets), np.float32)
    for k in range(table.num_rows):
        pairs = table.column("c")[k].values
        counts = np.full(buckets, s.smooth)
        counts[pairs.field("bucket").to_numpy()] += pairs.field("n").to_numpy()
        log_prob[k] = np.log(counts / counts.sum())
    return Model(table.column("lang").to_pylist(), log_prob)


class Inference:
    """Mixture inference for lists of texts."""

    def __init__(self, model: Model, s: Settings):
        self.model, self.s, self.table = model, s, np.ascontiguousarray(model.log_prob.T)
        self.buckets = len(self.table)  # the model's, which may have fewer than the settings

    def _proportions(self, like: np.ndarray, langs: list[int]) -> tuple[np.ndarray, float]:
        """EM over the words of one document: shares of ``langs``, and the log-likelihood."""
        part = like[:, langs]
        top = part.max(1)
        e = np.exp(part - top[:, None])
        share = np.full(len(langs), 1 / len(langs))
        total = e @ share
        for _ in range(self.s.rounds if len(langs) > 1 else 0):
            share = share * (e.T @ (1 / total)) / len(e)
            share = np.maximum(share, 1e-9) / np.maximum(share, 1e-9).sum()
            total = e @ share
        return share, float(np.log(total).sum() + top.sum())

    def one(self, like: np.ndarray) -> tuple[str, float]:
        """``like``: words by languages, log-likelihoods. The chosen set's largest language and its share."""
        alone = like.sum(0)
        chosen = [int(alone.argmax())]
        share, best = np.ones(1), float(alone.max())
        cost = self.s.penalty * np.log(len(like) + 1)
        while len(chosen) < like.shape[1]:
            covered = like[:, chosen].max(1)
            gain = np.maximum(like, covered[:, None]).sum(0) - covered.sum()  # no set with this language can gain more
            gain[chosen] = -np.inf
            best_new = None
            for new in np.argsort(-gain, kind="stable").tolist():
                if gain[new] <= max(cost, best_new[2] - best if best_new else cost):
                    break
                more, value = self._proportions(like, [*chosen, new])
                if value - best > cost and (best_new is None or value > best_new[2]):
                    best_new = new, more, value
            if best_new is None:
                break
            chosen, share, best = [*chosen, best_new[0]], best_new[1], best_new[2]
        k = max(range(len(chosen)), key=lambda i: (round(share[i], 9), -chosen[i]))
        return self.model.langs[chosen[k]], float(min(1.0, share[k]))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.model.langs:
            return names, scores
        for i, text in enumerate(texts):
            if not text or not _has_letter(text):
                continue
            data = np.frombuffer(_normal(text), np.uint8)
            if len(data) < 4:  # no letter that can be told from its bytes
                data = np.frombuffer(b"  " + bytes(data) + b"  ", np.uint8)
            like = np.zeros((0, len(self.model.langs)))
            block = 1 << 18
            parts = []
            starts = np.flatnonzero(data[:-3] == 32) if len(data) > 3 else np.zeros(1, np.int64)
            ids = trigrams(data, self.buckets)
            for k in range(0, len(starts), block):  # long texts in blocks of words
                some = starts[k : k + block]
                end = starts[k + block] if k + block < len(starts) else len(ids)
                parts.append(np.add.reduceat(self.table[ids[some[0] : end]], some - some[0], axis=0))
            like = np.concatenate(parts).astype(np.float64) * self.s.tempering
            names[i], scores[i] = self.one(like)
        return names, scores


def predict(docs: DataFrame, model: Model, s: Settings = Settings(), text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with ``lang_pred`` and ``lang_score``, or other ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[list], list]:
        infer = Inference(shared.value, s)
        return lambda texts: list(infer(texts))

    return add_columns(docs, text, dict(zip(names, ("string", "double"), strict=True)), start, keep)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the folds other than 0 of 5."""
    docs, s = read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), Settings()
    out = held_out("doc_id", 5, 0)
    found = predict(docs.select("doc_id", "text"), fit(docs.where(~out), s), s, keep=["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with a language; ``und`` ones go."""
    s = Settings()
    shared = spark.sparkContext.broadcast(fit(docs.where(~held_out("doc_id", 5, 0)), s))

    def start() -> Callable[[list], list[bool]]:
        infer = Inference(shared.value, s)
        return lambda texts: [name != UNDETERMINED for name in infer(texts)[0]]

    return where_text(docs, start)
