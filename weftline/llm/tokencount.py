"""Token counts by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words between white space, each led by the space mark U+2581. A pre-token's tokens are the
pieces of the vocabulary that cover it with the largest sum of scores (unigram Viterbi); a character without piece costs
``unknown`` below the lowest score for each of its bytes, and counts as that many tokens if the vocabulary has byte pieces, else as one.

The given vocabulary is one of merges: its own scores are ranks, not log-probabilities, and a sum of them would cut words into
many small pieces. As tokenizers are never trained, a piece's unigram log-probability is taken from its rank r among the
pieces by the Zipf-Mandelbrot law, log 1 / (r + ``offset``), normalised over all pieces. It depends on the file alone, so a
text has the same count in every corpus.

The distinct pre-tokens of a batch are walked in order of their characters, which is a walk of their trie: the forward
scores of a shared prefix are computed once and stand on a stack, and what a pre-token adds is cut back for the next. Each
end of a pre-token stores its count. Counts of pre-tokens seen before are kept, up to ``keep`` of them; a text's count is
the sum over its pre-tokens. One pass over all whole texts, nothing is shuffled, and memory is bounded by ``keep`` and a
batch.

Edge cases: NULL, empty and blank texts have 0 tokens and 0 pre-tokens; among coverings with equal scores the one whose
last piece is longest counts (and so on, from the end); repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from os.path import commonprefix

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import add_columns, read

SPACE_MARK = "▁"


@dataclass(frozen=True)
class Settings:
    vocabulary: str = "piece_bpe_32k.model"
    unknown: float = 10.0
    offset: float = 2.7
    keep: int = 400_000


@cache
def pieces(vocabulary: str, offset: float = 2.7) -> tuple[dict[str, float], bool]:
    """The vocabulary's pieces with their unigram log-probabilities by rank, and whether it has byte pieces.

    Control and byte pieces cover no characters and are left out.
    """
    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    weights = 1 / (np.arange(1, len(ids) + 1) + offset)
    scores = np.log(weights / weights.sum())
    return {model.id_to_piece(i): float(x) for i, x in zip(ids, scores, strict=True)}, any(map(model.is_byte, range(model.get_piece_size())))


class TrieCounter:
    """Counts tokens of pre-tokens; ``best[i]`` is the best score of the first i characters of the walk, ``count[i]`` its tokens."""

    def __init__(self, table: dict[str, float], unknown: float, keep: int, by_bytes: bool = False):
        self.table, self.keep, self.by_bytes = table, keep, by_bytes
        self.longest = max(map(len, table), default=1)
        self.low = min(table.values(), default=0.0) - unknown
        self.known: dict[str, int] = {}

    def walk(self, words: list[str]) -> None:
        """Stores the counts of ``words``, distinct and sorted."""
        score, table, low, longest = self.table.get, self.table, self.low, self.longest
        best, count, before = [0.0], [0], ""
        for word in words:
            shared = len(commonprefix((before, word)))
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, tokens = None, 0
                for start in range(max(0, end - longest), end):
                    value = score(word[start:end])
                    if value is not None and (top is None or best[start] + value > top):
                        top, tokens = best[start] + value, count[start] + 1
                if word[end - 1 : end] not in table:
                    parts = len(word[end - 1 : end].encode("utf-8", "replace")) if self.by_bytes else 1
                    if top is None or best[end - 1] + parts * low > top:
                        top, tokens = best[end - 1] + parts * low, count[end - 1] + parts
                best.append(top)
                count.append(tokens)
            self.known[word] = count[len(word)]
            before = word

    def __call__(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        docs = [t.split() if t else [] for t in texts]
        if len(self.known) > self.keep:
            self.known.clear()
        new = set().union(*docs).difference(self.known)
        if new:
            marked = sorted(SPACE_MARK + w for w in new)
            self.walk(marked)
            for w in marked:
                self.known[w[1:]] = self.known.pop(w)
        return [sum(map(self.known.__getitem__, d)) for d in docs], [len(d) for d in docs]


def count_tokens(docs: DataFrame, s: Settings = Settings(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with ``n_tokens`` and ``n_pretokens``."""

    def start() -> Callable[[list], list]:
        table, by_bytes = pieces(s.vocabulary, s.offset)
        counter = TrieCounter(table, s.unknown, s.keep, by_bytes)
        return lambda texts: list(counter(texts))

    return add_columns(docs, text, {"n_tokens": "long", "n_pretokens": "long"}, start, keep, rows=4096)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's numbers of tokens and pre-tokens."""
    return count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
