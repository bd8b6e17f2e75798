"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last 16 bytes cuts each text into chunks, so that copies and shared passages are cut alike wherever
they stand. A chunk is encoded once, by itself, and reused in every document of the task that holds it. Near its ends its
tokens may be wrong, as its neighbours weren't seen. So each join is repaired: the text is scanned again from the last place
of the chunk before that doesn't hang on what follows it, pre-token by pre-token over the join and into the new chunk, until
a pre-token starts where one of the new chunk does. From there on both scans are the same, so the chunk's own tokens are
taken from that place to its last sure one. If they never agree, the join goes on over the chunk, up to a whole text if need
be. This needs no spaces and holds in every script.

A place inside a chunk is sure if the character after it is in the chunk too, and the three characters from the start of the
pre-token that ends there: the vocabulary's pattern looks at one character past a pre-token, and its longest fixed
alternative has three. Special tokens are those that the vocabulary's tokenizer file names; they end a text for the pattern,
so the stretches between them are encoded as texts of their own.

The vocabulary files are parameters (paths that executors can read, as they have the tokenizers package, or names in that
package). Nothing is shuffled. The cache of chunks holds at most ``keep_bytes``; when full it is begun anew.

Edge cases: NULL counts as empty and gives no ids; the text of a special token becomes its id and is decoded again to its
text; ids are decoded to bytes and read as UTF-8 with replacement characters for bytes that aren't; NULL ids decode to an
empty text; repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import json
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, read

@dataclass(frozen=True)
class Settings:
    """``mask`` sets the mean chunk (its number of values, in bytes), ``longest`` the longest; ``keep_bytes`` bounds the cache."""

    vocabulary: str = "byte_bpe_50k.tiktoken"
    tokenizer: str = "byte_bpe_50k.json"
    mask: int = 1023
    longest: int = 16_384
    keep_bytes: int = 48 << 20


def _path(name: str) -> str:
    return name if "/" in name else public_tokenizers.path(name)


@cache
def engine(vocabulary: str, tokenizer: str) -> tuple[tiktoken.Encoding, list[bytes], dict[str, int]]:
    """The encoder of a vocabulary file, the bytes of each id, and the special tokens that the tokenizer file names."""
    with open(_path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(_path(tokenizer), encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    table = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for token, rank in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
        table[rank] = token
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), table, special


#: One pseudo-random number a byte value, by a fixed rule.
GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def chunk_ends(data: np.ndarray, mask: int, longest: int) -> np.ndarray:
    """Ends of the content-defined chunks of UTF-8 bytes, the last being the length; never inside a character."""
    n = len(data)
    h = GEAR[data]
    for k in (1, 2, 4, 8):  # after all four, h[i] mixes the bytes i - 15 to i
        shifted = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += shifted
    ends = np.flatnonzero((h >> np.uint32(7)) & np.uint32(mask) == np.uint32(mask)) + 1
    ends = np.append(ends[ends < n], n)
    gaps = np.diff(np.append(0, ends))
    if gaps.max(initial=0) > longest:
        ends = np.concatenate([np.append(np.arange(e - g + longest, e, longest), e) for e, g in zip(ends, gaps, strict=True)])
    inside = np.append(data, 0)[ends] & 0xC0 == 0x80
    while inside.any():
        ends = ends + inside
        inside = np.append(data, 0)[ends] & 0xC0 == 0x80
    return np.unique(ends)


@dataclass(frozen=True)
class Chunk:
    """A chunk encoded by itself. ``starts``: where its pre-tokens start, in characters, the end included; ``tokens``: how many
    ids come before each of these; ``sure``: the number of pre-tokens up to the last sure place."""

    ids: np.ndarray
    starts: list[int]
    tokens: list[int]
    sure: int


class Encoder:
    """Encodes texts; chunks are kept for reuse."""

    def __init__(self, s: Settings = Settings()):
        self.s = s
        self.encoding, table, self.special = engine(s.vocabulary, s.tokenizer)
        self.size = np.fromiter(map(len, table), np.int64, len(table))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.between = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks: dict[str, Chunk] = {}
        self.held = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int32)

    def chunk(self, text: str) -> Chunk:
        """The chunk from the cache, or encoded."""
        found = self.chunks.get(text)
        if found is None:
            ids = self._ids(text)
            pieces = self.pattern.findall(text)
            starts = [0, *accumulate(map(len, pieces))]
            ends = np.cumsum(self.size[ids])
            in_bytes = starts[1:] if text.isascii() else [*accumulate(len(x.encode()) for x in pieces)]
            place = np.searchsorted(ends, in_bytes)
            n = len(pieces)
            while n and not (starts[n] < len(text) and starts[n - 1] + 3 <= len(text)):
                n -= 1
            if starts[-1] != len(text) or not (ends[np.minimum(place, len(ends) - 1)] == in_bytes).all():
                n = 0  # the two scans don't agree on this text: nothing of it is taken
            found = Chunk(ids, starts, [0, *(place + 1).tolist()], n)
            room = 16 * len(text) + 64 * len(pieces) + 500
            if self.held + room > self.s.keep_bytes:
                self.chunks.clear()
                self.held = 0
            if room <= self.s.keep_bytes:
                self.chunks[text] = found
                self.held += room
        return found

    def _stretch(self, text: str, out: list[np.ndarray]) -> None:
        """Appends the ids of a text without special tokens."""
        raw = text.encode("utf-8")
        ends = chunk_ends(np.frombuffer(raw, np.uint8), self.s.mask, self.s.longest).tolist()
        done = begin = first = 0  # characters encoded for good, and where the chunk begins in characters and bytes
        for end in ends:
            part = raw[first:end].decode("utf-8")
            chunk = self.chunk(part)
            k, pieces, agreed = 0, [], begin == 0
            for m in self.pattern.finditer(text, done) if begin else ():
                at = m.start() - begin
                if at >= chunk.starts[chunk.sure]:
                    break
                if at >= 0:
                    k = bisect_left(chunk.starts, at)
                    if agreed := chunk.starts[k] == at:
                        break
                pieces.append(m.group())
            if agreed and chunk.sure > k:
                out.extend(map(self._ids, pieces))
                out.append(chunk.ids[chunk.tokens[k] : chunk.tokens[chunk.sure]])
                done = begin + chunk.starts[chunk.sure]
            begin, first = begin + len(part), end
        if done < len(text):
            out.extend(self._ids(m.group()) for m in self.pattern.finditer(text, done))

    def __call__(self, text: str | None) -> np.ndarray:
        text = text.encode("utf-8", "replace").decode("utf-8") if text else ""
        out: list[np.ndarray] = [np.zeros(0, np.int32)]
        for part in self.between.split(text) if self.between else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.int32))
            elif part:
                self._stretch(part, out)
        return np.concatenate(out)


class Decoder:
    """Decodes ids to texts."""

    def __init__(self, s: Settings = Settings()):
        self.table = engine(s.vocabulary, s.tokenizer)[1]

    def __call__(self, ids: np.ndarray | list[int] | None) -> str:
        if ids is None:
            return ""
        table = self.table
        return b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")


def encode(docs: DataFrame, s: Settings = Settings(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with ``ids`` (array of int)."""

    def start() -> Callable[[list], list]:
        encoder = Encoder(s)
        return lambda texts: [[encoder(t) for t in texts]]

    return add_columns(docs, text, {"ids": "array<int>"}, start, keep, rows=128)


def decode(docs: DataFrame, s: Settings = Settings(), ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with ``decoded`` (string)."""

    def start() -> Callable[[list], list]:
        decoder = Decoder(s)
        return lambda rows: [[decoder(x) for x in rows]]

    return add_columns(docs, ids, {"decoded": "string"}, start, keep, rows=128)


def digests(docs: DataFrame, s: Settings = Settings(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with ``n_tokens`` and digests of the ids and of the text they decode to.

    Encoding and decoding stay in one task, so neither ids nor decoded texts leave it.
    """

    def start() -> Callable[[list], list]:
        encoder, decoder = Encoder(s), Decoder(s)
        names = [str(i) for i in range(len(decoder.table))]

        def sha(x: bytes) -> str:
            return hashlib.sha256(x).hexdigest()

        def work(texts: list) -> list:
            ids = [encoder(t) for t in texts]
            joined = [sha(",".join([names[i] for i in x.tolist()]).encode()) for x in ids]
            return [[len(x) for x in ids], joined, [sha(decoder(x).encode()) for x in ids]]

        return work

    return add_columns(docs, text, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, start, keep, rows=128)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, and digests of its ids and of the text decoded from them."""
    return digests(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents as token ids, with their number and whether they decode to the same text (NULL as empty)."""
    s = Settings()

    def start() -> Callable[[list], list]:
        encoder, decoder = Encoder(s), Decoder(s)

        def work(texts: list) -> list:
            ids = [encoder(t) for t in texts]
            same = [decoder(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
            return [[len(x) for x in ids], ids, same]

        return work

    return add_columns(docs, "text", {"n_tokens": "long", "ids": "array<int>", "round_trip": "boolean"}, start, ["doc_id", "lang", "source"], rows=128)
