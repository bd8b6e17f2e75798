"""Alignment of two tokenizers by inverted bitmaps of token pairs.

Both tokenizers cut the bytes of space + text. Where a token of each ends at one offset, the two are linked, and such offsets
cut the tokens into groups. How often a pair of ids is linked in the corpus is its count.

1. One pass of Arrow batches encodes every whole text. Neither tokenizer has a token over the place before a space that
   follows another character, so a text is a row of segments (a word with its space), each encoded and aligned once a task and
   reused; a bounded cache holds them. This finds groups and links of a text without holding all of its tokens.
2. A chunk is up to 65,536 documents or ``chunk_bytes`` of text of one task. For each pair of ids it has an inverted list of the
   documents that link it: a bitmap of their numbers in the chunk, kept as sorted 16-bit numbers or as bits, whichever is
   shorter. Plane 0 is the bitmap of all these documents, plane k > 0 that of those whose number of links less one has
   bit k - 1, so links are counted from the planes.
3. Planes of a pair are over disjoint chunks: their union over the corpus is their concatenation, and document and link counts
   are sums of their set bits, added in tasks before they are shuffled. Of each id of the second tokenizer the largest count is found.
4. Counts go back to the planes by a broadcast of checked size, or a shuffle beyond it, and each chunk adds them up by
   document. Texts aren't shuffled, and a pair in every document is a row for each chunk.

Edge cases: NULL and empty texts, and texts whose tokens of either kind don't spell space + text (as with U+2581), have no tokens:
zeros and an empty digest; repeated rows are documents each; a NULL id is kept; special tokens' strings are plain text; an
empty table gives no rows; a stretch without any space, however long, is one segment.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _path, engine
from .common import bounded_batches, checkpointed, read, sized_broadcast, slices


@dataclass(frozen=True)
class Settings:
    """``keep_bytes`` bounds the cache of segments, ``chunk_bytes`` and ``chunk_rows`` (65,536 at most) a chunk."""

    vocabulary: str = "byte_bpe_50k.tiktoken"
    tokenizer: str = "byte_bpe_50k.json"
    pieces: str = "piece_bpe_32k.model"
    keep_bytes: int = 48 << 20
    chunk_bytes: int = 16 << 20
    chunk_rows: int = 1 << 16


@cache
def piece_engine(name: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """The second tokenizer and the bytes of each of its pieces; special and unknown ones have none that occur in a text."""
    model = sentencepiece.SentencePieceProcessor(model_file=_path(name))
    table = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            table.append(bytes([int(piece[3:5], 16)]))
        else:
            table.append(b"\xff" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    if any("▁" in piece.lstrip("▁") for piece in map(model.id_to_piece, range(model.get_piece_size()))):
        raise ValueError("a piece has a space after another character: segments can't be encoded by themselves")
    return model, table


#: A space after white space: no place to cut at.
LOOSE = re.compile(r"\s ")
#: Where a long text may be cut.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Characters of a text that are handled at a time.
BLOCK = 1 << 20


def stretches(text: str) -> Iterator[str]:
    """A long text in parts that both tokenizers encode as they do in place; each but the first is meant with the space before it."""
    start = 0
    while start + BLOCK < len(text):
        found = CUT.search(text, start + BLOCK)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start() + 1
    yield text[start:]


def segments(text: str) -> list[str]:
    """Words of a text, each meant with a space before it, that both tokenizers encode as they do in place."""
    words = text.split(" ")
    if words[0] and words[-1] and not LOOSE.search(text):
        return words
    out, now = [], words[0]
    for word in words[1:]:
        if not now or now[-1].isspace():
            now = f"{now} {word}"
        else:
            out.append(now)
            now = word
    if not now and out:  # a last space by itself
        out[-1] += " "
        return out
    return [*out, now]


class Column:
    """A growing array."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1024, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(self.n, len(x)), self.data.dtype)])
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)


class Aligner:
    """Encodes and aligns segments, and numbers those it has seen; columns by number have what a segment adds to a text.

    New segments of a text are encoded together, as both tokenizers cut between them; ``n_a`` is -1 where bytes differ.
    """

    def __init__(self, s: Settings):
        self.s = s
        self.a, self.bytes_a, _ = engine(s.vocabulary, s.tokenizer)
        self.b, self.bytes_b = piece_engine(s.pieces)
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.names = list(map(str, range(max(len(self.len_a), len(self.len_b)))))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.n_links, self.starts, self.pairs = (Column(np.int64) for _ in range(5))
        self.held = 0

    def full(self) -> bool:
        return self.held > self.s.keep_bytes

    def keep(self, parts: list[str], n_a: np.ndarray, n_b: np.ndarray, n_links: np.ndarray, pairs: np.ndarray, groups: list[str]) -> None:
        first, starts = len(self.number), self.pairs.n + np.cumsum(n_links) - n_links
        self.number.update(zip(parts, range(first, first + len(parts)), strict=True))
        for column, x in ((self.n_a, n_a), (self.n_b, n_b), (self.n_links, n_links), (self.starts, starts), (self.pairs, pairs)):
            column.add(x)
        self.groups += groups
        self.held += 2 * sum(map(len, parts)) + sum(map(len, groups)) + 8 * len(pairs) + 260 * len(parts)

    def learn(self, parts: list[str]) -> None:
        """Encodes and aligns new segments. Several must neither begin nor end with white space."""
        text = " ".join(parts)
        a, b = np.array(self.a.encode_ordinary(" " + text), np.int64), np.array(self.b.encode(text), np.int64)
        data = (" " + text).encode("utf-8", "replace")
        sizes = map(len, parts) if text.isascii() else (len(p.encode("utf-8", "replace")) for p in parts)
        ends = np.cumsum(np.fromiter(sizes, np.int64, len(parts)) + 1)
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        fine = b"".join(map(self.bytes_b.__getitem__, b.tolist())) == data and ends_a[-1] == len(data)  # the first tokenizer only cuts bytes
        common = np.intersect1d(ends_a, ends_b, assume_unique=True) if fine else ends[:0]
        if not fine or not np.isin(ends, common).all():
            if len(parts) == 1:
                none = np.zeros(1, np.int64)
                return self.keep(parts, none - 1, none - 1, none, none[:0], [""])
            half = len(parts) // 2
            self.learn(parts[:half])
            return self.learn(parts[half:])
        at_a, at_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        last = np.searchsorted(common, ends)  # the last group of each segment
        self.keep(parts, np.diff(at_a[last] + 1, prepend=0), np.diff(at_b[last] + 1, prepend=0), np.diff(last + 1, prepend=0), a[at_a] << 32 | b[at_b], self.written(a, b, ends_a, ends_b, common, at_a, at_b, last))

    def written(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, common: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, last: np.ndarray) -> list[str]:
        """The groups of each segment as text: all ids in the order of groups, with what stands before each."""
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        place_a = np.arange(len(a)) + np.append(0, at_b + 1)[group_a]
        place_b = np.arange(len(b)) + (at_a + 1)[group_b]
        ids, marks = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        begins = np.ones(len(common), np.int64)  # a group begins with ";", the first one of a segment with a new line
        begins[np.append(0, last[:-1] + 1)] = 2
        marks[place_a[np.append(0, at_a[:-1] + 1)]] = begins
        marks[place_b[np.append(0, at_b[:-1] + 1)]] = 3
        signs = map((",", ";", "\n", "|").__getitem__, marks.tolist())
        return "".join(chain.from_iterable(zip(signs, map(self.names.__getitem__, ids.tolist()), strict=True))).split("\n")[1:]

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The numbers of segments; new ones are aligned."""
        new = [p for p in dict.fromkeys(parts) if p not in self.number]
        safe = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        if safe:
            self.learn(safe)
        if len(safe) < len(new):
            for p in set(new).difference(safe):
                self.learn([p])
        return np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))

    def links(self, at: np.ndarray) -> np.ndarray:
        """The linked pairs of segments, one after the other."""
        n = self.n_links.data[at]
        return self.pairs.data[np.arange(n.sum()) + np.repeat(self.starts.data[at] - np.cumsum(n) + n, n)]


class Chunk:
    """Documents of a chunk and their links, as numbers of documents and pairs."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0
        self.docs: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []

    def links(self, row: int, pairs: np.ndarray) -> None:
        self.docs.append(np.full(len(pairs), row, np.uint16))
        self.pairs.append(pairs)

    def planes(self) -> Iterator[tuple[int, int, int, bytes]]:
        """``(pair, plane, documents, container)``: an inverted list a pair and plane."""
        if not self.pairs:
            return
        pair, doc = np.concatenate(self.pairs), np.concatenate(self.docs)
        b = pair & 0xFFFFFFFF
        size = int(b.max()) + 1
        key = ((pair >> 32) * size + b) << 16 | doc  # ids of at most 23 bits
        key.sort()
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        more = np.diff(np.append(starts, len(key))) - 1
        key = key[starts]
        at, doc = key >> 16, (key & 0xFFFF).astype(np.uint16)
        at = (at // size) << 32 | at % size
        for plane in range(1 + int(more.max()).bit_length()):
            set_ = np.ones(len(key), bool) if plane == 0 else (more >> (plane - 1) & 1).astype(bool)
            if not set_.any():
                continue
            pairs, docs = at[set_], doc[set_]
            starts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            ends = np.append(starts[1:], len(pairs))
            data = docs.tobytes()
            for p, low, high in zip(pairs[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
                yield p, plane, high - low, container(data[2 * low : 2 * high])


def container(numbers: bytes) -> bytes:
    """Sorted 16-bit numbers as they are (after a 0), or as bits (after a 1), whichever is shorter."""
    if len(numbers) > 128:
        x = np.frombuffer(numbers, np.uint16)
        if int(x[-1]) // 8 + 1 < len(numbers):
            bits = np.zeros((int(x[-1]) // 8 + 1) * 8, np.uint8)
            bits[x] = 1
            return b"\1" + np.packbits(bits, bitorder="little").tobytes()
    return b"\0" + numbers


def members(container: bytes) -> np.ndarray:
    """The numbers in a container."""
    if container[:1] == b"\1":
        return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8, offset=1), bitorder="little"))
    return np.frombuffer(container, np.uint16, offset=1)


#: Rows of documents have a NULL pair and plane, rows of inverted lists no doc_id: both come from one pass over the texts.
INDEX = "chunk long, pair long, plane int, n long, list binary, row int, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"


def index(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Rows of ``INDEX`` of ``docs (doc_id, text)``: documents with their groups, and the inverted lists of pairs by chunk."""
    if not 0 < s.chunk_rows <= 1 << 16:
        raise ValueError("a chunk has from 1 to 65,536 documents")
    bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in INDEX.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def batch(columns: list[list | None], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def sent(chunk: Chunk, number: int) -> Iterator[pa.RecordBatch]:
        rows = list(zip(*chunk.rows, strict=True))
        n = len(chunk.rows)
        yield batch([[number] * n, None, None, None, None, list(range(n)), *map(list, rows)], n)
        waiting: list[tuple] = []
        for row in chunk.planes():
            waiting.append(row)
            if len(waiting) == 20_000:
                yield batch([[number] * len(waiting), *map(list, zip(*waiting, strict=True)), *[None] * 6], len(waiting))
                waiting = []
        if waiting:
            yield batch([[number] * len(waiting), *map(list, zip(*waiting, strict=True)), *[None] * 6], len(waiting))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, chunk, number = Aligner(s), Chunk(), TaskContext.get().partitionId() << 32
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                chunk.rows.append((doc_id, *document(align, chunk, text)))
                chunk.size += len(text or "")
                if len(chunk.rows) == s.chunk_rows or chunk.size >= s.chunk_bytes:
                    yield from sent(chunk, number)
                    chunk, number = Chunk(), number + 1
        if chunk.rows:
            yield from sent(chunk, number)

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


def document(align: Aligner, chunk: Chunk, text: str | None) -> tuple[int, int, int, str]:
    """Numbers of tokens and groups of a text, and the digest of its groups; its links go to the chunk."""
    if not text:
        return 0, 0, 0, ""
    sums, digest, found = np.zeros(3, np.int64), hashlib.sha256(), []
    for part in stretches(text):
        if align.full():
            align.clear()
        at = align.numbers(segments(part))
        n_a = align.n_a.data[at]
        if n_a.min() < 0:
            return 0, 0, 0, ""
        sums += n_a.sum(), align.n_b.data[at].sum(), align.n_links.data[at].sum()
        if found:
            digest.update(b";")
        digest.update(";".join(map(align.groups.__getitem__, at.tolist())).encode())
        found.append(align.links(at))
    for pairs in found:
        chunk.links(len(chunk.rows), pairs)
    return *sums.tolist(), digest.hexdigest()


def pair_counts(lists: DataFrame) -> DataFrame:
    """``(pair, docs, links)`` of inverted lists: set bits of plane 0, and of all planes by their weight."""
    links = F.when(F.col("plane") == 0, F.col("n")).otherwise(F.col("n") * F.expr("shiftleft(1L, plane - 1)"))
    return lists.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("docs"), F.sum(links).alias("links"))


def best_pairs(counts: DataFrame) -> DataFrame:
    """``counts`` with ``best``: 1 where no other pair of the second id has more links."""
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "docs", "links", (F.col("links") == F.col("most")).cast("long").alias("best"))


def scores(lists: DataFrame, counts: DataFrame) -> DataFrame:
    """``(chunk, row, n_best, count_sum)``: sums over a document's links, from the lists it is in; perhaps several rows a document."""
    known = counts.select("pair", "links", "best")
    small = sized_broadcast(known)
    joined = lists.select("chunk", "pair", "plane", "list").join(small, "pair").select("chunk", "plane", "list", "links", "best")
    if small is known:  # after a shuffle by pair the rows of a chunk are together again
        joined = joined.repartition("chunk").sortWithinPartitions("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, best = None, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

        def rows() -> pa.RecordBatch:
            at = np.flatnonzero(count)
            out = pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now, np.int64)), pa.array(at, pa.int32()), pa.array(best[at]), pa.array(count[at])], names=["chunk", "row", "n_best", "count_sum"])
            count[:], best[:] = 0, 0
            return out

        for b in batches:
            if not b.num_rows:
                continue
            chunks, planes, links, bests = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4))
            cuts = np.flatnonzero(np.append(True, chunks[1:] != chunks[:-1])).tolist()
            for low, high in zip(cuts, [*cuts[1:], len(chunks)], strict=True):
                if chunks[low] != now:
                    if now is not None:
                        yield rows()
                    now = int(chunks[low])
                lists = [members(x) for x in b.column(2).slice(low, high - low).to_pylist()]
                weight = np.int64(1) << np.maximum(planes[low:high].astype(np.int64) - 1, 0)
                at, sizes = np.concatenate(lists).astype(np.int64), np.fromiter(map(len, lists), np.int64, len(lists))
                np.add.at(count, at, np.repeat(weight * links[low:high], sizes))
                np.add.at(best, at, np.repeat(weight * bests[low:high], sizes))
        if now is not None:
            yield rows()

    return joined.mapInArrow(run, "chunk long, row int, n_best long, count_sum long")


def align(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs (doc_id, text)`` with its numbers, digest and scores, and ``(pair, docs, links, best)`` of the corpus."""
    made = checkpointed(index(docs, s))
    lists = made.where("pair IS NOT NULL")
    counts = checkpointed(best_pairs(checkpointed(pair_counts(lists))))
    rows = made.where("pair IS NULL").select("chunk", "row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    both = rows.unionByName(scores(lists, counts), allowMissingColumns=True)
    own = [F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    found = both.groupBy("chunk", "row").agg(*own, *sums)
    return found.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"), counts


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment of the two public tokenizers."""
    return align(read(spark, sf_dir, "documents").select("doc_id", "text"))[0]
