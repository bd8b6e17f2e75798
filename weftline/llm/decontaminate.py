"""Benchmark decontamination: near copies of benchmark items inside documents, by edit distance.

A document holds an item if some stretch of it is within ``ratio`` of the item's length in edits of UTF-8 bytes (both in
normal form: lower case, each run of white space and of ASCII characters other than letters and digits a single space; all
characters beyond ASCII stay).

1. *Windows.* Of each item-sized stretch, only those that can be within the distance are looked at. An item is tiled by
   pieces of q bytes (spaces too), which don't overlap, so that an edit of a byte changes at most one. With k allowed edits,
   of its k + m rarest pieces at least m stand unchanged in a copy, each telling where the copy starts to within k bytes.
   Stretches without m such pieces are passed over; no near copy is among them, whatever its edits do to words. Each item
   has the q of at most 8 that leaves the most bytes to be found, m q; m is at least 1, as q is at most size / (k + 1).
2. *Embedding.* Each window, and each item, is mapped by CGK random walks (Chakraborty, Goldenberg, Koucky 2016): step t
   writes the character under the pointer, and a random bit of (t, character) says whether the pointer moves. Few edits
   become few differing positions of equally long strings. An item of two tiles or more is embedded tile by tile, and a
   window of each tile is where an unchanged piece of it stands.
3. *LSH.* Each of ``bands`` keys samples ``bits`` positions of one of ``walks`` walks. An item that agrees with a window in
   a key is a candidate. With half of the positions equal, the defaults find a pair with probability 1 - (1 - 2^-6)^1024,
   above 0.9999, and with three tenths equal above 0.52; a copy gives several windows, and nearer copies have more equal
   positions.
4. *Verification.* The exact edit distance of each candidate item to the best stretch around its windows. Windows of one copy
   are merged first, so that a copy is verified once, and a column of distances is a few numbers of many bits.

The benchmark is a list of questions, not a corpus: it is broadcast if its text has at most ``max_item_chars`` characters,
and is otherwise cut into parts of that size, one pass each. Documents are read once a part, are never shuffled, and long
texts are taken whole.

Edge cases: NULL and empty texts hold nothing; items that are NULL or have no letter or digit are passed over; items with
equal normal forms are all reported; rows with repeated ids are each looked at and reported once an id; empty tables give no
rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, plain_words, read, slices, where_text


@dataclass(frozen=True)
class Settings:
    ratio: float = 0.1
    whole_pieces: int = 6
    walks: int = 16
    bands: int = 1024
    bits: int = 6
    seed: int = 11
    max_item_chars: int = 4_000_000
    tile: int = 1024
    walk_bytes: int = 64 << 20


@dataclass(frozen=True)
class Item:
    item_id: int
    text: bytes
    edits: int


@lru_cache(maxsize=256)
def _moves(seed: int, walks: int, steps: int) -> np.ndarray:
    """Random bits of the walks: walk, step, byte; eight bits a number."""
    return np.random.default_rng(seed).integers(0, 256, (walks, steps, 32), dtype=np.uint8)


def cgk(texts: np.ndarray, steps: int, s: Settings) -> np.ndarray:
    """CGK strings of equally long byte rows (n by length): walks by n by ``steps``; past the end a walk writes zeros."""
    n, length = texts.shape
    padded = np.concatenate([texts, np.zeros((n, steps - length + 1), np.uint8)], 1).reshape(-1)
    moves = _moves(s.seed, s.walks, steps)
    at = np.tile(np.arange(n, dtype=np.int64) * (steps + 1), (s.walks, 1))
    walk = np.arange(s.walks)[:, None]
    out = np.empty((steps, s.walks, n), np.uint8)
    for t in range(steps):
        out[t] = padded[at]
        at += moves[walk, t, out[t] >> 3] >> (out[t] & 7) & 1
    return out.transpose(1, 2, 0)


def edit_distance_within(item: bytes, stretch: bytes) -> int:
    """Least edit distance of ``item`` to any part of ``stretch``: bits of whole columns at a time (Myers 1999)."""
    item, stretch = bytes(item), bytes(stretch)
    size, letters = len(item), np.frombuffer(item, np.uint8)
    places = {int(c): int.from_bytes(np.packbits(letters == c, bitorder="little").tobytes(), "little") for c in np.unique(letters)}
    full, last = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size  # where the column's next number is one more, one less; its last number
    least = size
    for c in stretch:
        same = places.get(c, 0)
        level = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        if more & last:
            score += 1
        elif less & last:
            score -= 1
            least = min(least, score)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (full & ~(level | more)), more & level
    return least


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and how often each stands."""
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[first], np.diff(np.append(first, len(values)))


def _grams(texts: bytes, q: int) -> np.ndarray:
    """The q bytes (at most 8) from each place on, as a number; past the end come zeros."""
    return np.ndarray((len(texts),), "<u8", texts + bytes(8), strides=(1,)) & np.uint64((1 << 8 * q) - 1)


def _piece(size: int, edits: int, most: int) -> tuple[int, int]:
    """Bytes of the pieces of an item, and how many of any ``edits`` more are unchanged in a copy."""
    fit = [(min(most, size // q - edits), q) for q in range(1, min(8, size // (edits + 1)) + 1)]
    need, q = max(fit, key=lambda x: (x[0] * x[1], x[1]))
    return q, need


#: Bits of the hashes that tell most places of a text from pieces.
HASH_BITS = 20


def _hashed(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)


def merged(places: list[int], gap: int) -> Iterator[tuple[int, int]]:
    """First and last of the runs of sorted places that are no more than ``gap`` apart."""
    low = high = places[0]
    for p in places[1:]:
        if p > high + gap:
            yield low, high
            low = p
        high = p
    yield low, high


class Index:
    """Items, their anchor pieces, and the keys of their embeddings, by size of item."""

    def __init__(self, items: list[tuple[int, str | None]], s: Settings):
        if not 0 <= s.ratio < 1 or s.whole_pieces < 1:
            raise ValueError("ratio must be at least 0 and below 1, whole_pieces at least 1")
        self.s = s
        rng = np.random.default_rng(s.seed + 1)
        self.items: list[Item] = []
        for item_id, text in sorted(items, key=lambda x: x[0]):
            joined = b" ".join(plain_words(text))
            if joined:
                self.items.append(Item(item_id, joined, int(s.ratio * len(joined))))
        pieces = [_piece(len(x.text), x.edits, s.whole_pieces) for x in self.items]
        self.need = np.array([m for _, m in pieces], np.int64)
        whole = b"\0".join(x.text for x in self.items)
        #: For each q: bits of the hashes of the pieces, the sorted pieces, and the number of the first of them.
        self.anchors: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        anchors = []
        for size in sorted({q for q, _ in pieces}):
            often = np.unique(_grams(whole, size), return_counts=True)
            own: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for k, item in enumerate(self.items):
                if pieces[k][0] == size:
                    tiles = _grams(item.text, size)[: len(item.text) - size + 1 : size]
                    # the rarest pieces of the item, by the benchmark
                    rare = np.argsort(often[1][np.searchsorted(often[0], tiles)], kind="stable")[: item.edits + int(self.need[k])]
                    for i in rare.tolist():
                        own[int(tiles[i])].append((k, i * size))
            ranked = np.array(sorted(own), np.uint64)
            bits = np.zeros(1 << HASH_BITS, np.bool_)
            bits[_hashed(ranked)] = True
            self.anchors.append((size, bits, ranked, len(anchors)))
            anchors += [own[x] for x in ranked.tolist()]
        self.of = [np.array(x, np.int64) for x in anchors]
        self.count = np.array([len(x) for x in self.of] or [0])
        self.first = np.append(0, np.cumsum(self.count))[:-1]
        self.flat = np.concatenate(self.of) if self.of else np.zeros((0, 2), np.int64)
        self.size = np.array([len(x.text) for x in self.items])
        self.edits = np.array([x.edits for x in self.items])
        # many edits lose the walks for good, so that a long item is looked for tile by tile
        self.tiles = np.where(self.size >= 2 * s.tile, self.size // s.tile, 1)
        whole = np.where(self.tiles > 1, s.tile, self.size)
        # a window is as long as the shortest item of its size class, so that both strings are full
        ladder = np.unique((1.1 ** np.floor(np.log(np.maximum(whole, 1)) / np.log(1.1))).astype(np.int64)) if len(whole) else whole
        self.group = ladder[np.searchsorted(ladder, whole, "right") - 1] if len(whole) else whole
        self.places: dict[int, np.ndarray] = {}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.group):
            own = np.array([(k, t) for k in np.flatnonzero(self.group == size).tolist() for t in range(self.tiles[k])])
            self.places[size] = rng.integers(0, max(1, 3 * size // 2), (s.bands, s.bits))
            keys = self.keys(np.stack([np.frombuffer(self.items[k].text[t * s.tile :][:size], np.uint8) for k, t in own.tolist()]), size)
            order = np.argsort(keys.T, axis=1, kind="stable")
            self.tables[int(size)] = own, np.take_along_axis(keys.T, order, 1), order

    def keys(self, texts: np.ndarray, size: int) -> np.ndarray:
        """The sampled bytes of each row and band, as one number."""
        steps, places = max(1, 3 * int(size) // 2), self.places[size]
        weights = np.uint64(256) ** np.arange(self.s.bits, dtype=np.uint64)  # up to 8 bits
        out = np.empty((len(texts), self.s.bands), np.uint64)
        block = max(1, self.s.walk_bytes // (steps * self.s.walks))
        for k in range(0, len(texts), block):
            walked = cgk(texts[k : k + block], steps, self.s)
            for b in range(self.s.bands):
                out[k : k + block, b] = walked[b % self.s.walks][:, places[b]].astype(np.uint64) @ weights
        return out

    def retrieve(self, texts: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        """Sorted (row of ``texts``, item, tile) that share a key."""
        own, ranked, order = self.tables[size]
        keys = self.keys(texts, size)
        pairs = []
        for band in range(self.s.bands):
            low, high = np.searchsorted(ranked[band], keys[:, band], "left"), np.searchsorted(ranked[band], keys[:, band], "right")
            for w in np.flatnonzero(high > low).tolist():
                pairs += [(w, *own[k].tolist()) for k in order[band, low[w] : high[w]]]
        return sorted(set(pairs))

    def _enough(self, cells: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Cells that hold, with the one before or after, as many pieces as their item needs."""
        beside = np.append(cells[1:] == cells[:-1] + 1, False)[: len(cells)]
        enough = pieces + np.where(beside, np.append(pieces[1:], 0)[: len(cells)], 0) >= self.need[(cells >> 34) % len(self.items)]
        return enough | np.append(False, (enough & beside)[:-1])[: len(cells)]

    def windows(self, doc: np.ndarray, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Rows (size class, document, byte place) where an item or a tile of a long one may start, from the anchors found and their byte places."""
        each = self.count[anchor]
        inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        found = self.flat[np.repeat(self.first[anchor], each) + inner]
        doc, item, offset = np.repeat(doc, each), found[:, 0], found[:, 1]
        start = np.repeat(at, each) - offset
        # unchanged pieces of a near copy say where it starts to within its edits, so that they fall into two cells side by side
        width = 2 * self.edits[item] + 1
        cell = (doc * len(self.items) + item) * (1 << 34) + (start + (1 << 32)) // width
        # few cells are full enough even if pieces count more than once; only these are counted in full
        order = np.argsort(cell)
        cells, size = _runs(cell[order])
        inside = order[np.repeat(self._enough(cells, size), size)]
        inside = inside[np.lexsort((offset[inside], cell[inside]))]
        cells, size = _runs(cell[inside])
        new = np.append(True, (np.diff(cell[inside]) != 0) | (np.diff(offset[inside]) != 0))[: len(inside)]
        pieces = np.add.reduceat(new.astype(np.int64), np.cumsum(size) - size) if len(inside) else size
        inside = inside[np.repeat(self._enough(cells, pieces), size)]
        tile = np.minimum(offset[inside] // self.s.tile, self.tiles[item[inside]] - 1)
        return np.unique(np.stack([self.group[item[inside]], doc[inside], np.maximum(start[inside] + tile * self.s.tile, 0)], 1), axis=0)

    def found(self, normal: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, byte place and number of the anchors in texts of normal form."""
        whole = b"\0".join(normal)  # no piece holds the zero
        begin = np.append(0, np.cumsum([len(x) + 1 for x in normal]))
        place, anchor = [], []
        for low in range(0, len(whole), 1 << 18):
            for size, bits, ranked, first in self.anchors:
                grams = _grams(whole[low : low + (1 << 18) + size - 1], size)[: 1 << 18]
                some = np.flatnonzero(bits[_hashed(grams)])
                rank = np.minimum(np.searchsorted(ranked, grams[some]), len(ranked) - 1)
                same = ranked[rank] == grams[some]
                place.append(some[same] + low)
                anchor.append(rank[same] + first)
        at = np.concatenate(place) if place else np.zeros(0, np.int64)
        doc = np.searchsorted(begin, at, "right") - 1
        return doc, at - begin[doc], np.concatenate(anchor) if anchor else at

    def search(self, texts: list[str | None]) -> list[list[tuple[int, int]]]:
        """For each text, (item_id, edits) of the items that it holds."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        normal = [b" ".join(plain_words(text)) for text in texts]
        doc, at, anchor = self.found(normal)
        if not len(doc):
            return out
        windows = self.windows(doc, at, anchor)
        candidates: dict[tuple[int, int], list[int]] = defaultdict(list)
        for size in np.unique(windows[:, 0]).tolist():
            all_of = windows[windows[:, 0] == size, 1:]
            for k in range(0, len(all_of), 4096):
                some = all_of[k : k + 4096].tolist()
                cut = b"".join(normal[d][p : p + size].ljust(size, b"\0") for d, p in some)
                for w, i, t in self.retrieve(np.frombuffer(cut, np.uint8).reshape(-1, size), size):
                    candidates[some[w][0], i].append(max(0, some[w][1] - t * self.s.tile))
        best: dict[tuple[int, int], int] = {}
        for (d, i), places in candidates.items():
            item = self.items[i]
            for low, high in merged(sorted(places), 4 * item.edits):
                part = normal[d][max(0, low - 2 * item.edits) : high + len(item.text) + 2 * item.edits]
                edits = 0 if item.text in part else edit_distance_within(item.text, part)
                if edits <= item.edits:
                    best[d, i] = min(edits, best.get((d, i), edits))
                    if edits == 0:
                        break
        for (d, i), edits in sorted(best.items()):
            out[d].append((self.items[i].item_id, edits))
        return out


def _parts(benchmark: DataFrame, s: Settings) -> list[list[tuple[int, str]]]:
    """The items in lists of at most ``max_item_chars`` characters each (or of one item)."""
    out: list[list[tuple[int, str]]] = [[]]
    room = s.max_item_chars
    for r in benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if len(r["text"]) > room and out[-1]:
            out.append([])
            room = s.max_item_chars
        out[-1].append((r["item_id"], r["text"]))
        room -= len(r["text"])
    return [x for x in out if x]


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(doc_id, item_id, edits, similarity)``: the items that each document holds, with the least number of edits."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "doc_id long, item_id long, edits int, similarity double"
    found = None
    for items in _parts(benchmark, s):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, s)
            size = {x.item_id: len(x.text) for x in index.items}
            for b in slices(batches, 512):
                held = index.search(b.column(1).to_pylist())
                rows = [(d, i, e, 1 - e / size[i]) for d, x in zip(b.column(0).to_pylist(), held, strict=True) for i, e in x]
                if rows:
                    d, i, e, r = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(e, pa.int32()), pa.array(r, pa.float64())], names=["doc_id", "item_id", "edits", "similarity"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], schema)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"), F.max("similarity").alias("similarity"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item, picked in the pass that looks for them; no text is shuffled."""
    s = Settings()
    for items in _parts(read(spark, sf_dir, "benchmark"), s):
        shared = spark.sparkContext.broadcast(items)

        def start(shared=shared) -> Callable[[list], list[bool]]:
            index = Index(shared.value, s)
            return lambda texts: [not held for held in index.search(texts)]

        docs = where_text(docs, start)
    return docs
