"""Source divergence audit over K-squared quadtrees of the group-term count matrix.

A group is a (lang, source); its terms are runs of non-ASCII characters and ASCII letters, the latter lower-cased. Of each
lang the terms in at least ``least_docs`` of its documents are kept, V of them. A term of a group has the smoothed share
p = 1 + floor(scale * (count + smooth) / (N + smooth * V)), N being the group's occurrences of kept terms; the lang's own is q.

1. Terms are counted in one pass of Arrow batches, so that a task sends each term of a group once for many texts, and are
   summed by group and term. Texts are never shuffled.
2. The matrix of a lang (sources by kept terms) is cut into tiles: blocks of ``rows`` sources by about ``columns`` terms, dealt
   by the terms' hash. A task has one tile for a pair of blocks of sources, so no group of rows grows with the input.
3. A tile is a quadtree (k = 2), one bitmap a level: a bit is set where the quadrant has a count. Pairs of sources are walked
   down both trees at once: where both quadrants are all zero, every term adds the same |z - z'| for shares z, z' of a count
   of 0, so the quadrant is priced by its width; others go on to their children, down to single cells.
4. Terms that no source of a pair of blocks has are priced likewise, from V. Sums of tiles are added by pair.

All arithmetic is in whole numbers. Edge cases: NULL text, lang and source count as ''; a group without terms takes part, with
count 0 throughout; a lang without kept terms has pairs of value 0; a lang of one source has no pair; repeated rows count
each; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, read, sized_broadcast, slices


@dataclass(frozen=True)
class Settings:
    """``rows`` and ``columns`` bound a tile, ``entries`` the terms that a task holds before it sends them on."""

    least_docs: int = 30
    scale: int = 1_000_000_000
    smooth: int = 5
    top_terms: int = 50
    rows: int = 32
    columns: int = 1024
    entries: int = 400_000


#: Upper-case ASCII letters become lower-case; lower-case ones and bytes of other characters stay; the rest is a space.
TERM_BYTES = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Bytes of a text whose terms are listed at a time.
BLOCK = 1 << 20


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text as UTF-8 bytes, in lists of a bounded number."""
    data = text.encode("utf-8", "replace").translate(TERM_BYTES) if text else b""
    start = 0
    while start < len(data):
        end = data.find(b" ", start + BLOCK)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def term_counts(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term of a group; a row with a NULL term for each group."""
    bounded_batches(docs.sparkSession)
    most = s.entries

    def rows(found: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in found.items():
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            columns = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*columns, terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(d.__getitem__, n)], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in slices(batches):
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, d = found.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in terms_of(text):
                    n.update(terms)
                    seen.update(terms)
                d.update(seen)
            if sum(len(n) + 1 for n, _ in found.values()) > most:
                yield from rows(found)
                found = {}
        yield from rows(found)

    group = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    parts = docs.select("text", *group).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column, s: Settings) -> Column:
    """1 + floor(scale * (count + smooth) / (total + smooth * kept)), exact; 0 where nothing is kept."""
    top = F.lit(s.scale).cast("decimal(10,0)") * (count + s.smooth).cast("decimal(19,0)")
    bottom = (total + s.smooth * kept).cast("decimal(20,0)")
    exact = F.call_function("div", top, F.when(kept > 0, bottom))
    return F.coalesce(1 + exact, F.lit(0)).cast("long")


def pyramid(filled: np.ndarray, levels: int) -> list[np.ndarray]:
    """Bitmaps of a quadtree from cells to the root: whether a quadrant has any filled cell."""
    side = 1 << levels
    cells = np.zeros((side, side), bool)
    cells[: filled.shape[0], : filled.shape[1]] = filled
    out = [cells]
    for _ in range(levels):
        half = len(out[-1]) // 2
        out.append(out[-1].reshape(half, 2, half, 2).any((1, 3)))
    return out


def distances(a: np.ndarray, b: np.ndarray, za: np.ndarray, zb: np.ndarray, same: bool) -> np.ndarray:
    """Sums over columns of |a_i - b_j| for all rows i of ``a`` and j of ``b`` (i < j if they are the same rows).

    ``a`` and ``b`` have shares, 0 where a count is zero; the share is ``za[i]`` or ``zb[j]`` there.
    """
    height, width = max(len(a), len(b)), a.shape[1]
    levels = max(0, int(max(height, width, 1) - 1).bit_length())
    tree_a = pyramid(a > 0, levels)
    tree_b = tree_a if same else pyramid(b > 0, levels)
    cost = np.zeros((len(a), len(b)), np.int64)
    gap = np.abs(za[:, None] - zb[None, :])
    i, j, c = (np.zeros(1, np.int64) for _ in range(3))
    for level in range(levels, -1, -1):
        some = tree_a[level][i, c] | tree_b[level][j, c]
        side = 1 << level
        # all zero in both: each of the quadrant's columns costs the rows' gap
        free = np.zeros((-(-len(a) // side), -(-len(b) // side)), np.int64)
        empty = ~some
        np.add.at(free, (i[empty], j[empty]), np.minimum(width, (c[empty] + 1) * side) - c[empty] * side)
        cost += gap * free.repeat(side, 0).repeat(side, 1)[: len(a), : len(b)]
        i, j, c = i[some], j[some], c[some]
        if level:
            down = np.arange(8)
            i, j, c = ((2 * x[:, None] + (down >> k & 1)).ravel() for k, x in enumerate((i, j, c)))
            half = side >> 1
            inside = (i * half < len(a)) & (j * half < len(b)) & (c * half < width)
            if same:
                inside &= i <= j
            i, j, c = i[inside], j[inside], c[inside]
    x, y = a[i, c], b[j, c]
    np.add.at(cost, (i, j), np.abs(np.where(x > 0, x, za[i]) - np.where(y > 0, y, zb[j])))
    return np.triu(cost, 1) if same else cost


def _tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Partial distances of a tile: rows with a NULL term bring the sources and their share of a count of 0."""
    lang, low, high = key[0].as_py(), key[1].as_py(), key[2].as_py()
    block, source, p = (table.column(k).to_numpy() for k in ("block", "source_no", "p"))
    head = np.asarray(table.column("term").is_null())
    codes = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    columns = int(np.nanmax(np.where(head, -1, codes), initial=-1)) + 1
    parts = []
    for k in (low, high):
        own = block == k
        names = np.sort(source[own & head])
        z = np.zeros(len(names), np.int64)
        z[np.searchsorted(names, source[own & head])] = p[own & head]
        cells = np.zeros((len(names), columns), np.int64)
        at = own & ~head
        cells[np.searchsorted(names, source[at]), codes[at].astype(np.int64)] = p[at]
        parts.append((names, z, cells))
    (ga, za, a), (gb, zb, b) = parts
    cost = distances(a, b, za, zb, low == high)
    i, j = np.triu_indices(len(ga), 1) if low == high else (x.ravel() for x in np.indices(cost.shape))
    made = {"lang": pa.array([lang] * len(i), pa.string()), "a": ga[i], "b": gb[j], "cost": cost[i, j], "columns": np.full(len(i), columns, np.int64), "gap": np.abs(za[i] - zb[j])}
    return pa.table(made)


def audit(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``docs (text, lang, source)``: distances of sources, and terms above the lang's share."""
    counted = checkpointed(term_counts(docs, s))
    terms = counted.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    kept = checkpointed(terms.where(F.col("docs") >= s.least_docs).select("lang", "term", "total"))
    cells = checkpointed(counted.where("term IS NOT NULL").select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("source_total"))
    # one row a group: what the result has a square of
    groups = counted.where("term IS NULL").select("lang", "source").join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["kept", "lang_total", "source_total"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = checkpointed(groups.withColumn("source_no", place.cast("long")).withColumn("sources", F.count("*").over(Window.partitionBy("lang"))))
    few = sized_broadcast(groups)

    p = share(F.col("n"), F.col("source_total"), F.col("kept"), s)
    q = share(F.col("total"), F.col("lang_total"), F.col("kept"), s)
    shares = cells.join(few, ["lang", "source"]).withColumns({"p": p, "q": q})
    above = shares.where("n > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.top_terms)

    # cells and the sources themselves, to each tile and pair of blocks that they are in
    tiles = F.greatest(F.lit(1), F.ceil(F.col("kept") / s.columns)).cast("long")
    block, blocks = F.floor(F.col("source_no") / s.rows), F.ceil(F.col("sources") / s.rows)
    heads = groups.select("lang", "source_no", F.lit(None).cast("string").alias("term"), share(F.lit(0), F.col("source_total"), F.col("kept"), s).alias("p"), block.alias("block"), blocks.alias("blocks"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile"))
    body = shares.where("n > 0").select("lang", "source_no", "term", "p", block.alias("block"), blocks.alias("blocks"), F.pmod(F.xxhash64("term"), tiles).alias("tile"))
    sent = heads.union(body).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "tile", "block", "source_no", "term", "p")
    parts = sent.groupBy("lang", "low", "high", "tile").applyInArrow(_tile, "lang string, a long, b long, cost long, columns long, gap long")
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("cost").alias("cost"), F.sum("columns").alias("columns"), F.first("gap").alias("gap"))
    names = groups.select("lang", "source", "source_no", "kept")
    named = summed.join(sized_broadcast(names.withColumnsRenamed({"source": "source_a", "source_no": "a"})), ["lang", "a"])
    named = named.join(sized_broadcast(names.select("lang", F.col("source").alias("source_b"), F.col("source_no").alias("b"))), ["lang", "b"])
    value = F.col("cost") + (F.col("kept") - F.col("columns")) * F.col("gap")
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("x")
    pairs = named.select("lang", both, value.alias("value")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(above).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's distances to the other sources of its lang, and its terms above the lang's share."""
    return audit(read(spark, sf_dir, "documents").select("text", "lang", "source"))


#: The same by SQL: every source by every kept term.
ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(k.term) AS v, coalesce(sum(total), 0)::HUGEINT AS nl FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN k USING (lang) GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS ng FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
m AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (ng + 5 * v) AS p, 1 + (1000000000::HUGEINT * (total + 5)) // (nl + 5 * v) AS q FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM m WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o) WHERE part = 'pair' OR rank <= 50"""
