"""SimHash near-duplicates by meet-in-the-middle ball hashing.

1. Each text becomes a 64-bit fingerprint of its word shingles, in one pass of Arrow batches.
2. Equal fingerprints are merged first: one row each, with the smallest document id. A group of exact copies, however
   large, is one row from here on.
3. Every fingerprint emits all variants within half of the allowed distance (1 + 64 variants for 2 bits). Two
   fingerprints within the distance share a variant in the middle, so a shuffle on variants brings them together.
   At most as many fingerprints as a ball has points can meet on a variant, so no group is large.
4. Each group links its members to its smallest one; links are deduplicated and verified by counting differing bits.
   Members of a group are within twice the radius of each other, so these stars join all that pairs would.
5. Components of the links, by alternating large and small stars over fingerprints, with a checkpoint a round. A component
   has the smallest document id of its fingerprints.

Edge cases: NULL, empty and blank texts have the fingerprint zero, linked like any other; fewer words than a shingle's
give one shingle of them all; repeated rows give repeated rows; a NULL id gives a row whose component comes from the
others of its group (NULL if there are none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, checkpointed, keyed_join, read, sized_broadcast

SEED = 42


def text_fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash over XXH64 (seed 42) of the shingles of ASCII-lower-cased words, as a signed long."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    if len(tokens) < words:
        grams = [b" ".join(tokens)]
    else:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # very long texts in blocks
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = 3) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with ``simhash`` (long)."""

    def start() -> Callable[[list], list]:
        return lambda texts: [[text_fingerprint(t, words) for t in texts]]

    return add_columns(docs, text, {"simhash": "long"}, start, keep)


def ball(fingerprint: str, radius: int) -> F.Column:
    """Array of all 64-bit variants within ``radius`` (0, 1 or 2) bits of a long column."""
    masks = [0]
    for r in range(radius):
        masks += [a | 1 << b for a in masks if a.bit_count() == r for b in range(64) if 1 << b > a]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    column = F.col(fingerprint)
    return F.array(*[column.bitwiseXOR(F.lit(m).cast("long")) for m in signed])


def ball_links(nodes: DataFrame, distance: int) -> DataFrame:
    """Verified links ``a < b`` (ids) of ``nodes (id, simhash)`` with distinct fingerprints, enough to join all within ``distance``."""
    # a set number of tasks: small rows would be dealt to a few, though each makes a ball of rows
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.select("id", "simhash").repartition(tasks, "simhash")
    variants = dealt.select("id", "simhash", F.explode(ball("simhash", -(-distance // 2))).alias("variant"))
    group = variants.groupBy("variant").agg(F.collect_list(F.struct("id", "simhash")).alias("g")).where(F.size("g") > 1)
    least = F.array_min("g")
    links = group.select(least.alias("x"), F.explode("g").alias("y")).where("y.id > x.id")
    links = links.where(F.bit_count(F.col("x.simhash").bitwiseXOR(F.col("y.simhash"))) <= distance)
    return links.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id in ``links (a, b)``: the smallest id reachable, by alternating large and small stars.

    Each round is two grouped minima and joins over the links that are left; nothing is gathered but a count of changes.
    """
    edges = checkpointed(links.select("a", "b"))
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = keyed_join(both, low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = checkpointed(large)
        # small star: each id's smaller neighbours and the id itself point to the smallest of them
        parent = checkpointed(large.groupBy("b").agg(F.min("a").alias("m")))
        small = keyed_join(large, parent, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b")
        new = checkpointed(small.distinct())
        # done when the links form stars: no id is both a centre and a leaf, and no leaf has two centres
        leaves = new.groupBy("b").agg(F.count("*").alias("n"))
        loose = leaves.where("n > 1").select("b").union(leaves.select("b").join(new.select(F.col("a").alias("b")).distinct(), "b"))
        edges = new
        if loose.isEmpty():
            return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _with_components(marked: DataFrame, distance: int) -> DataFrame:
    """``marked (doc_id, simhash)`` with ``component``, a fingerprint, and ``component_id``, the smallest id of it."""
    prints = marked.groupBy("simhash").agg(F.min("doc_id").alias("least"))
    nodes = checkpointed(prints.select("simhash", F.col("simhash").alias("id"), "least"))
    # components are of fingerprints, so that one whose rows have no id still links its neighbours
    found = nodes.join(components(ball_links(nodes, distance)), "id", "left").select("simhash", F.coalesce("component", "id").alias("component"), "least")
    found = checkpointed(found)
    least = checkpointed(found.groupBy("component").agg(F.min("least").alias("component_id")))
    named = checkpointed(keyed_join(found, least, "component").select("simhash", "component", "component_id"))
    return keyed_join(marked.drop("component", "component_id"), named, "simhash", "left")


def near_duplicates(docs: DataFrame, distance: int = 2, words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``, with ``doc_id``) with ``simhash`` (long) and ``component_id``."""
    return _with_components(checkpointed(fingerprints(docs, keep=keep, words=words)), distance).drop("component")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, distance: int = 2, words: int = 3) -> DataFrame:
    """Of each component one row of ``docs``: of the smallest id, and of its texts that with the smallest hash.

    Rows without id stay. Only ids and hashes are shuffled: the keys of the rows to drop are joined to the documents, by
    broadcast if there are few enough. Texts are shuffled only beyond that, and where the same id and text repeat.
    """
    key = F.xxhash64("text").alias("__key")
    marked = checkpointed(fingerprints(docs.select("doc_id", "text", key).where("doc_id IS NOT NULL"), keep=["doc_id", "__key"], words=words))
    found = checkpointed(_with_components(checkpointed(marked.groupBy("doc_id", "__key", "simhash").agg(F.count("*").alias("n"))), distance))
    first = checkpointed(found.where("doc_id = component_id").groupBy("component").agg(F.min("__key").alias("first")))
    found = keyed_join(found, first, "component", "left")
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("__key") == F.col("first"))
    found = checkpointed(found.select("doc_id", "__key", "n", stays.alias("stays")))
    keyed = docs.withColumn("__key", key)
    drop = sized_broadcast(found.where("NOT stays").select("doc_id", "__key"))
    again = found.where("stays AND n > 1").select("doc_id", "__key")
    kept = keyed.join(drop, ["doc_id", "__key"], "left_anti")
    if not again.isEmpty():
        again = sized_broadcast(again)
        once = kept.join(again, ["doc_id", "__key"], "left_semi").dropDuplicates(["doc_id", "__key"]).select(keyed.columns)
        kept = kept.join(again, ["doc_id", "__key"], "left_anti").select(keyed.columns).union(once)
    return kept.select(docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id (one row of it); rows without id stay."""
    return first_of_each(docs)
