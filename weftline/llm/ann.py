"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs, one a shard.

Vectors are lengthened by sqrt(M^2 - |x|^2), M being the largest norm, so that the largest inner product is the least
Euclidean distance. Equal vectors are merged before anything else, each with its ``k + 1`` smallest ids: no answer needs
more of them, and a vector that a third of all rows share is one point. Points are dealt to shards by a hash; in each a graph
is built in blocks: greedy searches from the point nearest the middle propose neighbours, and a neighbour is dropped if a
closer one kept before is nearer to it by the factor ``alpha``, so that diverse edges stay. Edges are made mutual and pruned
again where there are too many.

Every query is searched for in every shard, so shards are few and large: for n points about ``growth`` times the root of n
rows each, from ``least_rows`` to ``most_rows``, and of at most ``most_bytes`` of vectors (which bound a task's memory). A search keeps no table of visited points: a
point that fell out of the beam can't come back into it, so only the beam is compared. Queries are dealt in parts, and a
task has one shard and one part: a beam search of width ``beam`` finds the nearest points, whose inner products are then
taken in double precision on the original vectors. The shards' answers are rows, of which a ranking that drops the worse ones
before the shuffle leaves the ``k`` best of each query.

Edge cases: vectors that are NULL, zero, or hold NULL or non-finite components take no part, nor do those of another
length than most have; rows without id take no part; repeated rows count once; fewer than ``k`` candidates are all returned; ties go to
the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, read


@dataclass(frozen=True)
class Settings:
    k: int = 20
    growth: int = 64
    least_rows: int = 1024
    most_rows: int = 1 << 19
    most_bytes: int = 1 << 27
    part: int = 1 << 16
    degree: int = 32
    beam: int = 96
    build_beam: int = 48
    alpha: float = 1.2
    passes: int = 1
    block: int = 512
    salts: int = 32
    seed: int = 5


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ids and squared distances of the ``beam`` nearest points met, nearest first; -1 and inf fill up."""
    b = len(queries)
    rows = np.arange(b)[:, None]
    norms = np.einsum("nd,nd->n", points, points)
    ids = np.full((b, beam), -1, np.int32)
    dist = np.full((b, beam), np.inf, np.float32)
    open_ = np.zeros((b, beam), bool)
    ids[:, 0], open_[:, 0] = start, True
    dist[:, 0] = norms[start] - 2 * queries @ points[start]
    live = np.arange(b)  # queries with points to expand
    while len(live):
        r = rows[: len(live)]
        own_ids, own_dist, own_open = ids[live], dist[live], open_[live]
        order = np.argsort(~own_open, axis=1, kind="stable")[:, :width]  # the nearest that aren't expanded
        some = own_open[r, order]
        own_open[r, order] = False
        near = np.where(some[:, :, None], graph[own_ids[r, order]], -1).reshape(len(live), -1).astype(np.int32)
        both = np.concatenate([own_ids, near], 1)
        by = np.argsort(both, axis=1, kind="stable")
        ranked = np.take_along_axis(both, by, 1)
        again = np.zeros(both.shape, bool)  # in the beam already, or reached from two points
        np.put_along_axis(again, by[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        fresh = (near >= 0) & ~again[:, beam:]
        d = norms[near] - 2 * np.matmul(points[near], queries[live][:, :, None])[:, :, 0]
        all_d = np.concatenate([own_dist, np.where(fresh, d, np.inf)], 1)
        pick = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live] = both[r, pick], all_d[r, pick]
        open_[live] = np.concatenate([own_open, fresh], 1)[r, pick] & np.isfinite(dist[live])
        live = live[open_[live].any(1)]
    return np.where(np.isfinite(dist), ids, -1).astype(np.int64), dist + (queries**2).sum(1, keepdims=True)


def robust_prune(points: np.ndarray, own: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's proposed neighbours (-1: none) at most ``degree``, by relaxed distance pruning; -1 fills up."""
    b, c = near.shape
    rows = np.arange(b)
    these = points[near]
    norms = np.einsum("bcd,bcd->bc", these, these)
    at = points[own]
    d = norms + (at**2).sum(1)[:, None] - 2 * np.matmul(these, at[:, :, None])[:, :, 0]
    d[(near < 0) | (near == own[:, None])] = np.inf
    order = np.argsort(near, axis=1, kind="stable")
    again = np.zeros_like(near, bool)
    again[rows[:, None], order[:, 1:]] = near[rows[:, None], order[:, 1:]] == near[rows[:, None], order[:, :-1]]
    d[again] = np.inf
    out = np.full((b, degree), -1, np.int64)
    for r in range(degree):
        best = d.argmin(1)
        good = np.isfinite(d[rows, best])
        if not good.any():
            break
        picked = near[rows, best]
        out[good, r] = picked[good]
        between = norms + norms[rows, best][:, None] - 2 * np.matmul(these, these[rows, best][:, :, None])[:, :, 0]
        d[(alpha * alpha * between <= d) | ~good[:, None]] = np.inf
        d[rows, best] = np.inf
    return out


def build_graph(points: np.ndarray, s: Settings) -> tuple[np.ndarray, int]:
    """Neighbours of each point (-1 fills up), and the point to start from."""
    n = len(points)
    rng = np.random.default_rng(s.seed)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    if n <= s.degree + 1:
        every = np.tile(np.arange(n), (n, 1))
        return np.where(every == np.arange(n)[:, None], -1, every), start
    graph = rng.integers(0, n, (n, s.degree))
    graph[:, s.degree // 2 :] = -1
    for turn in range(s.passes):
        alpha = 1.0 if turn < s.passes - 1 else s.alpha
        order = rng.permutation(n)
        for k in range(0, n, s.block):
            own = order[k : k + s.block]
            met, _ = beam_search(points, graph, start, points[own], s.build_beam)
            graph[own] = robust_prune(points, own, np.concatenate([met, graph[own]], 1), s.degree, alpha)
            source, target = np.repeat(own, s.degree), graph[own].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            target, source = target[by], source[by]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            place = np.arange(len(target)) - np.repeat(first, count)
            for part in range(0, int(count.max(initial=0)), s.degree):  # new edges into a point, so many at a time
                now = (place >= part) & (place < part + s.degree)
                has = np.flatnonzero(count > part)
                more = np.full((len(nodes), s.degree), -1)
                more[np.repeat(np.arange(len(nodes)), count)[now], place[now] - part] = source[now]
                both = np.concatenate([graph[nodes[has]], more[has]], 1)
                full = ((both >= 0).sum(1) > s.degree)
                graph[nodes[has[~full]]] = -np.sort(-both[~full], axis=1)[:, : s.degree]
                if full.any():
                    graph[nodes[has[full]]] = robust_prune(points, nodes[has[full]], both[full], s.degree, alpha)
    return graph, start


def usable(vectors: DataFrame, length: int | None = None) -> tuple[DataFrame, int]:
    """``(vec_id, v)``: the rows that take part, vectors as arrays of double; and their length (the most frequent, if not given)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(fine)
    if length is None:
        sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        length = sizes[0]["n"] if sizes else 0
    return rows.where(F.size("v") == length), length


def distinct_points(rows: DataFrame, s: Settings) -> DataFrame:
    """``(v, ids)``: every distinct vector with its ``k + 1`` smallest ids, found within salts first."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(s.salts))
    parts = rows.groupBy("v", salt.alias("salt"), F.col("vec_id")).agg(F.lit(1).alias("one"))
    within = Window.partitionBy("v", "salt").orderBy("vec_id")
    whole = Window.partitionBy("v").orderBy("vec_id")
    few = parts.withColumn("r", F.row_number().over(within)).where(F.col("r") <= s.k + 1).withColumn("r", F.row_number().over(whole)).where(F.col("r") <= s.k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def shard_rows(n: int, s: Settings, length: int = 1) -> int:
    """About how many rows of vectors of ``length`` a shard has, so that a column of it stays under ``most_bytes``."""
    room = max(1, s.most_bytes // (8 * max(length, s.degree // 2, s.k + 1)))
    return int(min(s.most_rows, room, max(s.least_rows, s.growth * n**0.5)))


def _lengthened(vectors: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([vectors, np.sqrt(np.maximum(most**2 - (vectors**2).sum(1), 0))[:, None]], 1).astype(np.float32)


def build_index(points: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """One row a shard: (shard, vectors, ids, sizes, graph, start, most), arrays as bytes; and the number of shards."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, most, length = points.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    shards = max(1, round((n or 0) / shard_rows(n or 0, s, length or 1)))
    most = float(most or 0.0)

    def build(t: pa.Table) -> pa.Table:
        vectors = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        graph, start = build_graph(_lengthened(vectors, most), s)
        ids = t.column("ids").combine_chunks()
        blob = [vectors.tobytes(), ids.flatten().to_numpy().tobytes(), np.diff(ids.offsets.to_numpy()).astype(np.int32).tobytes(), graph.astype(np.int32).tobytes()]
        return pa.table({"shard": t.column("shard").slice(0, 1), **{k: pa.array([x], pa.binary()) for k, x in zip(("vectors", "ids", "sizes", "graph"), blob, strict=True)}, "start": pa.array([start], pa.int32()), "most": pa.array([most], pa.float64())})

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).repartition(2 * shards, "shard")
    index = dealt.groupBy("shard").applyInArrow(build, "shard int, vectors binary, ids binary, sizes binary, graph binary, start int, most double")
    return checkpointed(index), shards


#: Columns that stand for a vector: two 64-bit hashes of it.
KEY = ["h1", "h2"]


def search(queries: DataFrame, index: DataFrame, shards: int, s: Settings) -> DataFrame:
    """``(h1, h2, found)`` for distinct ``queries (v, h1, h2)``: at most k + 1 (score, vec_id) of all shards, best first."""
    parts = max(1, -(-queries.count() // s.part))
    dealt = queries.withColumn("part", F.pmod("h1", F.lit(parts)).cast("int"))
    every = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    whole = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tasks = min(10_000, 2 * shards * parts)

    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["h1", "h2", "score", "vec_id"]
        if not shard.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())], names=names)
        row = {k: shard.column(k)[0] for k in ("vectors", "ids", "sizes", "graph", "start", "most")}
        q = asked.column("v").combine_chunks().flatten().to_numpy().reshape(asked.num_rows, -1)
        vectors = np.frombuffer(row["vectors"].as_buffer()).reshape(-1, q.shape[1])
        sizes = np.frombuffer(row["sizes"].as_buffer(), np.int32).astype(np.int64)
        ids, first = np.frombuffer(row["ids"].as_buffer(), np.int64), np.append(0, np.cumsum(sizes))
        long = _lengthened(vectors, row["most"].as_py())
        graph = np.frombuffer(row["graph"].as_buffer(), np.int32).reshape(len(vectors), -1)
        who, scores, found = [], [], []
        for low in range(0, len(q), s.block):
            some = q[low : low + s.block]
            near, _ = beam_search(long, graph, row["start"].as_py(), np.concatenate([some, np.zeros((len(some), 1))], 1).astype(np.float32), s.beam)
            query, place = np.nonzero(near >= 0)
            at = near[query, place]
            score = np.einsum("nd,nd->n", vectors[at], some[query])
            each = sizes[at]
            inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            query, score, of = np.repeat(query, each), np.repeat(score, each), ids[np.repeat(first[at], each) + inner]
            order = np.lexsort((of, -score, query))
            rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
            order = order[rank <= s.k]
            who.append(query[order] + low)
            scores.append(score[order])
            found.append(of[order])
        who = np.concatenate(who)
        return pa.table([asked.column("h1").take(pa.array(who)), asked.column("h2").take(pa.array(who)), pa.array(np.concatenate(scores)), pa.array(np.concatenate(found))], names=names)

    pairs = whole.repartition(tasks, "shard", "part").groupBy("shard", "part").cogroup(every.repartition(tasks, "shard", "part").groupBy("shard", "part"))
    answers = pairs.applyInArrow(run, "h1 long, h2 long, score double, vec_id long")
    ranked = answers.withColumn("r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= s.k + 1)
    best = F.array_sort(F.collect_list(F.struct("r", "score", "vec_id")))
    return ranked.groupBy(*KEY).agg(F.transform(best, lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"))).alias("found"))


def neighbours(vectors: DataFrame, asked: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for the rows ``asked`` the nearest of ``vectors``, but for themselves."""
    rows, length = usable(vectors)
    points = checkpointed(distinct_points(rows, s))
    index, shards = build_index(points, s)
    queries = usable(asked, length)[0].distinct()
    queries = checkpointed(queries.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64("v", F.lit(1))))
    found = search(queries.groupBy(*KEY).agg(F.first("v").alias("v")), index, shards, s)
    rows = queries.drop("v").join(found, KEY).select("vec_id", F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")).alias("found"))
    rows = rows.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice("found", 1, s.k)).alias("rank", "x"))
    return rows.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))
