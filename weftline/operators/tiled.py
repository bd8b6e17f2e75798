"""Fits of the spatial model for several K at once, tile by tile, with rounds that can be resumed.

The spots of a sample are cut into tiles by their places. A task holds a tile's sparse rows and those around it, as many edges
away as a round has sweeps and one more (its halo), so that all label sweeps of a round, for every K, are made in the task:
what a halo spot needs is there, and each sweep makes one ring of the halo stale. The blocks are dealt once and stay; a round sends
each tile the labels and factors of its spots and halo, once for all sweeps and K. It is three jobs whatever the number of K: the sweeps, the
sums by which each K's last sweep, smoothing and likelihood are chosen, and the sums of new parameters.

Results are those of ``model.fit`` for each K by itself. After each round a bundle can be written: parameters, settings and state
tables, and a manifest last, from which a fit that was stopped goes on.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.blocks import Sparse, block_sums, codes, vectors
from ..sources.checkpoints import setting, stored, table_path
from . import model, potts
from .model import Inputs, ModelSettings, Params, Posterior
from .qc import SPOT


BLOCK = "tile string, sample_id string, spot_id string, hop int, at int, near array<int>, other array<int>, idx array<int>, val array<double>"
_TEXTS = [(c, pa.string()) for c in ("tile", *SPOT)]
#: Without bounds on NULLs, which Spark's own array functions set.
BLOCK_SCHEMA = pa.schema([*_TEXTS, ("hop", pa.int32()), ("at", pa.int32()), *[(c, pa.list_(pa.int32())) for c in ("near", "other", "idx")], ("val", pa.list_(pa.float64()))])


@dataclass(frozen=True)
class Tiles:
    """``blocks``: tile, sample_id, spot_id, hop (edges from the tile's own spots), at (place in the tile), near and other (places of
    the neighbours by both graphs), idx, val. ``members``: tile, sample_id, spot_id, hop."""

    blocks: DataFrame
    members: DataFrame
    depth: int
    two_graphs: bool


def tile_of(places: DataFrame, side: float, x: str = "col", y: str = "row") -> DataFrame:
    """``(sample_id, spot_id, tile)``: squares of ``side`` in each sample."""
    cell = [F.floor(F.col(c) / side).cast("string") for c in (y, x)]
    return places.select(*SPOT, F.concat_ws("/", "sample_id", *cell).alias("tile"))


def cut(x: Inputs, tiles: DataFrame | None, depth: int) -> Tiles:
    """The rows of a fit in tiles with halos of ``depth`` edges. Without ``tiles (sample_id, spot_id, tile)`` a sample is one tile."""
    keys = x.rows.select(*SPOT)
    own = keys.withColumn("tile", F.col("sample_id")) if tiles is None else keys.join(tiles.select(*SPOT, "tile"), SPOT)
    graphs = [x.edges] if x.factor_edges is None else [x.edges, x.factor_edges]
    every = graphs[0] if len(graphs) == 1 else stored(graphs[0].union(graphs[1]).distinct())
    front = stored(own.select("tile", *SPOT, F.lit(0).alias("hop")))
    members = front
    for hop in range(1, depth + 1):
        beside = front.join(every, SPOT).select("tile", "sample_id", F.col("nbr_id").alias("spot_id")).distinct()
        front = stored(beside.join(members, ["tile", *SPOT], "left_anti").withColumn("hop", F.lit(hop)))
        members = members.union(front)
    members = stored(members.join(keys, SPOT, "left_semi"))
    rows = members.join(x.rows, SPOT)
    for name, edges in zip(("near", "other"), graphs, strict=False):
        rows = rows.join(edges.groupBy(*SPOT).agg(F.collect_list("nbr_id").alias(name)), SPOT, "left")
    rows = rows.select("tile", *SPOT, "hop", "near", *(["other"] if len(graphs) > 1 else [F.lit(None).cast("array<string>").alias("other")]), "idx", "val")

    def number(table: pa.Table) -> pa.Table:
        """Neighbours as places in the tile; outer spots' aren't needed."""
        spots = table.column("spot_id").to_pylist()
        at = {s: i for i, s in enumerate(spots)}
        inner = [h < depth for h in table.column("hop").to_pylist()]
        out = {c: table.column(c) for c in ("tile", *SPOT, "hop")} | {"at": pa.array(range(len(spots)), pa.int32())}
        for c in ("near", "other"):
            lists = [[at[s] for s in x if s in at] if x and i else [] for x, i in zip(table.column(c).to_pylist(), inner, strict=True)]
            out[c] = pa.array(lists, pa.list_(pa.int32()))
        return pa.table(out | {c: table.column(c) for c in ("idx", "val")}).cast(BLOCK_SCHEMA)

    blocks = rows.groupBy("tile").applyInArrow(number, BLOCK)
    parts = int(x.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Tiles(stored(blocks).repartition(parts, "tile").persist(StorageLevel.MEMORY_AND_DISK), members, depth, len(graphs) > 1)


class Graph:
    """Neighbours of a tile's spots as flat arrays."""

    def __init__(self, lists: pa.ListArray):
        ends = lists.offsets.to_numpy().astype(np.int64)
        self.flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.degree = np.diff(ends)
        self.row = np.repeat(np.arange(len(lists)), self.degree)
        self.some = np.flatnonzero(self.degree)
        self.starts = (ends - ends[0])[:-1][self.some]

    def same(self, y: np.ndarray, k: int) -> np.ndarray:
        """Neighbours with each label 0..k-1."""
        return np.bincount(self.row * k + y[self.flat], minlength=len(self.degree) * k).reshape(-1, k)

    def mean(self, v: np.ndarray) -> np.ndarray:
        """Mean of the neighbours' vectors, 0 without any."""
        out = np.zeros_like(v)
        if len(self.some):
            out[self.some] = np.add.reduceat(v[self.flat], self.starts) / self.degree[self.some, None]
        return out


def log_softmax(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(1, keepdims=True))


OUT = "tile string, sample_id string, spot_id string, y array<int>, g array<double>, m array<double>, v array<double>, m_new array<double>, t array<double>, sums array<double>"


def sweeps(joined: DataFrame, params: list[Params], s: ModelSettings, two_graphs: bool) -> DataFrame:
    """Rows of ``OUT``: of each own spot labels, factors and energies after each sweep, for each of the models in turn.

    ``joined``: blocks with y, v and m, the models' one after the other. One row of each tile has its ``sums``: by model and sweep
    the energy, the log-likelihood, and the objective at each smoothing value.
    """
    shared = joined.sparkSession.sparkContext.broadcast(params)
    many, q = s.max_sweeps - 1, params[0].w.shape[1]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at").combine_chunks()
        b = table.to_batches(max_chunksize=max(1, table.num_rows))[0]
        names = b.schema.names
        graph = Graph(b.column(names.index("near")))
        other = Graph(b.column(names.index("other"))) if two_graphs else graph
        rows, own = Sparse(b), np.flatnonzero(b.column(names.index("hop")).to_numpy() == 0)
        everyone = np.arange(rows.n)
        state = {c: vectors(b, c) for c in ("y", "v", "m")}
        out: dict[str, list[np.ndarray]] = {c: [] for c in ("y", "g", "m", "v", "m_new", "t")}
        sums: list[float] = []
        for i, p in enumerate(shared.value):
            k, r = len(p.mu), int(codes(b.slice(0, 1), "sample_id", p.samples)[0])
            post = Posterior(p, r, s.spatial_factor)
            y, v, m = state["y"][:, i].astype(np.int64) - 1, state["v"][:, i * q : (i + 1) * q], state["m"][:, i * q : (i + 1) * q]
            a, g = post.reduce(rows, everyone)
            u = post.energy(a, g, m)
            out["g"].append(g[own])
            out["m"].append(m[own])
            for _ in range(many):
                near = other.mean(v)
                t = u - log_softmax(-(p.beta[r] / 2) * (graph.degree[:, None] - graph.same(y, k)))
                y = t.argmin(1)
                v = post.factor(y, g, near)
                mine = -t[own]
                resp = log_softmax(mine)
                sums += [float(t[own].min(1).sum()), float((mine - resp)[:, 0].sum())]
                resp = np.exp(resp)
                unlike = (graph.degree[:, None] - graph.same(y, k))[own]
                sums += [float((resp * log_softmax(-(beta / 2) * unlike)).sum()) for beta in s.beta_grid]
                for c, x in (("y", y[:, None] + 1), ("v", v), ("m_new", near), ("t", t)):
                    out[c].append(x[own])
        if not len(own):
            return OUT_SCHEMA.empty_table()
        whole = pa.table({c: table.column(c).take(pa.array(own)) for c in ("tile", *SPOT)})
        for c, parts in out.items():
            x = np.hstack(parts)
            kind = pa.int32() if c == "y" else pa.float64()
            whole = whole.append_column(c, pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind)))
        return whole.append_column("sums", pa.array([sums, *[None] * (len(own) - 1)], pa.list_(pa.float64())))

    return joined.groupBy("tile").applyInArrow(run, OUT)


OUT_SCHEMA = pa.schema([*_TEXTS, ("y", pa.list_(pa.int32())), *[(c, pa.list_(pa.float64())) for c in ("g", "m", "v", "m_new", "t", "sums")]])


@dataclass
class Fitting:
    """Where a fit of several K stands: parameters of each, those still running, finished results, and the state of the running.

    With ``scratch``, three paths, a round's sweeps and state are there in place of those of the round before, and the one before that.
    """

    params: dict[int, Params]
    running: list[int]
    state: DataFrame
    done: dict[int, DataFrame]
    rounds: int = 0
    scratch: list[str] | None = None


def begin(x: Inputs, ks: list[int], s: ModelSettings) -> Fitting:
    """First labels and parameters of all K; what doesn't depend on K is computed once."""
    noise, params, labels = model.start_noise(x, s), {}, None
    for k in ks:
        first, params[k] = model.starting(x, k, s, noise)
        one = first.select(*SPOT, F.col("y").cast("int").alias(f"y{k}"))
        labels = one if labels is None else labels.join(one, SPOT)
    zero = F.array(*[F.lit(0.0)] * (len(ks) * x.loadings.shape[1]))
    state = labels.select(*SPOT, F.array(*[F.col(f"y{k}") for k in ks]).alias("y"), zero.alias("v"), zero.alias("m"))
    return Fitting(params, list(ks), stored(state), {})


def last_sweep(energies: list[float], spatial: bool) -> int:
    """The sweep after which a round stops: the first whose energy rises (or, without spatial factors, no longer falls)."""
    last = math.inf
    for i, energy in enumerate(energies):
        if energy > last + 1e-5 or (not spatial and last - energy < 1e-5):
            return i
        last = energy
    return len(energies) - 1


def advance(x: Inputs, tiles: Tiles, f: Fitting, s: ModelSettings) -> Fitting:
    """One round of every K that is running. Blocks stay dealt by tile: what is joined to them is dealt so, and they aren't again."""
    with setting(x.rows.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        return _advance(x, tiles, f, s)


def _advance(x: Inputs, tiles: Tiles, f: Fitting, s: ModelSettings) -> Fitting:
    params, q, many, width = [f.params[k] for k in f.running], x.loadings.shape[1], s.max_sweeps - 1, 2 + len(s.beta_grid)
    sent = tiles.members.select("tile", *SPOT).join(f.state, SPOT)
    swept = stored(sweeps(tiles.blocks.join(sent, ["tile", *SPOT]), params, s, tiles.two_graphs), f.scratch and f.scratch[0])
    got = swept.where("sums IS NOT NULL").select("sample_id", F.posexplode("sums").alias("at", "x")).groupBy("sample_id", "at").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros((len(x.moments.samples), len(params) * many * width))  # numbers of samples, models, sweeps and smoothing values
    for r in got:
        sums[x.moments.samples.index(r["sample_id"]), r["at"]] = r["x"]
    sums = sums.reshape(len(x.moments.samples), len(params), many, width)
    chosen, finished, starts = [], [], np.append(0, np.cumsum([len(p.mu) * many for p in params]))
    for i, p in enumerate(params):
        at = last_sweep(sums[:, i, :, 0].sum(0).tolist(), s.spatial_factor)
        own = sums[:, i, at, 2:] if s.mix_prop_heter else np.repeat(sums[:, i, at, 2:].sum(0, keepdims=True), len(p.samples), 0)
        beta = np.array(s.beta_grid)[own.argmax(1)] if s.beta_grid else p.beta
        path = [*p.path, float(sums[:, i, at, 1].sum())]
        params[i] = replace(p, beta=beta, path=path)
        finished.append(model.settled(path, s) or len(path) == s.max_rounds - 1)
        place, wide = i * many + at, len(p.mu)
        part = lambda c, place=place: F.slice(c, place * q + 1, q)
        chosen.append({"y": F.col("y")[place], "g": F.slice("g", i * q + 1, q), "m": F.slice("m", i * q + 1, q), "v": part("v"), "m_new": part("m_new"), "t": F.slice("t", int(starts[i]) + at * wide + 1, wide)})
    results = dict(f.done)
    for i, (k, end) in enumerate(zip(f.running, finished, strict=True)):
        if end:
            one = swept.select(*SPOT, *[c.alias(name) for name, c in chosen[i].items()])
            results[k] = stored(model.final_embedding(potts.responsibilities(one, "t"), params[i], s.spatial_factor))
    going = [i for i, end in enumerate(finished) if not end]
    every = dict(f.params) | dict(zip(f.running, params, strict=True))
    if going:
        columns = {c: F.concat(*[chosen[i][c] for i in going]).alias(c) for c in ("g", "m", "v", "m_new", "t")}
        now = swept.select("tile", *SPOT, F.array(*[chosen[i]["y"] for i in going]).alias("y"), *columns.values())
        every |= dict(zip([f.running[i] for i in going], new_parameters(x, tiles, now, [params[i] for i in going], s), strict=True))
        state = stored(now.select(*SPOT, "y", "v", F.col("m_new").alias("m")), f.scratch and f.scratch[1 + f.rounds % 2])
    else:
        state = f.state.limit(0)
    return Fitting(every, [f.running[i] for i in going], state, results, f.rounds + 1, f.scratch)


def new_parameters(x: Inputs, tiles: Tiles, now: DataFrame, params: list[Params], s: ModelSettings) -> list[Params]:
    """The models' new parameters, from one pass over the own spots of all tiles."""
    q, shared = x.loadings.shape[1], now.sparkSession.sparkContext.broadcast(params)
    rows = tiles.blocks.where("hop = 0").select("tile", *SPOT, "idx", "val").join(now.drop("y", "v"), ["tile", *SPOT])

    def work(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        every = [model.Sums(p, s) for p in shared.value]
        for b in batches:
            if not b.num_rows:
                continue
            rows, r = Sparse(b), codes(b, "sample_id", every[0].samples)
            g, m, m_new, t = (vectors(b, c) for c in ("g", "m", "m_new", "t"))
            low = 0
            for i, (p, sums) in enumerate(zip(shared.value, every, strict=True)):
                resp = np.exp(log_softmax(-t[:, low : low + len(p.mu)]))
                low += len(p.mu)
                sums.add(rows, r, *(c[:, i * q : (i + 1) * q] for c in (g, m, m_new)), resp)
        return {k: v for i, sums in enumerate(every) for k, v in sums.named(f"{i}/").items()}

    got = block_sums(rows.select("sample_id", "idx", "val", "g", "m", "m_new", "t"), work)
    each = [{k.split("/")[1]: v for k, v in got.items() if k.startswith(f"{i}/")} for i in range(len(params))]
    return [model.updated(sums, p, s, x.moments.squares, x.moments.n) for sums, p in zip(each, params, strict=True)]


def fit_many(x: Inputs, ks: list[int], s: ModelSettings = ModelSettings(), tiles: DataFrame | None = None, bundle: str | None = None) -> dict[int, tuple[DataFrame, Params]]:
    """``{k: (sample_id, spot_id, cluster, hz, hv, resp; parameters)}`` for all K at once.

    ``tiles (sample_id, spot_id, tile)``: see ``tile_of``; without them a task holds a sample. With a ``bundle``, a folder that
    all executors share, each round is written there, and a fit that finds rounds there goes on from the last.
    """
    spark = x.rows.sparkSession
    cuts = cut(x, tiles, s.max_sweeps)
    f = load_round(spark, bundle, ks, s) if bundle else None
    if f is None:
        f = begin(x, ks, s)
    x.rows.unpersist()  # the rounds read blocks
    f = replace(f, scratch=[table_path(spark) for _ in range(3)])
    while f.running:
        f = advance(x, cuts, f, s)
        if bundle:
            save_round(bundle, f, s)
    cuts.blocks.unpersist()
    return {k: (f.done[k], f.params[k]) for k in ks}


def save_round(folder: str, f: Fitting, s: ModelSettings) -> None:
    """Writes the state, the results and the parameters of a round, and a manifest that names them last."""
    spark, at = f.state.sparkSession, f"{folder}/round={f.rounds}"
    f.state.write.mode("overwrite").parquet(f"{at}/state")
    for k, rows in f.done.items():
        rows.write.mode("overwrite").parquet(f"{at}/done/k={k}")
    rows = []
    for k, p in f.params.items():
        for name in ("means", "w", "lam", "mu", "sigma", "psi", "beta", "path"):
            v = np.asarray(getattr(p, name), np.float64)
            flat = v.ravel().tolist()
            rows += [(k, name, list(v.shape), i, flat[i : i + 65_536]) for i in range(0, max(1, len(flat)), 65_536)]
    spark.createDataFrame(rows, "k int, name string, shape array<int>, at long, values array<double>").write.mode("overwrite").parquet(f"{at}/params")
    samples = next(iter(f.params.values())).samples
    manifest = {"round": f.rounds, "running": f.running, "done": sorted(f.done), "samples": samples, "settings": asdict(s)}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{at}/manifest")


def load_round(spark: SparkSession, folder: str, ks: list[int], s: ModelSettings) -> Fitting | None:
    """The last whole round in a bundle, None if there is none. The bundle's settings and K must be the same."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rounds = sorted((int(x.getPath().getName().split("=")[1]) for x in (files.listStatus(path) if files.exists(path) else []) if x.getPath().getName().startswith("round=")), reverse=True)
    for n in rounds:
        at = f"{folder}/round={n}"
        if not files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/manifest/_SUCCESS")):
            continue
        manifest = json.loads(spark.read.text(f"{at}/manifest").first()[0])
        if manifest["settings"] != json.loads(json.dumps(asdict(s))) or sorted(manifest["running"] + manifest["done"]) != sorted(ks):
            raise ValueError("the bundle is of other settings or other K")
        found: dict[int, dict[str, list]] = {}
        last = Window.partitionBy("k", "name").orderBy("at")
        for r in spark.read.parquet(f"{at}/params").withColumn("i", F.row_number().over(last)).orderBy("k", "name", "i").collect():
            shape, flat = found.setdefault(r["k"], {}).setdefault(r["name"], (r["shape"], []))
            flat += r["values"]
        params = {}
        for k, values in found.items():
            own = {name: np.array(flat).reshape(shape) for name, (shape, flat) in values.items()}
            params[k] = Params(manifest["samples"], **{name: v for name, v in own.items() if name != "path"}, path=own["path"].tolist())
        done = {k: spark.read.parquet(f"{at}/done/k={k}") for k in manifest["done"]}
        return Fitting(params, manifest["running"], spark.read.parquet(f"{at}/state"), done, n)
    return None
