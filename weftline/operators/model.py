"""The spatial mixture and factor model: settings, posteriors, label sweeps, updates, the fit, and the choice of K.

x = W(z + v) + e, with e ~ N(0, diag lam of the sample), z | label k ~ N(mu_k, sigma_k), v ~ N(mean of the neighbours' v, psi of the
sample), labels a Potts field with smoothing beta of the sample. x is centred within samples; rows stay sparse, as centring is folded
into sums. All algebra of a spot is in q dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import Sparse, block_sums, codes, vectors
from ..sources.checkpoints import checkpointed, stored
from . import potts, start
from .qc import SPOT

TINY = 1e-8


@dataclass(frozen=True)
class ModelSettings:
    """Flags and limits of a fit; checked when made."""

    sigma_equal: bool = False
    sigma_diag: bool = True
    mix_prop_heter: bool = True
    error_heter: bool = True
    spatial_factor: bool = True
    beta_start: float = 1.5
    beta_grid: tuple[float, ...] = tuple(round(0.2 * i, 10) for i in range(1, 21))
    max_rounds: int = 20
    max_sweeps: int = 6
    eps_loglik: float = 1e-5
    init: str = "mixture"
    init_starts: int = 5
    weighted_pca: bool = True
    potts_direction: str = "in"
    seed: int = 1
    legacy_loglik: bool = False

    def __post_init__(self):
        if self.init not in ("mixture", "kmeans"):
            raise ValueError("init is 'mixture' or 'kmeans'")
        if self.max_rounds < 2 or self.max_sweeps < 2 or self.init_starts < 1:
            raise ValueError("rounds and sweeps are at least 2, starts at least 1")
        if not self.beta_grid or min(self.beta_grid) < 0 or self.eps_loglik <= 0:
            raise ValueError("beta_grid has values from 0, eps_loglik is over 0")
        if self.potts_direction not in ("in", "out"):
            raise ValueError("potts_direction is 'in' or 'out'")


@dataclass(frozen=True)
class Params:
    """mu: K x q; sigma: K x q x q; psi: samples x q x q; w: p x q; lam: samples x p; beta: samples."""

    samples: list[str]
    means: np.ndarray
    w: np.ndarray
    lam: np.ndarray
    mu: np.ndarray
    sigma: np.ndarray
    psi: np.ndarray
    beta: np.ndarray
    path: list[float] = field(default_factory=list)


class Posterior:
    """What the posteriors of one sample need, and the posteriors of blocks of its spots."""

    def __init__(self, p: Params, r: int, spatial: bool = True):
        self.spatial, self.mu, self.sigma = spatial, p.mu, p.sigma
        self.wl = p.w / p.lam[r][:, None]
        self.l = p.w.T @ self.wl
        self.shift_g = p.means[r] @ self.wl
        self.lam, self.mean = p.lam[r], p.means[r]
        self.psi = p.psi[r] if spatial else np.zeros_like(p.psi[r])
        self.psi_inv = np.linalg.inv(p.psi[r] + TINY * np.eye(len(p.psi[r]))) if spatial else None
        eye = np.eye(len(self.l))
        self.b_inv = np.array([np.linalg.inv(self.l + np.linalg.inv(s + self.psi)) for s in p.sigma])
        self.q = np.array([self.l - self.l @ b @ self.l for b in self.b_inv])
        c_inv = np.array([np.linalg.inv(self.l + np.linalg.inv(s)) for s in p.sigma])
        self.t = np.array([self.l - self.l @ c @ self.l for c in c_inv])
        self.keep_c = np.array([eye - c @ self.l for c in c_inv])
        self.keep_b = np.array([eye - b @ self.l for b in self.b_inv])
        self.half_det = np.array([0.5 * (-np.linalg.slogdet(s + self.psi)[1] + np.linalg.slogdet(b)[1] - np.log(self.lam).sum()) for s, b in zip(p.sigma, self.b_inv, strict=True)])
        self.vz = np.array([s - s @ q @ s for s, q in zip(p.sigma, self.q, strict=True)])
        self.vv = np.array([self.psi - self.psi @ q @ self.psi for q in self.q])
        self.vzv = np.array([vz + vv - self.psi @ q @ s - s @ q @ self.psi for vz, vv, q, s in zip(self.vz, self.vv, self.q, p.sigma, strict=True)])

    def reduce(self, rows: Sparse, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a = x' lam^-1 x and g = x' lam^-1 W of the chosen rows, centring folded in."""
        n = rows.n
        g, a = np.zeros((n, self.l.shape[0])), np.zeros(n)
        np.add.at(g, rows.row, rows.val[:, None] * self.wl[rows.idx])
        np.add.at(a, rows.row, (rows.val**2 - 2 * rows.val * self.mean[rows.idx]) / self.lam[rows.idx])
        return a[chosen] + (self.mean**2 / self.lam).sum(), g[chosen] - self.shift_g

    def energy(self, a: np.ndarray, g: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Gaussian energies: spots by clusters."""
        out = np.empty((len(g), len(self.mu)))
        for k, mu in enumerate(self.mu):
            u = m + mu
            ul = u @ self.l
            t = g - ul
            out[:, k] = 0.5 * (a - 2 * (g * u).sum(1) + (ul * u).sum(1) - ((t @ self.b_inv[k]) * t).sum(1)) - self.half_det[k]
        return out

    def moments(self, k: int, g: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means of z and v given label k."""
        d = g @ self.keep_b[k] - (m + self.mu[k]) @ self.q[k]
        return d @ self.sigma[k] + self.mu[k], d @ self.psi + m

    def factor(self, y: np.ndarray, g: np.ndarray, m: np.ndarray) -> np.ndarray:
        """v of each spot given its label and the mean m of its neighbours' v."""
        out = np.zeros_like(g)
        if self.spatial:
            for k in range(len(self.mu)):
                at = y == k
                s = g[at] @ self.keep_c[k] - self.mu[k] @ self.t[k] + m[at] @ self.psi_inv
                out[at] = s @ np.linalg.inv(self.t[k] + self.psi_inv)
        return out


def by_sample(b: pa.RecordBatch, samples: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Samples in a batch, with their rows."""
    r = codes(b, "sample_id", samples)
    for s in np.unique(r):
        yield int(s), np.flatnonzero(r == s)


def lists(x: np.ndarray) -> pa.Array:
    """A matrix as an array column."""
    return pa.array(list(x), pa.list_(pa.float64()))


def e_step(state: DataFrame, p: Params, spatial: bool) -> DataFrame:
    """``(sample_id, spot_id, y, u, g, v, m)`` from rows with idx, val, y, v, m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts = {}
        for b in batches:
            rows, m = Sparse(b), vectors(b, "m")
            u, g = np.zeros((rows.n, len(p.mu))), np.zeros((rows.n, p.w.shape[1]))
            for r, at in by_sample(b, p.samples):
                post = posts.setdefault(r, Posterior(p, r, spatial)) if r not in posts else posts[r]
                a, g[at] = post.reduce(rows, at)
                u[at] = post.energy(a, g[at], m[at])
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in (*SPOT, "y")), lists(u), lists(g), b.column(names.index("v")), b.column(names.index("m"))], names=[*SPOT, "y", "u", "g", "v", "m"])

    return state.select(*SPOT, "idx", "val", "y", "v", "m").mapInArrow(run, "sample_id string, spot_id string, y int, u array<double>, g array<double>, v array<double>, m array<double>")


def neighbourhood(state: DataFrame, edges: DataFrame, k: int, q: int, factor_edges: DataFrame | None = None) -> DataFrame:
    """Each spot's ``same`` (neighbours by label), ``degree`` and ``near`` (mean of v), by one join and one grouping.

    ``factor_edges`` is another graph for ``near`` (a second join and grouping).
    """
    if factor_edges is not None:
        own = neighbourhood(state, edges, k, q).drop("near")
        return own.join(neighbourhood(state, factor_edges, k, q).select(*SPOT, "near"), SPOT)
    nbr = state.select("sample_id", F.col("spot_id").alias("nbr_id"), F.col("y").alias("__y"), F.col("v").alias("__v"))
    d = edges.join(nbr, ["sample_id", "nbr_id"]).groupBy(*SPOT).agg(F.count("*").alias("degree"), F.array(*[F.count_if(F.col("__y") == i + 1) for i in range(k)]).alias("same"), F.array(*[F.avg(F.col("__v")[i]) for i in range(q)]).alias("near"))
    zero = F.array(*[F.lit(0.0)] * q)
    return state.join(d, SPOT, "left").withColumns({"degree": F.coalesce("degree", F.lit(0)), "same": F.coalesce("same", F.array(*[F.lit(0).cast("long")] * k)), "near": F.coalesce("near", zero)})


def sweep(state: DataFrame, edges: DataFrame, p: Params, spatial: bool, factor_edges: DataFrame | None = None) -> DataFrame:
    """One label sweep of all spots at once, from the labels and factors before it: new ``y``, ``v``, ``m_new``, and ``low`` (energy)."""
    k, q = len(p.mu), p.w.shape[1]
    beta = F.create_map(*[F.lit(x) for s, b in zip(p.samples, p.beta, strict=True) for x in (s, float(b))])[F.col("sample_id")]
    d = neighbourhood(state, edges, k, q, factor_edges).withColumn("e", potts.potts_energy(F.col("same"), F.col("degree"), beta))
    d = d.withColumn("t", F.zip_with("e", "u", lambda a, b: a + b)).withColumn("low", F.array_min("t")).withColumn("y", F.array_position("t", F.col("low")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts = {}
        for b in batches:
            g, m = vectors(b, "g"), vectors(b, "near")
            y, v = b.column(b.schema.get_field_index("y")).to_numpy() - 1, np.zeros_like(g)
            for r, at in by_sample(b, p.samples):
                post = posts.setdefault(r, Posterior(p, r, spatial)) if r not in posts else posts[r]
                v[at] = post.factor(y[at], g[at], m[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], lists(v), b.column(b.schema.get_field_index("near"))], names=[*b.schema.names[:-2], "v", "m_new"])

    d = d.select(*SPOT, "y", "u", "g", "m", "t", "low", "near", F.lit(0).alias("pad"))
    got = d.mapInArrow(run, "sample_id string, spot_id string, y int, u array<double>, g array<double>, m array<double>, t array<double>, low double, v array<double>, m_new array<double>")
    return checkpointed(got)


class Sums:
    """The sums over spots that new parameters are made of, for one model."""

    def __init__(self, p: Params, s: ModelSettings):
        k, q, m, genes = len(p.mu), p.w.shape[1], len(p.samples), p.w.shape[0]
        self.samples, self.posts = p.samples, [Posterior(p, r, s.spatial_factor) for r in range(m)]
        self.size, self.s1, self.s2, self.zz = np.zeros((m, k)), np.zeros((m, k, q)), np.zeros((m, k, q, q)), np.zeros((m, k, q, q))
        self.xz, self.psi, self.ezv = np.zeros((m, genes, q)), np.zeros((m, q, q)), np.zeros((m, q))

    def add(self, x: Sparse, r_of: np.ndarray, g: np.ndarray, m: np.ndarray, m_new: np.ndarray, resp: np.ndarray) -> None:
        mean = np.zeros_like(g)
        for r in np.unique(r_of).tolist():
            at = np.flatnonzero(r_of == r)
            for k in range(resp.shape[1]):
                w = resp[at, k]
                ez, ev = self.posts[r].moments(k, g[at], m[at])
                both = ez + ev
                self.size[r, k] += w.sum()
                self.s1[r, k] += w @ ez
                self.s2[r, k] += (ez * w[:, None]).T @ ez
                self.zz[r, k] += (both * w[:, None]).T @ both
                d = m_new[at] - ev
                self.psi[r] += (d * w[:, None]).T @ d
                mean[at] += w[:, None] * both
            self.ezv[r] += mean[at].sum(0)
        np.add.at(self.xz, (r_of[x.row], x.idx), x.val[:, None] * mean[x.row])

    def named(self, prefix: str = "") -> dict[str, np.ndarray]:
        return {prefix + k: getattr(self, k) for k in ("size", "s1", "s2", "zz", "xz", "psi", "ezv")}


def m_step(rows: DataFrame, p: Params, s: ModelSettings, squares: np.ndarray, n: np.ndarray) -> Params:
    """New parameters from rows with idx, val, g, m (before the sweeps), m_new and resp; one pass of sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        sums = Sums(p, s)
        for b in batches:
            sums.add(Sparse(b), codes(b, "sample_id", p.samples), *(vectors(b, c) for c in ("g", "m", "m_new", "resp")))
        return sums.named()

    return updated(block_sums(rows.select("sample_id", "idx", "val", "g", "m", "m_new", "resp"), work), p, s, squares, n)


def updated(got: dict[str, np.ndarray], p: Params, s: ModelSettings, squares: np.ndarray, n: np.ndarray) -> Params:
    """New parameters from the sums over all spots."""
    k_, q, m_, genes = len(p.mu), p.w.shape[1], len(p.samples), p.w.shape[0]
    size = got["size"]
    xz = got["xz"] - p.means[:, :, None] * got["ezv"][:, None, :]
    posts = [Posterior(p, r, s.spatial_factor) for r in range(m_)]
    total = size.sum(0)
    full = total > 1e-6  # an empty cluster keeps its mean and covariance
    mu = np.where(full[:, None], got["s1"].sum(0) / np.maximum(total, 1e-6)[:, None], p.mu)
    spread = np.zeros_like(p.sigma)
    for k in range(k_):
        s1 = got["s1"][:, k].sum(0)
        spread[k] = got["s2"][:, k].sum(0) - np.outer(s1, mu[k]) - np.outer(mu[k], s1) + total[k] * np.outer(mu[k], mu[k])
        spread[k] += sum(size[r, k] * posts[r].vz[k] for r in range(m_))
    if s.sigma_equal:
        sigma = np.repeat((spread.sum(0) / max(total.sum(), 1e-6))[None], k_, 0)
    else:
        sigma = np.where(full[:, None, None], spread / np.maximum(total, 1e-6)[:, None, None], p.sigma)
    if s.sigma_diag:
        sigma = np.einsum("kij,ij->kij", sigma, np.eye(q))
    sigma = sigma + TINY * np.eye(q)
    psi = p.psi
    if s.spatial_factor:
        psi = np.array([(got["psi"][r] + sum(size[r, k] * posts[r].vv[k] for k in range(k_))) / max(n[r], 1) for r in range(m_)]) + TINY * np.eye(q)
    b = np.array([sum(got["zz"][r, k] + size[r, k] * posts[r].vzv[k] for k in range(k_)) for r in range(m_)])
    left = np.einsum("rj,rab->jab", 1 / p.lam, b) + TINY * np.eye(q)
    w = np.linalg.solve(left, np.einsum("rjq,rj->jq", xz, 1 / p.lam)[:, :, None])[:, :, 0]
    centred = squares - n[:, None] * p.means**2
    lam = np.array([(centred[r] - 2 * (w * xz[r]).sum(1) + ((w @ b[r]) * w).sum(1)) / max(n[r], 1) for r in range(m_)])
    lam = np.maximum(lam, 1e-7)
    if not s.error_heter:
        lam = np.repeat(lam.mean(1, keepdims=True), genes, 1)
    return replace(p, w=w, lam=lam, mu=mu, sigma=sigma, psi=psi)


def final_embedding(rows: DataFrame, p: Params, spatial: bool) -> DataFrame:
    """``hz``: each spot's z averaged over its labels; ``hv`` is its spatial factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts = {r: Posterior(p, r, spatial) for r in range(len(p.samples))}
        for b in batches:
            g, m, resp = vectors(b, "g"), vectors(b, "m"), vectors(b, "resp")
            hz = np.zeros_like(g)
            for r, at in by_sample(b, p.samples):
                for k in range(len(p.mu)):
                    hz[at] += resp[at, k : k + 1] * posts[r].moments(k, g[at], m[at])[0]
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([b.column(names.index("sample_id")), b.column(names.index("spot_id")), b.column(names.index("y")), lists(hz), b.column(names.index("v")), b.column(names.index("resp"))], names=[*SPOT, "cluster", "hz", "hv", "resp"])

    return rows.select(*SPOT, "y", "g", "m", "v", "resp").mapInArrow(run, "sample_id string, spot_id string, cluster int, hz array<double>, hv array<double>, resp array<double>")


@dataclass(frozen=True)
class Inputs:
    """What fits for all K share: sparse rows, edges, moments, loadings, aligned scores."""

    rows: DataFrame
    edges: DataFrame
    moments: start.Moments
    loadings: np.ndarray
    residual: np.ndarray
    scores: DataFrame
    raw_scores: DataFrame
    factor_edges: DataFrame | None = None


def prepare(rows: DataFrame, edges: DataFrame, p: int, q: int, s: ModelSettings = ModelSettings(), factor_edges: DataFrame | None = None, ready: bool = False) -> Inputs:
    """Stores the rows (unless they are ``ready``: stored before), and computes components and aligned scores once for all K.

    Labels are smoothed over ``edges``, spatial factors over ``factor_edges`` (the same graph if None). The sparse rows are
    dealt by spot once and persisted so: a round's joins shuffle the small state to them, never the rows. What a lost
    executor held is dealt again from the stored table.
    """
    rows = rows if ready else stored(rows)
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *SPOT).persist(StorageLevel.MEMORY_AND_DISK)
    samples = [r[0] for r in rows.select("sample_id").distinct().orderBy("sample_id").collect()]
    m, v, residual = start.components(rows, p, q, samples, s.weighted_pca, seed=s.seed)
    scores = stored(start.project(rows, v, m.sums / np.maximum(m.n, 1)[:, None], samples))
    aligned = scores if len(samples) < 2 else stored(start.harmonize(scores, samples, seed=s.seed))
    flipped = edges if s.potts_direction == "in" else edges.select("sample_id", F.col("nbr_id").alias("spot_id"), F.col("spot_id").alias("nbr_id"))
    others = None if factor_edges is None else stored(factor_edges.select(*SPOT, "nbr_id"))
    return Inputs(rows, stored(flipped.select(*SPOT, "nbr_id")), m, v, residual, aligned, scores, others)


def starting(x: Inputs, k: int, s: ModelSettings, noise: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[DataFrame, Params]:
    """First labels and parameters; ``noise`` is what ``start_noise`` gives, if it is known."""
    m, q = x.moments, x.loadings.shape[1]
    if s.init == "mixture":
        labels, got = start.mixture_start(x.scores, k, s.init_starts, s.seed)
        mu, sigma = got["mu"], np.repeat(got["sigma"][None], k, 0)
    else:
        labels = start.kmeans_start(x.scores, k, s.init_starts, s.seed)
        _, mu, sigma = start.cluster_moments(labels, k)
    if s.sigma_equal:
        sigma = np.repeat(sigma.mean(0)[None], k, 0)
    if s.sigma_diag:
        sigma = np.einsum("kij,ij->kij", sigma, np.eye(q))
    lam, psi = start_noise(x, s) if noise is None else noise
    return labels, Params(m.samples, m.sums / np.maximum(m.n, 1)[:, None], x.loadings, lam, mu, sigma + TINY * np.eye(q), psi, np.full(len(m.samples), s.beta_start))


def start_noise(x: Inputs, s: ModelSettings) -> tuple[np.ndarray, np.ndarray]:
    """Variance of x - W h in each sample, and covariance of h, from the sums of h and of x h'; the same for all K."""
    m, q = x.moments, x.loadings.shape[1]
    means = m.sums / np.maximum(m.n, 1)[:, None]
    genes, n_samples = len(x.loadings), len(m.samples)

    def work(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        xh, hh, h1 = np.zeros((n_samples, genes, q)), np.zeros((n_samples, q, q)), np.zeros((n_samples, q))
        for b in batches:
            rows, h, r = Sparse(b), vectors(b, "vec"), codes(b, "sample_id", m.samples)
            np.add.at(xh, (r[rows.row], rows.idx), rows.val[:, None] * h[rows.row])
            np.add.at(hh, r, np.einsum("ni,nj->nij", h, h))
            np.add.at(h1, r, h)
        return {"xh": xh, "hh": hh, "h1": h1}

    got = block_sums(x.rows.join(x.raw_scores, SPOT).select("sample_id", "idx", "val", "vec"), work)
    lam, psi = [], []
    for r in range(n_samples):
        n = max(m.n[r], 2)
        xh = got["xh"][r] - np.outer(means[r], got["h1"][r])
        cov = (got["hh"][r] - np.outer(got["h1"][r], got["h1"][r]) / n) / (n - 1)
        lam.append(np.maximum((m.squares[r] - n * means[r] ** 2 - 2 * (xh * x.loadings).sum(1) + ((x.loadings @ got["hh"][r]) * x.loadings).sum(1)) / (n - 1), 1e-7))
        psi.append(cov + TINY * np.eye(q))
    lam = np.array(lam)
    if not s.error_heter:
        lam = np.repeat(lam.mean(1, keepdims=True), genes, 1)
    return lam, np.array(psi)


def settled(path: list[float], s: ModelSettings) -> bool:
    """Whether the log-likelihood changed by less than the wanted share in the last round."""
    return len(path) > 1 and abs(path[-1] - path[-2]) < s.eps_loglik * abs(path[-2])


def reported_loglik(p: Params, s: ModelSettings = ModelSettings()) -> float:
    """The last round's log-likelihood; with ``legacy_loglik``, that of the round before if the fit settled."""
    return float(p.path[-2] if s.legacy_loglik and settled(p.path, s) else p.path[-1])


def fit(x: Inputs, k: int, s: ModelSettings = ModelSettings()) -> tuple[DataFrame, Params]:
    """``(sample_id, spot_id, cluster, hz, hv, resp)`` and parameters for one K. Every sweep is checkpointed; the driver holds scalars and parameters."""
    labels, p = starting(x, k, s)
    q = len(p.mu[0])
    zero = F.array(*[F.lit(0.0)] * q)
    state = checkpointed(labels.select(*SPOT, F.col("y").cast("int").alias("y"), zero.alias("v"), zero.alias("m")))
    path: list[float] = []
    for _ in range(s.max_rounds - 1):
        now, last = checkpointed(e_step(x.rows.join(state, SPOT), p, s.spatial_factor)), math.inf
        swept = now
        for _ in range(s.max_sweeps - 1):
            swept = sweep(swept, x.edges, p, s.spatial_factor, x.factor_edges)
            energy = swept.agg(F.sum("low")).first()[0]
            if energy > last + 1e-5 or (not s.spatial_factor and last - energy < 1e-5):
                break
            last = energy
        swept = potts.responsibilities(swept, "t")
        # the smoothing parameter is chosen by the new labels
        near = neighbourhood(swept, x.edges, k, q).select("sample_id", "degree", "same", "resp")
        if s.beta_grid:
            chosen = {r["sample_id"]: r["beta"] for r in potts.beta_grid(near, list(s.beta_grid), s.mix_prop_heter).collect()}
            p = replace(p, beta=np.array([chosen.get(r, chosen.get("all", b)) for r, b in zip(p.samples, p.beta, strict=True)]))
        path.append(swept.agg(F.sum("loglik")).first()[0])
        rows = x.rows.join(swept.select(*SPOT, "y", "g", "m", "m_new", "v", "resp"), SPOT)
        old = p
        if settled(path, s) or len(path) == s.max_rounds - 1:
            return final_embedding(swept, old, s.spatial_factor), replace(p, path=path)
        p = m_step(rows, p, s, x.moments.squares, x.moments.n)
        state = swept.select(*SPOT, "y", "v", F.col("m_new").alias("m"))
    raise AssertionError("unreachable")


def fit_all(x: Inputs, ks: list[int] | None = None, s: ModelSettings = ModelSettings()) -> dict[int, tuple[DataFrame, Params]]:
    """A fit for each K (4 to 12 if none are given), on the same inputs."""
    return {k: fit(x, k, s) for k in (range(4, 13) if ks is None else ks)}


def degrees_of_freedom(k: int, p: int, q: int, r: int, s: ModelSettings = ModelSettings()) -> float:
    """Free parameters of the model with K clusters, p genes, q factors and r samples."""
    full = q * (q + 1) / 2
    covariance = {(False, True): 2 * k * q, (False, False): k * (q + full), (True, True): k * q + q, (True, False): k * q + full}[s.sigma_equal, s.sigma_diag]
    return (r if s.mix_prop_heter else 1) + p * (q + r) + covariance + r * full


def select_k(logliks: DataFrame, p: int, q: int, r: int, n: int, s: ModelSettings = ModelSettings(), pen_const: float = 1.0) -> DataFrame:
    """``(k, loglik, dfree, mbic, bic, maic, aic)`` of ``logliks (k, loglik)``. MBIC and BIC are one expression, as they are defined."""
    # linear in K: the value at 0 and the step
    at0, at1 = (degrees_of_freedom(k, p, q, r, s) for k in (0, 1))
    d = logliks.withColumn("dfree", F.lit(float(at0)) + F.col("k") * F.lit(float(at1 - at0)))
    heavy = math.log(math.log(p + n)) * pen_const
    criteria = {"mbic": math.log(n) * heavy, "bic": math.log(n) * heavy, "maic": 2 * heavy, "aic": 2.0}
    return d.withColumns({name: -2 * F.col("loglik") + F.col("dfree") * weight for name, weight in criteria.items()})


def best_k(criteria: DataFrame, name: str = "mbic") -> int:
    """The K of the first minimum."""
    return criteria.orderBy(name, "k").first()["k"]


def params_table(spark: SparkSession, fits: dict[int, tuple[DataFrame, Params]]) -> DataFrame:
    """``(k, name, sample_id, values, shape)``: parameters of all fits."""
    out = []
    for k, (_, p) in fits.items():
        for name in ("w", "mu", "sigma"):
            v = getattr(p, name)
            out.append((k, name, None, v.ravel().tolist(), list(v.shape)))
        for name in ("lam", "psi", "beta"):
            out += [(k, name, s, np.ravel(v).tolist(), list(np.shape(v))) for s, v in zip(p.samples, getattr(p, name), strict=True)]
        out.append((k, "loglik", None, [float(x) for x in p.path], [len(p.path)]))
    return spark.createDataFrame(out, "k int, name string, sample_id string, values array<double>, shape array<int>")
