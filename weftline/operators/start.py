"""Principal components, alignment of samples, and starting clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import Sparse, block_sums, codes, vectors
from .qc import SPOT

#: A p by p matrix of doubles is summed in tasks: its bound. Beyond it, components are found without such a matrix.
MAX_GENES = 4000


@dataclass(frozen=True)
class Moments:
    """Spots of each sample, sums of each gene in each, sums of products over all (None if there are too many genes), sums of squares in each."""

    samples: list[str]
    n: np.ndarray
    sums: np.ndarray
    gram: np.ndarray | None
    squares: np.ndarray

    def means(self, by_sample: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Spots and means (by genes) of each sample, or of all."""
        n, sums = (self.n, self.sums) if by_sample else (self.n.sum(keepdims=True), self.sums.sum(0, keepdims=True))
        return n, sums / np.maximum(n, 1)[:, None]

    def centred(self, by_sample: bool = True) -> np.ndarray:
        """Products of centred columns: with each sample's means, or the means of all."""
        n, mean = self.means(by_sample)
        return self.gram - (mean.T * n) @ mean

    def variances(self, by_sample: bool = True) -> np.ndarray:
        """Sums of squares of centred columns."""
        n, mean = self.means(by_sample)
        return np.maximum(self.squares.sum(0) - (mean**2 * n[:, None]).sum(0), 0)


def gramian(rows: DataFrame, p: int, samples: list[str], products: bool = True) -> Moments:
    """Moments of sparse rows in one pass; centring is a correction of low rank, so rows are never made dense as a whole.

    Without ``products`` there is no p by p matrix.
    """
    if products and p > MAX_GENES:
        raise ValueError(f"more than {MAX_GENES} genes: see components")

    def work(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        n, sums, gram, squares = np.zeros(len(samples)), np.zeros((len(samples), p)), np.zeros((p, p) if products else 0), np.zeros((len(samples), p))
        for b in batches:
            s, r = Sparse(b), codes(b, "sample_id", samples)
            n += np.bincount(r, minlength=len(samples))
            place = r[s.row] * p + s.idx
            sums += np.bincount(place, s.val, sums.size).reshape(sums.shape)
            squares += np.bincount(place, s.val**2, sums.size).reshape(sums.shape)
            for block in s.blocks() if products else ():
                x = s.dense(p, block)
                gram += x.T @ x
        return {"n": n, "sums": sums, "gram": gram, "squares": squares}

    got = block_sums(rows.select("sample_id", "idx", "val"), work)
    return Moments(samples, got["n"], got["sums"], got["gram"] if products else None, got["squares"])


def times_products(rows: DataFrame, m: Moments, v: np.ndarray, by_sample: bool = True, scale: np.ndarray | None = None) -> np.ndarray:
    """G v for the p by p matrix G of products of centred (and by ``scale`` divided) genes, in one pass and without G."""
    left = v if scale is None else v / scale[:, None]
    shared = rows.sparkSession.sparkContext.broadcast(left)

    def work(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        left, out = shared.value, np.zeros(v.shape)
        for b in batches:
            s = Sparse(b)
            step = max(1, int(20_000 * s.n / max(len(s.idx), 1)))  # rows of some 20,000 cells
            for k in range(0, s.n, step):
                low, high = s.first[k], s.first[min(s.n, k + step)]
                idx, val, row = s.idx[low:high], s.val[low:high, None], s.row[low:high] - k
                if not len(idx):
                    continue
                y = np.zeros((min(s.n, k + step) - k, v.shape[1]))
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                y[row[starts]] = np.add.reduceat(val * left[idx], starts)
                order = np.argsort(idx, kind="stable")
                genes = idx[order]
                starts = np.flatnonzero(np.append(True, genes[1:] != genes[:-1]))
                out[genes[starts]] += np.add.reduceat((val * y[row])[order], starts)
        return {"out": out}

    got = block_sums(rows.select("idx", "val"), work).get("out", np.zeros(v.shape))
    n, mean = m.means(by_sample)
    got = got - (mean.T * n) @ (mean @ left)
    return got if scale is None else got / scale[:, None]


def leading(times: Callable[[np.ndarray], np.ndarray], p: int, q: int, over: int = 10, rounds: int = 30, tolerance: float = 1e-9, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The q leading eigenvectors of a symmetric matrix G that is given by its products, and G times them.

    A random block is multiplied by G again and again; each product, made orthogonal to those before, widens a basis in
    which G is small. Rounds end when the leading vectors are eigenvectors up to ``tolerance`` (of the largest eigenvalue). Each
    round is one pass over the rows; the basis has at most ``rounds`` blocks of q + ``over`` columns by genes.
    """
    width = min(p, q + over)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, width)))[0]
    basis, images = np.zeros((p, 0)), np.zeros((p, 0))
    for _ in range(rounds):
        image = times(block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, c = np.linalg.eigh((small + small.T) / 2)
        c = c[:, ::-1][:, :q]
        v, gv = basis @ c, images @ c
        left = np.linalg.norm(gv - v * values[::-1][:q], axis=0)
        if left.max(initial=0) <= tolerance * max(values[-1], 1e-300) or basis.shape[1] >= p:
            break
        for _ in range(2):  # twice, as once leaves rounding errors
            image = image - basis @ (basis.T @ image)
            norms = np.linalg.norm(image, axis=0)
            image = np.linalg.qr(image[:, norms > 1e-12 * max(norms.max(), 1e-300)])[0][:, : p - basis.shape[1]]
        block = image
        if not block.shape[1]:
            break
    return v, gv


def signed(v: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive."""
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)


def pca(m: Moments, q: int, weighted: bool = False, by_sample: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (p by q, orthonormal) and residual variance of each gene; ``weighted`` whitens by the residuals and does it again."""
    g = m.centred(by_sample)

    def top(scale: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        own = g if scale is None else g / scale[:, None] / scale
        v = np.linalg.eigh(own)[1][:, ::-1][:, :q]
        return v, own @ v

    return _loadings(m, top, lambda v: g @ v, weighted, by_sample)


def _loadings(m: Moments, top: Callable[[np.ndarray | None], tuple[np.ndarray, np.ndarray]], times: Callable[[np.ndarray], np.ndarray], weighted: bool, by_sample: bool) -> tuple[np.ndarray, np.ndarray]:
    """``top(scale)``: leading vectors of the products, divided by ``scale``, and their images; ``times``: images of other vectors."""
    n, variances = max(m.n.sum(), 1), m.variances(by_sample)

    def residual(v: np.ndarray, gv: np.ndarray) -> np.ndarray:
        return np.maximum(variances - 2 * (gv * v).sum(1) + ((v @ (v.T @ gv)) * v).sum(1), 0) / n

    v, gv = top(None)
    turned = signed(v)
    left = residual(turned, gv * np.where((turned == v).all(0), 1, -1))
    if weighted:
        d = np.sqrt(np.maximum(left, 1e-7))
        turned = signed(np.linalg.svd(top(d)[0] * d[:, None], full_matrices=False)[0])
        left = residual(turned, times(turned))
    return turned, left


def components(rows: DataFrame, p: int, q: int, samples: list[str], weighted: bool = False, by_sample: bool = True, most: int = MAX_GENES, seed: int = 1) -> tuple[Moments, np.ndarray, np.ndarray]:
    """Moments, loadings and residual variances for any number of genes.

    Up to ``most`` genes their products are summed in one pass. Beyond it the leading components are found by products with G
    (``leading``), a pass over the rows each; no p by p matrix is made anywhere.
    """
    if p <= most:
        m = gramian(rows, p, samples)
        return m, *pca(m, q, weighted, by_sample)
    m = gramian(rows, p, samples, products=False)
    times = lambda v, scale=None: times_products(rows, m, v, by_sample, scale)
    return m, *_loadings(m, lambda scale: leading(lambda v: times(v, scale), p, min(p, q), seed=seed), times, weighted, by_sample)


def project(rows: DataFrame, v: np.ndarray, means: np.ndarray, samples: list[str], name: str = "vec") -> DataFrame:
    """``(sample_id, spot_id, vec)``: centred rows times loadings. ``means``: samples by genes (or one row for all)."""
    shift = means @ v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = Sparse(b)
            out = np.zeros((s.n, v.shape[1]))
            np.add.at(out, s.row, s.val[:, None] * v[s.idx])
            out -= shift[codes(b, "sample_id", samples)] if len(shift) > 1 else shift
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(out), pa.list_(pa.float64()))], names=[*SPOT, name])

    return rows.select(*SPOT, "idx", "val").mapInArrow(run, f"sample_id string, spot_id string, {name} array<double>")


def harmonize(scores: DataFrame, samples: list[str], clusters: int | None = None, rounds: int = 10, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, seed: int = 1) -> DataFrame:
    """Scores aligned over samples: soft clusters that want every batch in each, then a ridge shift per cluster and batch.

    All rows are updated at once in a round. One sample comes back as it is.
    """
    if len(samples) < 2:
        return scores
    n = scores.count()
    k = clusters or max(2, min(n // 30, 100))
    m = len(samples)
    few = np.array([r["vec"] for r in scores.orderBy(F.xxhash64(F.lit(seed), *SPOT)).limit(k).collect()])
    y = few / np.maximum(np.linalg.norm(few, axis=1, keepdims=True), 1e-12)
    k = len(y)
    shift, mix = np.zeros((k, m, few.shape[1])), np.zeros((k, m))
    share = np.array([r["count"] for r in scores.groupBy("sample_id").count().orderBy("sample_id").collect()], float) / n
    share = dict(zip(sorted(samples), share, strict=True))
    pr = np.array([share[s] for s in samples])

    def assign(z: np.ndarray, r: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        unit = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        a = np.exp(-2 * (1 - unit @ y.T) / sigma) * penalty[:, r].T
        return a / np.maximum(a.sum(1, keepdims=True), 1e-300)

    penalty = np.ones((k, m))
    for turn in range(rounds):

        def work(batches: Iterator[pa.RecordBatch], y=y, penalty=penalty, shift=shift) -> dict[str, np.ndarray]:
            mix, sums, raw, units = np.zeros((k, m)), np.zeros((k, m, y.shape[1])), np.zeros((k, y.shape[1])), np.zeros((k, y.shape[1]))
            for b in batches:
                z0, r = vectors(b, "vec"), codes(b, "sample_id", samples)
                a = assign(z0, r, y, penalty)
                z = z0 - np.einsum("nk,nkd->nd", a, shift[:, r].transpose(1, 0, 2))
                a = assign(z, r, y, penalty)
                for j in range(m):
                    mix[:, j] += a[r == j].sum(0)
                    sums[:, j] += a[r == j].T @ z0[r == j]
                raw += a.T @ z0
                units += a.T @ (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12))
            return {"mix": mix, "sums": sums, "units": units}

        got = block_sums(scores.select("sample_id", "vec"), work)
        mix, units = got["mix"], got["units"]
        y = units / np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-12)
        expected = mix.sum(1, keepdims=True) * pr
        penalty = (np.maximum(expected, 1e-9) / np.maximum(mix, 1e-9)) ** theta
        penalty /= penalty.max(1, keepdims=True)
        new = np.zeros_like(shift)
        for c in range(k):  # ridge on [1, one-hot batches], weighted by the assignment; the intercept isn't shrunk
            gram = np.block([[np.array([[mix[c].sum()]]), mix[c][None]], [mix[c][:, None], np.diag(mix[c] + ridge)]])
            new[c] = np.linalg.lstsq(gram + 1e-10 * np.eye(m + 1), np.vstack([got["sums"][c].sum(0), got["sums"][c]]), rcond=None)[0][1:]
        moved, shift = np.abs(new - shift).max(), new
        if moved < 1e-4 * max(1.0, np.abs(few).max()):
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, r = vectors(b, "vec"), codes(b, "sample_id", samples)
            a = assign(z, r, y, penalty)
            z = z - np.einsum("nk,nkd->nd", a, shift[:, r].transpose(1, 0, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(z), pa.list_(pa.float64()))], names=[*SPOT, "vec"])

    return scores.select(*SPOT, "vec").mapInArrow(run, "sample_id string, spot_id string, vec array<double>")


def cluster_moments(labels: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, mean and covariance (over n) of ``vec`` in each cluster ``y`` 1..k."""

    def work(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            z, y = vectors(b, "vec"), b.column(b.schema.get_field_index("y")).to_numpy() - 1
            one = np.eye(k)[y]
            for name, v in (("n", one.sum(0)), ("s", one.T @ z), ("ss", np.einsum("nk,ni,nj->kij", one, z, z))):
                total[name] = total.get(name, 0) + v
        return total

    got = block_sums(labels.select("vec", "y"), work)
    n = np.maximum(got["n"], 1)
    mean = got["s"] / n[:, None]
    return got["n"], mean, got["ss"] / n[:, None, None] - np.einsum("ki,kj->kij", mean, mean)


def kmeans_start(scores: DataFrame, k: int, starts: int = 1, seed: int = 1, rounds: int = 100) -> DataFrame:
    """``(sample_id, spot_id, vec, y)``: the best of some k-means runs."""
    v = scores.select(*SPOT, "vec", array_to_vector("vec").alias("features"))
    models = [KMeans(k=k, seed=seed + i, maxIter=rounds).fit(v) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(v).select(*SPOT, "vec", (F.col("prediction") + 1).alias("y"))


def mixture_start(scores: DataFrame, k: int, starts: int = 1, seed: int = 1, rounds: int = 50, tolerance: float = 1e-6) -> tuple[DataFrame, dict]:
    """``(sample_id, spot_id, vec, y)`` and parameters of a Gaussian mixture with one full covariance, the best BIC of some starts."""
    n = scores.count()
    best = None
    for i in range(starts):
        size, mu, cov = cluster_moments(kmeans_start(scores, k, 1, seed + i, 10), k)
        q = mu.shape[1]
        pi, sigma = np.maximum(size, 1) / np.maximum(size, 1).sum(), np.einsum("k,kij->ij", size, cov) / n + 1e-8 * np.eye(q)
        last, path = -np.inf, []
        for _ in range(rounds):

            def work(batches: Iterator[pa.RecordBatch], pi=pi, mu=mu, sigma=sigma) -> dict[str, np.ndarray]:
                total: dict[str, np.ndarray] = {}
                for b in batches:
                    z = vectors(b, "vec")
                    e = mixture_log(z, pi, mu, sigma)
                    top = e.max(1)
                    ll = top + np.log(np.exp(e - top[:, None]).sum(1))
                    r = np.exp(e - ll[:, None])
                    for name, v in (("n", r.sum(0)), ("s", r.T @ z), ("ss", z.T @ z), ("ll", np.array([ll.sum()]))):
                        total[name] = total.get(name, 0) + v
                return total

            got = block_sums(scores.select("vec"), work)
            pi, mu = got["n"] / n, np.where(got["n"][:, None] > 1e-8, got["s"] / np.maximum(got["n"], 1e-8)[:, None], mu)
            sigma = (got["ss"] - np.einsum("k,ki,kj->ij", got["n"], mu, mu)) / n + 1e-8 * np.eye(q)
            path.append(float(got["ll"][0]))
            if path[-1] - last < tolerance * abs(last):
                break
            last = path[-1]
        bic = 2 * path[-1] - ((k - 1) + k * q + q * (q + 1) / 2) * np.log(n)
        if best is None or bic > best["bic"]:
            best = {"pi": pi, "mu": mu, "sigma": sigma, "bic": bic, "loglik": path}
    pi, mu, sigma = best["pi"], best["mu"], best["sigma"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = mixture_log(vectors(b, "vec"), pi, mu, sigma).argmax(1) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(y, pa.int32())], names=[*SPOT, "vec", "y"])

    return scores.select(*SPOT, "vec").mapInArrow(run, "sample_id string, spot_id string, vec array<double>, y int"), best


def mixture_log(z: np.ndarray, pi: np.ndarray, mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Log of weight times density of each component."""
    inverse, (_, log_det) = np.linalg.inv(sigma), np.linalg.slogdet(sigma)
    d = z[:, None] - mu[None]
    return np.log(np.maximum(pi, 1e-300)) - 0.5 * (np.einsum("nki,ij,nkj->nk", d, inverse, d) + log_det + z.shape[1] * np.log(2 * np.pi))
