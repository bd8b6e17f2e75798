"""Batch correction of expression by multi-response least squares."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import Sparse, block_sums, sparse_rows, vectors
from ..functions.order import sized_broadcast
from ..sources.checkpoints import checkpointed, stored
from .markers import sample_rate
from .qc import SPOT, align_spots, design_matrix, disambiguate_ids, firstup, log_normalize
from .start import components, project


def control_genes(genes: DataFrame, species: DataFrame | None = None, custom: DataFrame | None = None) -> DataFrame:
    """The species' control genes and the user's own, as far as they are among ``genes (gene)``."""
    lists = [x.select("gene") for x in (species, custom) if x is not None]
    if not lists:
        return genes.select("gene").limit(0)
    every = lists[0] if len(lists) == 1 else lists[0].union(lists[1])
    return genes.select("gene").join(every.distinct(), "gene", "left_semi").distinct()


def least_squares(rows: DataFrame, p: int, fixed: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (d by p) of every gene on the design ``d`` and the first ``fixed`` of them; exact, by sums over all rows.

    ``rows``: idx, val and the design as an array; rows whose design has a NULL take no part. A design without full rank gets
    the solution of least norm.
    """
    fine = rows.where(F.forall("d", lambda x: x.isNotNull())).select("idx", "val", "d")

    def work(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        dd = dx = None
        for b in batches:
            if not b.num_rows:
                continue
            s, d = Sparse(b), vectors(b, "d")
            if dd is None:
                dd, dx = np.zeros((d.shape[1], d.shape[1])), np.zeros((p, d.shape[1]))
            dd += d.T @ d
            np.add.at(dx, s.idx, s.val[:, None] * d[s.row])
        return {} if dd is None else {"dd": dd, "dx": dx}

    got = block_sums(fine, work)
    if not got:  # no rows
        return np.zeros((fixed, p)), np.zeros((fixed, p))
    beta = np.linalg.pinv(got["dd"], rcond=1e-10, hermitian=True) @ got["dx"].T
    return beta, beta[:fixed]


def subtract(rows: DataFrame, part: np.ndarray, p: int, column: str = "h", beside: list[str] | None = None) -> DataFrame:
    """``(sample_id, spot_id, corrected)``: values minus ``column`` times ``part``, dense arrays by gene. Columns ``beside`` come along."""
    own = [*SPOT, *(beside or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, h = Sparse(b), vectors(b, column)
            for block in s.blocks():
                out = s.dense(p, block) - h[block] @ part
                dense = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * p, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(block.start, len(out)) for i in range(len(own))), dense], names=[*own, "corrected"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema.fields)
    return rows.select(*own, "idx", "val", F.col(column).alias(column)).mapInArrow(run, f"{kinds}, corrected array<double>")


def _joined(rows: DataFrame, others: list[DataFrame], beside: DataFrame | None, d: Column) -> DataFrame:
    """Sparse rows with all that is joined to their spots, and the design ``d`` of these; stored, as it is read for the sums and again.

    What stands beside a spot is joined here, so that no dense row is ever shuffled.
    """
    for x in [*others, *([] if beside is None else [beside])]:
        rows = rows.join(x, SPOT)
    return stored(rows.withColumn("d", d))


def _columns(beside: DataFrame | None) -> list[str]:
    return [] if beside is None else [c for c in beside.columns if c not in SPOT]


def correct_by_factors(rows: DataFrame, factors: DataFrame, design: DataFrame, p: int, rate: float | None = None, seed: int = 1, beside: DataFrame | None = None) -> DataFrame:
    """Method 1: regress on the spatial factors ``(…, h)`` and the design ``(…, d)`` with intercept; subtract the factors' part.

    With ``rate``, coefficients are of that share of the spots, picked by hash; all spots are corrected. No rows give no rows.
    The columns of ``beside (sample_id, spot_id, …)`` come along, for the spots that it has.
    """
    d = _joined(rows, [factors.select(*SPOT, "h"), design.select(*SPOT, "d")], beside, F.concat("h", "d"))
    first = d.select(F.size("h")).first()
    size = first[0] if first else 0
    fitted = d if rate is None else sample_rate(d, rate, seed)
    return subtract(d, least_squares(fitted, p, size)[1], p, beside=_columns(beside))


def correct_all_genes(counts: DataFrame, genes: DataFrame, factors: DataFrame, design: DataFrame, rate: float | None = None, seed: int = 1, beside: DataFrame | None = None) -> DataFrame:
    """Method 1 for a whole gene list after a fit on selected genes: ``(sample_id, spot_id, corrected)``.

    ``counts`` are cut to the spots of the fit (``factors``), normalised over all their genes, and every gene of
    ``genes (gene, gene_idx)`` is regressed and corrected. ``rate`` fits on a share of the spots (all are corrected). ``beside``:
    see ``correct_by_factors``.
    """
    rows = sparse_rows(log_normalize(align_spots(counts, factors)), genes, SPOT)
    return correct_by_factors(rows, factors, design, genes.count(), rate, seed, beside)


def correct_by_controls(rows: DataFrame, controls: list[int], resp: DataFrame, design: DataFrame, p: int, most: int = 10, rate: float | None = None, seed: int = 1, beside: DataFrame | None = None) -> DataFrame:
    """Method 2: components of the control genes (their places), cluster shares and the design without intercept; subtract the components' part.

    With ``rate``, coefficients are of that share of the spots, picked by hash; all spots are corrected.
    """
    samples = [r[0] for r in rows.select("sample_id").distinct().orderBy("sample_id").collect()]
    at = {g: i for i, g in enumerate(sorted(controls))}
    place = F.create_map(*[F.lit(x) for g, i in at.items() for x in (g, i)])
    cells = F.filter(F.arrays_zip("idx", "val"), lambda c: c["idx"].isin(list(at)))
    only = rows.select(*SPOT, F.transform(cells, lambda c: place[c["idx"]]).alias("idx"), F.transform(cells, lambda c: c["val"]).alias("val"))
    only = stored(only)
    m, v, _ = components(only, len(at), min(most, len(at)), samples, by_sample=False)
    h = project(only, v, (m.sums.sum(0) / max(m.n.sum(), 1))[None], samples, "h")
    d = _joined(rows, [h, resp.select(*SPOT, "resp"), design.select(*SPOT, "d")], beside, F.concat("h", "resp", "d"))
    fitted = d if rate is None else sample_rate(d, rate, seed)
    return subtract(d, least_squares(fitted, p, v.shape[1])[1], p, beside=_columns(beside))


def long_values(corrected: DataFrame, genes: DataFrame, beside: list[str] | None = None) -> DataFrame:
    """``(sample_id, spot_id, gene, value)`` of dense corrected arrays over ``genes (gene, gene_idx)``, for markers and displays.

    Columns ``beside`` come along, in place of a join of as many rows as there are values.
    """
    own = [*SPOT, *(beside or [])]
    names = genes.select("gene", (F.col("gene_idx") - 1).cast("int").alias("__at"))
    cells = corrected.select(*own, F.posexplode("corrected").alias("__at", "value"))
    return cells.join(sized_broadcast(names), "__at").select(*own, "gene", "value")


def integrate(corrected: DataFrame, fitted: DataFrame, spots: DataFrame) -> DataFrame:
    """Key, batch, cluster, corrected values, aligned embedding and place of each spot."""
    return corrected.join(fitted.select(*SPOT, "cluster", "hz"), SPOT).join(spots.select(*SPOT, "row", "col"), SPOT).withColumn("batch", F.col("sample_id"))


def species_name(gene: Column, species: str) -> Column:
    """A gene's name as the species' lists have it: upper case, with only the first letter in upper case, or as it is."""
    if species.lower() not in ("human", "mouse", "unknown"):
        raise ValueError("species is 'human', 'mouse' or 'unknown'")
    return {"human": F.upper, "mouse": firstup, "unknown": lambda g: g}[species.lower()](gene)


@dataclass(frozen=True)
class Integrated:
    """``rows``: sample_id, spot_id, new_id, batch, cluster, corrected, hz, row, col. ``genes (gene, gene_idx)`` name the corrected
    values, ``controls (gene)`` those that were used; ``method`` is 'factors' or 'controls'."""

    rows: DataFrame
    genes: DataFrame
    controls: DataFrame
    method: str


def integrate_samples(
    counts: DataFrame,
    fitted: DataFrame,
    spots: DataFrame,
    species: str = "unknown",
    species_genes: DataFrame | None = None,
    custom: DataFrame | None = None,
    covariates: list[str] | None = None,
    rate: float | None = None,
    seed: int = 1,
    least: int = 5,
    most: int = 10,
) -> Integrated:
    """Batch-corrected expression of all genes after a fit, with the fit's clusters and embeddings, from one sample or many.

    ``counts`` is the raw table, with more genes than the fit's and perhaps more spots; ``fitted`` has cluster, hz, hv and resp.
    Counts are cut to the spots of the fit (``ValueError`` if one is missing) and normalised over all genes. Gene names, and
    those of the user's own control genes, are written as the species' are; genes whose names become equal are added up. The control genes
    are the species' list ``species_genes (gene)`` and the user's ``custom (gene)``, as far as the samples have them. With fewer
    than ``least``, every gene is regressed on the spatial factors hv and the covariates with an intercept, and the factors'
    part is subtracted; otherwise on at most ``most`` components of the control genes, the cluster shares resp and the
    covariates, and the components' part is subtracted. ``rate`` fits on a share of the spots; all are corrected.
    ``new_id`` has the sample's number appended where barcodes repeat over samples.
    """
    if rate is not None and not 0 < rate <= 1:
        raise ValueError("rate is over 0, and 1 at most")
    as_named = lambda df: None if df is None else df.select(species_name(F.col("gene"), species).alias("gene"))
    named = counts.select(*SPOT, species_name(F.col("gene"), species).alias("gene"), "cnt")
    if species.lower() != "unknown":
        named = named.groupBy(*SPOT, "gene").agg(F.sum("cnt").alias("cnt"))
    aligned = stored(align_spots(stored(named), fitted))
    listed = aligned.select("gene").distinct()
    genes = checkpointed(listed.withColumn("gene_idx", F.row_number().over(Window.orderBy("gene"))))  # a row a gene
    controls = checkpointed(control_genes(genes.select("gene"), as_named(species_genes), as_named(custom)))
    p, many = genes.count(), controls.limit(least).count() >= least
    rows = sparse_rows(log_normalize(aligned), genes, SPOT)
    own = spots.join(fitted.select(*SPOT), SPOT, "left_semi")
    design = design_matrix(own, covariates or [])
    columns = [F.col(f"`{c}`") for c in design.columns if c not in SPOT and not (many and c == "intercept")]
    design = design.select(*SPOT, (F.array(*columns) if columns else F.array().cast("array<double>")).alias("d"))
    beside = fitted.select(*SPOT, "cluster", "hz").join(spots.select(*SPOT, "row", "col"), SPOT).withColumn("batch", F.col("sample_id")).join(disambiguate_ids(own.select(*SPOT)), SPOT)
    if many:
        places = [r[0] - 1 for r in genes.join(controls, "gene", "left_semi").select("gene_idx").collect()]  # the species' list at most
        done = correct_by_controls(stored(rows), places, fitted, design, p, most, rate, seed, beside)
    else:
        done = correct_by_factors(rows, fitted.select(*SPOT, F.col("hv").alias("h")), design, p, rate, seed, beside)
    return Integrated(done, genes, controls, "controls" if many else "factors")
