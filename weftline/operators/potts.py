"""Potts energies, label sweeps, responsibilities and the smoothing parameter, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import same_label_counts
from .qc import SPOT


def log_sum_exp(values: Column) -> Column:
    """log of the sum of exponentials of an array column."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def potts_energy(same: Column, degree: Column, beta: Column) -> Column:
    """Normalised energies of all labels: -log softmax(-beta / 2 * (degree - same))."""
    v = F.transform(same, lambda s: -(beta / 2) * (degree - s))
    return F.transform(v, lambda x: log_sum_exp(v) - x)


def energies(spots: DataFrame, edges: DataFrame, k: int, beta: float, label: str = "y") -> DataFrame:
    """``(sample_id, spot_id, degree, same, energy)``."""
    return same_label_counts(spots, edges, k, label).withColumn("energy", potts_energy(F.col("same"), F.col("degree"), F.lit(beta)))


def label_sweep(spots: DataFrame, edges: DataFrame, k: int, beta: float, unary: str = "u", label: str = "y") -> DataFrame:
    """``(sample_id, spot_id, y, energy)``: all spots at once take the label of least total energy, ties to the smaller label."""
    d = energies(spots, edges, k, beta, label).join(spots.select(*SPOT, F.col(unary).alias("__u")), SPOT)
    total = d.withColumn("__t", F.zip_with("energy", "__u", lambda a, b: a + b))
    return total.select(*SPOT, F.array_position("__t", F.array_min("__t")).cast("int").alias("y"), F.array_min("__t").alias("energy"))


def responsibilities(total: DataFrame, energy: str = "t") -> DataFrame:
    """``resp`` (softmax of minus the total energies) and ``loglik`` of each spot."""
    minus = F.transform(F.col(energy), lambda x: -x)
    return total.withColumn("loglik", log_sum_exp(minus)).withColumn("resp", F.transform(energy, lambda x: F.exp(-x - F.col("loglik"))))


def beta_grid(rows: DataFrame, grid: list[float], by_sample: bool = True) -> DataFrame:
    """``(sample_id, beta, objective)``: the first grid value with the largest expected log prior. ``rows``: degree, same, resp.

    One pass: a sum for each grid value, then the first maximum, so nothing is exploded.
    """
    sums = []
    for i, beta in enumerate(grid):
        e = potts_energy(F.col("same"), F.col("degree"), F.lit(float(beta)))
        sums.append(F.sum(-F.aggregate(F.zip_with("resp", e, lambda r, v: r * v), F.lit(0.0), lambda a, x: a + x)).alias(f"o{i}"))
    d = (rows.groupBy("sample_id") if by_sample else rows.groupBy(F.lit("all").alias("sample_id"))).agg(*sums)
    every = F.array(*[F.struct(F.col(f"o{i}").alias("objective"), F.lit(-i).alias("at"), F.lit(float(b)).alias("beta")) for i, b in enumerate(grid)])
    return d.select("sample_id", F.array_max(every).alias("m")).select("sample_id", F.col("m.beta").alias("beta"), F.col("m.objective").alias("objective"))
