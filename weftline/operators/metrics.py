"""Agreement of labelings, and summaries of data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adjusted_rand(labels: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """``ari`` of two labelings, for all rows or within each group of ``by``; 1 where both are trivial in the same way."""
    by = by or []
    pair = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = labels.groupBy(*by, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count("*").alias("n"))
    every = cells.agg if not by else cells.groupBy(*by).agg
    joint = every(F.sum(pair("n")).alias("nij"), F.sum("n").alias("n"))

    def side(c: str, name: str) -> DataFrame:
        s = cells.groupBy(*by, c).agg(F.sum("n").alias("n"))
        return (s.groupBy(*by) if by else s).agg(F.sum(pair("n")).alias(name))

    d = joint
    for c, name in (("__a", "ai"), ("__b", "bj")):
        d = d.join(side(c, name), by) if by else d.crossJoin(side(c, name))
    expected = F.when(F.col("n") > 1, F.col("ai") * F.col("bj") / pair("n")).otherwise(F.lit(0.0))
    most = (F.col("ai") + F.col("bj")) / 2
    return d.select(*by, F.when(most == expected, F.lit(1.0)).otherwise((F.col("nij") - expected) / (most - expected)).alias("ari"))


def cluster_batch_cube(labels: DataFrame, cluster: str = "cluster", batch: str = "batch") -> DataFrame:
    """Counts of clusters by batches, with margins (NULL)."""
    return labels.cube(cluster, batch).agg(F.count("*").alias("n"))


def dataset_rollup(counts: DataFrame) -> DataFrame:
    """Spots, genes and total count of each sample, and of all (NULL)."""
    return counts.rollup("sample_id").agg(F.countDistinct("sample_id", "spot_id").alias("n_spots"), F.countDistinct("gene").alias("n_genes"), F.sum("cnt").alias("total"))
