"""Filters, normalisation, names and designs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPOT = ["sample_id", "spot_id"]


def spot_filter(counts: DataFrame, min_features: int = 0, inclusive: bool = False) -> DataFrame:
    """Rows of the spots with more than (``inclusive``: at least) ``min_features`` genes over 0."""
    n = counts.groupBy(*SPOT).agg(F.count_if(F.col("cnt") > 0).alias("n"))
    return counts.join(n.where(F.col("n") >= min_features if inclusive else F.col("n") > min_features), SPOT, "left_semi")


def gene_filter(counts: DataFrame, min_spots: int = 20, inclusive: bool = False) -> DataFrame:
    """Rows of the genes that more than (``inclusive``: at least) ``min_spots`` spots of the sample have over 0."""
    n = counts.groupBy("sample_id", "gene").agg(F.count_if(F.col("cnt") > 0).alias("n"))
    return counts.join(n.where(F.col("n") >= min_spots if inclusive else F.col("n") > min_spots), ["sample_id", "gene"], "left_semi")


def inclusive_filter(counts: DataFrame, min_features: int = 10, min_cells: int = 10) -> DataFrame:
    """Spots with at least ``min_features`` genes, then genes in at least ``min_cells`` of these."""
    return gene_filter(spot_filter(counts, min_features, True), min_cells, True)


def subset_genes(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Rows of the listed genes ``(gene, gene_idx)``, with their place in the list."""
    return counts.join(genes.select("gene", "gene_idx"), "gene")


def log_normalize(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """``value`` = ln(1 + scale * count / the spot's total over the genes that are there)."""
    total = F.sum("cnt").over(Window.partitionBy(*SPOT))
    return counts.withColumn("value", F.log1p(F.lit(scale) * F.col("cnt") / total))


def gene_means(expr: DataFrame) -> DataFrame:
    """Each sample's mean of each gene, zeros included: what centring subtracts."""
    spots = expr.select(*SPOT).distinct().groupBy("sample_id").agg(F.count("*").alias("n"))
    sums = expr.groupBy("sample_id", "gene").agg(F.sum("value").alias("total"))
    return sums.join(spots, "sample_id").select("sample_id", "gene", (F.col("total") / F.col("n")).alias("mean"))


def firstup(name: Column) -> Column:
    """Lower case, with the first letter upper case."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 1 << 30)))


def make_unique(names: DataFrame, name: str = "gene", order: str = "pos") -> DataFrame:
    """Upper-case names made unique: ``X, X.1, X.2`` in order; a number whose name stands already is passed over."""
    rows = names.withColumn(name, F.upper(name)).withColumn("__n", F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1)
    # numbers that are taken by names as they stand, of each name
    cut = F.regexp_extract(name, r"^(.*)\.([1-9][0-9]*)$", 1)
    taken = rows.select(cut.alias("__stem"), F.regexp_extract(name, r"\.([1-9][0-9]*)$", 1).try_cast("long").alias("__taken")).where("__taken IS NOT NULL").groupBy("__stem").agg(F.sort_array(F.collect_set("__taken")).alias("__t"))
    later = rows.join(taken, F.col(name) == F.col("__stem"), "left")
    # the n-th number that isn't taken: each taken one at or below moves it up
    moved = F.aggregate(F.coalesce("__t", F.array().cast("array<long>")), F.col("__n").cast("long"), lambda a, t: a + F.when(t <= a, 1).otherwise(0))
    return later.withColumn("unique_name", F.when(F.col("__n") == 0, F.col(name)).otherwise(F.concat_ws(".", F.col(name), moved.cast("string")))).drop("__n", "__stem", "__t")


def translate_genes(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Gene ids replaced by ``mapping (gene, symbol)``; ids that it lacks stay."""
    return counts.join(mapping, "gene", "left").withColumn("gene", F.coalesce("symbol", "gene")).drop("symbol")


def disambiguate_ids(spots: DataFrame) -> DataFrame:
    """``new_id``: where any spot id repeats over samples, all get their sample's number (samples in order, from 1) appended."""
    number = spots.select("sample_id").distinct().withColumn("__k", F.row_number().over(Window.orderBy("sample_id")))
    again = spots.groupBy("spot_id").count().agg(F.max("count").alias("__most"))
    return spots.join(number, "sample_id").crossJoin(again).withColumn("new_id", F.when(F.col("__most") > 1, F.concat("spot_id", F.col("__k").cast("string"))).otherwise(F.col("spot_id"))).drop("__k", "__most")


def rotate(spots: DataFrame, theta: float, x: str = "col", y: str = "row") -> DataFrame:
    """Coordinates turned counter-clockwise by ``theta`` radians."""
    c, s = math.cos(theta), math.sin(theta)
    return spots.withColumns({x: F.col(x) * c - F.col(y) * s, y: F.col(x) * s + F.col(y) * c})


def add_embedding(embeddings: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``embeddings`` with the rows ``(sample_id, spot_id, vec)`` under a name."""
    return embeddings.unionByName(rows.select(*SPOT, F.lit(name).alias("name"), "vec"))


def design_matrix(spots: DataFrame, columns: list[str]) -> DataFrame:
    """Intercept, numeric covariates as they are, and text ones as dummies (the first level dropped); NULL stays NULL."""
    kinds, out = dict(spots.dtypes), [F.lit(1.0).alias("intercept")]
    for c in columns:
        if kinds[c] == "string":
            levels = sorted(r[0] for r in spots.select(c).where(F.col(c).isNotNull()).distinct().limit(1001).collect())
            if len(levels) > 1000:
                raise ValueError(f"{c} has over 1000 levels")
            out += [F.when(F.col(c).isNotNull(), (F.col(c) == level).cast("double")).alias(f"{c}_{level}") for level in levels[1:]]
        else:
            out.append(F.col(c).cast("double").alias(c))
    return spots.select(*SPOT, *out)


def align_spots(full: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of a fuller table for the kept spots; an error if one of them isn't there."""
    keys = kept.select(*SPOT).distinct()
    if not keys.join(full.select(*SPOT).distinct(), SPOT, "left_anti").isEmpty():
        raise ValueError("a kept spot is missing from the full table")
    return full.join(keys, SPOT, "left_semi")
