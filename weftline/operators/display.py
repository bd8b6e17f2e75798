"""Tables behind displays: scaled values, heat maps, dots, colours, scatter codes, box summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import quantiles
from ..sources.checkpoints import checkpointed
from .markers import downsample
from .qc import SPOT


def scale_genes(expr: DataFrame, spots: int | None = None, cap: float = 10.0) -> DataFrame:
    """``scaled``: each gene to mean 0 and standard deviation 1 over all spots (zeros that aren't stored included), at most ``cap``.

    Only stored values get a row; a spot's missing gene has the scaled value ``zero_scaled``.
    """
    n = expr.select(*SPOT).distinct().count() if spots is None else spots
    s = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    mean = F.col("s") / n
    sd = F.sqrt(F.greatest((F.col("ss") - n * mean * mean) / max(1, n - 1), F.lit(0.0)))
    stats = s.select("gene", mean.alias("mean"), sd.alias("sd"))
    form = lambda v: F.when(F.col("sd") > 0, F.least((v - F.col("mean")) / F.col("sd"), F.lit(cap))).otherwise(F.lit(0.0))
    return expr.join(stats, "gene").select(*SPOT, "gene", "value", form(F.col("value")).alias("scaled"), form(F.lit(0.0)).alias("zero_scaled"))


def heatmap_rows(expr: DataFrame, clusters: DataFrame, genes: DataFrame, per_cluster: int = 50, seed: int | None = 1) -> DataFrame:
    """``(cluster, sample_id, spot_id, gene, scaled)`` of chosen genes in spots sampled from each cluster."""
    few = downsample(clusters, "cluster", per_cluster, seed)
    return scale_genes(expr).join(genes.select("gene"), "gene", "left_semi").join(few, SPOT).select("cluster", *SPOT, "gene", "scaled")


def dot_summary(expr: DataFrame, clusters: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``(cluster, gene, mean, pct, scaled)``: mean of expm1 and share over 0 of a gene in a cluster; log means scaled over clusters, clipped."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    sums = expr.join(clusters, SPOT).groupBy("cluster", "gene").agg(F.sum(F.expm1("value")).alias("e"), F.count_if(F.col("value") > 0).alias("k"))
    every = expr.select("gene").distinct().crossJoin(F.broadcast(size)).join(sums, ["cluster", "gene"], "left").na.fill(0, ["e", "k"])
    rows = every.select("cluster", "gene", (F.col("e") / F.col("n")).alias("mean"), (F.col("k") / F.col("n")).alias("pct"))
    per, v = Window.partitionBy("gene"), F.log1p("mean")
    sd = F.stddev_samp(v).over(per)
    scaled = F.when(sd > 0, F.least(F.greatest((v - F.avg(v).over(per)) / sd, F.lit(low)), F.lit(high))).otherwise(F.lit(low))
    return rows.withColumn("scaled", scaled)


def rgb_display(points: DataFrame, columns: tuple[str, str, str]) -> DataFrame:
    """``rgb``: three components, each from its least to its largest value in the sample, as #RRGGBB; a constant one is 0."""
    ends = [f(c).alias(f"__{k}{i}") for i, c in enumerate(columns) for k, f in (("low", F.min), ("high", F.max))]
    limits = points.groupBy(F.col("sample_id").alias("__sample")).agg(*ends)  # one row a sample
    parts = []
    for i, c in enumerate(columns):
        low, high = F.col(f"__low{i}"), F.col(f"__high{i}")
        share = F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.0))
        parts.append(F.lpad(F.hex(F.floor(share * 255 + 0.5).cast("long")), 2, "0"))
    joined = points.join(F.broadcast(limits), F.col("sample_id").eqNullSafe(F.col("__sample")))
    return joined.withColumn("rgb", F.concat(F.lit("#"), *parts)).select(*[c for c in points.columns if c != "rgb"], "rgb")


def scatter_codes(spots: DataFrame, label: str, seed: int | None = None) -> DataFrame:
    """Places with the label's number 1..n in sorted order, and a plotting order (by a hash with a seed)."""
    codes = spots.select(F.col(label).alias("__l")).where("__l IS NOT NULL").distinct().withColumn("code", F.row_number().over(Window.orderBy("__l")))
    d = spots.join(codes, F.col(label) == F.col("__l"), "left").drop("__l")
    return d if seed is None else d.withColumn("plot_order", F.xxhash64(F.lit(seed), *SPOT))


def box_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(name, min, q1, median, q3, max, low, high)`` of each column that isn't all NULL; low and high end the whiskers.

    Quantiles are exact and found from counts: no task gets a column's values. NaN and infinite values take no part.
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where(F.abs("v") < F.lit(float("inf")))
    q = quantiles(long, ["name"], "v", [0.0, 0.25, 0.5, 0.75, 1.0])
    q = q.select("name", *[F.col("q")[i].alias(c) for i, c in enumerate(("min", "q1", "median", "q3", "max"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = long.join(F.broadcast(q), "name").groupBy("name").agg(F.min(F.when(F.col("v") >= F.col("q1") - reach, F.col("v"))).alias("low"), F.max(F.when(F.col("v") <= F.col("q3") + reach, F.col("v"))).alias("high"))
    return q.join(ends, "name")


def feature_quantile(expr: DataFrame, quant: float = 0.5) -> DataFrame:
    """``(gene, midpoint)``: the quantile of a gene's scaled values."""
    return quantiles(checkpointed(scale_genes(expr)), ["gene"], "scaled", [quant]).select("gene", F.col("q")[0].alias("midpoint"))
