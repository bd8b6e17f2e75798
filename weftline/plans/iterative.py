"""Queries of the iterative jobs, and the flagship: preprocess, graph, short fit, cluster sizes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.blocks import sparse_rows
from ..operators import correct, genes, graph, model, qc, start, tiled
from ..sources.adapters import counts, spots
from ..sources.checkpoints import checkpointed, stored

KEY = ["sample_id", "spot_id"]
#: Factors of a fit.
Q = 15
#: Side of a tile: some 2,000 spots of a lattice.
SIDE = 64.0


def _kept(spark: SparkSession, sf: str, pre: int = 20, cells: int = 20) -> DataFrame:
    return qc.gene_filter(qc.spot_filter(stored(counts(spark, sf)), pre), cells)


def _listed(kept: DataFrame) -> DataFrame:
    """``(gene, gene_idx)``: all genes that every sample has, by total."""
    samples = kept.select("sample_id").distinct().count()
    g = kept.groupBy("gene").agg(F.sum("cnt").alias("t"), F.countDistinct("sample_id").alias("m")).where(F.col("m") == samples)
    return g.withColumn("gene_idx", F.row_number().over(Window.orderBy(F.desc("t"), "gene"))).select("gene", "gene_idx")


def _rows(spark: SparkSession, sf: str, pre: int = 20, cells: int = 20) -> tuple[DataFrame, DataFrame, int]:
    """Sparse log-normalised rows, the genes, and how many there are."""
    kept = stored(_kept(spark, sf, pre, cells))
    listed = checkpointed(_listed(kept))
    return sparse_rows(qc.log_normalize(qc.subset_genes(kept, listed)).drop("gene_idx"), listed, KEY), listed, listed.count()


def _samples(df: DataFrame) -> list[str]:
    return [r[0] for r in df.select("sample_id").distinct().orderBy("sample_id").collect()]


def gramian(spark: SparkSession, sf: str) -> DataFrame:
    """Products of centred genes, from the moments that principal components are made of."""
    rows, listed, p = _rows(spark, sf)
    g = start.gramian(rows, p, _samples(rows)).centred()
    names = [r["gene"] for r in listed.orderBy("gene_idx").collect()]
    d = spark.createDataFrame([(a, row.tolist()) for a, row in zip(names, g, strict=True)], "gene_a string, row array<double>")
    other = F.array(*[F.lit(x) for x in names])
    return d.select("gene_a", F.posexplode("row").alias("j", "v")).select("gene_a", F.get(other, F.col("j")).alias("gene_b"), F.round("v", 5).alias("product"))


def _components(spark: SparkSession, sf: str, weighted: bool) -> DataFrame:
    rows, _, p = _rows(spark, sf)
    samples = _samples(rows)
    m, v, _ = start.components(checkpointed(rows) if p > start.MAX_GENES else rows, p, 5, samples, weighted)
    return start.project(rows, v, m.sums / np.maximum(m.n, 1)[:, None], samples)


def pca(spark: SparkSession, sf: str) -> DataFrame:
    """Five component scores of each spot."""
    return _components(spark, sf, False)


def wpca(spark: SparkSession, sf: str) -> DataFrame:
    """Five weighted component scores of each spot."""
    return _components(spark, sf, True)


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings table, all components of its vectors, as scores of three samples."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.where(fine).select((F.col("vec_id") % 3).cast("string").alias("sample_id"), F.col("vec_id").cast("string").alias("spot_id"), v.alias("vec"))


def harmonize(spark: SparkSession, sf: str) -> DataFrame:
    """Scores aligned over the three samples."""
    e = checkpointed(_embedded(spark, sf))
    return start.harmonize(e, _samples(e), clusters=20)


def kmeans_start(spark: SparkSession, sf: str) -> DataFrame:
    """Ten k-means clusters, the best of two runs."""
    return start.kmeans_start(checkpointed(_embedded(spark, sf)), 10, 2)


def gmm_start(spark: SparkSession, sf: str) -> DataFrame:
    """Ten components of a mixture with one covariance."""
    return start.mixture_start(checkpointed(_embedded(spark, sf)), 10)[0]


def _lattice_inputs(spark: SparkSession, sf: str, q: int, s: model.ModelSettings, pre: int = 20, cells: int = 20) -> model.Inputs:
    """Inputs of a fit over all genes that every sample has; q factors, or one a gene if there are fewer genes."""
    rows, _, p = _rows(spark, sf, pre, cells)
    rows = stored(rows)
    edges = graph.lattice(spots(spark, sf).join(rows.select(*KEY), KEY, "left_semi"))
    return model.prepare(rows, edges, p, min(q, p), s, ready=True)


def fit(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, embeddings and spatial factors over all common genes, for the K of 3 and 4 that the criterion prefers; three rounds."""
    s = model.ModelSettings(max_rounds=4, max_sweeps=4, init="kmeans", init_starts=1)
    x = _lattice_inputs(spark, sf, Q, s)
    fits = tiled.fit_many(x, [3, 4], s, tiled.tile_of(spots(spark, sf), SIDE))
    ll = spark.createDataFrame([(k, model.reported_loglik(p, s)) for k, (_, p) in fits.items()], "k int, loglik double")
    k = model.best_k(model.select_k(ll, *x.loadings.shape, len(x.moments.samples), int(x.moments.n.sum()), s))
    return fits[k][0].withColumn("k", F.lit(k))


def select_k(spark: SparkSession, sf: str) -> DataFrame:
    """Criteria over log-likelihoods made from line items: one for each line number."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    ll = line.groupBy(F.col("l_linenumber").cast("int").alias("k")).agg((-F.sum("l_quantity").cast("double")).alias("loglik"))
    d = model.select_k(ll, 100, 10, 2, 800)
    return d.select("k", *[F.round(c, 4).alias(c) for c in ("loglik", "dfree", "mbic", "bic", "maic", "aic")])


def control_genes(spark: SparkSession, sf: str) -> DataFrame:
    """Control genes: one brand as the species' list, some size class as the user's own."""
    g = counts(spark, sf).select("gene").distinct()
    return correct.control_genes(_kept(spark, sf).select("gene").distinct(), g.where("gene LIKE 'Brand#2%'"), g.where("gene LIKE '%#3'"))


def ols_correct_1d(spark: SparkSession, sf: str) -> DataFrame:
    """Every gene regressed on one factor (the spot's x) and an intercept, the factor's part subtracted."""
    rows, listed, p = _rows(spark, sf)
    s = spots(spark, sf).select(*KEY, F.array(F.col("x") / 100).alias("h"), F.array(F.lit(1.0)).alias("d"))
    done = correct.correct_by_factors(rows, s.drop("d"), s.drop("h"), p)
    names = F.array(*[F.lit(r["gene"]) for r in listed.orderBy("gene_idx").collect()])
    return done.select(*KEY, F.posexplode("corrected").alias("j", "v")).select(*KEY, F.get(names, F.col("j")).alias("gene"), F.round("v", 5).alias("corrected"))


def corrected(spark: SparkSession, sf: str, *beside: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every gene of the unfiltered counts corrected in the spots of a fit (the kept ones), by a factor (the spot's x); the genes; the spots.

    Columns ``beside`` of the spots come along.
    """
    every = stored(counts(spark, sf))
    listed = checkpointed(every.select("gene").distinct().withColumn("gene_idx", F.row_number().over(Window.orderBy("gene"))))
    kept = qc.spot_filter(every, 20).select(*KEY).distinct()
    s = stored(spots(spark, sf).join(kept, KEY, "left_semi").select(*KEY, F.array(F.col("x") / 100).alias("h"), F.array(F.lit(1.0)).alias("d"), *beside))
    return correct.correct_all_genes(every, listed, s.select(*KEY, "h"), s.select(*KEY, "d"), beside=s.select(*KEY, *beside) if beside else None), listed, s


def correct_all_genes(spark: SparkSession, sf: str) -> DataFrame:
    """What ``corrected`` makes, a row a spot and gene."""
    done, listed, _ = corrected(spark, sf)
    return correct.long_values(done, listed).select(*KEY, "gene", F.round("value", 5).alias("corrected"))


def _places(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts, spots and a stand-in for a fit on the kept spots, with places as barcodes, which repeat over samples.

    The label is the cluster, x the spatial factor, and the labels' indicators are the cluster shares.
    """
    s = spots(spark, sf).withColumn("barcode", F.concat_ws("x", F.col("row").cast("long").cast("string"), F.col("col").cast("long").cast("string")))
    c = stored(counts(spark, sf).join(s.select(*KEY, "barcode"), KEY).select("sample_id", F.col("barcode").alias("spot_id"), "gene", "cnt"))
    s = s.drop("spot_id").withColumnRenamed("barcode", "spot_id")
    labels = [r[0] for r in s.select("label").distinct().orderBy("label").limit(1000).collect()]
    shares = F.array(*[(F.col("label") == x).cast("double") for x in labels])
    kept = qc.spot_filter(c, 20).select(*KEY).distinct()
    fitted = s.join(kept, KEY, "left_semi").select(*KEY, F.col("label").alias("cluster"), F.array("x", "y").alias("hz"), F.array(F.col("x") / 100).alias("hv"), shares.alias("resp"))
    return c, s, stored(fitted)


def integrate_factors(spark: SparkSession, sf: str) -> DataFrame:
    """The composed integration of human samples with two control genes: fewer than five, so by the factors. A row a spot and gene."""
    c, s, fitted = _places(spark, sf)
    own = c.select("gene").distinct().where("gene IN ('Brand#11#1', 'Brand#12#2')").withColumn("gene", F.lower("gene"))
    got = correct.integrate_samples(c, fitted, s, "human", custom=own)
    beside = ["new_id", "batch", "cluster", "row", "col"]
    values = correct.long_values(got.rows, got.genes, beside)
    return values.select(*KEY, *beside, F.lit(got.method).alias("method"), "gene", F.round("value", 5).alias("corrected"))


def integrate_controls(spark: SparkSession, sf: str) -> DataFrame:
    """The composed integration with many control genes and a covariate: by components of the control genes. A row a spot."""
    c, s, fitted = _places(spark, sf)
    names = c.select("gene").distinct()
    got = correct.integrate_samples(c, fitted, s, "mouse", names.where("gene LIKE 'Brand#2%'"), names.where("gene LIKE '%#3'").withColumn("gene", F.upper("gene")), ["covar"])
    # corrected values are finite, and as many as genes
    return got.rows.select(*KEY, "new_id", "batch", "cluster", "row", "col", F.lit(got.method).alias("method"), F.lit(got.controls.count()).alias("n_controls"), F.size("corrected").alias("n_genes"), F.forall("corrected", lambda v: F.abs(v) < float("inf")).alias("finite"))


def correct_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Correction by components of the first twenty genes, with label shares as clusters."""
    rows, _, p = _rows(spark, sf)
    s = spots(spark, sf)
    labels = sorted(r[0] for r in s.select("label").distinct().collect())
    resp = s.select(*KEY, F.array(*[(F.col("label") == x).cast("double") for x in labels]).alias("resp"))
    return correct.correct_by_controls(checkpointed(rows), list(range(20)), resp, s.select(*KEY, F.array(F.col("covar").cast("double")).alias("d")), p)


def integrate(spark: SparkSession, sf: str) -> DataFrame:
    """A fit of two rounds over all common genes, their correction by its spatial factors, and both joined with places."""
    s = model.ModelSettings(max_rounds=3, max_sweeps=3, init="kmeans", init_starts=1)
    x = _lattice_inputs(spark, sf, Q, s)
    fitted = tiled.fit_many(x, [4], s, tiled.tile_of(spots(spark, sf), SIDE))[4][0]
    one = x.rows.select(*KEY, F.array(F.lit(1.0)).alias("d"))
    done = correct.correct_by_factors(x.rows, fitted.select(*KEY, F.col("hv").alias("h")), one, len(x.loadings))
    return correct.integrate(done, fitted, spots(spark, sf))


def display_components(spark: SparkSession, sf: str) -> DataFrame:
    """Three display coordinates of the aligned embeddings."""
    e = checkpointed(harmonize(spark, sf))
    rows = e.select(*KEY, F.transform("vec", lambda _, i: i).alias("idx"), F.col("vec").alias("val"))
    samples, p = _samples(rows), e.agg(F.max(F.size("vec"))).first()[0]
    m = start.gramian(rows, p or 0, samples)
    v, _ = start.pca(m, 3, by_sample=False)
    return start.project(rows, v, (m.sums.sum(0) / max(m.n.sum(), 1))[None], samples)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Preprocess, lattice, a fit with K = 4, and ``(sample_id, cluster, n_spots)``; limits fit small inputs too."""
    s = model.ModelSettings(max_rounds=3, max_sweeps=3, init="kmeans", init_starts=1)
    x = _lattice_inputs(spark, sf, Q, s, 5, 2)
    fitted, _ = tiled.fit_many(x, [4], s, tiled.tile_of(spots(spark, sf), SIDE))[4]
    return fitted.groupBy("sample_id", "cluster").agg(F.count("*").alias("n_spots"))


#: Shared by two oracles: genes that all five samples have, normalised over them.
_FULL = """full_expr AS (SELECT sample_id, spot_id, gene, ln(1 + 1e4 * cnt / sum(cnt) OVER (PARTITION BY sample_id, spot_id)) AS value FROM kept SEMI JOIN (SELECT gene FROM kept GROUP BY gene HAVING count(DISTINCT sample_id) = (SELECT count(DISTINCT sample_id) FROM kept)) g USING (gene)),
  full_spots AS (SELECT DISTINCT sample_id, spot_id FROM full_expr), full_genes AS (SELECT DISTINCT gene FROM full_expr)"""
#: A spot's place as its barcode.
_BARCODE = "CAST(CAST(\"row\" AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(col AS BIGINT) AS VARCHAR)"
_HEAVY = math.log(math.log(900))

QUERIES = {
    "gramian": (gramian, f"""SELECT * FROM (WITH {_FULL},
  s AS (SELECT sample_id, gene, sum(value) AS s FROM full_expr GROUP BY ALL), n AS (SELECT sample_id, count(*) AS n FROM full_spots GROUP BY ALL),
  ab AS (SELECT a.gene AS gene_a, b.gene AS gene_b, sum(a.value * b.value) AS v FROM full_expr a JOIN full_expr b USING (sample_id, spot_id) GROUP BY ALL),
  c AS (SELECT a.gene AS gene_a, b.gene AS gene_b, sum(a.s * b.s / n) AS c FROM s a JOIN s b USING (sample_id) JOIN n USING (sample_id) GROUP BY ALL)
  SELECT gene_a, gene_b, round(coalesce(v, 0) - c, 5) AS product FROM c LEFT JOIN ab USING (gene_a, gene_b))"""),
    "pca": (pca, None),
    "wpca": (wpca, None),
    "harmonize": (harmonize, None),
    "kmeans_start": (kmeans_start, None),
    "gmm_start": (gmm_start, None),
    "fit": (fit, None),
    "select_k": (select_k, f"SELECT k, loglik, dfree, round(-2 * loglik + dfree * {math.log(800) * _HEAVY!r}, 4) AS mbic, round(-2 * loglik + dfree * {math.log(800) * _HEAVY!r}, 4) AS bic, round(-2 * loglik + dfree * {2 * _HEAVY!r}, 4) AS maic, round(-2 * loglik + dfree * 2, 4) AS aic FROM (SELECT CAST(l_linenumber AS INTEGER) AS k, round(-sum(l_quantity)::DOUBLE, 4) AS loglik, (2 + 100 * 12 + 2 * 55 + 20 * l_linenumber)::DOUBLE AS dfree FROM lineitem GROUP BY l_linenumber)"),
    "control_genes": (control_genes, "SELECT DISTINCT gene FROM kept WHERE gene LIKE 'Brand#2%' OR gene LIKE '%#3'"),
    "ols_correct_1d": (ols_correct_1d, f"""SELECT * FROM (WITH {_FULL},
  d AS (SELECT sample_id, spot_id, gene, coalesce(value, 0) AS value, x / 100 AS h FROM full_spots CROSS JOIN full_genes LEFT JOIN full_expr USING (sample_id, spot_id, gene) JOIN spots USING (sample_id, spot_id))
  SELECT sample_id, spot_id, gene, round(value - b * h, 5) AS corrected FROM d JOIN (SELECT gene, regr_slope(value, h) AS b FROM d GROUP BY gene) USING (gene))"""),
    "correct_all_genes": (correct_all_genes, "SELECT sample_id, spot_id, gene, round(value, 5) AS corrected FROM corrected"),
    "integrate_factors": (integrate_factors, f"SELECT sample_id, {_BARCODE} AS spot_id, {_BARCODE} || CAST(dense_rank() OVER (ORDER BY sample_id) AS VARCHAR) AS new_id, sample_id AS batch, label AS cluster, \"row\", col, 'factors' AS method, upper(gene) AS gene, round(value, 5) AS corrected FROM corrected JOIN spots USING (sample_id, spot_id)"),
    "integrate_controls": (integrate_controls, f"SELECT sample_id, {_BARCODE} AS spot_id, {_BARCODE} || CAST(dense_rank() OVER (ORDER BY sample_id) AS VARCHAR) AS new_id, sample_id AS batch, label AS cluster, \"row\", col, 'controls' AS method, (SELECT count(DISTINCT gene) FROM counts WHERE gene LIKE 'Brand#2%' OR gene LIKE '%#3') AS n_controls, (SELECT CAST(count(DISTINCT gene) AS INTEGER) FROM counts) AS n_genes, true AS finite FROM kept_spots JOIN spots USING (sample_id, spot_id)"),
    "correct_controls": (correct_controls, None),
    "integrate": (integrate, None),
    "display_components": (display_components, None),
}
