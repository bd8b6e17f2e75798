"""Sums over sparse tables, variable genes, and the vote for a common list."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.error import erfc
from ..functions.order import quantiles
from ..sources.checkpoints import checkpointed
from .qc import SPOT, gene_filter, log_normalize, spot_filter, subset_genes


def sparse_sums(counts: DataFrame, by: str = "gene", value: str = "cnt") -> DataFrame:
    """Sum and mean of each gene over spots (or spot over genes) of a sample, zeros that aren't stored included."""
    other = "spot_id" if by == "gene" else "gene"
    size = counts.select("sample_id", other).distinct().groupBy("sample_id").agg(F.count("*").alias("n"))
    return counts.groupBy("sample_id", by).agg(F.sum(value).alias("total")).join(size, "sample_id").select("sample_id", by, "total", (F.col("total") / F.col("n")).alias("mean"))


def kernel_features(spots: DataFrame, x: str = "col", y: str = "row") -> DataFrame:
    """``(sample_id, spot_id, f)``: the eleven centred feature pairs of the spatial test, as 22 doubles.

    Pairs are the places themselves, and exp(-s^2 / 2l^2) and cos(2 pi s / l) for five lengths l, quantiles of |s|.
    """
    middle = spots.groupBy("sample_id").agg(F.avg(x).alias("__x"), F.avg(y).alias("__y"))  # one row a sample, as below
    s = spots.join(F.broadcast(middle), "sample_id").select(*SPOT, (F.col(x) - F.col("__x")).cast("double").alias("a"), (F.col(y) - F.col("__y")).cast("double").alias("b"))
    q = [0.2, 0.4, 0.6, 0.8, 1.0]
    sizes = checkpointed(s.select("sample_id", F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.abs(k).alias("v")) for k in "ab"])).alias("e")).select("sample_id", "e.*"))
    lengths = quantiles(sizes, ["sample_id", "axis"], "v", q)
    lengths = lengths.groupBy("sample_id").agg(*[F.first(F.when(F.col("axis") == k, F.col("q")), ignorenulls=True).alias(f"q{k}") for k in "ab"])
    s = s.join(F.broadcast(lengths), "sample_id")
    columns = [F.col(k) for k in "ab"]
    for i in range(len(q)):
        for form in (lambda v, w: F.exp(-v * v / (2 * w * w)), lambda v, w: F.cos(2 * math.pi * v / w)):
            columns += [form(F.col(k), F.greatest(F.col(f"q{k}")[i], F.lit(1e-12))) for k in "ab"]
    rows = s.select(*SPOT, *[c.alias(f"f{i}") for i, c in enumerate(columns)])
    means = rows.groupBy("sample_id").agg(*[F.avg(f"f{i}").alias(f"m{i}") for i in range(len(columns))])
    return rows.join(F.broadcast(means), "sample_id").select(*SPOT, F.array(*[F.col(f"f{i}") - F.col(f"m{i}") for i in range(len(columns))]).alias("f"))


def projection_sums(counts: DataFrame, features: DataFrame, pairs: int = 11) -> tuple[DataFrame, DataFrame]:
    """Per gene the sums of y times each feature, of y and of y^2; per sample the number of spots and the pairs' moments."""
    n = 2 * pairs
    features = features.select(*SPOT, F.slice("f", 1, n).alias("f"))
    joined = counts.join(features, SPOT)
    sums = joined.groupBy("sample_id", "gene").agg(*[F.sum(F.col("cnt") * F.col("f")[i]).alias(f"s{i}") for i in range(n)], F.sum("cnt").alias("sy"), F.sum(F.col("cnt") * F.col("cnt")).alias("syy"))
    moments = []
    for k in range(pairs):
        a, b = F.col("f")[2 * k], F.col("f")[2 * k + 1]
        moments += [F.sum(a * a).alias(f"aa{k}"), F.sum(a * b).alias(f"ab{k}"), F.sum(b * b).alias(f"bb{k}")]
    return sums, features.groupBy("sample_id").agg(F.count("*").alias("n"), *moments)


def projection_p(sums: DataFrame, moments: DataFrame, pair: int = 0) -> DataFrame:
    """Statistic and p-value of one kernel for each gene: chi-square with 2 degrees of freedom, scaled."""
    d = sums.join(F.broadcast(moments), "sample_id")
    a, b = F.col(f"s{2 * pair}"), F.col(f"s{2 * pair + 1}")
    aa, ab, bb = (F.col(f"{k}{pair}") for k in ("aa", "ab", "bb"))
    stat = F.col("n") * (bb * a * a - 2 * ab * a * b + aa * b * b) / (aa * bb - ab * ab) / F.col("syy")
    scale = 1 - F.col("sy") * F.col("sy") / F.col("n") / F.col("syy")
    return d.select("sample_id", "gene", stat.alias("stat"), F.exp(-stat / (2 * scale)).alias("p"))


def svg_rank(counts: DataFrame, spots: DataFrame, pairs: int = 11) -> DataFrame:
    """``(sample_id, gene, rank, p_adj)``: spatially variable genes by the combined, Benjamini-Yekutieli adjusted p-value.

    A pair of features whose columns depend on each other, as all do where spots lie along an axis, has rank one and one degree
    of freedom; one whose columns vanish takes no part, so that the combination is over the pairs that a sample has.
    """
    sums, moments = projection_sums(counts, checkpointed(kernel_features(spots)), pairs)
    moments = checkpointed(moments)  # a row a sample
    scale = 1 - F.col("sy") * F.col("sy") / F.col("n") / F.col("syy")
    stats, two, one = [], [], []
    for k in range(pairs):
        a, b, aa, ab, bb = (F.col(x) for x in (f"s{2 * k}", f"s{2 * k + 1}", f"aa{k}", f"ab{k}", f"bb{k}"))
        det = aa * bb - ab * ab
        two.append(det > 1e-9 * aa * bb)
        one.append(~two[k] & (F.greatest(aa, bb) > 1e-18 * F.col("n")))
        full = (bb * a * a - 2 * ab * a * b + aa * b * b) / F.when(two[k], det)
        stats.append(F.when(two[k], full).when(one[k], F.when(aa >= bb, a * a / aa).otherwise(b * b / bb)) * F.col("n") / F.col("syy") / scale)
    d = sums.join(F.broadcast(moments), "sample_id")
    alone = F.array(*[F.lit(None).cast("double")] * pairs)
    if not moments.where(F.array_contains(F.array(*one), True)).isEmpty():
        alone = erfc(F.array(*[F.when(o & (scale > 0), F.sqrt(x / 2)) for o, x in zip(one, stats, strict=True)]))
    d = d.withColumn("alone", alone)
    used = sum((F.when(t | o, 1).otherwise(0) for t, o in zip(two, one, strict=True)), F.lit(0))
    d = d.withColumn("used", used)
    most = F.when(F.col("used") > 1, 1 - 1 / F.col("used")).otherwise(F.lit(1.0))
    terms = []
    for k in range(pairs):
        p = F.least(F.when(two[k], F.exp(-stats[k] / 2)).otherwise(F.col("alone")[k]), most)
        term = F.when(p < 1e-15, 1 / (F.greatest(p, F.lit(1e-300)) * math.pi)).otherwise(F.tan((0.5 - p) * math.pi))
        terms.append(F.when((two[k] | one[k]) & (scale > 0), term).otherwise(F.lit(0.0)))
    t = sum(terms[1:], terms[0]) / F.greatest(F.col("used"), F.lit(1))
    p = F.when(F.col("used") == 0, F.lit(1.0)).when(t > 1e15, 1 / (t * math.pi)).otherwise(0.5 - F.atan(t) / math.pi)
    rows = d.select("sample_id", "gene", p.alias("p"))
    per = Window.partitionBy("sample_id")
    order = per.orderBy("p", "gene")
    rows = rows.withColumns({"i": F.row_number().over(order), "g": F.count("*").over(per)})
    rows = rows.withColumn("h", F.sum(1.0 / F.col("i")).over(per))
    back = per.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("p_adj", F.least(F.lit(1.0), F.min(F.col("p") * F.col("g") * F.col("h") / F.col("i")).over(back)))
    return rows.select("sample_id", "gene", F.row_number().over(per.orderBy("p_adj", "p", "gene")).alias("rank"), "p_adj")


def moments(counts: DataFrame, spots_per_sample: DataFrame) -> DataFrame:
    """``(sample_id, gene, mean, var, nnz, n)`` of raw counts, zeros included (variance over n - 1)."""
    s = counts.groupBy("sample_id", "gene").agg(F.sum("cnt").alias("s"), F.sum(F.col("cnt") * F.col("cnt")).alias("ss"), F.count("*").alias("nnz"))
    d = s.join(F.broadcast(spots_per_sample), "sample_id")
    mean = F.col("s") / F.col("n")
    return d.select("sample_id", "gene", mean.alias("mean"), ((F.col("ss") - F.col("n") * mean * mean) / (F.col("n") - 1)).alias("var"), "nnz", "n")


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local quadratic fit at each point, tricube weights over the nearest share ``span`` of points."""
    n = len(x)
    k = min(n, max(4, math.ceil(span * n)))
    out = np.empty(n)
    for i in range(n):
        d = np.abs(x - x[i])
        near = np.argpartition(d, k - 1)[:k]
        w = np.sqrt((1 - np.minimum(1, d[near] / max(d[near].max() * 1.0001, 1e-12)) ** 3) ** 3)
        a = np.vander(x[near] - x[i], 3, increasing=True)
        out[i] = np.linalg.lstsq(a * w[:, None], y[near] * w, rcond=None)[0][0]
    return out


def hvg_rank(counts: DataFrame, span: float = 0.3) -> DataFrame:
    """``(sample_id, gene, rank, score)``: genes by their variance standardised for the mean, values cut at sqrt(n)."""
    n = counts.select(*SPOT).distinct().groupBy("sample_id").agg(F.count("*").alias("n"))

    def fit(pdf):
        import pandas as pd

        good = pdf["var"] > 0
        sd = np.full(len(pdf), np.nan)
        if good.sum() > 3:
            sd[good] = np.sqrt(10 ** loess(np.log10(pdf["mean"][good].to_numpy()), np.log10(pdf["var"][good].to_numpy()), span))
        return pd.DataFrame({"sample_id": pdf["sample_id"], "gene": pdf["gene"], "mean": pdf["mean"], "sd": sd, "nnz": pdf["nnz"], "n": pdf["n"]})

    # one row a gene: a sample's genes are tens of thousands, whatever its spots
    fitted = moments(counts, n).groupBy("sample_id").applyInPandas(fit, "sample_id string, gene string, mean double, sd double, nnz long, n long").where("sd > 0")
    z = F.least((F.col("cnt") - F.col("mean")) / F.col("sd"), F.sqrt(F.col("n").cast("double")))
    some = counts.join(checkpointed(fitted), ["sample_id", "gene"]).groupBy("sample_id", "gene").agg(F.sum(z * z).alias("zz"), F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.first("nnz").alias("nnz"), F.first("n").alias("n"))
    score = (F.col("zz") + (F.col("n") - F.col("nnz")) * (F.col("mean") / F.col("sd")) ** 2) / (F.col("n") - 1)
    rows = some.select("sample_id", "gene", score.alias("score"))
    return rows.select("sample_id", "gene", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("score"), "gene")).alias("rank"), "score")


def top_genes(ranked: DataFrame, n: int) -> DataFrame:
    """The first ``n`` genes of each sample; a sample with fewer gives all it has (see ``list_size``)."""
    return ranked.where(F.col("rank") <= n)


def list_size(ranked: DataFrame, n: int) -> int:
    """``n``, or the length of the shortest list if that is less, with a warning."""
    shortest = ranked.groupBy("sample_id").count().agg(F.min("count")).first()[0] or 0
    if shortest < n:
        warnings.warn(f"a sample's list has {shortest} genes, fewer than {n}: the vote is for {shortest}", stacklevel=2)
    return min(n, shortest)


def common_genes(ranked: DataFrame, counts: DataFrame, n: int) -> DataFrame:
    """``(gene, gene_idx)``: the vote of the samples' ranked lists for ``n`` genes.

    Candidates are the genes among some list's first ``n`` that every sample has with a total over 0, each with the number of
    (whole) lists that have it. Genes with more than the n-th largest number come first, in order of first appearance; those with
    just that number fill up by the smaller median rank, then by first appearance. A single sample's list is its first n.
    """
    samples = counts.select("sample_id").distinct().count()
    number = counts.select("sample_id").distinct().withColumn("k", F.row_number().over(Window.orderBy("sample_id")))
    listed = ranked.join(F.broadcast(number), "sample_id")
    union = listed.where(F.col("rank") <= n).groupBy("gene").agg(F.min(F.struct("k", "rank")).alias("first"))
    there = counts.groupBy("sample_id", "gene").agg(F.sum("cnt").alias("t")).where("t > 0").groupBy("gene").count().where(F.col("count") == samples)
    votes = listed.groupBy("gene").agg(F.count("*").alias("votes"), F.percentile("rank", F.lit(0.5)).alias("median"))
    kept = union.join(there, "gene", "left_semi").join(votes, "gene")
    place = F.row_number().over(Window.orderBy(F.desc("votes"), "median", "first"))  # at most samples * n genes
    kept = kept.withColumn("place", place)
    cut = F.coalesce(F.max(F.when(F.col("place") == n, F.col("votes"))).over(Window.partitionBy()), F.lit(0))
    sure = F.col("votes") > cut
    order = Window.orderBy(F.desc("sure"), F.when(F.col("sure"), 0).otherwise(-F.col("votes")), F.when(F.col("sure"), 0).otherwise(F.col("median")), "first")
    kept = kept.withColumn("sure", sure)
    return kept.withColumn("gene_idx", F.row_number().over(order)).where(F.col("gene_idx") <= n).select("gene", "gene_idx")


def user_gene_list(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """``(gene, gene_idx)``: the listed genes ``(gene, pos)`` that every sample has, in the user's order."""
    samples = counts.select("sample_id").distinct().count()
    there = counts.select("sample_id", "gene").distinct().groupBy("gene").count().where(F.col("count") == samples)
    return genes.join(there, "gene", "left_semi").select("gene", F.row_number().over(Window.orderBy("pos")).alias("gene_idx"))


def dropped_genes(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """The listed genes that some sample lacks."""
    return genes.select("gene").exceptAll(user_gene_list(counts, genes).select("gene"))


def preprocess(counts: DataFrame, spots: DataFrame, gene_number: int = 2000, select: str = "spatial", genes: DataFrame | None = None, pre: tuple[int, int] = (20, 20), post: tuple[int, int] = (15, 15), keep_raw: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Filter, rank, vote, cut, filter, normalise: ``(sample_id, spot_id, gene, gene_idx, cnt, value)``, and the raw table if kept.

    ``pre`` and ``post`` are the strict limits of genes a spot and spots a gene. The first filter runs with a user list too.
    """
    if select not in ("spatial", "dispersion"):
        raise ValueError("select is 'spatial' or 'dispersion'")
    kept = checkpointed(gene_filter(spot_filter(counts, pre[0]), pre[1]))  # the votes read it several times
    if genes is None:
        ranked = checkpointed(svg_rank(kept, spots.join(kept.select(*SPOT).distinct(), SPOT, "left_semi")) if select == "spatial" else hvg_rank(kept))
        chosen = common_genes(ranked, kept, list_size(ranked, gene_number))
    else:
        chosen = user_gene_list(kept, genes)
    cut = gene_filter(spot_filter(subset_genes(kept, checkpointed(chosen)), post[0]), post[1])
    return log_normalize(cut), counts if keep_raw else None
