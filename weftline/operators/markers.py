"""Marker genes of clusters, and top rows of groups."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.error import erfc
from ..functions.order import SMALL, cut_points, part_of, sized_broadcast
from ..sources.checkpoints import stored, table_path
from .qc import SPOT


def top_n(rows: DataFrame, group: str, by: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the largest value, ties kept."""
    return rows.withColumn("rank", F.rank().over(Window.partitionBy(group).orderBy(F.desc(by)))).where(F.col("rank") <= n)


def row_hash(keys: list[str], seed: int) -> Column:
    """A hash of seed and keys as text, the same in every engine: rows are in its order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def smallest_hashes(rows: DataFrame, by: list[str], want: Callable[[Column], Column], keys: list[str], seed: int) -> DataFrame:
    """Of each group the rows with the smallest hashes of ``keys``, as many as ``want`` makes of the group's size.

    The limit of each group is found from counts of the hashes' first four digits, which combine before they are shuffled. Rows
    under it are taken where they stand; only those at the limit, one in 65,536 of a large group, are sorted.
    """
    h = row_hash(keys, seed)
    bins = rows.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.substring(h, 1, 4).alias("__bin")).agg(F.count("*").alias("m"))
    own = [f"__g{i}" for i in range(len(by))]
    per = Window.partitionBy(*own, F.lit(0))
    upto, total = F.sum("m").over(per.orderBy("__bin")), F.sum("m").over(per)
    need = F.greatest(F.least(want(F.col("total")), F.col("total")), F.lit(0))
    bins = bins.withColumns({"upto": upto, "total": total}).withColumn("need", need)
    edge = F.min(F.when(F.col("upto") >= F.col("need"), F.struct(F.col("__bin").alias("at"), (F.col("need") - F.col("upto") + F.col("m")).alias("left"))))
    limits = bins.groupBy(*own).agg(edge.alias("__edge"))
    same = F.lit(True)
    for c, k in zip(by, own, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    marked = rows.withColumn("__h", h).join(sized_broadcast(limits), same)
    under = marked.where(F.substring("__h", 1, 4) < F.col("__edge.at"))
    order = Window.partitionBy(*own, F.lit(0)).orderBy("__h", *keys)
    at = marked.where(F.substring("__h", 1, 4) == F.col("__edge.at")).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.col("__edge.left"))
    return under.select(*rows.columns).union(at.select(*rows.columns))


def downsample(rows: DataFrame, group: str, m: int, seed: int | None = 1, keys: list[str] | None = None) -> DataFrame:
    """At most ``m`` rows of each group, by a hash of seed and keys (the sample and the spot), or by the keys alone for ``seed=None``.

    The same rows for any partitioning, also where barcodes repeat over samples.
    """
    keys = [c for c in SPOT if c in rows.columns] if keys is None else keys
    if seed is None:
        return rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*keys))).where(F.col("__r") <= m).drop("__r")
    return smallest_hashes(rows, [group], lambda n: F.lit(m).cast("long"), keys, seed)


def sample_rate(rows: DataFrame, rate: float, seed: int = 1, keys: list[str] | None = None) -> DataFrame:
    """Exactly floor(rate * n) rows, by a hash of seed and keys (the sample and the spot): the same ones however rows are partitioned."""
    if not 0 <= rate <= 1:
        raise ValueError("rate is from 0 to 1")
    return smallest_hashes(rows, [], lambda n: F.floor(n * F.lit(float(rate))), [c for c in SPOT if c in rows.columns] if keys is None else keys, seed)


#: Values that are shuffled at once; of more, some genes' at a time.
MOST_VALUES = 1 << 28


def _sums(d: DataFrame, path: str, small: int) -> DataFrame:
    """``(gene, cluster, r, k, pos, e, ties)``: sums over the values but 0, with mid-ranks among these; a gene without any has NULLs.

    The table of values is at ``path``, in place of the one before.
    """
    by_value = stored(d.groupBy("gene", F.col("value").cast("double").alias("value"), "cluster").agg(F.count("*").alias("m")), path)
    most = by_value.groupBy("gene").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
    cuts = F.lit(None).cast("array<double>")
    if most > small:
        by_value = by_value.join(sized_broadcast(cut_points(by_value, ["gene"], "value", small)), "gene", "left")
        cuts = F.col("cuts")
    one = by_value.where("value <> 0").select("gene", "value", "cluster", "m", part_of(cuts, F.col("value")).alias("part"))
    upto = F.sum("m").over(Window.partitionBy("gene", "part").orderBy("value"))
    ties = F.sum("m").over(Window.partitionBy("gene", "part", "value"))
    one = one.withColumns({"upto": upto, "t": ties})
    mid, t = F.col("upto") - (F.col("t") - 1) / 2, F.col("t").cast("double")
    sums = [F.sum(F.col("m") * mid).alias("r"), F.sum("m").alias("k"), F.sum(F.when(F.col("value") > 0, F.col("m")).otherwise(0)).alias("pos"), F.sum(F.col("m") * F.expm1("value")).alias("e"), F.sum(F.col("m") * (t * t - 1)).alias("ties")]
    parts = one.groupBy("gene", "part", "cluster").agg(*sums)
    # values in the parts below come first
    before = F.coalesce(F.sum("k").over(Window.partitionBy("gene").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("r", F.col("r") + F.col("k") * before)
    own = parts.groupBy("gene", "cluster").agg(*[F.sum(c).alias(c) for c in ("r", "k", "pos", "e", "ties")])
    return stored(by_value.select("gene").distinct().join(own, "gene", "left"))


def rank_sums(expr: DataFrame, clusters: DataFrame, small: int = SMALL, values: int | None = None) -> DataFrame:
    """``(cluster, gene, n1, n, pct1, pct2, avg_log2fc, z)``: each cluster against the rest, by mid-ranks over all values.

    Zeros, stored or not, are one block of ties inside the order: negative values below it, positive ones above. Values of equal
    size are summed before they are ranked. A gene with more than ``small`` of them is ranked in parts between cut points, so
    that no task gets a gene's values, whatever the number of spots. Of more than ``MOST_VALUES`` values (``values``, where their
    number is known) some genes' at a time are shuffled, which bounds the disk. An ``expr`` that has its spots' ``cluster`` isn't
    joined with ``clusters``. All else is sums of genes by clusters. ``pct1`` and ``pct2`` are shares of values over 0; fold
    changes are of means of exp(value) - 1, plus 1.
    """
    d = expr.where("value IS NOT NULL")
    if "cluster" not in expr.columns:
        d = d.join(clusters.select(*SPOT, "cluster"), SPOT)
    sizes = {r["cluster"]: r["n1"] for r in clusters.groupBy("cluster").agg(F.count("*").alias("n1")).where("cluster IS NOT NULL").collect()}  # one number a cluster
    n = sum(sizes.values())
    turns, path = max(1, math.ceil((d.count() if values is None else values) / MOST_VALUES)), table_path(expr.sparkSession)
    turn = F.pmod(F.xxhash64("gene"), F.lit(turns))
    own = [_sums(d.where(turn == i) if turns > 1 else d, path, small) for i in range(turns)]
    genes = reduce(DataFrame.union, own).groupBy("gene")
    per_gene = genes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("k", "pos", "e", "ties")], F.map_from_entries(F.collect_list(F.when(F.col("cluster").isNotNull(), F.struct("cluster", F.struct("r", "k", "pos", "e"))))).alias("own"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cluster"), F.lit(k).cast("long").alias("n1")) for c, k in sizes.items()])).alias("c")
    if not sizes:
        return per_gene.select(F.lit(None).cast(dict(clusters.dtypes)["cluster"]).alias("cluster"), "gene", *[F.lit(None).cast("long").alias(c) for c in ("n1", "n")], *[F.lit(None).cast("double").alias(c) for c in ("pct1", "pct2", "avg_log2fc", "z")]).limit(0)
    every = per_gene.select("gene", "k", "pos", "e", "ties", "own", each).select("*", F.col("c.cluster").alias("cluster"), F.col("c.n1").alias("n1"))
    x = F.col("own")[F.col("cluster")]
    r1, k1, pos1, e1 = (F.coalesce(x[c], F.lit(0)) for c in ("r", "k", "pos", "e"))
    n1, n2, zeros = F.col("n1"), F.lit(n) - F.col("n1"), F.lit(n) - F.col("k")
    negative = F.col("k") - F.col("pos")
    rank_sum = r1 + pos1 * zeros + (n1 - k1) * (negative + (zeros + 1) / 2)
    u = rank_sum - n1 * (n1 + 1) / 2 - n1 * n2 / 2.0
    block = zeros.cast("double") ** 3 - zeros
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - (F.col("ties") + block) / (n * (n - 1.0)))) if n > 1 else F.lit(0.0)
    z = F.when(sd > 0, (u - F.signum(u) * 0.5) / sd).otherwise(F.lit(0.0))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 3)
    mean1, mean2 = e1 / n1, F.when(n2 > 0, (F.col("e") - e1) / n2).otherwise(F.lit(0.0))
    return every.select("cluster", "gene", "n1", F.lit(n).cast("long").alias("n"), share(pos1, n1).alias("pct1"), share(F.col("pos") - pos1, n2).alias("pct2"), (F.log2(mean1 + 1) - F.log2(mean2 + 1)).alias("avg_log2fc"), z.alias("z"))


def markers(expr: DataFrame, clusters: DataFrame, min_pct: float = 0.1, min_log2fc: float = 0.25, max_p: float = 0.01) -> DataFrame:
    """Rows of ``rank_sums`` that pass the thresholds, with p and Bonferroni-adjusted p."""
    genes = expr.select("gene").distinct().count()

    d = rank_sums(expr, clusters).where((F.greatest("pct1", "pct2") >= min_pct) & (F.col("avg_log2fc") >= min_log2fc))
    d = d.withColumn("p", erfc(F.array(F.abs("z") / math.sqrt(2)))[0]).where(F.col("p") < max_p)
    return d.withColumn("p_adj", F.least(F.lit(1.0), F.col("p") * genes))
