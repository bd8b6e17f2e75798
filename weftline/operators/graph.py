"""Neighbour graphs ``edges (sample_id, spot_id, nbr_id)`` by equi-joins, and what is summed over them."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import order_statistics, sized_broadcast
from ..sources.checkpoints import checkpointed
from .qc import SPOT

#: Neighbour offsets (column, row) of the two lattices.
OFFSETS = {
    "Visium": [(-2, 0), (2, 0), (-1, -1), (1, -1), (-1, 1), (1, 1)],
    "ST": [(0, -1), (1, 0), (0, 1), (-1, 0)],
}


def lattice(spots: DataFrame, platform: str = "Visium", x: str = "col", y: str = "row") -> DataFrame:
    """Neighbours on a lattice: each spot emits its neighbours' places, joined on (sample, place)."""
    if platform not in OFFSETS:
        raise ValueError(f"platform is one of {', '.join(OFFSETS)}")
    offsets = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in OFFSETS[platform]])
    asked = spots.select(*SPOT, F.explode(offsets).alias("o"), F.col(x).alias("x"), F.col(y).alias("y"))
    asked = asked.select(*SPOT, (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"))
    there = spots.select("sample_id", F.col("spot_id").alias("nbr_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return asked.join(there, ["sample_id", "x", "y"]).select(*SPOT, "nbr_id")


def _cells(spots: DataFrame, side: float, x: str, y: str) -> DataFrame:
    return spots.select(*SPOT, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.floor(F.col(x) / side).alias("cx"), F.floor(F.col(y) / side).alias("cy"))


def _around(rings: int) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-rings, rings + 1) for b in range(-rings, rings + 1)])


#: Spots of a cell that one task compares with what is around them; those of a denser cell are dealt to several.
DENSE = 2048


def _close_pairs(spots: DataFrame, side: float, x: str, y: str, askers: DataFrame | None = None, dense: int | None = None, others: DataFrame | None = None) -> DataFrame:
    """Pairs of spots in the same or adjacent cells of ``side``, with their squared distance; no self.

    ``askers (sample_id, spot_id, …)`` are the spots whose neighbours are wanted, with columns to keep (all spots if None);
    ``others`` are the spots that may be neighbours (all if None). A cell with more than ``dense`` spots is copied to as many parts as it has so many, and who asks for it is dealt to one
    of them by a hash, so that no task has all pairs of a dense cell.
    """
    dense = DENSE if dense is None else dense
    c = checkpointed(_cells(spots, side, x, y))
    cell = ["sample_id", "cx", "cy"]
    parts = c.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > dense).select(*cell, F.ceil(F.col("n") / dense).cast("int").alias("parts"))
    parts = sized_broadcast(checkpointed(parts))
    own = c if askers is None else c.join(askers, SPOT)
    one = own.withColumn("o", F.explode(_around(1))).withColumns({"cx": F.col("cx") + F.col("o.a"), "cy": F.col("cy") + F.col("o.b")}).drop("o")
    one = one.join(parts, cell, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*SPOT), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    two = c if others is None else _cells(others, side, x, y)
    two = two.select("sample_id", F.col("spot_id").alias("nbr_id"), F.col("x").alias("nx"), F.col("y").alias("ny"), "cx", "cy")
    two = two.join(parts, cell, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    d2 = (F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2
    return one.join(two, [*cell, "part"]).where("spot_id <> nbr_id").withColumn("d2", d2).drop("part")


def radius_graph(spots: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Neighbours strictly nearer than ``radius``: cells as wide as the radius, nine of them joined."""
    return _close_pairs(spots, radius, x, y).where(F.sqrt("d2") < radius).select(*SPOT, "nbr_id")


def median_degree(spots: DataFrame, edges: DataFrame) -> float:
    """Median number of neighbours, spots without any included."""
    degree = edges.groupBy(*SPOT).count()
    return float(spots.join(degree, SPOT, "left").agg(F.percentile(F.coalesce("count", F.lit(0)), F.lit(0.5))).first()[0])


def median_degrees(spots: DataFrame, most: int, x: str = "x", y: str = "y") -> Callable[[float], float]:
    """The median number of neighbours nearer than a radius, as a function of the radius, without a graph for each.

    From one pass of ``most`` nearest neighbours: a spot has k neighbours within a radius if its k-th nearest is, so the
    middle spots' degrees follow from order statistics of the distances to the k-th nearest. Degrees over ``most`` count as ``most``.
    """
    n = spots.count()
    near = checkpointed(nearest(spots, most, x, y).select("r", F.sqrt("d2").alias("d")))
    middle = [(n - 1) // 2, n // 2]  # the same spot twice if their number is odd
    at = F.array(*[F.lit(n - 1 - j).cast("long") for j in middle])
    stats = order_statistics(near, ["r"], "d", lambda m: F.filter(at, lambda i: i < m))
    found = {r["r"]: r["found"] for r in stats.collect()}  # two numbers a neighbour
    reach = [[found.get(k, {}).get(n - 1 - j, math.inf) for k in range(1, most + 1)] for j in middle]
    return lambda radius: sum(sum(t < radius for t in each) for each in reach) / 2


def auto_radius(spots: DataFrame, low: float = 4, high: float = 6, start: float = 1.0, least: float = 1.0, most: float = 50.0, steps: int = 40, x: str = "x", y: str = "y") -> float:
    """A radius, found by halving, for which the median number of neighbours is from ``low`` to ``high``.

    Distances are looked at once (``median_degrees``); a median of two degrees is within the bounds only if neither is over
    twice ``high``. Where no radius from ``least`` to ``most`` has such a median, as with many spots at each place, it is the
    radius of the last step, with a warning.
    """
    median_at = median_degrees(spots, int(2 * high) + 1, x, y)
    radius = start
    for step in range(steps):
        median = median_at(radius)
        if low <= median <= high:
            return radius
        if step < steps - 1:
            least, most = (radius, most) if median < low else (least, radius)
            radius = (least + most) / 2
    warnings.warn(f"no radius has a median of {low} to {high} neighbours; the last one tried is {radius}", stacklevel=2)
    return radius


def nearest(spots: DataFrame, k: int, x: str = "col", y: str = "row", rounds: int = 24) -> DataFrame:
    """``(sample_id, spot_id, nbr_id, d2, r)``: the ``k`` nearest spots of each (or all others, if there are fewer), ties to the
    smaller id; exact.

    Cells start at a side that holds about ``k`` spots, or at smaller ones where spots are dense, in which only spots with enough
    others in their cell ask. A spot is done once its k-th neighbour is no farther than the side, as no spot outside the
    adjacent cells is nearer; for the others the side is doubled. Of the spots at one place only those with the ``k`` + 1
    smallest ids can be among anyone's ``k`` nearest, so that equal places don't make pairs of all their spots.
    """
    size = checkpointed(spots.groupBy("sample_id").agg(F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("w"), (F.max(y) - F.min(y)).alias("h")))
    none = spots.select(*SPOT, F.col("spot_id").alias("nbr_id"), F.lit(0.0).alias("d2"), F.lit(1).alias("r")).limit(0)
    side, far = size.agg(F.min(F.sqrt(F.greatest(F.col("w") * F.col("h"), F.lit(1e-9)) * k / F.col("n"))), F.max(F.greatest("w", "h"))).first()
    if side is None:
        return none
    side, found = max(float(side), 1e-6), none
    wanted = size.select("sample_id", F.least(F.lit(k), F.col("n") - 1).alias("k"))
    open_ = spots.select(*SPOT).join(F.broadcast(wanted), "sample_id").where("k > 0")  # a row a sample
    order = Window.partitionBy(*SPOT).orderBy("d2", "nbr_id")
    place = Window.partitionBy("sample_id", F.col(x).cast("double"), F.col(y).cast("double")).orderBy("spot_id")
    first = checkpointed(spots.select(*SPOT, x, y, F.dense_rank().over(place).alias("__r")).where(F.col("__r") <= k + 1).drop("__r"))
    fine = _finer_sides(first, side, k, x, y, float(far))
    sides = [*fine, *(side * 2.0**i for i in range(rounds))]
    for i, side in enumerate(sides):
        now = open_
        if i < len(fine):  # in cells too small for most spots only those ask whose cell has enough
            full = _cells(first, side, x, y).groupBy("sample_id", "cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > k)
            now = open_.join(_cells(spots, side, x, y).join(full, ["sample_id", "cx", "cy"]).select(*SPOT), SPOT, "left_semi")
        pairs = _close_pairs(spots, side, x, y, now, None, first).withColumn("r", F.row_number().over(order)).where((F.col("r") <= k) & (F.col("r") <= F.col("k")))
        kept = pairs.withColumn("last", F.max(F.when(F.col("r") == F.col("k"), F.sqrt("d2"))).over(Window.partitionBy(*SPOT)))
        done = kept if side > far else kept.where(F.col("last") <= side)
        done = checkpointed(done.select(*SPOT, "nbr_id", "d2", "r"))
        found = found.union(done)
        if side > far:
            return found
        open_ = checkpointed(open_.join(done.select(*SPOT).distinct(), SPOT, "left_anti"))
        if open_.isEmpty():
            return found
    raise ValueError("spots are spread over too many orders of magnitude")


def _finer_sides(spots: DataFrame, side: float, k: int, x: str, y: str, far: float) -> list[float]:
    """Sides of smaller cells, least first, where cells of ``side`` hold far more than ``k`` spots: halved until none does."""
    out: list[float] = []
    while side > 1e-9 * max(far, 1e-9):
        most = _cells(spots, side, x, y).groupBy("sample_id", "cx", "cy").count().agg(F.max("count")).first()[0] or 0
        if most <= 8 * (k + 1):
            break
        side /= 2
        out.insert(0, side)
    return out


def knn_graph(spots: DataFrame, k: int = 6, x: str = "col", y: str = "row") -> DataFrame:
    """The ``k`` nearest spots of each, ties to the smaller id; exact. Every sample needs more than ``k`` spots."""
    if not spots.groupBy("sample_id").count().where(F.col("count") <= k).isEmpty():
        raise ValueError(f"a sample has no more than {k} spots")
    return nearest(spots, k, x, y).select(*SPOT, "nbr_id")


def build_graph(spots: DataFrame, kind: str = "fixed_distance", platform: str = "Visium", radius: float | None = None, number: int = 6) -> DataFrame:
    """Lattice for Visium and ST places, a given or found radius for others, or a fixed number of neighbours."""
    if kind == "fixed_number":
        return knn_graph(spots, number)
    if kind != "fixed_distance":
        raise ValueError("kind is 'fixed_distance' or 'fixed_number'")
    if platform in OFFSETS:
        return lattice(spots, platform)
    radius = auto_radius(spots, x="col", y="row") if radius is None else radius
    return radius_graph(spots, radius, "col", "row")


def degree_summary(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """``(sample_id, n_spots, n_identified, n_edges)``: spots with a neighbour."""
    degree = edges.groupBy(*SPOT).agg(F.count("*").alias("d"))
    d = spots.join(degree, SPOT, "left")
    return d.groupBy("sample_id").agg(F.count("*").alias("n_spots"), F.count("d").alias("n_identified"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_edges"))


def neighbor_mean(spots: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each column over a spot's neighbours, 0 without any."""
    state = spots.select("sample_id", F.col("spot_id").alias("nbr_id"), *columns)
    means = edges.join(state, ["sample_id", "nbr_id"]).groupBy(*SPOT).agg(*[F.avg(c).alias(c) for c in columns])
    return spots.select(*SPOT).join(means, SPOT, "left").select(*SPOT, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def same_label_counts(spots: DataFrame, edges: DataFrame, k: int, label: str = "y") -> DataFrame:
    """``(sample_id, spot_id, degree, same)``: the number of neighbours with each label 1..k, as an array; isolated spots too."""
    state = spots.select("sample_id", F.col("spot_id").alias("nbr_id"), F.col(label).alias("__y"))
    n = edges.join(state, ["sample_id", "nbr_id"]).groupBy(*SPOT).agg(F.count("*").alias("degree"), F.array(*[F.count_if(F.col("__y") == i + 1) for i in range(k)]).alias("same"))
    none = F.array(*[F.lit(0).cast("long")] * k)
    return spots.select(*SPOT).join(n, SPOT, "left").select(*SPOT, F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("same", none).alias("same"))
