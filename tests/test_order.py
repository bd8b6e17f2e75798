"""Order statistics against the built-in percentile and against sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.order import cut_points, order_statistics, part_of, quantiles

PROBS = [0.0, 0.2, 0.25, 0.5, 0.77, 1.0]


def values(spark):
    rng = np.random.default_rng(6)
    groups = {"normal": rng.normal(size=700), "heavy": rng.standard_cauchy(500) * 1e12, "ties": rng.integers(0, 3, 600).astype(float), "one": [4.0], "same": [2.5] * 300, "wide": [-1.7e308, 1.7e308, 0.0, 1.0] * 30, "tiny": rng.random(400) * 1e-300}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [(None, float(x)) for x in range(101)] + [("one", None), ("none", None), ("normal", float("nan"))]
    return spark.createDataFrame(rows, "g string, v double").repartition(4)


@pytest.mark.parametrize(("small", "bins"), [(100_000, 1024), (20, 4), (1, 2)])
def test_quantiles_are_percentiles(spark, small, bins):
    d = values(spark)
    want = {r["g"]: r["q"] for r in d.where("NOT isnan(v)").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).collect() if r["q"] is not None}
    got = {r["g"]: r["q"] for r in quantiles(d, ["g"], "v", PROBS, small, bins).collect()}
    assert got == want


def test_order_statistics_without_keys(spark):
    d = values(spark).where("g = 'normal' AND NOT isnan(v)")
    own = sorted(r["v"] for r in d.collect())
    got = order_statistics(d, [], "v", lambda n: F.array(F.lit(0).cast("long"), F.lit(17).cast("long"), n - 1), 10, 8).first()
    assert got["n"] == 700 and got["found"] == {0: own[0], 17: own[17], 699: own[-1]}


def test_no_task_gets_a_group(spark):
    """Parts between cuts have about ``small`` values unless these are equal, and are in order."""
    d = values(spark).where("NOT isnan(v)")
    cuts = cut_points(d, ["g"], "v", 50)
    assert {r["g"] for r in cuts.collect()} == {"normal", "heavy", "ties", "same", "wide", "tiny", None}
    j = d.where("v IS NOT NULL").join(cuts.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")), "left").withColumn("part", part_of(F.col("cuts"), F.col("v")))
    parts = j.groupBy("g", "part").agg(F.count("*").alias("n"), F.countDistinct("v").alias("d"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("g", "part").collect()
    assert all(r["n"] <= 101 or r["d"] == 1 for r in parts)
    for a, b in zip(parts, parts[1:], strict=False):
        assert a["g"] != b["g"] or a["high"] < b["low"]


def test_empty(spark):
    d = spark.createDataFrame([], "g string, v double")
    assert quantiles(d, ["g"], "v", PROBS).count() == 0 and cut_points(d, ["g"], "v").count() == 0
