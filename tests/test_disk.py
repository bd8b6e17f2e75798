"""What large tables leave on disk, and plans that must not shuffle dense rows."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import graph, markers, model, tiled
from weftline.plans.registry import QUERIES
from weftline.sources.checkpoints import stored

FOLDER = "/root/testdata/sf0.001"


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_leave_no_shuffle_files(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    want, before = sorted(df.collect()), shuffle_files(spark)
    got = stored(df)
    assert sorted(got.collect()) == want and "Scan parquet" in plan(got)
    assert not shuffle_files(spark) - before


def test_the_projection_keeps_counts_as_columns(spark):
    """no checkpoint of the counts as rows."""
    text = plan(QUERIES["svg_projection_p"](spark, FOLDER).where("gene = 'x'"))
    assert "Scan parquet" in text and not re.search(r"Scan ExistingRDD\[[^\]]*\bcnt#", text)


def test_sparse_rows_are_shuffled_once_for_the_correction(spark):
    """what the sums read is stored with its design, and read again."""
    text = plan(QUERIES["correct_all_genes"](spark, FOLDER))
    assert "MapInArrow" in text and "hashpartitioning" not in text


@pytest.mark.parametrize("name", ["integrate_factors", "integrate_controls"])
def test_dense_rows_are_not_shuffled(spark, name):
    """clusters, places and ids are joined with the sparse rows, before values are made dense."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES[name](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "MapInArrow" in text and "hashpartitioning" not in text.split("MapInArrow")[0]


def test_markers_of_some_genes_at_a_time(spark, monkeypatch):
    """with a bound on the values that are shuffled at once the statistics are the same."""
    want = sorted(tuple(r) for r in QUERIES["markers_corrected"](spark, FOLDER).collect())
    shuffled, plain = [], markers._sums
    monkeypatch.setattr(markers, "_sums", lambda d, *a: shuffled.append(d.count()) or plain(d, *a))
    monkeypatch.setattr(markers, "MOST_VALUES", 5000)
    assert sorted(tuple(r) for r in QUERIES["markers_corrected"](spark, FOLDER).collect()) == want
    assert len(shuffled) > 2 and max(shuffled) < 3 * 5000 < sum(shuffled) == 135 * 133


def test_a_fit_keeps_one_table_of_sweeps(spark):
    """F8: each round's sweeps and state are in place of earlier ones, and blocks aren't shuffled again for a round."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    spots = spark.createDataFrame([("a", str(i), float(i // 8), float(2 * (i % 8) + i // 8 % 2)) for i in range(96)], "sample_id string, spot_id string, row double, col double")
    values = np.random.default_rng(7).normal(size=(96, 3)) + np.arange(96)[:, None] // 48
    rows = spark.createDataFrame([("a", str(i), [0, 1, 2], v.tolist()) for i, v in enumerate(values)], "sample_id string, spot_id string, idx array<int>, val array<double>")
    s = model.ModelSettings(max_rounds=4, max_sweeps=3, init="kmeans", init_starts=1, eps_loglik=1e-12)
    x, tiles = model.prepare(rows, graph.lattice(spots), 3, 2, s), tiled.tile_of(spots, 8.0)
    before = set(folder.rglob("table-*"))
    fitted, p = tiled.fit_many(x, [2], s, tiles)[2]
    assert len(p.path) == 3 and fitted.count() == 96
    columns = [set(spark.read.parquet(f"file://{t}").columns) for t in set(folder.rglob("table-*")) - before]
    assert sum("m_new" in c for c in columns) == 1 and sum(c == {"sample_id", "spot_id", "y", "v", "m"} for c in columns) == 3
