"""Empty tables, NULL keys, ties and repeated rows through the core operators; plans that must not shuffle rows."""

import importlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.blocks import block_sums, sparse_rows, vectors
from weftline.operators import correct, display, genes, graph, markers, metrics, model, qc, start

COUNTS = "sample_id string, spot_id string, gene string, cnt long"
SPOTS = "sample_id string, spot_id string, row double, col double, x double, y double, label string"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COUNTS), spark.createDataFrame([], SPOTS)


def test_empty_tables_give_empty_tables(spark, none):
    counts, spots = none
    expr = qc.log_normalize(counts)
    clusters = spots.select("sample_id", "spot_id", F.col("label").alias("cluster"))
    edges = graph.lattice(spots)
    empty = [
        qc.spot_filter(counts, 1), qc.gene_filter(counts, 1), qc.inclusive_filter(counts), expr, qc.gene_means(expr),
        genes.sparse_sums(counts), genes.svg_rank(counts, spots), genes.hvg_rank(counts), edges, graph.radius_graph(spots, 2.0),
        graph.knn_graph(spots, 3), graph.degree_summary(spots, edges), graph.neighbor_mean(spots, edges, ["x"]),
        display.scale_genes(expr), display.dot_summary(expr, clusters), display.rgb_display(spots, ("x", "y", "col")),
        display.scatter_codes(spots, "label"), display.box_summary(spots, ["x"]), markers.rank_sums(expr, clusters),
        markers.sample_rate(spots, 0.5), markers.downsample(clusters, "cluster", 3), metrics.cluster_batch_cube(clusters.withColumn("batch", F.col("sample_id"))).where("cluster IS NOT NULL"),
    ]
    assert [d.count() for d in empty] == [0] * len(empty)
    listed = spark.createDataFrame([("g", 1)], "gene string, gene_idx int")
    rows = sparse_rows(expr, listed, ["sample_id", "spot_id"])
    one = spots.select("sample_id", "spot_id", F.array("x").alias("h"), F.array(F.lit(1.0)).alias("d"))
    assert correct.correct_by_factors(rows, one.drop("d"), one.drop("h"), 1).count() == 0


def test_null_keys_and_repeated_genes_in_sparse_rows(spark):
    rows = [("a", "1", "g", 1.0), ("a", "1", "g", 2.0), (None, "1", "g", 1.0), ("a", None, "g", 1.0), ("a", "2", "h", 4.0)]
    expr = spark.createDataFrame(rows, "sample_id string, spot_id string, gene string, value double")
    listed = spark.createDataFrame([("g", 1), ("h", 2)], "gene string, gene_idx int")
    got = sparse_rows(expr, listed, ["sample_id", "spot_id"])
    assert sorted((r["spot_id"], list(r["idx"]), list(r["val"])) for r in got.collect()) == [("1", [0], [3.0]), ("2", [1], [4.0])]
    m = start.gramian(got, 2, ["a"])
    assert m.gram.tolist() == [[9.0, 0.0], [0.0, 16.0]]


def test_sums_over_many_tasks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    d = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(70)

    def work(batches):
        total = np.zeros((4, 4))
        for b in batches:
            total += vectors(b, "v").T @ vectors(b, "v") if b.num_rows else 0
        return {"gram": total}

    assert np.allclose(block_sums(d, work)["gram"], x.T @ x)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 0.999, 1.0])
def test_exact_rates(spark, rate):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("spot_id"))
    got = markers.sample_rate(rows, rate)
    assert got.count() == int(rate * 1000) == got.distinct().count()
    other = markers.sample_rate(rows.repartition(7), rate)
    assert {r[0] for r in got.collect()} == {r[0] for r in other.collect()}


def test_a_fit_on_a_share_of_the_spots_corrects_all(spark):
    rng = np.random.default_rng(4)
    h = rng.normal(size=200)
    rows = spark.createDataFrame([("a", str(i), [0], [float(3 * h[i] + 5)]) for i in range(200)], "sample_id string, spot_id string, idx array<int>, val array<double>")
    s = spark.createDataFrame([("a", str(i), [float(h[i])], [1.0]) for i in range(200)], "sample_id string, spot_id string, h array<double>, d array<double>")
    got = correct.correct_by_factors(rows, s.drop("d"), s.drop("h"), 1, rate=0.3).collect()
    assert len(got) == 200 and all(abs(r["corrected"][0] - 5) < 1e-6 for r in got)


def test_short_lists_warn(spark):
    ranked = spark.createDataFrame([("a", f"g{i}", i) for i in range(1, 6)], "sample_id string, gene string, rank int")
    with pytest.warns(UserWarning, match="5 genes"):
        assert genes.list_size(ranked, 9) == 5


def test_colours_with_null_samples_and_constant_columns(spark):
    d = spark.createDataFrame([(None, "1", 0.0, 1.0, 5.0), (None, "2", 1.0, 1.0, 6.0), ("a", "3", 4.0, 1.0, 7.0)], "sample_id string, spot_id string, x double, y double, z double")
    got = {r["spot_id"]: r["rgb"] for r in display.rgb_display(d, ("x", "y", "z")).collect()}
    assert got == {"1": "#000000", "2": "#FF00FF", "3": "#000000"}


def test_another_graph_for_factors(spark):
    state = spark.createDataFrame([("a", "1", 1, [1.0]), ("a", "2", 2, [3.0]), ("a", "3", 1, [5.0])], "sample_id string, spot_id string, y int, v array<double>")
    labels = spark.createDataFrame([("a", "1", "2")], "sample_id string, spot_id string, nbr_id string")
    factors = spark.createDataFrame([("a", "1", "3"), ("a", "2", "3")], "sample_id string, spot_id string, nbr_id string")
    got = {r["spot_id"]: (list(r["same"]), r["near"][0]) for r in model.neighbourhood(state, labels, 2, 1, factors).collect()}
    assert got == {"1": ([0, 1], 5.0), "2": ([0, 0], 5.0), "3": ([0, 0], 0.0)}


def test_rows_of_a_fit_are_not_shuffled_in_its_rounds(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([("a", str(i), [0, 1, 2], rng.normal(size=3).tolist()) for i in range(60)], "sample_id string, spot_id string, idx array<int>, val array<double>")
    places = spark.createDataFrame([("a", str(i), float(i // 8), float(2 * (i % 8) + i // 8 % 2)) for i in range(60)], "sample_id string, spot_id string, row double, col double")
    x = model.prepare(rows, graph.lattice(places), 3, 2)
    state = places.select("sample_id", "spot_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = x.rows.join(state, ["sample_id", "spot_id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    before = plan.split("InMemoryRelation")[0]
    assert before.count("Exchange hashpartitioning") <= 1 and "InMemoryTableScan" in plan
    x.rows.unpersist()


def test_entry_survives_a_library_that_is_missing(monkeypatch):
    import __spark_entry__ as entry

    for name in [k for k in sys.modules if k.startswith(("weftline.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "weftline.llm.queries", None)
    found = importlib.reload(entry).queries()
    assert "fit" in found and not any(k.startswith("op") or k == "pipeline" for k in found)
    assert entry.oracle_sql()
