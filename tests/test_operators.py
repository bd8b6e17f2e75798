"""Hand-checked answers, dense oracles and invariants of the sample-integration operators."""

import math
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import bench
from weftline.functions.blocks import Sparse, sparse_rows
from weftline.operators import correct, display, genes, graph, markers, metrics, model, potts, qc, start
from weftline.plans import iterative
from weftline.sources import tables


def spots_of(spark, places, sample="a"):
    return spark.createDataFrame([(sample, str(i), float(r), float(c)) for i, (r, c) in enumerate(places)], "sample_id string, spot_id string, row double, col double")


def degrees(edges, n):
    d = {r["spot_id"]: r["count"] for r in edges.groupBy("spot_id").count().collect()}
    return [d.get(str(i), 0) for i in range(n)]


def test_lattices(spark):
    st = graph.lattice(spots_of(spark, [(r, c) for r in range(3) for c in range(3)]), "ST")
    assert degrees(st, 9) == [2, 3, 2, 3, 4, 3, 2, 3, 2]
    visium = graph.lattice(spots_of(spark, [(r, 2 * j + r % 2) for r in range(3) for j in range(3)]))
    assert degrees(visium, 9) == [2, 4, 3, 5, 6, 3, 2, 4, 3]
    with pytest.raises(ValueError):
        graph.lattice(spots_of(spark, [(0, 0)]), "other")


def test_radius_is_strict(spark):
    s = spots_of(spark, [(0, 0), (3, 4)])
    assert graph.radius_graph(s, 5.0, "col", "row").count() == 0
    assert graph.radius_graph(s, 5.0001, "col", "row").count() == 2


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(20, 2)) * 40, [[500.0, 500.0]], rng.integers(0, 3, (20, 2)).astype(float)])
    got = {}
    for r in graph.knn_graph(spots_of(spark, p), 4).collect():
        got.setdefault(int(r["spot_id"]), set()).add(r["nbr_id"])
    for i in range(len(p)):
        d = ((p - p[i]) ** 2).sum(1)
        order = sorted((j for j in range(len(p)) if j != i), key=lambda j: (d[j], str(j)))[:4]
        assert {round(d[int(j)], 9) for j in got[i]} == {round(d[j], 9) for j in order} and len(got[i]) == 4


def ranked(spark, *lists):
    return spark.createDataFrame([(str(s), g, i + 1) for s, x in enumerate(lists) for i, g in enumerate(x)], "sample_id string, gene string, rank int")


def test_votes(spark):
    r = ranked(spark, "abcd", "bdea")
    c = spark.createDataFrame([(s, "x", g, 1) for s in "01" for g in "abcde"], "sample_id string, spot_id string, gene string, cnt long")
    for n, want in ((3, "bad"), (4, "abdc")):
        assert "".join(x["gene"] for x in genes.common_genes(r, c, n).orderBy("gene_idx").collect()) == want


def test_potts_and_degrees_of_freedom(spark):
    d = spark.createDataFrame([([2, 1, 1], 4)], "same array<long>, degree long")
    e = d.select(potts.potts_energy(F.col("same"), F.col("degree"), F.lit(1.0)).alias("e")).first()["e"]
    assert np.allclose(e, [0.794377, 1.294377, 1.294377], atol=1e-6)
    assert model.degrees_of_freedom(7, 100, 10, 2) == 1452
    ll = spark.createDataFrame([(7, -5000.0)], "k int, loglik double")
    r = model.select_k(ll, 100, 10, 2, 800).first()
    assert r["dfree"] == 1452 and abs(r["mbic"] - 28609.176250) < 1e-5 and r["bic"] == r["mbic"]


def test_names_filters_and_rotation(spark):
    d = spark.createDataFrame([("good",), ("Morning",), ("tWO wOrds",), ("",)], "n string")
    assert [r[0] for r in d.select(qc.firstup(F.col("n"))).collect()] == ["Good", "Morning", "Two words", ""]
    names = spark.createDataFrame([("x", 1), ("X", 2), ("x.1", 3), ("x", 4)], "gene string, pos int")
    assert [r[0] for r in qc.make_unique(names).orderBy("pos").select("unique_name").collect()] == ["X", "X.2", "X.1", "X.3"]
    c = spark.createDataFrame([("a", "1", "g", 1), ("a", "1", "h", 2), ("a", "2", "g", 1)], "sample_id string, spot_id string, gene string, cnt long")
    assert qc.spot_filter(c, 1).count() == 2 and qc.spot_filter(c, 2).count() == 0 and qc.spot_filter(c, 2, True).count() == 2
    r = qc.rotate(spots_of(spark, [(0, 1)]), math.pi / 2).first()
    assert abs(r["col"]) < 1e-12 and abs(r["row"] - 1) < 1e-12


def test_reported_loglik():
    z, old = np.zeros((1, 1)), model.ModelSettings(legacy_loglik=True, eps_loglik=1e-3)
    p = model.Params(["a"], z, z, z, z, z, z, z, path=[-900.0, -800.0, -799.9])
    assert model.reported_loglik(p) == -799.9 and model.reported_loglik(p, old) == -800.0
    for path in ([-900.0, -800.0], [-5.0]):  # ended by the number of rounds
        assert model.reported_loglik(replace(p, path=path), old) == path[-1]


def test_entry_checks(spark, tmp_path):
    c = spark.createDataFrame([("a", "1", "g", 1), ("b", "2", "h", 2), ("b", "2", "g", 2)], "sample_id string, spot_id string, gene string, cnt long")
    s = spark.createDataFrame([("a", "1", 0.0, 0.0), ("b", "2", 0.0, 0.0)], "sample_id string, spot_id string, row double, col double")
    with pytest.raises(ValueError):
        tables.check_inputs(c, s)
    assert {r["gene"] for r in tables.check_inputs(c, s, on_mismatch="intersect").collect()} == {"g"}
    with pytest.raises(ValueError):
        tables.check_inputs(c, s.drop("row"))
    with pytest.raises(ValueError):
        tables.check_inputs(c, s, k=[0])
    tables.save(c, f"{tmp_path}/c")
    assert sorted(map(str, tables.load(spark, f"{tmp_path}/c").select(c.columns).collect())) == sorted(map(str, c.collect()))


def test_10x_folder(spark, tmp_path):
    inner = tmp_path / "filtered_feature_bc_matrix"
    inner.mkdir()
    (tmp_path / "spatial").mkdir()
    (inner / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n2 3 4\n1 1 5\n2 1 1\n1 3 7\n2 2 9\n")
    (inner / "features.tsv").write_text("id1\tGA\tGene Expression\nid2\tGB\tGene Expression\n")
    (inner / "barcodes.tsv").write_text("b1\nb2\nb3\n")
    (tmp_path / "spatial/tissue_positions_list.csv").write_text("b1,1,0,0,1.5,2.5\nb2,0,0,2,1,1\nb3,1,1,1,3,3\nb4,1,5,5,0,0\n")
    counts, spots = tables.read_10x(spark, str(tmp_path), "s")
    assert sorted((r["spot_id"], r["gene"], r["cnt"]) for r in counts.collect()) == [("b1", "GA", 5), ("b1", "GB", 1), ("b2", "GB", 9), ("b3", "GA", 7)]
    assert sorted((r["spot_id"], r["row"], r["col"]) for r in spots.collect()) == [("b1", 0.0, 0.0), ("b3", 1.0, 1.0)]
    kept, lost = tables.assemble(counts, spots)
    assert kept.count() == 3 and [r["spot_id"] for r in lost.collect()] == ["b2"]


def _folder_10x(path, zipped, cells, genes_, barcodes, size=None):
    import gzip

    inner = path / "filtered_feature_bc_matrix"
    inner.mkdir(parents=True)
    (path / "spatial").mkdir()
    write = (lambda name, text: (inner / f"{name}.gz").write_bytes(gzip.compress(text.encode()))) if zipped else (lambda name, text: (inner / name).write_text(text))
    write("features.tsv", "".join(f"id{i}\t{g}\tGene Expression\n" for i, g in enumerate(genes_)))
    write("barcodes.tsv", "".join(f"{b}\n" for b in barcodes))
    size = size or f"{len(genes_)} {len(barcodes)} {len(cells)}"
    write("matrix.mtx", f"%%MatrixMarket matrix coordinate integer general\n% a note\n{size}\n" + "".join(f"{g} {s} {n}\n" for g, s, n in cells))
    (path / "spatial" / "tissue_positions_list.csv").write_text("".join(f"{b},1,{i},{i},0,0\n" for i, b in enumerate(barcodes)))
    return f"file://{path}"


@pytest.mark.parametrize("zipped", [True, False])
def test_lines_are_numbered_over_splits(spark, tmp_path, zipped):
    """Many splits of a plain file, one of a zipped one: genes and barcodes keep their numbers, the size line is checked."""
    rng = np.random.default_rng(40)
    genes_, barcodes = [f"gene {i}" for i in range(700)], [f"BC{i:05d}-1" for i in range(900)]
    cells = [(int(g) + 1, int(s) + 1, int(n) + 1) for g, s, n in zip(rng.permutation(700).repeat(3), rng.integers(0, 900, 2100), rng.integers(0, 9, 2100), strict=True)]
    cells = list({(g, s): (g, s, n) for g, s, n in cells}.values())
    folder = _folder_10x(tmp_path / "a", zipped, cells, genes_, barcodes)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = tables.numbered_lines(spark, f"{folder}/filtered_feature_bc_matrix/barcodes.tsv*")
        assert [tuple(r) for r in lines.orderBy("n").collect()] == list(enumerate(barcodes, 1))
        assert zipped or lines.rdd.getNumPartitions() > 5
        counts, spots = tables.read_10x(spark, folder, "s")
        assert sorted(tuple(r)[1:] for r in counts.collect()) == sorted((barcodes[s - 1], genes_[g - 1], n) for g, s, n in cells)
        assert spots.count() == 900
        for i, size in enumerate(("700 900 5", "701 900 " + str(len(cells)))):
            with pytest.raises(ValueError, match="size line"):
                tables.read_10x(spark, _folder_10x(tmp_path / f"bad{i}", zipped, cells, genes_, barcodes, size), "s")
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


# --- the model


def params(rng, samples=2, p=12, q=3, k=2):
    spd = lambda: (lambda a: a @ a.T + np.eye(q))(rng.normal(size=(q, q)))
    return model.Params([str(i) for i in range(samples)], rng.normal(size=(samples, p)), rng.normal(size=(p, q)), rng.uniform(0.5, 2, (samples, p)), rng.normal(size=(k, q)), np.array([spd() for _ in range(k)]), np.array([spd() for _ in range(samples)]), np.ones(samples))


def test_posteriors_against_dense_algebra():
    rng = np.random.default_rng(3)
    par = params(rng)
    n, p, q = 30, 12, 3
    x, m = rng.normal(size=(n, p)) * (rng.random((n, p)) < 0.6), rng.normal(size=(n, q))
    lists = [np.flatnonzero(r) for r in x]
    batch = pa.RecordBatch.from_arrays([pa.array([i.astype(np.int32) for i in lists]), pa.array([r[i] for r, i in zip(x, lists, strict=True)])], names=["idx", "val"])
    post = model.Posterior(par, 1)
    a, g = post.reduce(Sparse(batch), np.arange(n))
    u = post.energy(a, g, m)
    lam, w, psi = np.diag(par.lam[1]), par.w, par.psi[1]
    for k in range(2):
        cov = w @ (par.sigma[k] + psi) @ w.T + lam
        d = x - par.means[1] - (m + par.mu[k]) @ w.T
        assert np.allclose(u[:, k], 0.5 * (np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
        ez, ev = post.moments(k, g, m)
        gain = d @ np.linalg.inv(cov) @ w
        assert np.allclose(ez, par.mu[k] + gain @ par.sigma[k], atol=1e-6) and np.allclose(ev, m + gain @ psi, atol=1e-6)
        joint = par.sigma[k] + psi - (par.sigma[k] + psi) @ w.T @ np.linalg.inv(cov) @ w @ (par.sigma[k] + psi)
        assert np.allclose(post.vzv[k], joint, atol=1e-6)
        # v given the label, z integrated out
        cov_z = w @ par.sigma[k] @ w.T + lam
        d = x - par.means[1] - par.mu[k] @ w.T
        want = np.linalg.solve(w.T @ np.linalg.inv(cov_z) @ w + np.linalg.inv(psi), (d @ np.linalg.inv(cov_z) @ w + m @ np.linalg.inv(psi)).T).T
        assert np.allclose(post.factor(np.full(n, k), g, m), want, atol=1e-5)


@pytest.fixture(scope="module")
def simulated(spark):
    """Two samples of 10 by 12 spots in three bands, 15 genes."""
    rng = np.random.default_rng(4)
    load, rows, places = rng.normal(size=(15, 2)), [], []
    centre = np.array([[0, 0], [5, 0], [0, 5]])
    for s in "ab":
        for r in range(12):
            for c in range(10):
                y = r // 4
                v = np.maximum(8 + (centre[y] + rng.normal(size=2) * 0.4) @ load.T + rng.normal(size=15) * 0.5 + (1.0 if s == "b" else 0.0), 0)
                key = f"{r}-{c}"
                places.append((s, key, float(r), float(2 * c + r % 2), y))
                rows += [(s, key, f"g{j:02d}", float(v[j])) for j in range(15)]
    e = spark.createDataFrame(rows, "sample_id string, spot_id string, gene string, value double")
    listed = spark.createDataFrame([(f"g{j:02d}", j + 1) for j in range(15)], "gene string, gene_idx int")
    spots = spark.createDataFrame(places, "sample_id string, spot_id string, row double, col double, truth int")
    return sparse_rows(e, listed, ["sample_id", "spot_id"]), spots


def test_components_and_least_squares(spark, simulated):
    rows, spots = simulated
    x = {(r["sample_id"], r["spot_id"]): r["val"] for r in rows.collect()}
    keys = sorted(x)
    dense = np.array([x[k] for k in keys])
    m = start.gramian(rows, 15, ["a", "b"])
    by = np.array([k[0] for k in keys])
    centred = dense - np.where((by == "a")[:, None], dense[by == "a"].mean(0), dense[by == "b"].mean(0))
    assert np.allclose(m.centred(), centred.T @ centred)
    v, residual = start.pca(m, 2)
    assert np.allclose(residual, ((centred - centred @ v @ v.T) ** 2).mean(0))
    u, _ = start.pca(m, 2, weighted=True)
    assert np.allclose(u.T @ u, np.eye(2))
    h = spots.select("sample_id", "spot_id", F.array("row", "col").alias("h"))
    one = spots.select("sample_id", "spot_id", F.array(F.lit(1.0)).alias("d"))
    got = {(r["sample_id"], r["spot_id"]): r["corrected"] for r in correct.correct_by_factors(rows, h, one, 15).collect()}
    design = {(r["sample_id"], r["spot_id"]): [r["row"], r["col"], 1.0] for r in spots.collect()}
    d, out = np.array([design[k] for k in keys]), np.array([got[k] for k in keys])
    beta = np.linalg.lstsq(d, dense, rcond=None)[0]
    assert np.allclose(out, dense - d[:, :2] @ beta[:2])


def test_alignment_brings_samples_together(spark, simulated):
    rows, _ = simulated
    m = start.gramian(rows, 15, ["a", "b"])
    v, _ = start.pca(m, 2, by_sample=False)
    raw = start.project(rows, v, m.sums.sum(0)[None] / m.n.sum(), ["a", "b"])
    gap = lambda d: np.linalg.norm(np.subtract(*[np.array([r["vec"] for r in d.where(F.col("sample_id") == s).collect()]).mean(0) for s in "ab"]))
    assert gap(start.harmonize(raw, ["a", "b"], clusters=6)) < gap(raw) / 2
    assert start.harmonize(raw, ["a"]) is raw


@pytest.mark.parametrize("spatial", [True, False])
def test_fit_recovers_bands(spark, simulated, spatial):
    rows, spots = simulated
    s = model.ModelSettings(max_rounds=4, max_sweeps=4, spatial_factor=spatial)
    x = model.prepare(rows, graph.lattice(spots), 15, 2, s)
    fitted, p = model.fit(x, 3, s)
    d = fitted.join(spots, ["sample_id", "spot_id"])
    assert metrics.adjusted_rand(d, "cluster", "truth").first()["ari"] > 0.8
    assert len(p.path) >= 2 and all(np.isfinite(p.path)) and p.path[-1] >= p.path[0] - 1e-6
    assert fitted.where("abs(aggregate(resp, 0D, (a, x) -> a + x) - 1) > 1e-9").count() == 0 and fitted.count() == 240
    table = model.params_table(spark, {3: (fitted, p)})
    assert {r["name"] for r in table.collect()} == {"w", "mu", "sigma", "lam", "psi", "beta", "loglik"}


def test_every_component_of_the_embeddings_counts(spark, tmp_path):
    rng = np.random.default_rng(12)
    side = np.arange(60) // 3 % 2
    x = np.concatenate([np.full((60, 8), 0.5), rng.normal(0, 0.1, (60, 4)) + 9.0 * side[:, None]], 1)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for query in (iterative.kmeans_start, iterative.gmm_start):
        got = {int(r["spot_id"]): r["y"] for r in query(spark, str(tmp_path)).collect()}
        assert not {y for i, y in got.items() if side[i]} & {y for i, y in got.items() if not side[i]}
    assert {len(r["vec"]) for r in iterative.harmonize(spark, str(tmp_path)).collect()} == {12}
    shown = {int(r["spot_id"]): r["vec"][0] for r in iterative.display_components(spark, str(tmp_path)).collect()}
    one, two = ([v for i, v in shown.items() if side[i] == k] for k in (0, 1))
    assert max(one) < min(two) or max(two) < min(one)


def test_a_partial_sum_is_no_total():
    assert bench.summary({"a": 1.5, "b": 2.0}, [], 0.1)["value"] == 3.5
    assert bench.summary({"a": 1.5}, ["b"], 0.1)["value"] is None


def test_settings_are_checked():
    for bad in ({"init": "x"}, {"max_rounds": 1}, {"beta_grid": ()}, {"potts_direction": "up"}):
        with pytest.raises(ValueError):
            model.ModelSettings(**bad)


def test_box_summary_drops_null_columns(spark):
    d = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (100.0, None)], "a double, b double")
    got = display.box_summary(d, ["a", "b"]).collect()
    assert [(r["name"], r["median"], r["high"], r["max"]) for r in got] == [("a", 2.5, 3.0, 100.0)]


def test_combined_p_values_find_a_spatial_gene(spark):
    rng = np.random.default_rng(5)
    places = [(r, c) for r in range(15) for c in range(15)]
    s = spots_of(spark, places)
    rows = []
    for i, (r, _) in enumerate(places):
        rows += [("a", str(i), f"g{j}", int(v)) for j, v in enumerate(rng.poisson(3, 20)) if v] + [("a", str(i), "band", int(v)) for v in [rng.poisson(1 + r)] if v]
    c = spark.createDataFrame(rows, "sample_id string, spot_id string, gene string, cnt long")
    got = {r["gene"]: (r["rank"], r["p_adj"]) for r in genes.svg_rank(c, s).collect()}
    assert got["band"][0] == 1 and got["band"][1] < 1e-6 and min(p for g, (_, p) in got.items() if g != "band") > 0.01
    assert sorted(r["gene"] for r in genes.hvg_rank(c).collect()) == sorted(got)


def brute_rank_sums(values, labels):
    """z, shares over 0 and fold change of each (cluster, gene) by ranking all spots: values[gene] has one value a spot."""
    out = {}
    for gene, x in values.items():
        order = np.sort(x)
        low, high = np.searchsorted(order, x, "left"), np.searchsorted(order, x, "right")
        rank, n = (low + high + 1) / 2, len(x)
        t = np.unique(x, return_counts=True)[1].astype(float)
        for c in sorted(set(labels)):
            own = labels == c
            n1, n2 = own.sum(), (~own).sum()
            u = rank[own].sum() - n1 * (n1 + 1) / 2 - n1 * n2 / 2
            sd = math.sqrt(max(0, n1 * n2 / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1)))))
            z = (u - np.sign(u) * 0.5) / sd if sd > 0 else 0.0
            out[c, gene] = (z, (x[own] > 0).mean(), (x[~own] > 0).mean(), math.log2(np.expm1(x[own]).mean() + 1) - math.log2(np.expm1(x[~own]).mean() + 1))
    return out


@pytest.mark.parametrize("small", [100_000, 7])
def test_markers_of_values_of_both_signs(spark, small):
    """Dense corrected values, sparse counts and mixtures, also ranked in parts between cut points."""
    rng = np.random.default_rng(12)
    n = 100
    labels = np.array(["a"] * 50 + ["b"] * 30 + ["c"] * 20)
    values = {
        "negative": np.where(labels == "a", -1.0, -3.0) + rng.random(n) * 0.5,
        "signs": np.where(labels == "a", 1.0, -1.0) + rng.random(n) * 0.5,
        "sparse": np.where(rng.random(n) < 0.6, 0.0, np.round(rng.random(n), 1)),
        "mixed": np.round(rng.normal(size=n), 1),
        "zeros": np.zeros(n),
        "constant": np.full(n, 2.0),
        "minus": np.where(labels == "c", -2.0, 0.0),
    }
    rows = [("s", str(i), g, float(x[i])) for g, x in values.items() for i in range(n) if g == "zeros" or x[i] != 0 or rng.random() < 0.5]
    expr = spark.createDataFrame(rows, "sample_id string, spot_id string, gene string, value double")
    clusters = spark.createDataFrame([("s", str(i), str(c)) for i, c in enumerate(labels)], "sample_id string, spot_id string, cluster string")
    want = brute_rank_sums(values, labels)
    got = {(r["cluster"], r["gene"]): r for r in markers.rank_sums(expr, clusters, small).collect()}
    assert set(got) == set(want)
    for k, (z, p1, p2, fold) in want.items():
        assert got[k]["z"] == pytest.approx(z, abs=1e-9), k
        assert got[k]["avg_log2fc"] == pytest.approx(fold, abs=1e-9), k
        assert (got[k]["pct1"], got[k]["pct2"]) == (pytest.approx(p1, abs=5.1e-4), pytest.approx(p2, abs=5.1e-4))


def test_samples_are_picked_by_row_and_not_by_barcode(spark):
    """Five slides with equal barcodes: the same rows for any partitioning, and no barcode stands out."""
    rows = spark.createDataFrame([(s, f"b{i}", "xy"[i % 2] if i % 5 else None) for s in "12345" for i in range(400)], "sample_id string, spot_id string, cluster string")
    a, b = ({tuple(r) for r in markers.sample_rate(d, 0.1).collect()} for d in (rows, rows.repartition(7, "spot_id")))
    assert a == b and len(a) == 200 and len({r[1] for r in a}) > 150
    each = {s: sum(r[0] == s for r in a) for s in "12345"}
    assert min(each.values()) > 20
    a, b = ({tuple(r) for r in markers.downsample(d, "cluster", 30).collect()} for d in (rows, rows.repartition(5, "sample_id")))
    assert a == b and len(a) == 90 and all(sum(r[2] == c for r in a) == 30 for c in ("x", "y", None))
    assert {tuple(r) for r in markers.downsample(rows, "cluster", 30, seed=2).collect()} != a
    assert markers.downsample(rows, "cluster", 10_000).count() == 2000 and markers.sample_rate(rows, 1.0).count() == 2000
    import hashlib

    order = sorted((hashlib.md5(f"1|{r[0]}|{r[1]}".encode()).hexdigest(), tuple(r)) for r in rows.collect())
    assert {r for _, r in order[:200]} == {tuple(r) for r in markers.sample_rate(rows, 0.1).collect()}


def _to_integrate(spark, samples=2, n=60):
    rng = np.random.default_rng(13)
    h = rng.normal(size=(samples, n))
    genes_ = [f"Hk{i}" for i in range(8)] + [f"Gene{i}" for i in range(6)]
    counts = [(str(s), f"b{i}", g, int(v)) for s in range(samples) for i in range(n) for k, g in enumerate(genes_) if (v := rng.poisson(20 * np.exp(0.4 * h[s, i] * (k % 3 + s)))) > 0]
    places = [(str(s), f"b{i}", float(i // 8), float(i % 8), float(rng.integers(0, 3))) for s in range(samples) for i in range(n)]
    fitted = [(str(s), f"b{i}", int(i % 2), [0.0], [float(h[s, i])], [float(i % 2), float(1 - i % 2)]) for s in range(samples) for i in range(n - 5)]
    return (
        spark.createDataFrame(counts, "sample_id string, spot_id string, gene string, cnt long"),
        spark.createDataFrame(fitted, "sample_id string, spot_id string, cluster int, hz array<double>, hv array<double>, resp array<double>"),
        spark.createDataFrame(places, "sample_id string, spot_id string, row double, col double, age double"),
    )


def _dense(counts, fitted, genes_):
    """Log-normalised values of the fitted spots, in order of sample and barcode."""
    key = sorted((r["sample_id"], r["spot_id"]) for r in fitted.collect())
    x = np.zeros((len(key), len(genes_)))
    for r in counts.collect():
        if (r["sample_id"], r["spot_id"]) in key and r["gene"] in genes_:
            x[key.index((r["sample_id"], r["spot_id"])), genes_.index(r["gene"])] += r["cnt"]
    return key, np.log1p(1e4 * x / x.sum(1, keepdims=True))


@pytest.mark.parametrize("samples", [1, 2])
@pytest.mark.parametrize("species", ["human", "unknown"])
def test_composed_integration_by_either_method(spark, samples, species):
    """The count of control genes chooses the method; values are those of dense least squares."""
    counts, fitted, places = _to_integrate(spark, samples)
    listed = sorted({r["gene"] for r in counts.select("gene").distinct().collect()})
    key, x = _dense(counts, fitted, listed)
    by = {(r["sample_id"], r["spot_id"]): r for r in fitted.join(places.select("sample_id", "spot_id", "age"), ["sample_id", "spot_id"]).collect()}
    h, resp, age = (np.array([by[k][c] for k in key]) for c in ("hv", "resp", "age"))
    known = spark.createDataFrame([(f"HK{i}" if species == "human" else f"Hk{i}",) for i in range(20)], "gene string")
    few = spark.createDataFrame([("gene1",), ("hk2",), ("absent",)], "gene string")
    for controls, custom in ((known, None), (None, few)):
        got = correct.integrate_samples(counts, fitted, places, species, controls, custom, ["age"])
        many = controls is not None
        assert got.method == ("controls" if many else "factors")
        names = [r["gene"] for r in got.genes.orderBy("gene_idx").collect()]
        assert names == sorted(g.upper() if species == "human" else g for g in listed)
        assert {r["gene"] for r in got.controls.collect()} == ({f"HK{i}" if species == "human" else f"Hk{i}" for i in range(8)} if many else {"GENE1", "HK2"} if species == "human" else set())
        at = [names.index(g.upper() if species == "human" else g) for g in listed]
        if many:
            own = x[:, [listed.index(f"Hk{i}") for i in range(8)]]
            c = own - own.mean(0)
            left = c @ np.linalg.svd(c, full_matrices=False)[2].T
            d = np.column_stack([left, resp, age])
        else:
            left = h
            d = np.column_stack([h, np.ones(len(h)), age])
        want = x - left @ np.linalg.lstsq(d, x, rcond=None)[0][: left.shape[1]]
        rows = {(r["sample_id"], r["spot_id"]): r for r in got.rows.collect()}
        assert sorted(rows) == key
        for k, w in zip(key, want, strict=True):
            r = rows[k]
            assert np.allclose(np.array(r["corrected"])[at], w, atol=1e-7)
            assert r["new_id"] == (k[1] + str(int(k[0]) + 1) if samples > 1 else k[1]) and r["batch"] == k[0] and r["cluster"] == by[k]["cluster"]


def test_composed_integration_checks_its_input(spark):
    counts, fitted, places = _to_integrate(spark)
    with pytest.raises(ValueError):
        correct.integrate_samples(counts, fitted, places, "dog")
    with pytest.raises(ValueError):
        correct.integrate_samples(counts, fitted, places, rate=1.5)
    with pytest.raises(ValueError):
        correct.integrate_samples(counts.where("spot_id <> 'b3'"), fitted, places)
    same = counts.union(counts.where("gene = 'Gene0'").withColumn("gene", F.lit("GENE0")))
    got = correct.integrate_samples(same, fitted, places, "mouse", rate=0.5)
    assert got.genes.count() == 14 and got.rows.count() == 110


def slow_spatial_p(y, places):
    """The combined p-value of one gene over all spots, by NumPy, with the rank of each pair of features."""
    n, scale = len(y), 1 - y.sum() ** 2 / len(y) / (y * y).sum()
    s = places - places.mean(0)
    length = np.quantile(np.abs(s), [0.2, 0.4, 0.6, 0.8, 1.0], axis=0)
    pairs = [s]
    for w in np.maximum(length, 1e-12):
        pairs += [np.exp(-s * s / (2 * w * w)), np.cos(2 * np.pi * s / w)]
    found = []
    for x in pairs:
        x = x - x.mean(0)
        rank = np.linalg.matrix_rank(x, tol=1e-9 * max(1, np.abs(x).max()) * math.sqrt(n))
        if rank:
            stat = n * np.sum((np.linalg.svd(x, full_matrices=False)[0][:, :rank].T @ y) ** 2) / (y * y).sum() / scale
            found.append(math.exp(-stat / 2) if rank == 2 else math.erfc(math.sqrt(stat / 2)))
    if not found:
        return 1.0
    most = 1 - 1 / len(found) if len(found) > 1 else 1.0
    t = np.mean([1 / (max(p, 1e-300) * math.pi) if p < 1e-15 else math.tan((0.5 - min(p, most)) * math.pi) for p in found])
    return 1 / (t * math.pi) if t > 1e15 else 0.5 - math.atan(t) / math.pi


@pytest.mark.parametrize("shape", ["row", "column", "diagonal", "field", "point"])
def test_spatial_genes_in_samples_of_any_shape(spark, shape):
    """Spots along a line: the gene that is ten-fold at one end comes first, and p-values are those of dense projections."""
    rng = np.random.default_rng(21)
    n = 200
    along = np.arange(n, dtype=float)
    places = {"row": np.column_stack([along, np.full(n, 3.0)]), "column": np.column_stack([np.zeros(n), along * 7]), "diagonal": np.column_stack([along, 2 * along + 1]), "field": np.column_stack([along % 20, along // 20]), "point": np.full((n, 2), 5.0)}[shape]
    counts = {"planted": rng.poisson(np.where(along < 60, 20, 2)), "flat": rng.poisson(5, n), "sparse": rng.poisson(0.3, n), "other": rng.poisson(3, n), "same": np.full(n, 2)}
    c = spark.createDataFrame([("s", str(i), g, int(v)) for g, x in counts.items() for i, v in enumerate(x) if v], "sample_id string, spot_id string, gene string, cnt long")
    s = spark.createDataFrame([("s", str(i), float(p[1]), float(p[0])) for i, p in enumerate(places)], "sample_id string, spot_id string, row double, col double")
    got = {r["gene"]: r for r in genes.svg_rank(c, s).collect()}
    p = {g: slow_spatial_p(x.astype(float), places) for g, x in counts.items() if g != "same"}
    p["same"] = 1.0 if shape == "point" else 0.5  # nothing to test
    order = sorted(p, key=lambda g: (p[g], g))
    adjusted, least = {}, 1.0
    h = sum(1 / i for i in range(1, 6))
    for i in range(5, 0, -1):
        least = min(least, p[order[i - 1]] * 5 * h / i)
        adjusted[order[i - 1]] = least
    assert {g: r["p_adj"] for g, r in got.items()} == pytest.approx(adjusted, rel=1e-6, abs=1e-12)
    assert shape == "point" or (got["planted"]["rank"] == 1 and got["planted"]["p_adj"] < 1e-6)


def _sparse_samples(spark, n, p, seed, share=0.2):
    """Sparse rows of two samples with a few strong directions."""
    rng = np.random.default_rng(seed)
    x = np.maximum(rng.normal(size=(n, 4)) @ rng.normal(size=(4, p)) * 2 + rng.normal(size=(n, p)), 0) * (rng.random((n, p)) < share)
    rows = [("ab"[i % 2], str(i), np.flatnonzero(r).tolist(), r[r != 0].tolist()) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "sample_id string, spot_id string, idx array<int>, val array<double>")


@pytest.mark.parametrize("by_sample", [True, False])
@pytest.mark.parametrize("weighted", [True, False])
def test_components_without_a_matrix_of_genes(spark, weighted, by_sample):
    """Products with the Gramian alone give its subspace and residuals."""
    _, rows = _sparse_samples(spark, 150, 200, 31)
    m, v, residual = start.components(rows, 200, 4, ["a", "b"], weighted, by_sample)
    few, u, other = start.components(rows, 200, 4, ["a", "b"], weighted, by_sample, most=0)
    assert few.gram is None and np.allclose(few.sums, m.sums) and np.allclose(few.squares, m.squares)
    assert np.abs(u @ u.T - v @ v.T).max() < 1e-6 and np.allclose(np.abs((u * v).sum(0)), 1, atol=1e-6)
    assert np.allclose(residual, other, atol=1e-8)


def test_products_with_centred_genes(spark):
    x, rows = _sparse_samples(spark, 60, 30, 32)
    m = start.gramian(rows, 30, ["a", "b"], products=False)
    w, d = np.random.default_rng(0).normal(size=(30, 3)), np.linspace(0.5, 2, 30)
    c = x.copy()
    for s in (0, 1):
        c[s::2] -= c[s::2].mean(0)
    assert np.allclose(start.times_products(rows, m, w), c.T @ c @ w)
    assert np.allclose(start.times_products(rows, m, w, scale=d), (c / d).T @ (c / d) @ w)
    assert np.allclose(m.variances(), (c**2).sum(0))


def test_components_of_thirty_thousand_genes(spark):
    x, rows = _sparse_samples(spark, 120, 30_000, 33, 0.01)
    _, v, residual = start.components(rows.repartition(4), 30_000, 3, ["a", "b"])
    c = x.copy()
    for s in (0, 1):
        c[s::2] -= c[s::2].mean(0)
    want = np.linalg.svd(c, full_matrices=False)[2][:3].T
    assert np.abs(v @ (v.T @ want) - want).max() < 1e-6 and residual.shape == (30_000,)


def test_leading_vectors_of_small_and_flat_matrices():
    for g in (np.zeros((5, 5)), np.eye(6), np.diag([3.0, 2.0, 1.0])):
        v, gv = start.leading(lambda b, g=g: g @ b, len(g), 2)
        assert np.allclose(v.T @ v, np.eye(2)) and np.allclose(gv, g @ v)
        assert np.allclose(np.diag(v.T @ gv), np.linalg.eigvalsh(g)[::-1][:2])


@pytest.mark.parametrize("seed", [2])
def test_radius_from_one_pass_is_that_of_graphs(spark, seed):
    """The halving sees the medians that a graph for each radius has; samples of any size, equal places among them."""
    rng = np.random.default_rng(seed)
    rows = [(s, str(i), float(a), float(b)) for s, n in (("a", 90), ("b", 40 + seed), ("c", 3), ("d", 1)) for i, (a, b) in enumerate(np.round(rng.normal(size=(n, 2)) * 12, 0))]
    spots = spark.createDataFrame(rows, "sample_id string, spot_id string, x double, y double")
    median = graph.median_degrees(spots, 13)
    for radius in (1.0, 2.5, 6.0):
        want = graph.median_degree(spots, graph.radius_graph(spots, radius))
        assert median(radius) == want if want <= 6 else median(radius) > 6
    found = graph.auto_radius(spots)
    assert 4 <= graph.median_degree(spots, graph.radius_graph(spots, found)) <= 6


def test_neighbours_where_nearly_all_spots_are_in_one_cell(spark, monkeypatch):
    """Nine tenths of the spots in a thousandth of the field, some at one place: exact, and without all pairs of the dense cell."""
    rng = np.random.default_rng(50)
    p = np.round(np.concatenate([rng.normal(size=(540, 2)) * 0.01 + 5, rng.random((50, 2)) * 1000, np.full((10, 2), 5.0)]), 4)
    s = spots_of(spark, p)
    pairs = []
    plain = graph._close_pairs
    monkeypatch.setattr(graph, "_close_pairs", lambda *a: pairs.append(plain(*a).count()) or plain(*a))
    got = {}
    for r in graph.knn_graph(s, 5).collect():
        got.setdefault(int(r["spot_id"]), []).append(r["nbr_id"])
    assert sum(pairs) < 200 * 600  # 290,000 in the dense cell alone
    y = p[:, ::-1]
    for i in range(len(y)):
        d = ((y - y[i]) ** 2).sum(1)
        order = sorted((j for j in range(len(y)) if j != i), key=lambda j: (d[j], str(j)))[:5]
        assert sorted(round(d[int(j)], 9) for j in got[i]) == sorted(round(d[j], 9) for j in order)


def test_radius_with_dense_cells_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(51)
    s = spots_of(spark, np.concatenate([rng.random((150, 2)) * 2, rng.random((40, 2)) * 30]))
    want = {tuple(r) for r in graph.radius_graph(s, 2.0, "col", "row").collect()}
    monkeypatch.setattr(graph, "DENSE", 20)
    got = [tuple(r) for r in graph.radius_graph(s, 2.0, "col", "row").collect()]
    assert set(got) == want and len(got) == len(want) > 5000
    parts = graph._close_pairs(s, 2.0, "col", "row")
    plan = parts._jdf.queryExecution().toString()
    assert "part" in plan


@pytest.mark.parametrize("copies, scale", [(9, 1.0), (1, 1000.0)])
def test_radius_where_no_median_is_in_the_bounds(spark, tmp_path, copies, scale):
    """Too many spots at each place, or all too far from each other: the last step's radius, as in SQL."""
    import duckdb

    from weftline.plans.registry import ORACLES, QUERIES

    # a thousand keys on are the same sample and the same y
    rows = [(i % 60 + i // 60 * 1000, i % 60 * 37.5 % 100 * scale, "A", 1) for i in range(60 * copies)]
    path = str(tmp_path / "customer.parquet")
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey int").coalesce(1).write.parquet(path)
    with pytest.warns(UserWarning, match="no radius"):
        got = sorted(tuple(r) for r in QUERIES["auto_radius"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(duck.sql(ORACLES["auto_radius"]).fetchall())


def test_nearest_of_many_spots_at_a_place(spark, monkeypatch):
    """Equal places don't make all pairs of their spots, and ties still go to the smaller id."""
    p = np.array([(0.0, 0.0)] * 200 + [(0.5, 0.0)] * 3 + [(9.0, 9.0)])
    s, pairs, plain = spots_of(spark, p), [], graph._close_pairs
    monkeypatch.setattr(graph, "_close_pairs", lambda *a: pairs.append(plain(*a).count()) or plain(*a))
    got = {}
    for r in graph.knn_graph(s, 4).collect():
        got.setdefault(int(r["spot_id"]), set()).add(r["nbr_id"])
    assert sum(pairs) < 200 * 20  # 40,000 of all pairs
    for i in range(len(p)):
        d = ((p - p[i]) ** 2).sum(1)
        assert got[i] == {str(j) for j in sorted((j for j in range(len(p)) if j != i), key=lambda j: (d[j], str(j)))[:4]}
