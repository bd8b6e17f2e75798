"""Fits of several K tile by tile, against fits one by one, and their bundles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.blocks import sparse_rows
from weftline.operators import graph, model, tiled

KEY = ["sample_id", "spot_id"]


def inputs(spark, s, seed=3, factor=False):
    rng = np.random.default_rng(seed)
    places, rows = [], []
    for sample, high in (("a", 9), ("b", 7)):
        for r in range(high):
            for c in range(8):
                i, kind = f"{r}x{c}", int(c > 3) + int(r > 4)
                places.append((sample, i, float(r), float(2 * c + r % 2)))
                x = np.maximum(rng.normal(size=12) + 2 * (np.arange(12) % 3 == kind) + (sample == "b") * 0.5, 0)
                rows.append((sample, i, np.flatnonzero(x).tolist(), x[x > 0].tolist()))
    spots = spark.createDataFrame([*places, ("a", "lone", 90.0, 90.0)], "sample_id string, spot_id string, row double, col double")
    rows.append(("a", "lone", [0, 3], [1.0, 2.0]))
    long = [(sample, i, f"g{g:02d}", v) for sample, i, idx, val in rows for g, v in zip(idx, val, strict=True)]
    listed = spark.createDataFrame([(f"g{g:02d}", g + 1) for g in range(12)], "gene string, gene_idx int")
    data = sparse_rows(spark.createDataFrame(long, "sample_id string, spot_id string, gene string, value double"), listed, KEY)
    other = graph.knn_graph(spots.where("spot_id <> 'lone'"), 3) if factor else None
    return model.prepare(data, graph.lattice(spots), 12, 2, s, other), spots


def same_fit(got, want):
    (rows, p), (other, q) = got, want
    assert np.allclose(p.path, q.path, rtol=1e-8) and len(p.path) == len(q.path)
    for name in ("w", "lam", "mu", "sigma", "psi", "beta"):
        assert np.allclose(getattr(p, name), getattr(q, name), rtol=1e-6, atol=1e-8), name
    a, b = ({(r["sample_id"], r["spot_id"]): r for r in d.collect()} for d in (rows, other))
    assert set(a) == set(b) and len(a) == rows.count()
    for k, r in a.items():
        assert r["cluster"] == b[k]["cluster"]
        for c in ("hz", "hv", "resp"):
            assert np.allclose(r[c], b[k][c], atol=1e-6), (k, c)


@pytest.mark.parametrize(("side", "settings"), [(4.0, {}), (None, {"mix_prop_heter": False}), (3.0, {"spatial_factor": False})])
def test_all_k_at_once_are_the_fits_one_by_one(spark, side, settings):
    s = model.ModelSettings(max_rounds=4, max_sweeps=4, init="kmeans", init_starts=1, **settings)
    x, spots = inputs(spark, s)
    got = tiled.fit_many(x, [2, 3], s, None if side is None else tiled.tile_of(spots, side))
    for k in (2, 3):
        same_fit(got[k], model.fit(x, k, s))
    x.rows.unpersist()


def test_two_graphs_and_resumed_rounds(spark, tmp_path, monkeypatch):
    """A fit that is killed after two rounds goes on from its bundle to the same result."""
    s = model.ModelSettings(max_rounds=5, max_sweeps=3, init="kmeans", init_starts=1, eps_loglik=1e-12)
    x, spots = inputs(spark, s, factor=True)
    tiles, folder = tiled.tile_of(spots, 5.0), f"file://{tmp_path}/bundle"
    whole = tiled.fit_many(x, [2, 3], s, tiles)
    same_fit(whole[3], model.fit(x, 3, s))
    plain, turns = tiled.advance, []

    def killed(*args):
        if len(turns) == 2:
            raise RuntimeError("killed")
        turns.append(1)
        return plain(*args)

    monkeypatch.setattr(tiled, "advance", killed)
    with pytest.raises(RuntimeError, match="killed"):
        tiled.fit_many(x, [2, 3], s, tiles, folder)
    turns.clear()
    monkeypatch.setattr(tiled, "advance", lambda *a: turns.append(1) or plain(*a))
    monkeypatch.setattr(tiled, "begin", lambda *a: 1 / 0)
    again = tiled.fit_many(x, [2, 3], s, tiles, folder)
    assert len(turns) == 2  # of four rounds
    for k in (2, 3):
        same_fit(again[k], whole[k])
    turns.clear()
    same_fit(tiled.fit_many(x, [2, 3], s, tiles, folder)[2], whole[2])
    assert not turns
    with pytest.raises(ValueError):
        tiled.fit_many(x, [2, 4], s, tiles, folder)
    x.rows.unpersist()


def test_halos_hold_what_sweeps_need(spark):
    s = model.ModelSettings(max_rounds=2, max_sweeps=3)
    x, spots = inputs(spark, s)
    cut = tiled.cut(x, tiled.tile_of(spots, 4.0), 3)
    edges = {}
    for r in x.edges.collect():
        edges.setdefault((r["sample_id"], r["spot_id"]), set()).add(r["nbr_id"])
    own, every = {}, {}
    for r in cut.members.collect():
        every.setdefault(r["tile"], {})[r["sample_id"], r["spot_id"]] = r["hop"]
        if r["hop"] == 0:
            own[r["sample_id"], r["spot_id"]] = r["tile"]
    assert len(own) == x.rows.count()
    for tile, hops in every.items():
        near = {k for k, t in own.items() if t == tile}
        for hop in range(4):
            assert {k for k, h in hops.items() if h <= hop} == near
            near = near | {(k[0], n) for k in near for n in edges.get(k, ())}
    cut.blocks.unpersist()


def test_rounds_have_as_many_jobs_for_any_number_of_k(spark):
    s = model.ModelSettings(max_rounds=4, max_sweeps=3, init="kmeans", init_starts=1, eps_loglik=1e-12)
    x, spots = inputs(spark, s)
    tiles, jobs = tiled.cut(x, tiled.tile_of(spots, 6.0), s.max_sweeps), []
    tracker = spark.sparkContext.statusTracker()
    tiles.blocks.count()
    for ks in ([2], [2, 3, 4]):
        f = tiled.begin(x, ks, s)
        group = f"round-{len(ks)}"
        spark.sparkContext.setJobGroup(group, group)
        tiled.advance(x, tiles, f, s)
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs[1] <= jobs[0] + 1, jobs  # a stage may be one more job
    x.rows.unpersist()
    tiles.blocks.unpersist()
