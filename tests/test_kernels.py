"""Invariants of the numeric kernels."""

import numpy as np
import pytest

from lithocube import numeric_queries as nq
from lithocube.kernels import bayes, fields
from lithocube.kernels import least_squares as ls
from lithocube.operators import system

from . import worlds

RNG = np.random.default_rng(3)


def test_nnls_meets_the_optimality_conditions():
    for _ in range(30):
        n = int(RNG.integers(2, 40))
        a = RNG.standard_normal((n + 5, n))
        x, off = ls.bounded_minimum(a.T @ a + 0.1 * np.eye(n), RNG.standard_normal(n))
        assert (x >= 0).all() and off < 1e-8


def test_joint_equals_the_dense_problem_and_separates():
    t, n = 12, 4
    w = RNG.standard_normal((t, n)) + 0.5
    d = w.sum(axis=1) * 1.1
    m, off = ls.solve_joint(d, w, 0.3, 2.0)
    x, _ = ls.bounded_minimum(ls.station_hessian(t, n, 0.3, 2.0), (d[:, None] + w).ravel())
    assert np.allclose(m.ravel(), x, atol=1e-8) and off < 1e-8
    rough = lambda z: (np.diff(z, axis=0) ** 2).sum()
    assert rough(ls.solve_joint(d, w, 0.3, 20.0)[0]) < rough(m) < rough(ls.solve_independent(d, w, 0.3)[0])


def test_elimination_by_epochs_equals_the_dense_solution():
    rng = np.random.default_rng(11)
    for t, n in ((1, 3), (2, 4), (9, 5)):
        layer, right = ls.layer_matrix(n, 0.3, 1.0), rng.standard_normal((t, n)) * 3
        solve, times = ls.banded_solver(layer, t, 1.7, right)
        dense = ls.station_hessian(t, n, 0.3, 1.7)
        for _ in range(5):
            free = rng.random(t * n) < 0.7
            x = np.zeros(t * n)
            x[free] = np.linalg.solve(dense[np.ix_(free, free)], right.ravel()[free])
            assert np.allclose(solve(free), x) and np.allclose(times(x), dense @ x)


def test_wide_station_with_bounds_that_hold():
    """83 epochs of 30 layers, a fifth of them at the bound, in seconds."""
    import time

    rng = np.random.default_rng(12)
    w = np.cumsum(np.abs(rng.standard_normal((83, 30))), axis=0) * np.where(np.arange(30) % 5 == 0, -1.0, 1.0)
    began = time.process_time()
    m, off = ls.solve_joint(w.sum(axis=1) * 1.15, w, 0.01, 3.0)
    assert (m >= 0).all() and off < 1e-6 and (m == 0).mean() > 0.1 and time.process_time() - began < 10


def test_posterior_std_is_exact():
    t, n = 7, 3
    exact = np.sqrt(np.diag(np.linalg.inv(ls.station_hessian(t, n, 0.4, 1.5)))).reshape(t, n)
    assert np.allclose(ls.posterior_std(t, n, 0.4, 1.5), exact)


def test_coupled_solution_keeps_its_bounds():
    w = np.abs(RNG.standard_normal((6, 4, 3))).cumsum(axis=0) * 5
    d = w.sum(axis=2) * 0.9
    m, primal, dual = ls.solve_coupled(d, w, np.array([[0, 1], [1, 2]]), np.array([1.0, 0.5]), 0.1, 0.5, floor=0.1, rounds=3000)
    assert (m >= 0).all() and (m.sum(axis=2) <= d + 1e-9).all() and max(primal, dual) < 1e-4


def test_projection():
    x = np.array([[3.0, -1.0, 2.0]])
    p = ls.capped_projection(x, np.array([4.0]))
    assert np.allclose(p, [[2.5, 0.0, 1.5]])


def test_bayes_equals_the_dense_formula_and_shrinks_the_prior():
    at = np.array([(i, j, k) for i in range(3) for j in range(3) for k in range(2)], float)
    column = (at[:, 0] * 3 + at[:, 1]).astype(int)
    wells = np.array([2, 3, 11])
    prior, noise, data = np.full(len(at), 4.0), np.r_[np.full(9, 0.25), np.full(3, 0.01)], np.r_[RNG.normal(8, 2, 9), RNG.normal(4, 1, 3)]
    design = np.vstack([np.eye(9)[:, column], np.eye(len(at))[wells]])
    for length_z in (None, 0.5):
        place = at / np.array([3.0, 3.0, length_z or 3.0])
        cov = 9 * np.exp(-np.sqrt(((place[:, None] - place[None]) ** 2).sum(-1)))
        gain = cov @ design.T @ np.linalg.inv(design @ cov @ design.T + np.diag(noise))
        mean, var = bayes.posterior(at, data, column, wells, noise, prior, 3.0, 3.0, length_z, block=4)
        assert np.allclose(mean, prior + gain @ (data - design @ prior), atol=1e-5)
        assert np.allclose(var, np.diag(cov - gain @ design @ cov), atol=1e-5) and (var <= 9 + 1e-9).all()


def test_bayes_of_many_voxels_needs_little_memory():
    import tracemalloc

    side, layers = 20, 5
    at = np.array([(i, j, k) for i in range(side) for j in range(side) for k in range(layers)], float)  # 2,000 voxels: 32 MB for all pairs
    column = np.where(np.arange(len(at)) // layers % 9 == 0, np.arange(len(at)) // layers // 9, -1)
    tracemalloc.start()
    mean, var = bayes.posterior(at, np.full(45, 20.0), column, np.zeros(0, int), np.full(45, 0.25), np.full(len(at), 4.0), 3.0, 3.0, block=200)
    assert tracemalloc.get_traced_memory()[1] < 20e6 and np.isfinite(mean).all() and (var > 0).all()
    tracemalloc.stop()


def test_kriging_is_exact_without_nugget():
    x, y = RNG.random((25, 2)) * 10, RNG.standard_normal(25)
    k = fields.Kriging(x, y, "spherical", 1.0, 5.0, 0.0)
    mean, std = k.predict(x)
    assert np.allclose(mean, y, atol=1e-6) and std.max() < 1e-3
    g = np.ones((26, 1))
    g[:-1] = k._gamma(fields.distances(k.placed, k._place(np.array([[3.0, 3.0]]))))
    assert abs((k.inverse @ g)[:-1].sum() - 1) < 1e-8


def test_field_goes_back_to_the_mean_far_away():
    x = RNG.random((30, 2))
    f = fields.fit_field(x, np.sin(5 * x[:, 0]), trials=10)
    mean, std = f.predict(np.array([[500.0, 500.0]]))
    assert abs(mean[0] - f.mean) < 1e-6 and std[0] >= f.predict(x)[1].max()


def test_rotated_field_finds_the_long_axis():
    z = worlds.random_field(60, 10.0, 45, 400, 50, 1.0, 0.01, 5)
    pick = RNG.choice(z.size, 250, replace=False)
    at = np.column_stack([np.tile(np.arange(60), 60), np.repeat(np.arange(60), 60)]) * 10.0
    f = fields.fit_field(at[pick], z.ravel()[pick], True, trials=60)
    angle = f.angle if f.lengths[0] >= f.lengths[1] else f.angle + 90
    assert min(abs(angle % 180 - 45), 180 - abs(angle % 180 - 45)) < 15


def test_worlds():
    truth, surface, wells = worlds.static_world(sigma=(0.0, 0.0))
    assert truth.shape == (100, 5) and wells.shape == (5, 5) and np.allclose(surface, truth.sum(axis=1)) and (truth >= 0).all()
    assert not np.allclose(worlds.static_world()[1], surface)
    grown, top, seen = worlds.timed_world()
    assert grown.shape == (12, 100, 5) and top.shape == (12, 100) and seen.shape == (12, 5, 5) and (np.diff(grown, axis=0) >= 0).all()
    exact, whole, wells = worlds.timed_world(sigma=(0, 0))
    assert np.allclose(whole, exact.sum(axis=2)) and (wells == exact[:, list(worlds.WELLS)]).all()
    assert abs(exact[-1].mean() - 1) < 0.3  # a base of mean 1


def test_random_wells():
    w = worlds.random_wells(400, 20)
    assert len(set(w)) == 20 and list(w) == sorted(w) and 0 <= w[0] and w[-1] < 400 and w == worlds.random_wells(400, 20)


def test_random_field_has_its_variogram():
    """Half the mean square of differences at lag h along the major axis is sill (1 - exp(-3 (h / a)^2))."""
    got = []
    for seed in range(30):
        z = worlds.random_field(100, 10.0, 0, 200, 200, 1.0, 0.0, seed)
        got.append([((z[:, k:] - z[:, :-k]) ** 2).mean() / 2 for k in (3, 6, 10)])
    wanted = [1 - np.exp(-3 * (h / 200) ** 2) for h in (30.0, 60.0, 100.0)]
    assert np.allclose(np.mean(got, axis=0), wanted, rtol=0.12)


def test_toy_solvers_recover_the_world():
    truth, surface, wells = worlds.static_world()
    h = ls.layer_matrix(5, 0.01, 1.0, 0.0)
    m = np.array([ls.tikhonov(h, np.full(5, d)) for d in surface])
    assert m.shape == truth.shape and ((m - truth) ** 2).mean() < 10


@pytest.mark.parametrize("name", sorted(set(nq.QUERIES) - {"q52_qp", "q70_gp", "q71_rotated_gp", "q72_kriging", "q73_grid_product"}))
def test_numeric_queries_run(spark, name):
    got = nq.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    assert len(got)
    if "kkt" in got:
        assert got["kkt"].max() < 1e-6 and (got["m"] >= 0).all()
    if name == "q62_grid_search":
        assert len(got) == 143 and (got["max_rmse"] >= got["mean_rmse"]).all()
    if name == "q93_solver_sweep":
        assert len(got) == 10 and (got["mse"] >= 0).all()
    if name == "q98_layer_models":
        assert sorted(got["engine"].dropna().unique()) == ["kriging", "rotated"] and got["ratio"].min() >= 1 and got["angle"].between(0, 180).all()


@pytest.mark.parametrize("name", sorted(nq.SQL))
def test_conditions_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = sorted((r.station, r.n, r.holds) for r in nq.QUERIES[name](spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(con.sql(nq.SQL[name]).fetchall())


def test_conditions_see_what_is_no_optimum(spark):
    rng = np.random.default_rng(17)
    w = rng.standard_normal((9, 3)) + 0.5
    d = w.sum(axis=1)
    frame = lambda m, v: spark.createDataFrame([(1, k + 1, t, float(m[t, k])) for t in range(9) for k in range(3)], f"station int, layer int, epoch int, {v} double")
    top = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate(d)], "station int, epoch int, d double")
    for lam_t, m in ((2.0, ls.solve_joint(d, w, 0.3, 2.0)[0]), (None, ls.solve_independent(d, w, 0.3)[0])):
        good = system.optimality(frame(m, "m"), top, frame(w, "w"), 0.3, lam_t).first()
        assert good.n == 27 and good.least == 0 and good.off < 1e-8
        moved = m.copy()
        moved[4, np.argmax(m[4])] += 0.01
        assert system.optimality(frame(moved, "m"), top, frame(w, "w"), 0.3, lam_t).first().off > 1e-3


def dense(pdf, values="w"):
    """(T, S, L) of long rows, and the surface (T, S)."""
    names = np.sort(pdf["station"].unique())
    cubes = [nq.inversion._cube(pdf[pdf["station"] == k]) for k in names]
    return names, np.stack([c[2] for c in cubes], 1), np.stack([c[3] for c in cubes], 1)


@pytest.mark.parametrize(("lam", "lam_t"), [(0.01, 1.0), (1.0, 0.3), (0.5, 0.0)])
def test_consensus_is_the_coupled_solution(spark, monkeypatch, lam, lam_t):
    """Stations that share edges, one that has none, one without a signal, an edge to a station without rows; each task has one station only."""
    rng = np.random.default_rng(13)
    w = rng.standard_normal((9, 7, 4)).cumsum(axis=0) * 4 + 2
    d = np.abs(w.sum(axis=2)) * rng.uniform(0.7, 1.2, 7)
    d[:, 4] = 0.5
    rows = spark.createDataFrame([(s, t, k + 1, float(w[t, s, k]), float(d[t, s])) for t in range(9) for s in range(7) for k in range(4)], "station int, epoch int, layer int, w double, d double")
    pairs, weight = np.array([[0, 1], [1, 2], [0, 2], [2, 3], [3, 4]]), np.array([1.0, 0.5, 0.3, 0.8, 0.9])
    edges = spark.createDataFrame([(int(a), int(b), float(x)) for (a, b), x in zip(pairs, weight, strict=True)] + [(6, 99, 1.0)], "a int, b int, weight double")
    got = nq.inversion.invert_coupled(rows, edges, lam, lam_t, tolerance=1e-8).toPandas()
    wanted, primal, dual = ls.solve_coupled(d, w, pairs, weight, lam, lam_t, rounds=20000)
    assert max(primal, dual) < 1e-5 and got[["primal", "dual"]].to_numpy().max() < 1e-8
    m = got.sort_values(["epoch", "station", "layer"])["m"].to_numpy().reshape(w.shape)
    assert np.abs(m - wanted).max() < 1e-5 and (m >= 0).all()
    assert nq.inversion.invert_coupled(rows.limit(0), edges).count() == 0


def test_coupled_query_is_the_solution_in_one_place(spark):
    d = "/root/testdata/sf0.01"
    rows, edges = nq.rows(spark, d).toPandas(), system.neighbours(nq.tables.stations(spark, d), 15000.0).toPandas()
    assert len(edges) == 75  # FIXTURES B
    got = nq.QUERIES["q52_qp"](spark, d).toPandas()
    names, w, surface = dense(rows)
    at = {s: k for k, s in enumerate(names.tolist())}
    wanted, *_ = ls.solve_coupled(surface, w, np.array([(at[a], at[b]) for a, b in zip(edges["a"], edges["b"], strict=True)]), edges["weight"].to_numpy(), 0.01, 1.0, rounds=20000)
    m = got.sort_values(["epoch", "station", "layer"])["m"].to_numpy().reshape(w.shape)
    assert np.abs(m - wanted).max() < 1e-5 and (m.sum(axis=2) <= np.maximum(surface, 0) + 1e-6)[:, np.abs(surface).max(axis=0) >= 10].all()


@pytest.mark.parametrize("kind", ["isotropic", "anisotropic", "depth"])
def test_bayes_over_blocks_is_the_dense_formula(spark, monkeypatch, kind):
    monkeypatch.setattr(nq.inversion, "TOGETHER", 3)
    monkeypatch.setattr(nq.inversion, "VOXELS", 7)
    rng = np.random.default_rng(14)
    rows = [(t, s, k, float(rng.normal(5, 2)), 12.0 + s + t) for t in range(7) for s in (0, 1, 2, 4, 5, 8, 9) for k in (1, 2, 3)]
    got = nq.inversion.bayes_epochs(spark.createDataFrame(rows, "epoch int, station int, layer int, w double, d double"), kind).toPandas()
    assert len(got) == len(rows)
    for t in range(7):
        mine = [r for r in rows if r[0] == t]
        s, k, w = np.array([r[1] for r in mine]), np.array([r[2] for r in mine]), np.array([r[3] for r in mine])
        names, wells = np.unique(s), np.flatnonzero(s % 4 == 0)
        prior = np.array([w[wells][k[wells] == x].mean() for x in k]) if kind == "depth" else np.full(len(w), w[wells].mean())
        data = np.r_[[next(r[4] for r in mine if r[1] == x) for x in names], w[wells]]
        at = np.column_stack([s // 4, s % 4, k - 1]).astype(float)  # a raster of 4 x 4
        noise = np.r_[np.full(len(names), 0.25), np.full(len(wells), 0.01)]
        mean, var = bayes.posterior(at, data, np.searchsorted(names, s), wells, noise, prior, 3.0, 3.0, None if kind == "isotropic" else 0.5)
        one = got[got["epoch"] == t].sort_values(["station", "layer"])
        assert np.allclose(one["mean"], mean, atol=1e-5) and np.allclose(one["std"] ** 2, var, atol=1e-5)
    with pytest.raises(Exception, match="same voxels"):
        nq.inversion.bayes_epochs(spark.createDataFrame(rows[:-1], "epoch int, station int, layer int, w double, d double"), kind).count()
    monkeypatch.setattr(nq.inversion, "MOST_OBSERVED", 3)
    with pytest.raises(ValueError, match="observations"):
        nq.inversion.bayes_epochs(spark.createDataFrame(rows, "epoch int, station int, layer int, w double, d double"), kind)


def test_bayes_has_no_group_of_an_epoch(spark):
    rows = spark.createDataFrame([(t, s, k, 1.0 + t, 3.0) for t in range(40) for s in range(4) for k in (1, 2)], "epoch int, station int, layer int, w double, d double")
    plan = nq.inversion.bayes_epochs(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan  # what is solved by group are 16 epochs of observations, checkpointed


@pytest.mark.parametrize("engine", ["gp", "rotated", "kriging"])
def test_search_by_trials_is_the_search_in_one_place(spark, engine):
    at = np.random.default_rng(15).random((3, 18, 2)) * 30000
    v = np.sin(at[..., 0] / 8000) + np.cos(at[..., 1] / 9000)
    v[2] = 0
    points = spark.createDataFrame([(k, s, *map(float, at[k, s]), float(v[k, s])) for k in range(3) for s in range(18)], "layer int, station int, x double, y double, v double")
    got = {r.layer: r for r in nq.inversion.fit_layers(points, engine, 60).collect()}
    for k in range(2):
        m = nq.inversion.fit_engine(at[k] / 1000, v[k], engine, 60)
        wanted = (m.angle, m.ratio, m.reach, m.sill, m.nugget) if engine == "kriging" else (m.angle, m.lengths[0] / m.lengths[1], m.lengths[0], m.signal, m.noise)
        assert np.allclose([got[k].angle, got[k].ratio, got[k].major, got[k].sill, got[k].nugget], wanted)
    assert got[2].engine is None


def test_search_is_dealt_out_by_trials(spark):
    points = spark.createDataFrame([(1, s, float(s * 1000), float(s * s * 100 % 7000), float(s % 5)) for s in range(12)], "layer int, station int, x double, y double, v double")
    chunks = []
    real = nq.inversion.cut
    nq.inversion.cut = lambda df: (chunks.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1]
    try:
        nq.inversion.search_models(points, "gp", hold_out=True).count()
    finally:
        nq.inversion.cut = real
    assert any("RepartitionByExpression" in c and "chunk" in c for c in chunks)


def test_pixels_are_the_whole_raster(spark):
    got = nq.inversion.grid_pixels(spark).toPandas()
    assert len(got) == got[["x", "y"]].drop_duplicates().shape[0] == 106 * 121
    assert (got["x"].min(), got["x"].max(), got["y"].min(), got["y"].max()) == (160000.0, 212500.0, 2600000.0, 2660000.0)


@pytest.mark.parametrize(("name", "search"), [("q70_gp", ("gp", 200)), ("q71_rotated_gp", ("rotated", 200)), ("q72_kriging", ("kriging", 50)), ("q73_grid_product", ("gp", 200))])
def test_gridding_predicts_every_cell_with_the_whole_search(spark, monkeypatch, name, search):
    seen, real = [], nq.inversion.interpolate

    def kept(points, pixels, engine="gp", trials=None):
        seen.append((engine, trials or nq.inversion.TRIALS[engine], pixels.count()))
        return real(points, pixels, engine, trials)

    monkeypatch.setattr(nq.inversion, "interpolate", kept)
    got = nq.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [(*search, 12826)] and got.select("pixel").distinct().count() == 12826


@pytest.mark.parametrize("engine", ["gp", "rotated", "kriging"])
def test_left_out_station_has_no_say(spark, engine):
    at = np.random.default_rng(8).random((14, 2)) * 40000
    v = np.sin(at[:, 0] / 9000) + np.cos(at[:, 1] / 7000)

    def left_out(values):
        points = spark.createDataFrame([(1, k, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(at, values, strict=True))], "layer int, station int, x double, y double, v double")
        return nq.inversion.leave_one_out(points, engine).toPandas().set_index("station").sort_index()

    other = v.copy()
    other[5] += 20
    one, two = left_out(v), left_out(other)
    assert np.allclose(one.loc[5, ["pred", "std"]].astype(float), two.loc[5, ["pred", "std"]].astype(float))
    assert not np.allclose(one["pred"].drop(5), two["pred"].drop(5))
    x = np.delete(at, 5, axis=0) / 1000
    pred, _ = nq.inversion.fit_engine(x, np.delete(v, 5), engine).predict(at[5:6] / 1000)
    assert abs(one.loc[5, "pred"] - pred[0]) < 1e-8


def test_models_are_no_column_of_pixels(spark):
    points = nq.layer_points(spark, "/root/testdata/sf0.001")
    models = nq.inversion.cut(nq.inversion.fit_layers(points, "gp", 5))
    plan = nq.inversion.predict_layers(models, nq.inversion.grid_pixels(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "sx" not in plan


@pytest.mark.parametrize("engine", ["gp", "rotated", "kriging"])
def test_near_points_give_what_all_points_give(spark, monkeypatch, engine):
    rng = np.random.default_rng(16)
    at = rng.random((150, 2)) * 40000
    points = spark.createDataFrame([(k, s, *map(float, at[s]), float(np.sin(at[s, 0] / 5000) + k * np.cos(at[s, 1] / 4000)) * (k < 3)) for k in (1, 2, 3) for s in range(150)], "layer int, station int, x double, y double, v double")
    models = nq.inversion.cut(nq.inversion.fit_layers(points, engine, 10))
    pixels = spark.createDataFrame([(p, float(rng.random() * 60000 - 5000), float(rng.random() * 40000)) for p in range(60)], "pixel int, x double, y double")
    line = lambda df: df.toPandas().sort_values(["layer", "pixel"])[["w", "std"]].to_numpy()
    whole = line(nq.inversion.predict_layers(models, pixels))
    assert np.allclose(line(nq.inversion.predict_near(models, pixels, 100000.0)), whole, atol=1e-6)
    assert np.allclose(line(nq.inversion.predict_near(models, pixels, 1000.0, least=150)), whole, atol=1e-6)  # cells grow until they hold all
    near = line(nq.inversion.predict_near(models, pixels, 4000.0, least=30))
    assert len(near) == 180 and np.abs(near[:, 0] - whole[:, 0]).mean() < 0.1
    monkeypatch.setattr(nq.inversion, "MOST_POINTS", 10)
    with pytest.raises(ValueError, match="predict_near"):
        nq.inversion.predict_layers(models, pixels)


def test_models_predict_alike_in_every_partition(spark):
    points = nq.layer_points(spark, "/root/testdata/sf0.001")
    pixels = nq.inversion.grid_pixels(spark).where("pixel % 50 = 0")
    models = nq.inversion.fit_layers(points, "rotated", 20)
    one, many = (nq.inversion.predict_layers(models, p).toPandas().sort_values(["layer", "pixel"])[["w", "std"]].to_numpy() for p in (pixels.coalesce(1), pixels.repartition(5)))
    assert np.allclose(one, many) and len(one) == 7 * 257


def test_sparse_samples_find_their_field():
    """100 samples of a field along 45 degrees, eight times as long as wide."""
    z = worlds.random_field(100, 10.0, 45, 400, 50, 1.0, 0.05, 42).ravel()
    pick = np.random.default_rng(42).choice(z.size, 100, replace=False)
    at = np.column_stack([np.tile(np.arange(100), 100), np.repeat(np.arange(100), 100)]) * 10.0 + 5
    f = nq.inversion.fit_engine(at[pick], z[pick], "rotated", 200, 12.0)
    assert abs(f.angle % 180 - 45) < 15 and np.sqrt(np.mean((z - f.predict(at)[0]) ** 2)) < 1.2 * 0.7172  # BASELINE


def test_kriging_score_is_the_folds_error():
    rng = np.random.default_rng(4)
    x, y = rng.random((60, 2)) * 40, rng.standard_normal(60)
    folds = fields.spatial_folds(x, 5)
    for trial in fields.kriging_trials(x, y, 20):
        kept = trial | {"shape": trial["shape"] if trial["model"] in fields.SHAPED else 1.0}
        got = fields.cross_validate(x, y, folds, lambda a, b: fields.Kriging(a, b, **kept))  # noqa: B023
        assert np.isclose(fields.kriging_score(x, y, folds, trial), np.mean((got[:, 0] - y) ** 2), rtol=1e-6)


def test_field_score_is_the_likelihood():
    x, y = np.random.default_rng(5).random((2, 40, 2))[0], np.random.default_rng(6).standard_normal(40)
    f = fields.Field(x, y, 30.0, (0.5, 0.2), 1.3, 0.05)
    k = 1.3 * fields.matern52(fields.distances(f.placed, f.placed)) + (0.05 + 1e-10) * np.eye(40)
    z = (y - f.mean) / f.spread
    assert np.isclose(f.score, 0.5 * z @ np.linalg.solve(k, z) + 0.5 * np.linalg.slogdet(k)[1]) and np.allclose(k @ f.weights, z)


@pytest.fixture(scope="module")
def small(spark):
    """Six stations, 24 epochs and 2 layers, with a raster of 9 pixels: what `run` takes."""
    rng = np.random.default_rng(21)
    m = np.abs(rng.standard_normal((24, 6, 2))).cumsum(axis=0) + 1
    at = rng.random((6, 2)) * 20000
    model = spark.createDataFrame([(s, k + 1, t, float(m[t, s, k])) for t in range(24) for s in range(6) for k in range(2)], "station int, layer int, epoch int, m double")
    insar = spark.createDataFrame([(s, t, float(m[t, s].sum() * 1.1)) for t in range(24) for s in range(6)], "station int, epoch int, d double")
    stations = spark.createDataFrame([(s, *map(float, at[s])) for s in range(6)], "station int, x double, y double")
    pixels = spark.createDataFrame([(p, p % 3 * 7000.0, p // 3 * 7000.0) for p in range(9)], "pixel int, x double, y double")
    return model, insar, stations, 24, pixels


BASE_TEXT = "[Inversion]\nlam = 0.01\nlam_t = 1.0\n[SpatialInterpolation]\nmethod = kriging\n[Kriging]\nn_trials = 3\n"
ALL = ["model", "weights", "forward", "loso", "models", "grid", "product", "total_std"]


def test_second_run_solves_nothing(spark, small, tmp_path):
    from lithocube.settings import RunConfig
    from lithocube.stages import Stages

    def made(text, tables=small):
        store = Stages(spark, str(tmp_path))
        out = nq.inversion.run(RunConfig.parse(text), spark, *tables, store=store)
        return store.made, out

    first, out = made(BASE_TEXT)
    assert first == ALL and set(out) == set(ALL)
    again, same = made(BASE_TEXT)
    assert again == [] and all(sorted(map(str, same[k].collect())) == sorted(map(str, out[k].collect())) for k in ALL)
    assert made(BASE_TEXT.replace("lam = 0.01", "lam = 0.5"))[0] == ALL
    assert made(BASE_TEXT + "[GP]\nstd_threshold = 0.01\n")[0] == ["product"]
    assert made(BASE_TEXT.replace("n_trials = 3", "n_trials = 4"))[0] == ["loso", "models", "grid", "product", "total_std"]
    assert made(BASE_TEXT + "[Report]\nno_plots = true\n[GP]\nn_restarts = 5\n")[0] == []
    model = small[0].withColumn("m", nq.F.col("m") + nq.F.when(nq.F.col("epoch") == 3, 0.1).otherwise(0.0))
    assert made(BASE_TEXT, (model, *small[1:]))[0] == ALL


#: A change of each key that acts, and the stages that must differ by it.
ACTS = [
    ("Inversion", "solver = independent", "model"), ("Inversion", "solver = cvxpy", "model"), ("Inversion", "weighted = true", "model"), ("Inversion", "month_start = 2", "model"),
    ("Inversion", "month_end = 21", "model"), ("SpatialInterpolation", "method = gp", "grid"), ("Kriging", "max_anisotropy = 9", "grid"), ("Kriging", "n_splits = 2", "models"),
    ("GP", "std_threshold = 0.0001", "product"),
]


@pytest.fixture(scope="module")
def acted():
    """Tables of runs by their settings, so that the unchanged one is made once."""
    return {}


@pytest.mark.parametrize(("section", "line", "stage"), ACTS)
def test_settings_act(spark, small, acted, section, line, stage):
    from lithocube.settings import RunConfig

    key = line.split(" =")[0]
    def run(changed):
        lines, at = [], None
        for row in BASE_TEXT.splitlines() + ([] if f"[{section}]" in BASE_TEXT else [f"[{section}]"]):
            at = row if row.startswith("[") else at
            if not (changed and at == f"[{section}]" and row.startswith(f"{key} =")):
                lines.append(row)
            if changed and row == f"[{section}]":
                lines.append(line)
        text = "\n".join([*(x for x in lines if changed or x != "[GP]"), "[CV]", "run_spatial_cv = false", "run_temporal_cv = false"])
        if text not in acted:
            acted[text] = nq.inversion.run(RunConfig.parse(text), spark, *small)
        out = acted[text]
        assert not {"loso", "forward", "total_std"} & set(out)
        return sorted(map(str, out[stage].drop("sx", "sy", "sv", "primal", "dual", "kkt").collect()))

    assert run(True) != run(False)


def test_settings_of_tuning_and_bounds_act(spark, small):
    from lithocube.settings import RunConfig

    text = "[Tuning]\nlam_candidates = 0.1,1\nlam_t_candidates = 0.5,2,3\n[CV]\nrun_spatial_cv = no\nrun_temporal_cv = no\n[SpatialInterpolation]\nmethod = kriging\n[Kriging]\nn_trials = 2\n"
    out = nq.inversion.run(RunConfig.parse(text), spark, *small)
    assert sorted((r.lam, r.lam_t) for r in out["trials"].collect()) == [(a, b) for a in (0.1, 1.0) for b in (0.5, 2.0, 3.0)]
    fixed = nq.inversion.run(RunConfig.parse(text + "").parse(text.replace("[Tuning]", "[Tuning]\nfixed_lam = 1\nfixed_lam_t = 2")), spark, *small)
    assert "trials" not in fixed
    bounds = RunConfig.parse("[GP]\ngp_mode = anisotropic\ngp_length_scale = 3\ngp_length_scale_min = 2\ngp_length_scale_max = 4\ngp_noise_level = 0.02\ngp_noise_level_min = 0.01\ngp_noise_level_max = 0.03\nangle_min = 20\nangle_max = 50\nmax_anisotropy = 2\n").engine
    search = nq.inversion.engine_search(RNG.random((9, 2)) * 30, RNG.standard_normal(9), **bounds)
    assert np.allclose(np.exp(search.low[[0, 2, 3]]), [2, 0.01, 1]) and np.allclose(np.exp(search.high[[0, 2, 3]]), [4, 0.03, 2]) and (search.low[4], search.high[4]) == (20, 50)
    assert np.allclose(np.exp(search.trials[0, [0, 2]]), [3, 0.02]) and search.trials[0, 4] == 20 and ((search.trials >= search.low) & (search.trials <= search.high)).all()


@pytest.mark.parametrize("rotated", [False, True])
def test_cost_of_a_trial_is_the_score_of_its_field(rotated):
    search = fields.FieldSearch(RNG.random((25, 2)) * 20, RNG.standard_normal(25), rotated, 5.0, 30)
    assert np.allclose(search.scores(slice(None)), [search.made(p).score for p in search.trials], rtol=1e-6)


def test_run_takes_solver_months_and_engine(spark):
    from lithocube.settings import RunConfig

    d, n = "/root/testdata/sf0.001", nq.N
    tables = nq.model(spark, d), nq.insar(spark, d), nq.tables.stations(spark, d)
    text = "[Inversion]\nsolver = {}\nlam = 0.01\nlam_t = 1.0\nmonth_start = 10\nmonth_end = 50\n[SpatialInterpolation]\nmethod = kriging\n[Kriging]\nn_trials = 3\n"
    with pytest.raises(ValueError, match="solver"):
        nq.inversion.invert(nq.rows(spark, d), "cvxpy")
    out = nq.inversion.run(RunConfig.parse(text.format("cvxpy")), spark, *tables, n)
    got = out["model"].toPandas()
    assert "primal" in got and got["epoch"].nunique() == 41 and got[["primal", "dual"]].to_numpy().max() < 1e-4
    assert {"product", "total_std"} <= set(out)
    quick = nq.inversion.run(RunConfig.parse(text.format("joint")), spark, *tables, n)
    assert quick["total_std"].where("total_std is null or total_std < 0").isEmpty()
    assert quick["grid"].where("ratio > 1").count() and quick["product"].agg({"epoch": "max"}).first()[0] == 40


def test_run_from_files_to_product(spark, tmp_path):
    """Seven station files, one of them too sparse and one without coordinates, a raster as NetCDF: the whole run, and a second call that makes nothing."""
    from lithocube.plans.from_files import load_grid, load_stations, run_files
    from lithocube.settings import RunConfig
    from lithocube.sources import arrays, files
    from lithocube.stages import Stages

    rng, months = np.random.default_rng(31), 24
    (tmp_path / "in" / "CSV_files").mkdir(parents=True)
    values = {}
    for k, name in enumerate("ABCDEFG"):
        v = -np.abs(rng.standard_normal((3, months)))
        v[0] = v[1:].sum(axis=0) * 1.1
        if name == "F":
            v[0, ::2] = np.nan
            v[0, 1] = np.nan
        v[1, 3] = np.nan
        values[name] = v
        header = "Depth," + ",".join(f"Month_{m + 1}" for m in range(months))  # unpadded numbers
        lines = [",".join([str(depth), *("" if np.isnan(x) else repr(float(x)) for x in row)]) for depth, row in zip((0, 10, 20), v, strict=True)]
        (tmp_path / "in" / "CSV_files" / f"{name}_insar_mlcw.csv").write_text("\n".join([header, *lines, "30" + "," * months]) + "\n")
    (tmp_path / "in" / "mlcw_station_coordinates.csv").write_text("Ename,Code,X_TWD97,Y_TWD97\n" + "".join(f"{n},c,{1000 * k * k},{7000 - 900 * k}\n" for k, n in enumerate("ABCDEF")))
    grid = rng.standard_normal((months, 2, 2, 3))
    grid[:, :, 1, 2] = np.nan
    axes = {"Time": np.arange(months), "Depth": np.array([0, 10]), "Y": np.array([0.0, 5000.0]), "X": np.array([0.0, 8000.0, 16000.0])}
    (tmp_path / "in" / "grid.nc").write_bytes(arrays.netcdf_bytes(axes, {"displacement": grid}))
    text = f"[Paths]\ndata_dir = {tmp_path}/in\ngrid_nc = {tmp_path}/in/grid.nc\noutput_dir = {tmp_path}/out\n" + BASE_TEXT
    config = RunConfig.parse(text)
    inputs = load_stations(config, spark)
    assert [r.name for r in inputs.stations.orderBy("station").collect()] == list("ABCDE") and [r.depth for r in inputs.depths.orderBy("layer").collect()] == [10, 20] and inputs.epochs == months
    m = {(r.station, r.layer, r.epoch): r.m for r in inputs.model.collect()}
    series = values["B"][1].copy()
    series[3] = (series[2] + series[4]) / 2
    assert np.allclose([m[1, 1, t] for t in range(months)], -np.cumsum(series)) and len(m) == 5 * 2 * months
    assert np.allclose(sorted(r.d for r in inputs.insar.where("station = 3").collect()), sorted(-np.cumsum(values["D"][0])))
    pixels, surface = load_grid(config, spark)
    assert sorted(r.pixel for r in pixels.collect()) == [0, 1, 2, 3, 4]
    assert np.allclose([r.d for r in surface.where("pixel = 4").orderBy("epoch").collect()], -np.cumsum(grid[:, 0, 1, 1]))
    store = Stages(spark, f"{tmp_path}/out/stages")
    out = run_files(config, spark, store)
    assert store.made == ALL and out["product"].count() == 5 * months
    residual, attributes = files.read_product(spark, f"{tmp_path}/out/product", "product")
    assert residual.count() == 5 * months and attributes["residual"] == {"units": "mm"} and dict(residual.dtypes)["residual"] == "float"
    again = Stages(spark, f"{tmp_path}/out/stages")
    run_files(config, spark, again)
    assert again.made == []
    shorter = Stages(spark, f"{tmp_path}/out/stages")
    assert run_files(RunConfig.parse(text.replace("[Inversion]", "[Inversion]\nmonth_start = 3")), spark, shorter)["product"].agg({"epoch": "max"}).first()[0] == months - 4
    assert shorter.made == ALL
    with pytest.raises(ValueError, match="data_dir"):
        run_files(RunConfig(), spark)
