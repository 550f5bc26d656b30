"""Every relational query against its SQL, and the exact cases of the fixtures."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lithocube import relational_queries as rq
from lithocube.functions.directions import compass, turned
from lithocube.functions.variograms import ARRAYS
from lithocube.operators import metrics, series, spatial, weights
from lithocube.settings import RunConfig
from lithocube.sources.files import read_wide_csv

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "supplier"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return sorted(tuple("~" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(rq.SQL))
def test_query_matches_sql(spark, con, name):
    got, wanted = rq.QUERIES[name](spark, DATA).toPandas(), con.sql(rq.SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert len(rows(got)) == len(rows(wanted))
    off = [(a, b) for a, b in zip(rows(got), rows(wanted), strict=True) if a != b]
    assert len(off) <= 0.001 * len(got), off[:3]  # a last digit may round either way


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("values", "wanted"), [([None, 1, None, 3, None], [1, 1, 2, 3, 3]), ([None, None], [0, 0])])
def test_gap_fill(spark, values, wanted):
    df = spark.createDataFrame([(1, k, None if v is None else float(v)) for k, v in enumerate(values)], "s int, epoch int, v double")
    assert [r.v for r in series.fill_gaps(df, ["s"], "v").orderBy("epoch").collect()] == wanted


@pytest.mark.parametrize(("values", "wanted"), [([1, None, 2], [1, 1, 3]), ([None, None], [None, None])])
def test_safe_cumsum(spark, values, wanted):
    df = spark.createDataFrame([(1, k, None if v is None else float(v)) for k, v in enumerate(values)], "s int, epoch int, v double")
    assert [r.cum for r in series.safe_cumsum(df, ["s"], "epoch", "v").orderBy("epoch").collect()] == wanted


def test_folds():
    assert series.folds(84) == [(1, 53, 54, 63), (2, 63, 64, 73), (3, 73, 74, 83)]
    assert series.folds(19)[0][1] == 0
    with pytest.raises(ValueError):
        series.folds(18)


def test_cap_and_normalise(spark):
    w = spark.createDataFrame([(1, 1, 0.8), (1, 2, 0.4)], "station int, layer int, total double").withColumn("surface", F.lit(1.0))
    assert [round(r.w, 6) for r in weights.depth_weights(w).orderBy("layer").collect()] == [0.66, 0.33]
    n = spark.createDataFrame([(1, 1, -0.2), (1, 2, 0.9), (1, 3, 0.6)], "station int, layer int, w double")
    assert [round(r.w, 6) for r in weights.normalise(n).orderBy("layer").collect()] == [0.0, 0.6, 0.4]


def test_missing_weight_makes_residual_null(spark):
    w = spark.createDataFrame([(1, 1, 0.5), (1, 2, None)], "station int, layer int, w double")
    d = spark.createDataFrame([(1, 0, 2.0)], "station int, epoch int, d double")
    assert weights.deep_residual(w, d).first().residual is None


def test_directions(spark):
    got = spark.createDataFrame([(a,) for a in (0.0, 90.0, 180.0, 45.0)], "a double").select(turned(F.col("a")).alias("z"), compass(turned(F.col("a"))).alias("c")).collect()
    assert [(r.z, r.c) for r in got] == [(90.0, "E"), (0.0, "N"), (270.0, "W"), (45.0, "NE")]


def test_circular_variogram():
    import numpy as np

    h = np.array([0.0, 10.0, 25.0])
    assert np.allclose(ARRAYS["circular"](h, 0.8, 10.0, 0.2, 1.0), [0.2, 1.0, 1.0])


def test_few_rows_have_no_fold_metrics(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "k int, pred double, truth double")
    r = metrics.fold_errors(df, ["k"]).first()
    assert r.rmse is None and r.n_valid == 1


def test_nearest_pixel_ties_go_low(spark):
    axis = spark.createDataFrame([(0, 0.0), (1, 10.0)], "idx int, x double")
    at = spark.createDataFrame([(1, 5.0), (2, 5.1), (3, -9.0), (4, 99.0)], "station int, x double")
    assert [r.i for r in spatial.nearest_on_axis(at, axis, "x", "i").orderBy("station").collect()] == [0, 1, 0, 1]


def test_wide_csv(spark, tmp_path):
    (tmp_path / "ANHE_insar_mlcw.csv").write_text("Depth,Month_001,Month_002\n0,1.5,NaN\n10,,2\n")
    got = {(r.station, r.depth, r.label): r.value for r in read_wide_csv(spark, str(tmp_path)).collect()}
    assert got == {("ANHE", 0, "Month_001"): 1.5, ("ANHE", 0, "Month_002"): None, ("ANHE", 10, "Month_001"): None, ("ANHE", 10, "Month_002"): 2.0}


def test_wide_csv_in_many_parts(spark, con):
    """Files of three rows at most: a station's rows are split over several, and all come back."""
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        got = rq.QUERIES["q86_wide_csv_io"](spark, DATA).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert rows(got) == rows(con.sql(rq.SQL["q86_wide_csv_io"]).df())


def test_every_query_reads_a_table(spark, monkeypatch):
    """The plan of each query comes from a given table, and so do the rows it writes and reads again."""
    from lithocube import numeric_queries as nq
    from lithocube.sources import tables

    seen, real = [], tables.table
    monkeypatch.setattr(tables, "table", lambda *a: (seen.append(a[2]), real(*a))[1])
    for name, query in {**rq.QUERIES, **nq.QUERIES}.items():
        seen.clear()
        if name != "q80_run_summary":  # runs everything while it is built; it starts from the same cube
            query(spark, DATA)
            assert seen, name


def test_config_precedence():
    c = RunConfig.parse("[Inversion]\nsolver = joint\nlam = 0.5\nlam_t = 2\n[Tuning]\nfixed_lam = 9\n")
    assert c.solver == "joint" and c.smoothing == (0.5, 2.0) and c.months == (0, None)


def test_running_totals_stream(spark, tmp_path):
    from lithocube.streaming.epochs import running_totals

    src = spark.createDataFrame([(1, 1, "2020-01-03 00:00:00", 1.0), (1, 1, "2020-01-09 00:00:00", 2.0)], "station int, layer int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = running_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.value, r.n) for r in spark.table("totals").collect()] == [(3.0, 2)]


def test_settings_of_all_sections():
    text = "[Dataset]\nx_col = X\nmin_insar_fraction = 0.4\ninsar_surface_depth = 0\n[SpatialInterpolation]\nmethod = Kriging\n[Kriging]\nn_trials = 9\nverbose = true\n[Tuning]\nlam_candidates = 0.1, 1\n[Inversion]\nmonth_end =\n"
    c = RunConfig.parse(text)
    assert (c["Dataset", "x_col"], c["Dataset", "min_insar_fraction"], c["Dataset", "depth_col"]) == ("X", 0.4, "Depth")
    assert c.engine == {"engine": "kriging", "trials": 9, "most_ratio": 3.0, "splits": 5, "bounds": None} and c["Tuning", "lam_candidates"] == (0.1, 1.0) and c.months == (0, None)
    assert RunConfig.parse("").sections == RunConfig().sections and RunConfig().engine["engine"] == "gp"


@pytest.mark.parametrize(("text", "told"), [("[Dataset]\nother = 1", "unknown key other"), ("[Else]\na = 1", "unknown section"), ("[Kriging]\nn_trials = many", "n_trials"), ("[CV]\nrun_spatial_cv = maybe", "true or false"), ("[Inversion]\nsolver = other", "cvxpy"), ("[GP]\ngp_mode = round", "isotropic")])
def test_wrong_settings_are_refused(text, told):
    with pytest.raises(ValueError, match=told):
        RunConfig.parse(text)


def test_fingerprint_and_torn_stage(spark, tmp_path):
    from lithocube.stages import Stages, fingerprint

    df = spark.createDataFrame([(1, "a", None), (2, None, 0.5)], "k int, s string, v double")
    assert fingerprint(df) == fingerprint(df.orderBy(F.col("k").desc()).repartition(3)) == fingerprint(df.select("v", "s", "k"))
    others = [df.limit(1), df.withColumn("v", F.lit(1.0)), df.union(df.limit(1)), df.withColumnRenamed("v", "w"), df.withColumn("k", F.col("k").cast("long"))]
    assert len({fingerprint(x) for x in [df, *others]}) == 6
    store = Stages(spark, str(tmp_path))
    for _ in range(2):
        got, key = store.stage("one", {"a": 1}, [], lambda: df)
        assert got.count() == 2
    assert store.made == ["one"]
    (tmp_path / f"one-{key}" / "_SUCCESS").unlink()  # as a run that was stopped leaves it
    (tmp_path / f"one-{key}" / "part-torn.parquet").write_bytes(b"torn")
    assert store.stage("one", {"a": 1}, [], lambda: df)[0].count() == 2 and store.made == ["one", "one"]


def test_scenarios():
    from lithocube.sources.files import read_scenarios

    grid, caps, found = read_scenarios('{"grid": {"nx": 100}, "S1": {"angle": 45.0}}')
    assert (grid, caps, found) == ({"nx": 100}, {"gpr": 1500, "kriging": 2000}, {"S1": {"angle": 45.0}})


def test_product_keeps_attributes(spark, tmp_path):
    from lithocube.sources import files

    df = spark.createDataFrame([(0, 1, 2.5), (1, 1, None)], "t int, station int, residual double")
    files.write_product({"residual": df}, str(tmp_path), rq.PRODUCT)
    got, attributes = files.read_product(spark, str(tmp_path), "residual")
    assert attributes == {"residual": rq.PRODUCT["residual"]} and dict(got.dtypes)["residual"] == "float" and got.count() == 2


def test_ranks_over_partitions(spark):
    df = spark.createDataFrame([(k * 37 % 101 % 7, k) for k in range(101)], "v int, k int").repartition(7)
    got = [(r.v, r.k) for r in metrics.ranked(df, "v", "k").orderBy("rank").collect()]
    assert got == sorted(got) and [r.rank for r in metrics.ranked(df, "v", "k").orderBy("rank").collect()] == list(range(101))


def test_leave_one_out_mean_and_worst(spark):
    w = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.4), (3, 1, 0.9)], "station int, layer int, w double")
    assert {r.station: round(r.pred, 9) for r in weights.mean_of_others(w).collect()} == {1: 0.65, 2: 0.55, 3: 0.3}
    assert weights.mean_of_others(w.where("station = 1")).first().pred is None
    assert [r.station for r in metrics.worst_deep_fraction(w, 2).collect()] == [1, 2]
    g = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), ("c", None)], "g string, v double")
    assert [(r.g, r["mean"]) for r in metrics.worst_groups(g, "g", "v", 5).collect()] == [("b", 3.0), ("a", 1.0)]


def test_nearest_of_an_irregular_axis(spark):
    axis = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 11.0)], "idx int, x double")
    p = spark.createDataFrame([(1, -5.0), (2, 5.0), (3, 10.5), (4, 99.0)], "station int, x double")
    assert {r.station: r.c for r in spatial.nearest_on_axis(p, axis, "x", "c").collect()} == {1: 0, 2: 0, 3: 1, 4: 2}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lithocube.session import shared_dir

    def session(master):
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context)

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("local[4]")).endswith("lithocube")


def test_entry_without_the_corpus_operators(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "lithocube.llm", None)
    for name in [m for m in sys.modules if m.startswith("lithocube.llm.") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    assert "q29_deep_residual" in entry.queries() and not any(n.startswith("op") for n in entry.queries()) and not any(n.startswith("op") for n in entry.oracle_sql())


@pytest.mark.parametrize("spread", ["even", "clustered", "line", "same"])
def test_nearest_neighbours(spark, spread):
    import numpy as np

    rng = np.random.default_rng(7)
    at = {"even": rng.random((80, 2)) * 1e5, "clustered": np.vstack([rng.normal(0, 5, (60, 2)), rng.random((20, 2)) * 1e6]), "line": np.column_stack([np.arange(80) * 100.0, np.zeros(80)]), "same": np.ones((80, 2))}[spread]
    asked = np.vstack([rng.random((50, 2)) * 2e5 - 5e4, at[:5], (at[:5] + at[5:10]) / 2])
    right = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)] + [(999, None, 1.0)], "s int, x double, y double").repartition(3)
    left = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(asked)], "p int, x double, y double")
    square = ((asked[:, None] - at[None]) ** 2).sum(axis=2)
    got = {r.p: (r.s, r.square) for r in spatial.nearest(left, right, "p", "s").collect()}
    assert len(got) == len(asked) and all(got[k][0] == int(np.flatnonzero(d == d.min())[0]) and np.isclose(got[k][1], d.min()) for k, d in enumerate(square))
    own = ((at[:, None] - at[None]) ** 2).sum(axis=2) + np.diag(np.full(80, np.inf))
    got = {r.s: (r.o, r.square) for r in spatial.nearest(right, right.withColumnRenamed("s", "o"), "s", "o", others=True).collect()}
    assert len(got) == 80 and all(np.isclose(got[k][1], d.min()) and got[k][0] == int(np.flatnonzero(d == d.min())[0]) for k, d in enumerate(own))
    assert np.isclose(spatial.farthest(right), np.sqrt(np.where(np.isfinite(own), own, 0).max()))
    assert spatial.nearest(left, right.limit(0), "p", "s").count() == 0 and spatial.nearest(left.limit(0), right, "p", "s").count() == 0


def test_nearest_has_no_product_in_its_plan(spark):
    left, right = (spark.createDataFrame([(k, float(k), 1.0) for k in range(9)], f"{n} int, x double, y double") for n in ("p", "s"))
    plan = spatial.nearest(left, right, "p", "s")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0, 1.0, 2.0], [float(k * k % 97) for k in range(1000)], [1e9, -1e9] + [k / 1e6 for k in range(500)], [0.1] * 300 + [0.2] * 300])
def test_exact_quantiles(spark, values):
    import numpy as np

    asked = [0.0, 0.25, 0.5, 0.95, 1.0]
    rows = [(g, float(v) * (g + 1)) for g in (0, 1) for v in values] + [(2, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    got = {(r.g, r.q): r.quantile for r in metrics.exact_quantiles(df, "v", asked, ["g"]).collect()}
    wanted = {(g, q): np.quantile(np.array(values) * (g + 1), q) for g in (0, 1) for q in asked}
    assert got.keys() == wanted.keys() and all(np.isclose(got[k], wanted[k], rtol=1e-12) for k in wanted)
    whole = metrics.exact_quantiles(df.where("g = 0"), "v", [0.5]).collect()
    assert len(whole) == 1 and np.isclose(whole[0].quantile, wanted[0, 0.5])
    assert metrics.exact_quantiles(df.limit(0), "v", asked, ["g"]).count() == 0


def test_screen_has_no_window(spark):
    points = spark.createDataFrame([(1, float(k), float(k * k % 7), float(k % 3)) for k in range(40)], "layer int, x double, y double, v double")
    out = spatial.anisotropy_screen(points, by=["layer"])
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 8
    few = spatial.anisotropy_screen(points.where("x < 4")).collect()  # too few for bins: the variance of all
    assert len({round(r.variance, 9) for r in few}) == 1


def test_npz_archives(spark, tmp_path):
    import numpy as np

    from lithocube.sources import arrays

    a = np.arange(120.0).reshape(5, 6, 4)
    for save, name in ((np.savez, "plain"), (np.savez_compressed, "packed")):
        save(tmp_path / f"{name}.npz", a=a, b=np.asfortranarray(a * 2), c=np.arange(5), n=np.array(["x", "yy", "", "é", "z"]), zero=np.array(3.5))
        got = arrays.read_npz(spark, str(tmp_path / f"{name}.npz"), ["a", "b"], block=24)
        assert got.rdd.getNumPartitions() == 5  # a block for each first index
        assert sorted((r.d0, r.d1, r.d2, r.a, r.b) for r in got.collect()) == [(i, j, k, a[i, j, k], 2 * a[i, j, k]) for i in range(5) for j in range(6) for k in range(4)]
        some = arrays.read_npz(spark, str(tmp_path / f"{name}.npz"), ["a"], 3, 3, block=24)
        assert some.rdd.getNumPartitions() == 1 and [r.a for r in some.orderBy("a").collect()] == a[3].ravel().tolist()
        assert [tuple(r) for r in arrays.read_npz(spark, str(tmp_path / f"{name}.npz"), ["c", "n"]).collect()] == [(0, "x"), (1, "yy"), (2, ""), (3, "é"), (4, "z")]
        assert arrays.read_npz(spark, str(tmp_path / f"{name}.npz"), ["zero"]).first()[0] == 3.5
    rows = spark.createDataFrame([(k, k / 2, k % 2 == 0, f"s{k}") for k in range(50)], "k long, v double, f boolean, s string").repartition(4)
    arrays.write_npz(rows, f"file://{tmp_path}/table")
    assert sorted(arrays.read_npz(spark, f"file://{tmp_path}/table").collect()) == sorted(rows.collect())
    with np.load(next((tmp_path / "table").glob("*.npz"))) as z:  # numpy reads what was written
        assert set(z.files) == {"k", "v", "f", "s"}
    with pytest.raises(Exception, match="several shapes"):
        arrays.read_npz(spark, str(tmp_path / "plain.npz"), ["a", "c"]).count()


def classic_netcdf(values, times):
    """A file with an unlimited dimension, made by hand: two record variables lie in turn, one fixed variable before them."""
    import struct

    text = lambda s: struct.pack(">i", len(s)) + s.encode() + bytes(-len(s) % 4)
    t, x = values.shape
    head = b"CDF\x01" + struct.pack(">iii", t, 10, 2) + text("Time") + struct.pack(">i", 0) + text("X") + struct.pack(">i", x) + struct.pack(">ii", 12, 1) + text("title") + struct.pack(">ii", 2, 3) + b"abc\0"
    made = lambda at: struct.pack(">ii", 11, 3) + text("X") + struct.pack(">ii", 1, 1) + struct.pack(">iiii", 0, 0, 5, 4 * x) + struct.pack(">i", at) + text("Time") + struct.pack(">ii", 1, 0) + struct.pack(">iiii", 0, 0, 4, 4) + struct.pack(">i", at + 4 * x) + text("disp") + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 12, 1) + text("_FillValue") + struct.pack(">iif", 5, 1, -9.0) + struct.pack(">ii", 5, 4 * x) + struct.pack(">i", at + 4 * x + 4)
    at = len(head) + len(made(0))
    body = struct.pack(f">{x}f", *[10.0 * k for k in range(x)])
    for k in range(t):
        body += struct.pack(">i", times[k]) + struct.pack(f">{x}f", *values[k])
    return head + made(at) + body


def test_netcdf_files(spark, tmp_path):
    import numpy as np

    from lithocube.sources import arrays

    values = np.arange(12.0).reshape(4, 3)
    values[1, 2] = -9.0
    (tmp_path / "one.nc").write_bytes(classic_netcdf(values, [5, 7, 9, 11]))
    got = arrays.read_netcdf(spark, str(tmp_path / "one.nc"), "disp", block=3)
    assert got.columns == ["Time_idx", "Time", "X_idx", "X", "disp"] and got.rdd.getNumPartitions() == 4
    rows = {(r.Time, r.X): r.disp for r in got.collect()}
    assert np.isnan(rows.pop((7, 20.0))) and rows == {(5 + 2 * t, 10.0 * x): values[t, x] for t in range(4) for x in range(3) if (t, x) != (1, 2)}
    some = arrays.read_netcdf(spark, str(tmp_path / "one.nc"), "disp", 7, 10, block=3)
    assert some.rdd.getNumPartitions() == 2 and {r.Time for r in some.collect()} == {7, 9} and got.count() == 12
    (tmp_path / "bad.nc").write_bytes(b"\x89HDF....")
    with pytest.raises(Exception, match="classic"):
        arrays.read_netcdf(spark, str(tmp_path / "bad.nc"), "disp").count()
    header = arrays.netcdf_header(str(tmp_path / "one.nc"))
    assert header["disp"].attributes == {"_FillValue": [-9.0]} and header["Time"].shape == (4,)
    df = spark.createDataFrame([(t, y, t + y / 8) for t in range(6) for y in range(5) if (t + y) % 4], "t int, y int, v double").withMetadata("v", {"units": "mm"})
    arrays.write_netcdf(df, str(tmp_path / "out"), ["t", "y"])
    back = arrays.read_netcdf(spark, str(tmp_path / "out"), "v").where("not isnan(v)")
    assert sorted((r.t, r.y, r.v) for r in back.collect()) == sorted(map(tuple, df.collect()))
    assert arrays.netcdf_header(str(next((tmp_path / "out").glob("*.nc"))))["v"].attributes == {"units": "mm"}
