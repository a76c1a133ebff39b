"""Operators against closed forms and invariants, on small cubes."""

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isobar import DataDiagnostics, ISOConfig, MJOConfig, ObservationData, ReplicabilityTest, ScientificEvaluation, SimulationData
from isobar.functions import expr as E
from isobar.functions import special
from isobar.operators import detect, eof, reduce, regrid, spectrum, stats, tracks, validate
from isobar.operators import windows as W
from isobar.sources import files
from isobar.sources.netcdf import read_netcdf


def test_p_values():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert special.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    # All of 3 below all of 3: two of twenty orders.
    assert special.mann_whitney_two_sided(0, 3, 3) == pytest.approx(0.1)
    assert special.ks_two_sided(1.0, 3, 3) == pytest.approx(0.1)
    assert special.mann_whitney_two_sided(4.5, 3, 3, 24.0) == 1.0


@pytest.fixture(scope="module")
def cube(spark):
    rng = np.random.default_rng(0)
    rows = [
        ("tas", m, pd.Timestamp(1990 + k // 12, k % 12 + 1, 1), k, lat, lon, float(rng.normal(10 + lat / 30, 1)))
        for m in range(5) for k in range(24) for lat in (-50.0, -10.0, 10.0, 50.0) for lon in (0.0, 90.0, 180.0, 270.0)
    ]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["variable", "realization", "time", "k", "lat", "lon", "value"])).withColumn("time", F.col("time").cast("timestamp_ntz")).cache()


def test_identical_ensembles(spark, cube):
    obs = cube.where("realization = 0").drop("realization")
    test = ReplicabilityTest([SimulationData(cube, "a"), SimulationData(cube, "b")], obs)
    test.perform_rep_test(["a", "b"], 200)
    assert test.get_test_results(["b", "a"]).where("rejected").count() == 0
    sizes = test.get_eff_sizes(["a", "b"]).toPandas()
    assert len(sizes) == 60 and (sizes["d"].abs() < 0.6).all()
    assert test.matrix_plot(["a", "b"]).count() == 60
    with pytest.raises(ValueError):
        ReplicabilityTest(alpha=2)
    with pytest.raises(NotImplementedError):
        test.report()


def _steps(spark, start, unit, n, members=4):
    """Members on a small grid at n steps from a date."""
    rng = np.random.default_rng(3)
    rows = [("tas", m, k, lat, 0.0, float(rng.normal())) for m in range(members) for k in range(n) for lat in (-50.0, 50.0)]
    time = F.expr(f"timestamp_ntz'{start}' + make_interval(0, {'k' if unit == 'month' else 0}, 0, {'k' if unit == 'day' else 0})")
    return spark.createDataFrame(rows, "variable string, realization int, k int, lat double, lon double, value double").withColumn("time", time)


@pytest.mark.parametrize("start,unit,n,seasons", [("2000-01-01", "day", 60, {"All", "DJF", "MAM"}), ("2000-07-01", "month", 2, {"All", "JJA"}), ("1999-12-01", "month", 3, {"All", "DJF"})])
def test_seasons_come_from_time(spark, start, unit, n, seasons):
    """Daily cubes, and those that begin in any month, have their own seasons only."""
    cube = _steps(spark, start, unit, n)
    if unit == "day":
        cube = cube.where("month(time) <= 2")
        seasons = seasons - {"MAM"}
    test = ReplicabilityTest([SimulationData(cube, "a"), SimulationData(cube.withColumn("value", F.col("value") * 2), "b")], cube.where("realization = 0").drop("realization"))
    test.perform_rep_test(["a", "b"], 50)
    assert {r[0] for r in test.get_eff_sizes(["a", "b"]).select("season").distinct().collect()} == seasons


def test_unequal_times_are_refused(spark):
    a, b = _steps(spark, "2000-01-01", "month", 3), _steps(spark, "2000-02-01", "month", 3)
    sims, obs = [SimulationData(a, "a"), SimulationData(b, "b")], a.where("realization = 0").drop("realization")
    with pytest.raises(ValueError, match="only"):
        ReplicabilityTest(sims, obs).perform_rep_test(["a", "b"], 10)
    for method in ("abs_diff_plot", "eff_size_plot"):
        with pytest.raises(ValueError, match="only"):
            getattr(DataDiagnostics(sims), method)("a", "b", "tas")


def test_the_first_observation_file_is_read(spark, tmp_path):
    """Of two products the first in order, tables of several parts, and NetCDF with a calendar."""
    from isobar.sources import netcdf_sink

    stamps = spark.sql("SELECT timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(id) AS time FROM range(4)")
    obs = lambda x: stamps.withColumns({"lat": F.lit(0.0), "lon": F.lit(0.0), "value": F.lit(x)})
    obs(1.0).repartition(3).write.parquet(str(tmp_path / "deep" / "data_obs_a_tas.parquet"))
    obs(2.0).write.parquet(str(tmp_path / "deep" / "data_obs_b_tas.parquet"))
    netcdf_sink.write_netcdf({"pr": netcdf_sink.Table(obs(3.0), ("time", "lat", "lon"))}, str(tmp_path / "data_obs_x_pr.nc"))
    got = files.read_observations(spark, str(tmp_path), ["tas", "pr"], stamps).toPandas()
    assert got.groupby("variable")["value"].agg(["size", "max"]).to_dict("index") == {"tas": {"size": 4, "max": 1.0}, "pr": {"size": 4, "max": 3.0}}
    with pytest.raises(KeyError):
        files.read_observations(spark, str(tmp_path), ["pr"], stamps.union(spark.sql("SELECT timestamp_ntz'2002-01-01 00:00:00'")))
    with pytest.raises(FileNotFoundError):
        files.read_observations(spark, str(tmp_path), ["ua"], stamps)


@pytest.mark.parametrize("frequency", ["annual", "monthly", "daily"])
def test_time_series_by_bins(spark, frequency):
    """Means of area means, members, and an observation, by pandas."""
    cube = _steps(spark, "1999-12-20", "day", 50)
    other = cube.withColumn("value", F.col("value") * 3 + 1)
    obs = cube.where("realization = 1").drop("realization")
    d = DataDiagnostics([SimulationData(cube, "a"), SimulationData(other, "b")])
    got = d.time_series_plot("tas", ["b"], frequency=frequency, obs={"seen": obs}, members=True).toPandas()
    plain = other.toPandas()
    cut = {"annual": "Y", "monthly": "M", "daily": "D"}[frequency]
    plain["bin"] = plain["time"].dt.to_period(cut)
    by_time = plain.groupby(["realization", "bin", "time"])["value"].mean().reset_index()  # both latitudes weigh the same
    each = by_time.groupby(["realization", "bin"])["value"].mean().unstack("realization")
    of = lambda kind: got[got["kind"] == kind].assign(bin=lambda x: pd.to_datetime(x["start"]).dt.to_period(cut)).set_index("bin").sort_index()
    whole, member, seen = of("ensemble"), of("member"), of("observation")
    assert np.allclose(whole["mean"], each.mean(axis=1)) and np.allclose(whole["q05"], each.quantile(0.05, axis=1)) and (whole["lo"] <= whole["mean"] + 1e-12).all()
    assert len(whole) == len(each) == len(seen) and len(member) == each.size and set(got["label"]) == {"b", "seen"}
    assert all(np.allclose(member[member["realization"] == r]["mean"].sort_index(), each[r]) for r in each.columns)
    assert np.allclose(seen["mean"] * 3 + 1, each[1]) and seen["lo"].isna().all()
    first = whole.iloc[0]
    assert first["k"] == {"annual": 1999, "monthly": 1999 * 12 + 11, "daily": 10945}[frequency]
    with pytest.raises(ValueError, match="hourly"):
        d.time_series_plot("tas", frequency="hourly")


def _pooled(x, y):
    """The pooled t-test of many keys, as a test of one's own."""
    from types import SimpleNamespace

    n, m = x.shape[1], y.shape[1]
    spread = np.sqrt((x.var(1, ddof=1) * (n - 1) + y.var(1, ddof=1) * (m - 1)) / (n + m - 2) * (1 / n + 1 / m))
    t = (x.mean(1) - y.mean(1)) / spread
    return SimpleNamespace(pvalue=special.t_two_sided(t, np.full(len(t), float(n + m - 2))))


def test_tests_of_ones_own(spark, cube):
    """Equal to the built-in one, in the map and in the matrix, beside others by name."""
    other = cube.withColumn("value", F.col("value") + F.when(F.col("lat") > 0, 1.5).otherwise(0))
    d = DataDiagnostics([SimulationData(cube, "a"), SimulationData(other, "b")])
    plain, own = (d.eff_size_plot("a", "b", "tas", resamples=50, **more).toPandas().sort_values(["lat", "lon"]) for more in ({}, {"test": _pooled}))
    assert plain["significant"].tolist() == own["significant"].tolist() and 0 < own["significant"].sum() < len(own)

    rows = [(k, s, float(v)) for k in range(40) for s, n in (("test", 4 + k % 3), ("ref", 6)) for v in np.random.default_rng(k).normal(k % 5, 1, n) * (1 if s == "ref" else 2)]
    rows += [(90, "test", 1.0), (91, "test", None), (91, "ref", 2.0)]
    samples = spark.createDataFrame(rows, "key int, side string, value double")
    want = {r["key"]: r["p"] for r in stats.with_t_p(stats.welch(samples, ["key"], equal=True)).collect()}
    got = {r["key"]: r["p"] for r in stats.by_test(samples, ["key"], _pooled).collect()}
    assert got.keys() == want.keys() and got[90] is None and got[91] is None
    assert all(got[k] == pytest.approx(want[k]) for k in range(40))

    test = ReplicabilityTest([SimulationData(cube, "a"), SimulationData(other, "b")], cube.where("realization = 0").drop("realization"))
    test.perform_rep_test(["a", "b"], 50, {"mine": lambda x, y: np.zeros(len(x)), "never": lambda x, y: 1.0, "KS-test": None})
    found = test.get_test_results(["a", "b"]).groupBy("test").agg(F.bool_and("rejected").alias("all"), F.bool_or("rejected").alias("any")).collect()
    assert {r["test"]: (r["all"], r["any"]) for r in found if r["test"] != "KS-test"} == {"mine": (True, True), "never": (False, False)} and len(found) == 3
    with pytest.raises(KeyError, match="Sign"):
        stats.all_tests(samples, ["key"], ["Sign-test"])


def test_shifted_ensemble_is_told(spark, cube):
    obs = cube.where("realization = 0").drop("realization")
    test = ReplicabilityTest([SimulationData(cube, "a"), SimulationData(cube.withColumn("value", F.col("value") + 5), "b")], obs)
    test.perform_rep_test(["a", "b"], 200)
    # Effect sizes of few members' resamples spread too widely for the bootstrap to tell.
    assert test.get_test_results(["a", "b"]).where("rejected AND region = 'Global' AND season = 'All' AND test <> 'Bootstrap'").count() == 3


def test_diagnostics(spark, cube):
    other = cube.withColumn("value", F.col("value") + 2)
    d = DataDiagnostics([SimulationData(cube, "a"), SimulationData(other, "b")])
    diff = d.abs_diff_plot("b", "a", "tas").toPandas()
    assert diff["value"].to_numpy() == pytest.approx(2.0) and diff["lon"].max() == 360
    assert set(d.abs_diff_plot("a", "a", "tas", ocean=True).toPandas()["value"]) == {1e-6}
    size = d.eff_size_plot("a", "b", "tas", resamples=100).toPandas()
    assert (size["value"] > 1).all() and size["significant"].sum() == len(size)
    assert d.time_series_plot("tas").count() == 4
    assert d.bias_plot("b", "tas", cube).toPandas()["value"].to_numpy() == pytest.approx(2.0)
    with pytest.raises(KeyError):
        d.abs_diff_plot("a", "c", "tas")
    with pytest.raises(ValueError):
        d.time_series_plot("tas", ["a"], 1991, 1990)


def test_general_scores(spark, cube):
    obs = cube.where("realization = 0").drop("realization")
    s = ScientificEvaluation([SimulationData(cube.where("realization = 0"), "a")]).compute_general_scores("a", obs, ["tas"]).scores.toPandas()
    assert s["bias"][0] == pytest.approx(0) and s["rmse"][0] == pytest.approx(0) and s["r"][0] == pytest.approx(1)


def test_observations_have_to_be_there(spark, cube):
    obs = ObservationData(cube.where("k < 20").drop("realization", "time"))
    with pytest.raises(KeyError):
        obs.load_and_process(cube)
    grid = ObservationData(cube.where("realization = 0").drop("realization", "time")).load_and_process(cube)
    assert grid.count() == 24 * 16  # equal grids: the values themselves
    want = cube.where("realization = 0").withColumnRenamed("value", "want")
    assert grid.join(want, ["variable", "k", "lat", "lon"]).where("abs(value - want) > 1e-9").count() == 0


def test_scores_lie_between_zero_and_one(spark, cube):
    obs = cube.where("realization = 0").drop("realization")
    s = reduce.season_region_scores(cube, obs, F.col("k") % 12 + 1).toPandas()
    assert s["score"].between(0, 1).all() and len(s) == 5 * 5 * 3 * 4


def test_zero_spread_is_missing(spark):
    x = spark.createDataFrame([("a", s, 1.0) for s in ("test", "ref") for _ in range(3)], "key string, side string, value double")
    assert stats.cohen(x, ["key"]).first()["d"] is None
    assert stats.cohen_bootstrap(x, ["key"], 50).first()["d"] is None
    assert stats.bootstrap_test(x, ["key"]).first()["p"] == 1.0
    assert stats.significant(spark.createDataFrame([(0.05,)], "p double")).first()["significant"] == 0


def test_long_kernel_forms_agree(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=300)
    s = spark.createDataFrame([("a", int(k), float(x)) for k, x in enumerate(v)], "key string, k int, value double")
    h = W.lanczos(141, 1 / 90, 1 / 25)
    assert sum(h) == pytest.approx(0, abs=0.03) and h == h[::-1]
    one = W.convolve(s, ["key"], h).orderBy("k").toPandas()["filtered"].to_numpy()
    two = spectrum.bandpass(s, ["key"], h).orderBy("k").toPandas()["value"].to_numpy()
    assert np.allclose(one, two) and np.allclose(two, np.convolve(v, h, "same"))
    with pytest.raises(ValueError):
        W.lanczos(140, 1 / 90, 1 / 25)


def test_harmonics_equal_a_cut_transform(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=240)
    s = spark.createDataFrame([(int(k), float(x)) for k, x in enumerate(v)], "k int, value double")
    z = np.fft.rfft(v.reshape(10, 24).mean(0))
    z[4:] = 0
    want = v - np.tile(np.fft.irfft(z, 24), 10)
    assert np.allclose(W.harmonics(s, [], 24).orderBy("k").toPandas()["value"], want)


def test_interpolation_and_detrending(spark):
    v = [None, 1.0, None, None, 4.0, 6.0, None]
    s = spark.createDataFrame(list(enumerate(v)), "k int, value double")
    assert W.interpolate(s, []).orderBy("k").toPandas()["value"].tolist() == pytest.approx([0, 1, 2, 3, 4, 6, 8])
    line = spark.createDataFrame([(k, 3.0 + 2.0 * k) for k in range(9)], "k int, value double")
    assert W.detrend(line, []).toPandas()["value"].to_numpy() == pytest.approx(11.0)


def test_eofs_equal_a_decomposition(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 7)) @ np.diag([5, 3, 1, 1, 1, 1, 1])
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(7)], "sample int, feature int, value double")
    modes, loads = eof.fit(long, 2)
    s = np.linalg.svd(x, compute_uv=False)
    m = modes.orderBy("mode").toPandas()
    assert np.allclose(m["eigval"], s[:2] ** 2 / 59) and np.allclose(m["var_frac"], (s**2 / (s**2).sum())[:2])
    v = loads.toPandas().pivot(index="feature", columns="mode", values="loading").to_numpy()
    assert np.allclose(v.T @ v, np.eye(2))
    pcs = eof.standard(eof.project(long, loads), modes)
    assert np.allclose(pcs.groupBy("mode").agg(F.sum(F.col("std") * F.col("std")).alias("v")).toPandas()["v"], 59)
    turned = loads.select((1 - F.col("mode")).cast("int").alias("mode"), "feature", (-F.col("loading")).alias("loading"))
    back = eof.match_modes(turned, loads).join(loads.withColumnRenamed("loading", "l"), ["mode", "feature"]).toPandas()
    assert np.allclose(back["loading"], back["l"])


def test_spectrum_finds_a_wave(spark):
    """A wave of wavenumber 2 that moves east in 12 steps."""
    rows = [(int(k), lat, lon * 45.0, math.cos(2 * math.pi * (2 * lon / 8 - k / 12))) for k in range(240) for lat in (-10.0, 10.0) for lon in range(8)]
    field = spark.createDataFrame(rows, "k int, lat double, lon double, value double")
    power = spectrum.segment_power(spectrum.symmetric(field, ["k"]), [])
    top = power.where("component = 'symmetric' AND frequency > 0").orderBy(F.desc("power")).first()
    assert (top["wavenumber"], round(1 / top["frequency"])) == (2, 12)
    assert spectrum.east_west(power.where("component = 'symmetric'"), [], (0.05, 0.2), (0, 4)).first()["ratio"] > 10
    assert power.where("component = 'antisymmetric'").agg(F.max("power")).first()[0] < 1e-20
    with pytest.raises(ValueError):
        spectrum.latitude_aggregate(power, [], "most")


def test_low_frequencies_go(spark):
    rows = [("c", k, 5.0 + math.sin(2 * math.pi * k / 240) + math.sin(2 * math.pi * k / 12)) for k in range(480)]
    s = spectrum.low_frequency_filter(spark.createDataFrame(rows, "cell string, k int, value double"), ["cell"], 96).orderBy("k").toPandas()["value"]
    assert np.allclose(s, [5.0 + math.sin(2 * math.pi * k / 12) for k in range(480)], atol=1e-9)


def test_taper():
    t = spectrum.taper(96)
    bell = np.hanning(10)
    assert np.allclose(t[:6], bell[:6]) and np.allclose(t[-4:], bell[6:]) and (t[6:-4] == 1).all()


def test_regridding(spark):
    rows = [(a, o, a + 2 * o) for a in (-30.0, 0.0, 30.0) for o in (0.0, 90.0, 180.0)]
    src = spark.createDataFrame(rows, "lat double, lon double, value double")
    to = spark.createDataFrame([(15.0, 45.0), (-30.0, 180.0), (40.0, 10.0), (0.0, 10.0)], "lat double, lon double")
    out = {(r["lat"], r["lon"]): r["value"] for r in regrid.bilinear(src, to, []).collect()}
    assert {k: v for k, v in out.items() if v is not None} == pytest.approx({(15.0, 45.0): 105.0, (-30.0, 180.0): 330.0, (0.0, 10.0): 20.0, (15.0, 180.0): 375.0, (15.0, 10.0): 35.0, (0.0, 45.0): 90.0, (0.0, 180.0): 360.0, (-30.0, 45.0): 60.0, (-30.0, 10.0): -10.0})
    holes = src.withColumn("value", F.when(F.col("lat") != 0, F.col("value")))
    assert regrid.bilinear(holes, to.where("lat = 15"), []).first()["value"] is None
    fine = spark.createDataFrame([(float(a), float(o), 1.0) for a in range(-30, 31, 10) for o in range(0, 181, 30)], "lat double, lon double, value double")
    for x, y in (regrid.to_coarser(src, fine, []), regrid.to_coarser(fine, src, [])[::-1]):
        assert x.count() == y.count() == 9 and y.where("value <> 1").count() == 0


def test_detection_and_stitching(spark):
    rows = []
    for k in range(12):
        clat, clon = 10.1 + k * 0.5, 100.1 + k
        for lat in np.arange(-5, 31, 1.0):
            for lon in np.arange(80, 131, 1.0):
                r = math.hypot(lat - clat, lon - clon)
                rows.append((k, float(lat), float(lon), 101000 - 3000 * math.exp(-((r / 2) ** 2)), 4000 + 30 * math.exp(-((r / 3) ** 2)), 5 + 30 * math.exp(-((r - 1) ** 2))))
    f = spark.createDataFrame(rows, "step int, lat double, lon double, psl double, thickness double, wind double")
    nodes = detect.detect_nodes(f, ["step"]).withColumn("node", F.col("step").cast("long"))
    assert nodes.count() == 12
    path = detect.stitch_nodes(nodes).orderBy("pt").toPandas()
    assert len(path) == 12 and path["track"].nunique() == 1 and path["pt"].tolist() == list(range(12))
    assert detect.stitch_nodes(nodes.where("step < 6")).count() == 0
    assert detect.stitch_nodes(nodes.where("NOT step IN (4, 5, 6, 7)"), min_points=4, min_strong=1).select("track").distinct().count() == 2


def test_track_metrics(spark):
    p = spark.createDataFrame(
        [("c", 1, k, 10.0 + k, 150.0, 20.0 + 5 * (k % 3), 990.0 - k, 7, 2001) for k in range(8)] + [("c", 2, 0, -10.0, 40.0, 9.0, 1005.0, 1, 2002)],
        "dataset string, storm long, pt int, lat double, lon double, wind double, pres double, month int, year int",
    )
    s = {r["storm"]: r for r in tracks.storm_stats(p).collect()}
    assert s[1]["lmi"] == 12.0 and s[1]["tcd"] == 2.0 and s[1]["gen_lat"] == 10.0
    assert tracks.by_basin(p, 4).count() == 8 and tracks.by_basin(p, 21).count() == 1 and tracks.by_basin(p, -1).count() == 9
    assert tracks.density(p, 2.5).agg(F.sum("hits")).first()[0] == 9
    assert tracks.monthly(tracks.storm_stats(p), 2.0).count() == 12
    y = tracks.yearly(tracks.storm_stats(p))
    assert y.count() == 2
    e = ScientificEvaluation.compute_tc_scores(p, "c", 2.0)
    assert e.climatology.count() == 1 and e.maps.count() == 3  # the weak storm is out


def test_basins_and_phases(spark):
    rows = [(20.0, 300.0, 1), (10.0, 260.0, 2), (10.0, 200.0, 3), (10.0, 150.0, 4), (10.0, 60.0, 5), (-10.0, 100.0, 6), (-10.0, 200.0, 7), (60.0, 300.0, 0), (-10.0, 300.0, 0)]
    got = spark.createDataFrame(rows, "lat double, lon double, want int").withColumn("got", E.basin()).toPandas()
    assert (got["want"] == got["got"]).all()
    ph = spark.createDataFrame([(math.sin(a), math.cos(a)) for a in np.radians(np.arange(10, 360, 45))], "a double, b double").select(E.phase("a", "b").alias("p"))
    assert sorted(r["p"] for r in ph.collect()) == list(range(1, 9))


def test_validation(spark, cube):
    with pytest.raises(validate.InvalidData):
        SimulationData(cube.drop("lat"), "x")
    catalog = spark.createDataFrame([("tas", True, "t", "atm", "K", 0.0, 20.0)], "variable string, check_enabled boolean, long_name string, mask string, units string, min double, max double")
    assert SimulationData(cube, "a", catalog).check_data().count() == 0
    holes = cube.withColumn("value", F.when(F.col("lat") > 0, F.col("value") * 100)).where("k <> 7")
    with pytest.raises(validate.InvalidData, match="missing values.*above.*missing step"):
        SimulationData(holes, "b", catalog).check_data()
    axis = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 1.5)], "i int, lat double")
    assert validate.monotone(axis, "lat", "i").count() == 1 and validate.monotone(axis.where("i < 2"), "lat", "i").count() == 0
    noon = cube.withColumn("time", F.expr("time + interval 12 hours"))
    assert validate.normal_time(noon).where("hour(time) <> 0").count() == 0


def test_track_text_and_config(spark, tmp_path):
    p = spark.createDataFrame([(s, k, 1, 2, 10.5, 20.25, 99000.0, 30.0, 0.0, 2001, 7, 4, 6 * k) for s in (1, 2) for k in range(3)], "storm long, pt int, i int, j int, lon double, lat double, psl double, wind double, phis double, year int, month int, day int, hour int")
    files.write_tracks(p, str(tmp_path / "t"))
    back = files.read_tracks(spark, str(tmp_path / "t")).toPandas()
    assert len(back) == 6 and (back["n"] == 3).all() and back["lat"].eq(20.25).all() and sorted(back["hour"]) == [0, 0, 6, 6, 12, 12]
    (tmp_path / "nodes.txt").write_text("2001 7 4 2 6\n\t1\t2\t10.0\t20.0\t99000.0\t30.0\n\t3\t4\t11.0\t21.0\t99100.0\t31.0\n2001 7 4 1 12\n\t5\t6\t12.0\t22.0\t99200.0\t32.0\n")
    nodes = files.read_nodes(spark, str(tmp_path / "nodes.txt")).orderBy("k").toPandas()
    assert nodes["hour"].tolist() == [6, 6, 12] and nodes["lat"].tolist() == [20, 21, 22]
    (tmp_path / "c.csv").write_text("! comment\na.txt, A, false, 3, 10, 1.0\n")
    assert files.read_config(spark, str(tmp_path / "c.csv")).first()["name"] == "A"
    assert [files.parse_value(x) for x in ("1/90", "(0, 4)", "True", "abc", "3")] == [1 / 90, (0, 4), True, "abc", 3]
    assert ISOConfig.from_text({"low": "1/80"}).low == 1 / 80 and MJOConfig().segment == 96
    with pytest.raises(FileNotFoundError):
        files.read_catalog(spark, str(tmp_path / "none.yaml"))
    assert files.result_path("out", "x") == "out/x" and files.result_path("a.parquet", "x") == "a.parquet"


def _classic(path, values):
    """A small classic file: time (records) x lat, with a fill value."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    attr = struct.pack(">ii", 12, 1) + name("_FillValue") + struct.pack(">ii", 5, 1) + struct.pack(">f", -99.0)
    none = struct.pack(">ii", 0, 0)
    dims = struct.pack(">ii", 10, 2) + name("time") + struct.pack(">i", 0) + name("lat") + struct.pack(">i", 2)

    def header(at):
        lat = name("lat") + struct.pack(">ii", 1, 1) + none + struct.pack(">iii", 6, 16, at)
        tas = name("tas") + struct.pack(">iii", 2, 0, 1) + attr + struct.pack(">iii", 5, 8, at + 16)
        return b"CDF\x01" + struct.pack(">i", len(values)) + dims + none + struct.pack(">ii", 11, 2) + lat + tas

    body = header(len(header(0)))
    path.write_bytes(body + struct.pack(">dd", -5.0, 5.0) + b"".join(struct.pack(">ff", *v) for v in values))


def test_netcdf(spark, tmp_path):
    _classic(tmp_path / "x.nc", [(1.0, 2.0), (3.0, -99.0), (5.0, 6.0)])
    got = read_netcdf(spark, str(tmp_path / "x.nc"), "tas").orderBy("time", "lat").toPandas()
    assert got["lat"].tolist() == [-5, 5] * 3 and got["value"].isna().tolist() == [False, False, False, True, False, False]
    assert got["value"].dropna().tolist() == [1, 2, 3, 5, 6]
    with pytest.raises(NotImplementedError):
        read_netcdf(spark, "x.grib", "tas")


def _arcs(points, cells):
    a, b = np.radians(points), np.radians(cells)
    h = np.sin((b[None, :, 0] - a[:, None, 0]) / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[None, :, 0]) * np.sin((b[None, :, 1] - a[:, None, 1]) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.minimum(h, 1))))


@pytest.mark.parametrize("kind", ["regular", "scattered", "patch", "one"])
def test_nearest_cells(spark, kind):
    """Poles, the date line, grids on one side only and repeated places, against all distances."""
    from isobar.operators import detect

    rng = np.random.default_rng(1)
    if kind == "regular":
        cells = [(la, lo) for la in np.arange(-90, 90.1, 7.5) for lo in np.arange(0, 360, 9.0)]
    elif kind == "scattered":
        cells = [(np.degrees(np.arcsin(u)), lo) for u, lo in zip(rng.uniform(-1, 1, 900), rng.uniform(-180, 180, 900), strict=True)]
    elif kind == "patch":
        cells = [(40 + la, 5 + lo) for la, lo in rng.uniform(0, 0.01, (400, 2))] + [(40.0, 5.0)] * 50
    else:
        cells = [(10.0, 20.0)]
    points = [(90.0, 0.0), (-90.0, 77.0), (0.0, 180.0), (0.0, -180.0), (1e-9, 359.9999999), (89.9, 200.0), (-40.0, 185.0), (40.005, 5.005)]
    points += [(float(np.degrees(np.arcsin(u))), float(lo)) for u, lo in zip(rng.uniform(-1, 1, 60), rng.uniform(-200, 400, 60), strict=True)]
    grid = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(cells)] + [(9999, None, 1.0)], "cell int, lat double, lon double")
    own = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(999, None, 0.0)], "id int, lat double, lon double")
    got = {r["id"]: (r["cell"], r["distance"]) for r in detect.nearest_cell(own, grid).collect()}
    far = _arcs(np.array(points), np.array(cells, float))
    assert got.keys() == set(range(len(points)))
    for k, (cell, distance) in got.items():
        assert distance == pytest.approx(far[k].min(), abs=1e-9) and far[k][cell] == pytest.approx(far[k].min(), abs=1e-9)
        ties = np.flatnonzero(far[k] == far[k].min())
        assert len(ties) == 1 or cell <= ties.max()
    assert detect.nearest_cell(own, grid.limit(0)).count() == 0


def test_candidates_do_not_grow_with_the_grid(spark, monkeypatch):
    """What a point meets at the last level, on grids of 1,000 and 40,000 cells."""
    from isobar.operators import detect

    rng = np.random.default_rng(2)
    point = lambda n: list(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, n))).tolist(), rng.uniform(0, 360, n).tolist(), strict=True))
    own = spark.createDataFrame([(k, *p) for k, p in enumerate(point(300))], "id int, lat double, lon double")
    most = []
    plain = detect.checkpointed
    for n in (1_000, 40_000):
        kept = []
        monkeypatch.setattr(detect, "checkpointed", lambda df, kept=kept: (lambda out: (kept.append(out.count()) if "px" in out.columns else None, out)[1])(plain(df)))
        grid = spark.createDataFrame(pd.DataFrame([(k, *p) for k, p in enumerate(point(n))], columns=["cell", "lat", "lon"]))
        assert detect.nearest_cell(own, grid).count() == 300
        most.append(max(kept) / 300)
    assert most[1] < 1.5 * most[0] + 5 and most[1] < 40


@pytest.mark.parametrize("signed", [False, True])
def test_points_along_an_arc(spark, signed):
    rows = [(0.0, 0.0, 0.0, 90.0), (10.0, 350.0, 20.0, 15.0), (-30.0, 170.0, 5.0, -160.0), (89.0, 10.0, 89.0, 190.0), (5.0, 5.0, 5.0, 5.0), (0.0, 0.0, 0.0, 180.0)]
    from isobar.functions import expr as E

    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    ends = [F.col(c) for c in "abcd"]
    got = df.select("a", "b", "c", "d", E.arc_points(*ends, 7, signed).alias("p"), E.arc_points(*ends, 2).alias("two"), E.arc_spacing(*ends, 7, 1.0).alias("s")).collect()
    for r in got:
        a, b, c, d = (np.radians(r[k]) for k in range(4))
        p, q = (np.array([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)]) for la, lo in ((a, b), (c, d)))
        angle = np.arccos(np.clip(p @ q, -1, 1))
        assert [tuple(x) for x in r["two"]] == [(r["a"], r["b"]), (r["c"], r["d"])] and r["s"] == pytest.approx(angle / 6, abs=1e-8)
        if r["d"] == 180.0 and r["a"] == 0.0:
            assert all(x["lat"] is None for x in r["p"])
            continue
        for k, x in enumerate(r["p"]):
            la, lo = np.radians([x["lat"], x["lon"]])
            at = np.array([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])
            assert np.arccos(np.clip(at @ p, -1, 1)) == pytest.approx(angle * k / 6, abs=1e-6) and np.arccos(np.clip(at @ q, -1, 1)) == pytest.approx(angle * (6 - k) / 6, abs=1e-6)
            assert (-180 <= x["lon"] < 180) if signed else (0 <= x["lon"] <= 360)
