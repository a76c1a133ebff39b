"""Storms from fields to scores, against what the made fields hold."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isobar.operators import detect, tracks, validate
from isobar.plans import storms
from isobar.plans.api import ScientificEvaluation, SimulationData
from isobar.plans.config import TCConfig

KNOTS = 1.94384449


def _cube(spark, members=(1, 2), off_hours=True):
    """One storm a member and year; member 2's has too weak winds in 2001.  Rows, and the
    nodes that are there: (member, year, k, lat, lon, wind, psl)."""
    rows, nodes = [], []
    lat, lon = np.meshgrid(np.arange(-2.0, 30), np.arange(140.0, 175), indexing="ij")
    for m in members:
        for year in (2000, 2001):
            begin = datetime.datetime(year, 5 + m, 1)
            for k in range(12):
                y, x = 10.1 + k * 0.5, 150.1 + k
                r2 = (lat - y) ** 2 + (lon - x) ** 2
                strong = 1.0 if m == 1 or year == 2000 else 0.2
                wind, psl = 2 + strong * (30 - abs(k - 6.2)) * np.exp(-r2 / 16), 101000 - 3000 * np.exp(-r2 / 4)
                fields = {"psl": psl, "uas": -0.6 * wind, "vas": 0.8 * wind, "zg300": 9000 + 30 * np.exp(-r2 / 9), "zg500": 5000 + 0 * lat}
                at = np.unravel_index(psl.argmin(), psl.shape)
                nodes.append((m, year, k, lat[at], lon[at], wind.max(), psl[at]))
                for v, f in fields.items():
                    rows.append(pd.DataFrame({"variable": v, "realization": m, "time": begin + datetime.timedelta(hours=6 * k), "lat": lat.ravel(), "lon": lon.ravel(), "value": f.ravel()}))
                if off_hours:
                    rows.append(rows[-5].assign(time=begin + datetime.timedelta(hours=6 * k + 3)))
    return spark.createDataFrame(pd.concat(rows)), pd.DataFrame(nodes, columns=["m", "year", "k", "lat", "lon", "wind", "psl"])


@pytest.fixture(scope="module")
def made(spark):
    cube, nodes = _cube(spark)
    return cube.cache(), nodes


@pytest.fixture(scope="module")
def control(spark):
    rows = [(f"s{n}", k, 2000 + n % 2, 1 + n, 12.0 + k, 160.0 + k, 18.0 + 3 * k + n, 100500.0 - 700 * k - 90 * n) for n in range(6) for k in range(5)]
    rows += [("weak", k, 2000, 3, 5.0, 80.0, 9.0, 100900.0) for k in range(5)] + [("early", 0, 1999, 3, 5.0, 80.0, 30.0, 99000.0)]
    return spark.createDataFrame(rows, "storm string, pt int, year int, month int, lat double, lon double, wind double, psl double")


@pytest.mark.parametrize("tile", [0.0, 20.0])
def test_from_fields(made, control, tile):
    cube, nodes = made
    e = ScientificEvaluation([SimulationData(cube, "sim")]).evaluate_storms("sim", {"ibt": storms.TrackSet(control)}, wind_factor=0.8, config=TCConfig(tile=tile, bin=15.0))
    points = e.points.where("dataset = 'sim'").toPandas()
    strong = nodes[(nodes["m"] == 1) | (nodes["year"] == 2000)]
    key = ["year", "month", "pt"]
    want = strong.assign(month=5 + strong["m"], pt=strong["k"]).sort_values(key)
    got = points.sort_values(key)
    assert points["storm"].nunique() == 3 and len(got) == len(want)
    for a, b in (("lat", want["lat"]), ("lon", want["lon"]), ("wind", 0.8 * want["wind"]), ("pres", want["psl"] / 100)):
        assert np.allclose(got[a], b)
    table = {r["name"]: r for r in e.settings.collect()}
    assert table["sim"]["members"] == 2 and table["sim"]["years"] == 2 and table["sim"]["wind_factor"] == 0.8
    yearly = {r["year"]: r for r in e.yearly.where("dataset = 'sim'").collect()}
    for year, own in strong.groupby("year"):
        assert yearly[year]["count"] == own["m"].nunique() / 2 and yearly[year]["tcd"] == pytest.approx(len(own) / 4 / 2)
        assert yearly[year]["ace"] == pytest.approx((1e-4 * (KNOTS * 0.8 * own["wind"]) ** 2).sum() / 2)
        assert yearly[year]["lmi"] == pytest.approx(own.loc[own.groupby("m")["wind"].idxmax(), "lat"].mean())
    clim = e.climatology.where("dataset = 'sim'").first()
    assert clim["uclim_count"] == 3 / 4
    own = control.toPandas().query("storm not in ('weak', 'early')")
    x = 1010 - np.minimum(own["psl"] / 100, 1010)
    fit = np.polyfit(x, own["wind"], 2)
    pace = (1e-4 * (KNOTS * np.polyval(fit, 1010 - strong["psl"] / 100)) ** 2).sum()
    assert clim["uclim_pace"] == pytest.approx(pace / 4, rel=1e-6)
    assert e.climatology.where("dataset = 'ibt'").first()["uclim_count"] == 6 / 2  # without the weak and the early
    assert e.clim_bias_table().count() > 0 and e.spatial_plots().count() > 0


def test_years_and_references(made, control):
    cube, _ = made
    refs = {"ibt": storms.TrackSet(control, years=(1980, 2020)), "short": storms.TrackSet(control, years=(2000, 2000))}
    with pytest.warns(UserWarning, match="short"):
        t = storms.from_fields(cube, "sim", refs, c=TCConfig(bin=15.0))
    assert {r["name"] for r in t["settings"].collect()} == {"ibt", "sim"}
    t = storms.from_fields(cube, "sim", refs, start=2000, end=2000, c=TCConfig(bin=15.0))
    assert {r["dataset"] for r in t["storms"].select("dataset").distinct().collect()} == {"ibt", "sim", "short"}
    assert t["storms"].where("year <> 2000").count() == 0
    for wrong, of in (({"start": 1990}, refs), ({"control": "none"}, refs), ({}, {}), ({"c": TCConfig(min_wind=5.0)}, refs), ({"control": "short"}, refs)):
        with pytest.raises((KeyError, validate.InvalidData)):
            storms.from_fields(cube, "sim", of, **wrong)


def test_tracker_input(spark, made):
    cube, _ = made
    keys = ["realization", "time"]
    with pytest.raises(validate.InvalidData, match="uas, zg500"):
        detect.tracker_input(cube.where("variable NOT IN ('uas', 'zg500')"), keys)
    holes = cube.where("NOT (variable = 'vas' AND lat = 3)").withColumn("value", F.when(~((F.col("variable") == "uas") & (F.col("lat") == 4)), F.col("value")))
    ground = spark.createDataFrame([(float(y), float(x), float(y)) for y in (-10, 40) for x in (140, 180)], "lat double, lon double, value double")
    out = detect.tracker_input(holes, keys, ground)
    first = out.where("lat = 7 AND lon = 150").first()
    assert first["phis"] == pytest.approx(7 * 9.80665) and first["thickness"] == pytest.approx(first["z300"] - first["z500"])
    assert out.where("lat = 3").count() == 0 and out.where("lat = 4 AND wind IS NOT NULL").count() == 0 and out.where("lat = 4").count() > 0
    assert out.where("hour(time) % 6 <> 0").count() == 0  # psl alone is there at those
    own = cube.unionByName(cube.where("variable = 'psl'").withColumns({"variable": F.lit("phis"), "value": F.lit(5.0)}))
    assert detect.tracker_input(own, keys, ground).where("phis <> 5").count() == 0
    assert detect.tracker_input(cube, keys).where("phis IS NOT NULL").count() == 0


def test_missing_wind_and_pressure(spark):
    rows = [("a", 0, 2000, 1, 5.0, 60.0, 20.0, None), ("a", 1, 2000, 1, 5.0, 60.0, None, 99000.0), ("a", 2, 2000, 1, 5.0, 60.0, -1.0, -1.0)]
    points = spark.createDataFrame(rows, "storm string, pt int, year int, month int, lat double, lon double, wind double, psl double")
    s = storms.TrackSet(points, wind_factor=2.0)
    filled = storms.prepared("x", s, (2000, 2000), TCConfig()).orderBy("pt").collect()
    assert filled[0]["wind"] == 40 and filled[0]["pres"] == pytest.approx(1010 - (40 / 2.3) ** (1 / 0.76))
    assert filled[1]["wind"] == pytest.approx(2.3 * 20**0.76) and (filled[2]["wind"], filled[2]["pres"]) == (15.0, 1008.0)
    bare = storms.prepared("x", s, (2000, 2000), TCConfig(), fill=False).orderBy("pt").collect()
    assert bare[0]["pres"] is None and bare[1]["wind"] is None and bare[2]["wind"] is None
    assert storms.prepared("x", s, (2000, 2000), TCConfig(), control_limit=17.5).count() == 2
    assert storms.prepared("x", s, (2001, 2001), TCConfig()).count() == 0
    assert storms.prepared("x", s, (2000, 2000), TCConfig(), basin=5).count() == 3 and storms.prepared("x", s, (2000, 2000), TCConfig(), basin=4).count() == 0


@pytest.mark.parametrize(("months", "kept"), [((1, 12), 12), ((3, 5), 3), ((11, 2), 4), ((6, 6), 12)])
def test_months_over_the_turn_of_the_year(spark, months, kept):
    p = spark.range(12).select(F.lit("x").alias("dataset"), F.col("id").alias("storm"), F.lit(0).alias("pt"), (F.col("id") + 1).alias("month"), F.lit(2000).alias("year"))
    assert tracks.by_time(p, months).count() == kept


def test_sets_from_files(spark, tmp_path, control):
    from isobar.sources import files

    own = control.withColumns({"i": F.lit(0), "j": F.lit(0), "phis": F.lit(0.0), "day": F.lit(1), "hour": F.lit(0)})
    path = f"{tmp_path}/tracks"
    files.write_tracks(own, path)
    rows = spark.createDataFrame([(path, "ibt", False, 1, 2, 1.0), (path, "again", False, 2, 2, 0.5)], "file string, name string, unstructured boolean, members int, years int, wind_factor double")
    sets = storms.from_settings(spark, rows)
    t = storms.scores(sets, "ibt", (2000, 2001), TCConfig(bin=15.0))
    got = {r["dataset"]: r for r in t["climatology"].collect()}
    assert got["ibt"]["uclim_count"] == 3 and got["again"]["uclim_count"] == 1.5
    assert got["again"]["storm_ace"] == pytest.approx(got["ibt"]["storm_ace"] / 4)
