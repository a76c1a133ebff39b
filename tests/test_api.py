"""Evaluations as objects, and what they are drawn from."""

import pytest

from isobar import ScientificEvaluation, SimulationData
from isobar.operators import tracks
from isobar.plans import bindings as B
from isobar.plans.config import MJOConfig, TCConfig
from isobar.sources import files

from .conftest import DATA

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def evaluation(spark):
    from pyspark.sql import functions as F

    daily = B.daily(spark, FOLDER, "A").withColumns({"variable": F.lit("rlut"), "realization": F.lit(1)})
    return ScientificEvaluation([SimulationData(daily, "days"), SimulationData(B.hourly_field(spark, FOLDER, 1).withColumns({"realization": F.lit(1), "time": F.expr("cast(timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, k) as timestamp_ntz)")}), "hours")])


def test_iso_tables(spark, evaluation, tmp_path):
    e = evaluation.compute_iso_scores("days", obs=B.daily(spark, FOLDER, "R"), years=(1995, 2001))
    maps = e.eeof_plots("winter").toPandas()
    assert len(maps) == 2 * 3 * 16 and set(maps["copy"]) == {0, 1, 2} and set(maps["lat"]) == {-15.0, -5.0, 5.0, 15.0}
    series = e.pc_plots((1997, 1997), "obs").toPandas()
    assert len(series) == 2 * 2 * 365 and set(series["time"].dt.year) == {1997}
    assert e.freq_plot().count() == 2 * 12 * 2
    e.save_data(str(tmp_path), ["days", "noaa olr"], (1995, 2001))
    names = {p.name for p in tmp_path.iterdir()}
    assert "skill_days-noaa_olr_1995-2001" in names and spark.read.parquet(f"{tmp_path}/alpha_days-noaa_olr_1995-2001").count() == 1
    assert all(files.named_years(n) == (1995, 2001) for n in names)
    own = evaluation.compute_iso_scores("days", years=(1995, 2001))
    assert "skill" not in own.tables and own.freq_plot().count() == 24


def test_mjo_tables(spark, evaluation):
    obs = B.hourly_field(spark, FOLDER, 0)
    e = evaluation.compute_mjo_scores("hours", obs, MJOConfig(wavenumber=(0, 3), frequency=(1 / 48, 1 / 4), deciding="view"), 24)
    loads = e.ceof_plots().toPandas()
    assert len(loads) == 2 * 2 * 3 * 8 and set(loads["variable"]) == {"click", "purchase", "view"}
    assert e.lead_lag_corr_plot().count() == 3 * 61
    corr = e.ceof_corr_table().where("row = 'obs'").toPandas()
    assert corr["value"].tolist() == pytest.approx([1] * 6) and set(corr["column"]) == {f"ceof_corr {v} {m}" for v in ("click", "purchase", "view") for m in (0, 1)}
    bias = e.ceof_bias_table().toPandas()
    assert len(bias) == 3 * 4 and set(bias["column"]) == {"explained_var_bias 0", "explained_var_bias 1", "max_corr_bias", "period_bias"}
    assert e.activity_per_phase_plots().count() == 2 * 3 * 8 and e.activity_per_phase_bias_tables().count() == 2 * 3 * 8
    power = e.power_spectrum_plots("view").toPandas()
    assert set(power["dataset"]) == {"obs", "sim"} and {"power", "kelvin", "ig1"} <= set(power["kind"])
    assert e.power_bias_table().count() == 2 * 3 * 3


def test_tc_tables(spark):
    e = ScientificEvaluation.compute_tc_scores(B.seasonal_tracks(spark, FOLDER), "control", {"control": 2.0, "model": 4.0}, TCConfig(bin=30.0))
    bias = e.clim_bias_table().toPandas().set_index(["row", "column"])["value"]
    clim = e.climatology.toPandas().set_index("dataset")
    for c in ("uclim_count", "uclim_tcd", "uclim_ace", "uclim_pace", "uclim_lmi"):
        assert bias["model", c] == pytest.approx(clim.loc["model", c] - clim.loc["control", c]) and bias["control", c] == pytest.approx(clim.loc["control", c])
    assert e.storm_bias_table().count() == 2 * 5
    assert e.temp_corr_table().count() == 2 * 5 and e.spatial_corr_table().count() == 2 * 7
    lines = e.linear_plots().toPandas()
    assert set(lines["cycle"]) == {"month", "year"} and (lines.query("cycle == 'month'").groupby("dataset").size() == 60).all()
    kinds = e.spatial_plots().toPandas()
    assert (kinds.query("kind == 'density'")["value"] != 0).all() and set(kinds.query("kind == 'bias'")["dataset"]) == {"model"}


def test_general_table(spark, evaluation):
    from pyspark.sql import functions as F

    cube = B.daily(spark, FOLDER, "A").withColumns({"variable": F.lit("rlut"), "realization": F.lit(1)})
    e = ScientificEvaluation([SimulationData(cube, "x")]).compute_general_scores("x", cube.drop("realization"), ["rlut"])
    rows = {(r["row"], r["column"]): r["value"] for r in e.scores_table().collect()}
    assert rows["simulation", "bias rlut"] == pytest.approx(0, abs=1e-9) and rows["simulation", "r rlut"] == pytest.approx(1)
    assert {v for (row, _), v in rows.items() if row == "reference"} == {1.0}


def test_most_intense_by_pressure(spark):
    rows = [("d", 1, 0, 5.0, 1.0, 20.0, 990.0), ("d", 1, 1, -9.0, 1.0, 30.0, 995.0), ("d", 1, 2, 7.0, 1.0, None, None)]
    p = spark.createDataFrame([(*r, 1, 2000) for r in rows], "dataset string, storm int, pt int, lat double, lon double, wind double, pres double, month int, year int")
    assert tracks.storm_stats(p).first()["lmi"] == 9.0 and tracks.storm_stats(p, by="pres").first()["lmi"] == 5.0


def test_model_years(spark):
    s = spark.createDataFrame([("a", 3, 10), ("b", 1, 40)], "name string, members int, years int")
    assert tracks.model_years(s) == {"a": 30.0, "b": 40.0} and tracks.model_years(s, 5) == {"a": 15.0, "b": 5.0}
