"""Evaluations from prepared observations are those from the field."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import validate
from isobar.plans import bindings as B
from isobar.plans import evaluations, prepared
from isobar.plans.config import ISOConfig

from .conftest import DATA

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('prepared')}/iso"
    prepared.prepare_iso(B.daily(spark, FOLDER, "R"), path, (1995, 2001))
    return path


def test_as_from_the_field(spark, saved):
    sim, obs = B.daily(spark, FOLDER, "A"), B.daily(spark, FOLDER, "R")
    years = (1996, 1999)
    a = evaluations.iso(sim, obs, ISOConfig(), (1995, 2001), True, years)
    b = evaluations.iso(sim, prepared.load_iso(spark, saved, ISOConfig()), correct=True, component_years=years)
    for name, key, value in (("alpha", [], "alpha"), ("freq_sim", ["month"], "f1"), ("freq_obs", ["month"], "f2")):
        x, y = (t[name].toPandas().sort_values(key)[value] if key else t[name].toPandas()[value] for t in (a, b))
        assert len(x) == len(y) > 0 and np.allclose(x, y)
    ends = b["labels_obs"].agg(F.min(F.year("time")), F.max(F.year("time"))).first()
    assert tuple(ends) == years


def test_what_is_refused(spark, saved, tmp_path):
    with pytest.raises(validate.InvalidData, match="other lag"):
        prepared.load_iso(spark, saved, ISOConfig(lag=4))
    with pytest.raises(validate.InvalidData, match="not a prepared"):
        prepared.load_iso(spark, f"{tmp_path}/none")
    ready = prepared.load_iso(spark, saved)
    small = B.daily(spark, FOLDER, "A").where("lat < 10")
    with pytest.raises(validate.InvalidData, match="does not cover"):
        ready.on_grid(small)


def test_boundaries_ask_for_a_check(spark):
    cube = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "variable string, value double")
    rows = [("a", True, None), ("b", True, "strict"), ("c", False, "strict")]
    catalog = spark.createDataFrame(rows, "variable string, check_enabled boolean, boundaries string").withColumns({x: F.lit(None).cast("double") for x in ("min", "max")})
    found = {(r["subject"], r["severity"]) for r in validate.plausible(cube, catalog).collect()}
    assert found == {("b", "error"), ("c", "warning")}
