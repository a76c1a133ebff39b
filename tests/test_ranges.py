"""One series without keys against the same under one key, and by plain sorting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isobar.operators import ranges, stats, windows


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(8)
    k = rng.permutation(5000)
    value = np.where(rng.random(5000) < 0.3, 7.0, np.round(rng.normal(size=5000), 2))  # a third of all values are one
    frame = pd.DataFrame({"k": k, "value": value, "side": np.where(rng.random(5000) < 0.4, "test", "ref")})
    return spark.createDataFrame(frame).withColumn("value", F.when(F.col("k") % 97 != 0, F.col("value"))).repartition(4).cache()


def rows(df, *columns):
    return sorted(map(repr, (tuple(None if x is None else round(x, 9) for x in r) for r in df.select(*columns).collect())))


def test_running_sums(series):
    made, total = ranges.running(series.select("k", F.coalesce("value", F.lit(0.0)).alias("value")), "k", ["value"])
    got = made.toPandas().sort_values("k")
    assert np.allclose(got["value_run"], got["value"].cumsum()) and total["value"] == pytest.approx(got["value"].sum())
    numbers, n = ranges.numbered(series, "k")
    assert n == 5000 and numbers.where("_n <> k + 1").count() == 0


def test_ranks(series):
    got = ranges.average_ranks(series, "value").toPandas().set_index("value")["rank"]
    plain = series.toPandas()["value"].dropna()
    assert all(got[v] == r for v, r in zip(plain, plain.rank(), strict=True))


@pytest.mark.parametrize("stretch", [50, 1000])
def test_rolling_over_seams(series, stretch, monkeypatch):
    monkeypatch.setattr(ranges, "STRETCH", stretch)
    whole = series.withColumn("value", F.coalesce("value", F.lit(1.0))).where("k % 1000 <> 500").withColumn("key", F.lit(1))
    for size in (3, 120):
        assert rows(windows.rolling_anomaly(whole.drop("key"), [], size), "k", "value") == rows(windows.rolling_anomaly(whole, ["key"], size), "k", "value")
    assert rows(windows.rolling_anomaly(series, [], 30), "k", "value") == rows(windows.rolling_anomaly(series.withColumn("key", F.lit(1)), ["key"], 30), "k", "value")


@pytest.mark.parametrize("keep", [True, False])
def test_trend(series, keep):
    assert rows(windows.detrend(series, [], keep), "k", "value") == rows(windows.detrend(series.withColumn("key", F.lit(1)), ["key"], keep), "k", "value")


def test_statistics(series, spark):
    keyed = series.withColumn("key", F.lit(1))
    for test, columns in ((stats.ks, ("d", "n", "m")), (stats.mann_whitney, ("u", "n", "m", "ties"))):
        assert rows(test(series, []), *columns) == rows(test(keyed, ["key"]), *columns)
        assert test(series.limit(0), []).first() is not None
    pairs = series.select((F.col("k") % 50).alias("x"), F.col("value").alias("y"))
    plain = pairs.toPandas().dropna()
    assert windows.spearman(pairs, []).first()["value"] == pytest.approx(plain["x"].rank().corr(plain["y"].rank()))
    assert windows.detrend(series.limit(0), []).count() == 0 and windows.rolling_anomaly(series.limit(0), [], 3).count() == 0


def test_no_window_has_one_task(series):
    """Every exchange that a window asks for is by range or stretch."""
    for df in (windows.rolling_anomaly(series, [], 120), windows.spearman(series.select(F.col("k").alias("x"), F.col("value").alias("y")), []), stats.ks(series, [])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_range" in plan or "hashpartitioning(_stretch" in plan
        assert "Window" in plan and "hashpartitioning(0" not in plan
