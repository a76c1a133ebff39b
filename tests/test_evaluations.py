"""Whole evaluations against plain versions in numpy and pandas."""

import numpy as np
import pandas as pd
import pytest

from isobar.operators import eof
from isobar.operators import windows as W
from isobar.plans import bindings as B
from isobar.plans import evaluations, more_queries
from isobar.plans.config import ISOConfig

from .conftest import DATA

FOLDER = f"{DATA}/sf0.001"


def grid(df):
    """steps x (lat, lon), as an array, with the steps' times and the latitudes."""
    p = df.toPandas()
    wide = p.pivot(index="k", columns=["lat", "lon"], values="value").sort_index().sort_index(axis=1)
    return wide.to_numpy(float), pd.to_datetime(p.drop_duplicates("k").set_index("k")["time"].sort_index()), np.array([c[0] for c in wide.columns])


def plain_modes(x, time, lat, season, years):
    months = {"winter": (12, 1, 2, 3, 4), "summer": (6, 7, 8, 9, 10)}[season]
    block = time.dt.year - (time.dt.month < months[0])
    rows = []
    for year in range(*years):
        at = np.flatnonzero((block == year).to_numpy() & time.dt.month.isin(months).to_numpy())
        rows += list(at) if len(at) >= 90 else []
    y = (x * np.sqrt(np.cos(np.radians(lat))))[rows]
    late = np.hstack([y[10 - 5 * c : len(y) - 5 * c] for c in range(3)])
    _, s, v = np.linalg.svd(late, full_matrices=False)
    return s[:2] ** 2 / (len(late) - 1), v[:2], (s[:2] ** 2 / (s**2).sum())


def test_iso(spark):
    h = W.lanczos(141, 1 / 90, 1 / 25)
    cubes = {"sim": B.daily(spark, FOLDER, "A"), "obs": B.daily(spark, FOLDER, "R")}
    got = evaluations.iso(cubes["sim"], cubes["obs"], ISOConfig(), (1995, 2001), correct=True)
    fields, raw, std = {}, {}, {}
    for name, cube in cubes.items():
        x, time, lat = grid(cube)
        fields[name] = np.stack([np.convolve(x[:, c], h, "same") for c in range(x.shape[1])], 1)
    for season in ("winter", "summer"):
        eig, v, share = plain_modes(fields["obs"], time, lat, season, (1995, 2001))
        table = got[f"modes_{season}"].orderBy("mode").toPandas()
        assert np.allclose(table["eigval"], eig) and np.allclose(table["var_frac"], share)
        for name, x in fields.items():
            y = x * np.cos(np.radians(lat))
            late = np.hstack([y[10 - 5 * c : len(y) - 5 * c] for c in range(3)])
            pcs = late @ v.T
            raw[name, season], std[name, season] = np.linalg.norm(pcs, axis=1), np.linalg.norm(pcs / np.sqrt(eig), axis=1)
            own = got[f"pcs_{name}"].where(f"season = '{season}'").toPandas().pivot(index="sample", columns="mode", values="raw").sort_index()
            assert np.allclose(np.abs(own.to_numpy()), np.abs(pcs)) and list(own.index) == list(range(10, len(x)))
    a = sum(raw["sim", s].mean() for s in ("winter", "summer")) / sum(raw["obs", s].mean() for s in ("winter", "summer"))
    assert got["alpha"].first()["alpha"] == pytest.approx(a)
    share = {}
    for name, by in (("sim", a), ("obs", 1.0)):
        r1, r2, s1, s2 = (x[name, s] / by for x in (raw, std) for s in ("winter", "summer"))
        label = np.where((r1 > r2) & (s1 >= 1), 1, np.where((r2 > r1) & (s2 >= 1), 2, 0))
        assert (got[f"labels_{name}"].orderBy("sample").toPandas()["label"].to_numpy() == label).all()
        month = time.dt.month.to_numpy()[10:]
        share[name] = np.array([(label[month == m] == 2).mean() - (label[month == m] == 1).mean() for m in range(1, 13)])
    r, s = np.corrcoef(share["sim"], share["obs"])[0, 1], share["sim"].std() / share["obs"].std()
    skill = got["skill"].first()
    assert [skill["r"], skill["sigma"], skill["tss"]] == pytest.approx([r, s, 4 * (1 + r) ** 4 / ((s + 1 / s) ** 2 * 16)])


def test_modes_of_more_features_than_samples(spark):
    """The block space ends at the decomposition's values: 10,800 features."""
    rng = np.random.default_rng(5)
    n, p = 40, 10_800
    x = rng.normal(size=(n, 6)) @ (rng.normal(size=(6, p)) * np.array([9, 6, 4, 3, 2, 1])[:, None]) + rng.normal(size=(n, p))
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "sample int, x array<double>")
    from pyspark.sql import functions as F

    modes, loads = eof.fit(rows.select("sample", F.posexplode("x").alias("feature", "value")), 2)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    table = modes.orderBy("mode").toPandas()
    assert np.allclose(table["eigval"], s[:2] ** 2 / (n - 1)) and np.allclose(table["var_frac"], (s**2 / (s**2).sum())[:2])
    own = loads.toPandas().pivot(index="mode", columns="feature", values="loading").to_numpy()
    assert np.allclose(np.abs((own * v[:2]).sum(1)), 1)


def test_no_complete_sample_gives_no_mode(spark):
    long = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "sample int, feature int, value double")
    modes, loads = eof.fit(long)
    assert modes.count() == 0 and loads.count() == 0


def test_mjo(spark):
    """Modes, sets and scores against a decomposition of the filtered fields."""
    from isobar.operators import spectrum

    got = {k: v.toPandas() for k, v in more_queries._mjo(spark, FOLDER).items() if k in ("ceof_scores", "ceof_corr", "pcs", "lead_lag", "scores", "activity", "power_scores", "power")}
    x, columns = {}, None
    for name, odd in (("obs", 0), ("sim", 1)):
        p = spectrum.prefilter(B.hourly_field(spark, FOLDER, odd), 24, 120).toPandas()
        wide = p.pivot(index="k", columns=["variable", "lon"], values="value").sort_index().sort_index(axis=1)
        x[name], columns = wide.to_numpy(float), wide.columns
    svd = {name: np.linalg.svd(v, full_matrices=False) for name, v in x.items()}
    sets = {"obs": ("obs", "obs"), "sim_on_obs": ("sim", "obs"), "sim_on_sim": ("sim", "sim")}
    scores = got["ceof_scores"].set_index(["dataset", "mode"])
    of = {v: columns.get_level_values("variable") == v for v in ("click", "purchase", "view")}
    r = np.corrcoef(svd["sim"][2][:2, of["view"]], svd["obs"][2][:2, of["view"]])[:2, 2:]  # one variable decides
    swap = abs(r[0, 1]) + abs(r[1, 0]) > abs(r[0, 0]) + abs(r[1, 1])
    order = {"obs": [0, 1], "sim": [1, 0] if swap else [0, 1]}
    for name, (data, modes) in sets.items():
        s, v = svd[modes][1], svd[modes][2]
        share = (100 * s**2 / (s**2).sum())[order[modes]]
        assert np.allclose(scores.loc[name]["explained_var"].sort_index(), share)
        own = got["pcs"].query("dataset == @name").pivot(index="sample", columns="mode", values="std").sort_index().to_numpy()
        plain = (x[data] @ v[order[modes]].T) / np.sqrt(s[order[modes]] ** 2 / (len(x[modes]) - 1))
        assert np.allclose(np.abs(own), np.abs(plain))
        corr = got["ceof_corr"].query("dataset == @name").set_index(["variable", "mode"])["ceof_corr"]
        for variable, at in of.items():
            for m in (0, 1):
                plain = np.corrcoef(v[order[modes]][m, at], svd["obs"][2][m, at])[0, 1]
                assert abs(corr[variable, m]) == pytest.approx(abs(plain))
                assert variable != "view" or corr[variable, m] >= 0
        curve = got["lead_lag"].query("dataset == @name").set_index("lag")["r"]
        for lag in (-30, -7, 0, 12):
            a, b = (own[: len(own) - lag, 0], own[lag:, 1]) if lag >= 0 else (own[-lag:, 0], own[:lag, 1])
            assert curve[lag] == pytest.approx(np.corrcoef(a, b)[0, 1])
        days = got["activity"].query("dataset == @name")
        assert days["days"].sum() == len(own)
        level = np.hypot(own[:, 0], own[:, 1])
        assert days["active_days"].sum() == (level > level.mean()).sum()
    ps = got["power_scores"].set_index(["dataset", "variable"]).sort_index()
    assert np.allclose(ps.loc["obs"]["eo_ratio"], 1) and np.allclose(ps.loc["sim"]["eo_ratio_bias"], ps.loc["sim"]["eo_ratio"] - 1)
    assert np.allclose(ps.loc["sim"]["ew_ratio_bias"], ps.loc["sim"]["ew_ratio"] - ps.loc["obs"]["ew_ratio"])


def test_tc_correlations(spark):
    got = {k: v.toPandas() for k, v in more_queries._tc(spark, FOLDER).items() if k.endswith("correlation") or k in ("monthly", "maps", "map_bias")}
    both = got["monthly"].pivot(index="month", columns="dataset")
    temporal = got["temporal_correlation"].set_index(["dataset", "metric"])
    for metric in evaluations.METRICS:
        pair = both[metric].dropna()
        assert temporal.loc[("model", metric), "pearson"] == pytest.approx(pair["model"].corr(pair["control"]))
        assert temporal.loc[("model", metric), "spearman"] == pytest.approx(pair["model"].rank().corr(pair["control"].rank()))
        assert temporal.loc[("control", metric), "pearson"] == pytest.approx(1)
    spatial = got["spatial_correlation"].set_index(["dataset", "metric"])["value"]
    for metric in evaluations.MAPS:
        wide = got["maps"].pivot(index=["i", "j"], columns="dataset", values=metric)
        full = wide.reindex(pd.MultiIndex.from_product([range(7), range(12)], names=["i", "j"])).fillna(0.0)
        w = np.cos(np.radians(full.index.get_level_values("i").to_numpy() * 30.0 - 90))
        x, y = full["model"].to_numpy(float), full["control"].to_numpy(float)
        x, y = x - np.average(x, weights=w), y - np.average(y, weights=w)
        assert spatial["model", metric] == pytest.approx((w * x * y).sum() / np.sqrt((w * x * x).sum() * (w * y * y).sum()))


def test_modes_that_do_not_settle_are_an_error(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, rng.normal(size=600).tolist()) for i in range(500)], "sample int, x array<double>")
    monkeypatch.setattr(eof, "BLOCKS", 3)
    with pytest.raises(eof.NotConverged, match="residual"):
        eof.fit(rows.select("sample", F.posexplode("x").alias("feature", "value")), 2)
    monkeypatch.setattr(eof, "BLOCKS", 60)
    assert eof.fit(rows.where("sample < 8").select("sample", F.posexplode("x").alias("feature", "value")), 2)[0].count() == 2
