"""Values of queries that SQL can't express, against plain versions in numpy."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.functions import special
from isobar.operators import spectrum, stats
from isobar.plans.more_queries import QUERIES, _dense

from .conftest import DATA

FOLDER = f"{DATA}/sf0.001"


def rows(spark, name):
    return QUERIES[name](spark, FOLDER).toPandas()


def embedded(spark):
    p = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toPandas()
    return p["vec_id"].to_numpy(), np.array(p["embedding"].tolist(), float)


def test_modes(spark):
    ids, x = embedded(spark)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    top = rows(spark, "srt4_top_modes").sort_values("mode")
    assert np.allclose(top["eigval"], s[:2] ** 2 / (len(x) - 1), atol=1e-5)
    fit = rows(spark, "eof4_fit").sort_values("mode")
    assert np.allclose(fit["var_frac"], (s**2 / (s**2).sum())[:3], atol=1e-5)
    shown = rows(spark, "eof14_scaled_loadings").pivot(index="mode", columns="feature", values="loading").to_numpy()
    assert np.allclose(np.abs(shown), np.abs(v[:2] * s[:2, None] / math.sqrt(len(x) - 1)), atol=1e-4)


def test_projection_on_other_samples(spark):
    ids, x = embedded(spark)
    even = x[ids % 2 == 0]
    _, s, v = np.linalg.svd(even, full_matrices=False)
    own = rows(spark, "eof8_projection_on_observed").pivot(index="sample", columns="mode", values="std").sort_index()
    plain = x[ids % 2 == 1] @ v[:2].T / (s[:2] / math.sqrt(len(even) - 1))
    assert list(own.index) == list(ids[ids % 2 == 1]) and np.allclose(np.abs(own.to_numpy()), np.abs(plain), atol=1e-4)


def test_matched_modes(spark):
    ids, x = embedded(spark)
    v = [np.linalg.svd(x[ids % 2 == k], full_matrices=False)[2][:2] for k in (0, 1)]
    r = np.array([[np.corrcoef(a, b)[0, 1] for b in v[1]] for a in v[0]])
    if abs(r[0, 1]) + abs(r[1, 0]) > abs(r[0, 0]) + abs(r[1, 1]):
        r = r[::-1]
    own = rows(spark, "eof9_10_matched_modes").pivot(index="mode_a", columns="mode_b", values="r").to_numpy()
    assert np.allclose(np.abs(own), np.abs(r), atol=1e-4) and (np.diag(own) >= 0).all()


def field(spark, filtered):
    p = _dense(spark, FOLDER).toPandas()
    x = p.pivot(index="k", columns=["lat", "lon"], values="value").sort_index().sort_index(axis=1).to_numpy(float).reshape(-1, 2, 8)
    if filtered:
        t = np.arange(len(x)) - (len(x) - 1) / 2
        x = x - np.einsum("t,ab->tab", t, np.einsum("t,tab->ab", t, x) / (t @ t))
        z = np.fft.rfft(x, axis=0)
        f = np.fft.rfftfreq(len(x))
        z[(f > 0) & (f < 1 / 96)] = 0
        x = np.fft.irfft(z, len(x), axis=0)
    south, north = x[:, 0], x[:, 1]
    return {"symmetric": (south + north) / 2, "antisymmetric": (north - south) / 2}


def plain_power(x):
    """wavenumber, frequency (of 96) to power of one latitude's series."""
    total, n = 0.0, 0
    bell = np.ones(96)
    bell[:6], bell[-4:] = np.hanning(10)[:6], np.hanning(10)[6:]
    t = np.arange(96) - 47.5
    for start in range(0, len(x) - 95, 36):
        s = x[start : start + 96]
        s = s - s.mean(0) - np.outer(t, t @ s / (t @ t))
        z = np.fft.fft2(s * bell[:, None]) / (96 * 8)
        total, n = total + np.abs(z) ** 2, n + 1
    power = 2 * total / n
    return {(k, f): power[-f % 96, k % 8] for k in range(-4, 5) for f in range(-48, 49)}


def test_power(spark):
    own = rows(spark, "spe6_spacetime_power")
    for part, x in field(spark, True).items():
        plain = plain_power(x)
        mine = own[own["component"] == part]
        assert len(mine) == len(plain)
        assert np.allclose(mine["power"], [plain[k, round(f * 96)] for k, f in zip(mine["wavenumber"], mine["frequency"], strict=True)], rtol=1e-4, atol=1e-5)


def test_background(spark):
    """The smoothed mean of both components, and what is left over it."""
    powers = {part: plain_power(x) for part, x in field(spark, False).items()}
    ks, fs = list(range(-4, 5)), list(range(49))
    grid = np.array([[(powers["symmetric"][k, f] + powers["antisymmetric"][k, f]) / 2 for k in ks] for f in fs])

    def smooth(x, passes):
        for _ in range(passes):
            p = np.vstack([x[:1], x, x[-1:]])
            x = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
        return x

    grid = smooth(grid, 10)
    for i in range(4):
        part = slice(i * 12, (i + 1) * 12 if i < 3 else None)
        grid[part] = smooth(grid[part].T, 10 * (i + 1)).T
    own = rows(spark, "spe7_normalised")
    for part in powers:
        mine = own[(own["component"] == part) & (own["frequency"] > 0)]
        plain = [powers[part][k, round(f * 96)] / grid[round(f * 96), ks.index(k)] for k, f in zip(mine["wavenumber"], mine["frequency"], strict=True)]
        assert len(mine) == 9 * 48 and np.allclose(mine["power"], plain, rtol=1e-3, atol=1e-4)
    assert own[own["frequency"] == 0]["power"].isna().all()


def test_taper_of_other_lengths():
    assert [int((spectrum.taper(n) < 1).sum()) for n in (64, 96)] == [len([w for w in np.hanning(round(n / 10)) if w < 1]) for n in (64, 96)]


def test_p_values_by_enumeration():
    """All ways to deal seven different values to two sides."""
    x = np.arange(7.0)

    def measures(a):
        b = np.setdiff1d(x, a)
        return max(abs((a <= v).mean() - (b <= v).mean()) for v in x), sum((p > q) for p in a for q in b)

    every = [measures(np.array(a)) for a in combinations(x, 3)]
    for d, u in every[::5]:
        assert special.ks_two_sided(d, 3, 4) == pytest.approx(np.mean([e[0] >= d - 1e-9 for e in every]))
        low = min(u, 12 - u)
        assert special.mann_whitney_two_sided(u, 3, 4) == pytest.approx(min(1, 2 * np.mean([e[1] <= low for e in every])))
    t, df = np.array([0.0, 0.4, -2.5, 7.0, np.nan]), np.array([3.0, 8.5, 30.0, 4.0, 2.0])
    for p, a, b in zip(special.t_two_sided(t, df)[:4], t, df, strict=False):
        grid = np.tan(np.linspace(math.atan(abs(a)), math.pi / 2, 400_001)[:-1])
        density = np.exp(math.lgamma((b + 1) / 2) - math.lgamma(b / 2)) / math.sqrt(b * math.pi) * (1 + grid * grid / b) ** (-(b + 1) / 2)
        assert p == pytest.approx(2 * np.trapezoid(density, grid), abs=1e-4)
    assert np.isnan(special.t_two_sided(t, df)[4])


def samples(spark, n=9, shift=0.7):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=n) + shift, rng.normal(size=n)
    made = spark.createDataFrame([("k", "test", float(v)) for v in x] + [("k", "ref", float(v)) for v in y], "key string, side string, value double")
    return x, y, made


def test_bootstraps_lie_near_what_they_estimate(spark):
    """Means of resamples, within a few of their own standard errors of a plain resampling."""
    x, y, made = samples(spark)
    rng = np.random.default_rng(99)
    a, b = rng.choice(x, (40_000, len(x))), rng.choice(y, (40_000, len(y)))
    plain = (a.mean(1) - b.mean(1)) / np.sqrt((a.var(1) + b.var(1)) / 2)
    got = stats.cohen_bootstrap(made, ["key"], 10_000).first()["d"]
    assert got == pytest.approx(plain.mean(), abs=5 * plain.std() / 100)
    test = stats.bootstrap_test(made, ["key"]).first()
    assert test["d"] == pytest.approx(plain.mean(), abs=5 * plain.std() / 100) and test["sigma"] == pytest.approx(plain.std(), rel=0.05)
    assert test["p"] == pytest.approx(math.erfc(abs(test["d"] / test["sigma"]) / math.sqrt(2)))
    mean = stats.bootstrap_test(made, ["key"], stats.mean_differences).first()
    assert mean["d"] == pytest.approx(x.mean() - y.mean(), abs=0.03)
    ends = stats.mean_interval(made.where("side = 'test'"), ["key"], 5000).first()
    assert [ends["lo"], ends["hi"]] == pytest.approx(np.percentile(a.mean(1), [2.5, 97.5]), abs=0.05)


def test_rejections_of_all_tests(spark):
    _, _, near = samples(spark, shift=0.0)
    _, _, far = samples(spark, shift=9.0)
    both = near.withColumn("key", F.lit("near")).union(far.withColumn("key", F.lit("far")))
    got = {(r["key"], r["test"]): r["rejected"] for r in stats.rejections(stats.all_tests(both, ["key"]), ["key"]).collect()}
    assert len(got) == 8 and all(v == (k[0] == "far") for k, v in got.items())


def test_matrix_keeps_variables_apart(spark):
    from isobar.plans import plots

    effects = spark.createDataFrame([("u", "DJF", "Globe", "RK08", 0.1), ("v", "DJF", "Globe", "RK08", 2.0)], "variable string, season string, region string, metric string, d double")
    rejected = spark.createDataFrame([("u", "DJF", "Globe", "T-test", False), ("v", "DJF", "Globe", "T-test", True)], "variable string, season string, region string, test string, rejected boolean")
    assert {r["variable"]: r["verdict"] for r in plots.matrix(effects, rejected).collect()} == {"u": False, "v": True}
