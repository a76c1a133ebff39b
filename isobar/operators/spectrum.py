"""Wavenumber-frequency spectra of daily (or other dense) cubes: k, lat, lon, value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from .windows import detrend, segments


def symmetric(cube: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of the field that are symmetric (kept south) and antisymmetric (kept
    north) about the equator, which stays as it is."""
    other = cube.select(*keys, "lon", (-F.col("lat")).alias("lat"), F.col("value").alias("_v"))
    both = cube.join(other, [*keys, "lat", "lon"])
    value = F.when(F.col("lat") < 0, (F.col("value") + F.col("_v")) / 2).when(F.col("lat") > 0, (F.col("value") - F.col("_v")) / 2).otherwise(F.col("value"))
    return both.withColumn("value", value).drop("_v")


def component():
    return F.when(F.col("lat") <= 0, "symmetric").otherwise("antisymmetric")


def taper(n: int = 96, share: float = 0.1) -> np.ndarray:
    """Split cosine bell: Hann weights of a tenth of the points at the ends."""
    m = round(n * share)
    bell = np.hanning(m)
    out = np.ones(n)
    head = m // 2 + 1
    out[:head] = bell[:head]
    out[n - (m - head) :] = bell[head:]
    return out


def low_frequency_filter(cube: DataFrame, keys: list[str], longest: int = 96) -> DataFrame:
    """Each key's series without periods beyond ``longest`` steps; the mean stays.
    A series is one cell's steps, which fit in a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        z = np.fft.rfft(pdf["value"].to_numpy(float))
        f = np.fft.rfftfreq(len(pdf))
        z[(f > 0) & (f < 1 / longest)] = 0
        return pdf.assign(value=np.fft.irfft(z, len(pdf)))

    return cube.groupBy(*keys).applyInPandas(one, cube.schema)


def bandpass(cube: DataFrame, keys: list[str], weights: list[float]) -> DataFrame:
    """Centred convolution of each key's dense series, zeros outside: one pass for
    long kernels, where the join form would copy every row for every tap."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        half = len(weights) // 2
        full = np.convolve(pdf["value"].to_numpy(float), weights)
        return pdf.assign(value=full[half : half + len(pdf)])

    return cube.groupBy(*keys).applyInPandas(one, cube.schema)


def segment_power(cube: DataFrame, keys: list[str], size: int = 96, overlap: int = 60) -> DataFrame:
    """keys, component, wavenumber, frequency, power: detrended, tapered segments'
    squared transforms, east and west resolved, averaged over segments, doubled,
    and summed over a hemisphere's latitudes.  A group is a segment of a latitude."""
    cut = segments(cube, size, overlap)
    bell = taper(size)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="k", columns="lon", values="value").sort_index()
        x = grid.to_numpy(float)
        n, m = x.shape
        if n != size or np.isnan(x).any():
            return pd.DataFrame(columns=[*names, "wavenumber", "frequency", "power"])
        t = np.arange(n) - (n - 1) / 2
        x = x - x.mean(0) - np.outer(t, t @ x / (t @ t))
        z = np.fft.fft2(x * bell[:, None]) / (n * m)
        k, f = np.meshgrid(np.arange(-(m // 2), m // 2 + 1), np.arange(-(n // 2), n // 2 + 1), indexing="ij")
        power = np.abs(z[-f % n, k % m]) ** 2
        out = pd.DataFrame({"wavenumber": k.ravel(), "frequency": f.ravel() / n, "power": power.ravel()})
        for name, v in zip(names, key, strict=True):
            out.insert(0, name, v)
        return out[[*names, "wavenumber", "frequency", "power"]]

    names = [*keys, "lat", "segment"]
    kinds = dict(cut.dtypes)
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "wavenumber int, frequency double, power double"])
    each = cut.groupBy(*names).applyInPandas(one, schema)
    mean = each.groupBy(*keys, "lat", "wavenumber", "frequency").agg((2 * F.avg("power")).alias("power"))
    return mean.groupBy(*keys, component().alias("component"), "wavenumber", "frequency").agg(F.sum("power").alias("power"))


def latitude_aggregate(power: DataFrame, keys: list[str], how: str = "sum") -> DataFrame:
    if how not in ("sum", "mean"):
        raise ValueError("how is sum or mean")
    return power.groupBy(*keys, "wavenumber", "frequency").agg((F.sum if how == "sum" else F.avg)("power").alias("power"))


def background(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """The mean of the components, smoothed: ten passes along frequency, then ten to
    forty along wavenumber, more in each quarter of the frequencies.  A group is one
    spectrum."""

    def smooth(x: np.ndarray, passes: int) -> np.ndarray:
        for _ in range(passes):
            p = np.pad(x, ((1, 1), (0, 0)), mode="edge")
            x = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
        return x

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot(index="frequency", columns="wavenumber", values="power").sort_index()
        x = smooth(grid.to_numpy(float), 10)
        quarter = max(len(x) // 4, 1)
        for i in range(4):
            rows = slice(i * quarter, (i + 1) * quarter if i < 3 else len(x))
            x[rows] = smooth(x[rows].T, 10 * (i + 1)).T
        out = pd.DataFrame(x, grid.index, grid.columns).stack().rename("background").reset_index()
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[[*keys, "wavenumber", "frequency", "background"]]

    kinds = dict(spectrum.dtypes)
    mean = spectrum.where("frequency >= 0").groupBy(*keys, "wavenumber", "frequency").agg(F.avg("power").alias("power"))
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "wavenumber int, frequency double, background double"])
    if keys:
        return mean.groupBy(*keys).applyInPandas(one, schema)
    return mean.groupBy(F.lit("all")).applyInPandas(one, schema)


def normalised(spectrum: DataFrame, keys: list[str]) -> DataFrame:
    """Power over the background; at frequency zero it is missing."""
    on = spectrum.where("frequency >= 0").join(background(spectrum, keys), [*keys, "wavenumber", "frequency"])
    return on.withColumn("power", F.when(F.col("frequency") != 0, ratio("power", "background"))).drop("background")


def box(frequency: tuple[float, float] = (1 / 80, 1 / 30), wavenumber: tuple[float, float] = (0, 4)):
    return F.col("frequency").between(*frequency) & F.col("wavenumber").between(*wavenumber)


def band_power(spectrum: DataFrame, keys: list[str], **edges) -> DataFrame:
    return spectrum.where(box(**edges)).groupBy(*keys).agg(F.sum("power").alias("power"))


def east_west(spectrum: DataFrame, keys: list[str], frequency: tuple[float, float] = (1 / 80, 1 / 30), wavenumber: tuple[float, float] = (0, 4)) -> DataFrame:
    """Eastward power over that of the mirrored westward box; null where that is
    zero."""
    a, b = wavenumber
    of = lambda lo, hi: F.sum(F.when(F.col("frequency").between(*frequency) & F.col("wavenumber").between(lo, hi), F.col("power")))
    return spectrum.groupBy(*keys).agg(ratio(of(a, b), of(-b, -a)).alias("ratio"))


def period(spectrum: DataFrame, keys: list[str], **edges) -> DataFrame:
    """Power-weighted mean period in the box, whose frequencies are not zero."""
    return spectrum.where(box(**edges)).groupBy(*keys).agg(ratio(F.sum(ratio("power", "frequency")), F.sum("power")).alias("period"))


def prefilter(cube: DataFrame, cycle: int = 365, rolling: int = 120, keys: tuple[str, ...] = ("variable", "lat", "lon")) -> DataFrame:
    """Anomalies from the seasonal cycle's harmonics and from the trailing mean,
    averaged over latitude with weights, over the spread: variable, k, lon, value."""
    from ..functions.expr import weight, weighted_mean
    from .windows import harmonics, rolling_anomaly

    ks = list(keys)
    a = rolling_anomaly(harmonics(cube, ks, cycle), ks, rolling)
    mean = a.groupBy("variable", "k", "lon").agg(weighted_mean("value", weight()).alias("value"))
    spread = mean.groupBy("variable", "lon").agg(F.stddev_pop("value").alias("s")).groupBy("variable").agg(F.avg("s").alias("s"))
    return mean.join(F.broadcast(spread), "variable").select("variable", "k", "lon", ratio("value", "s").alias("value"))


__all__ = ["symmetric", "taper", "low_frequency_filter", "bandpass", "segment_power", "latitude_aggregate", "background", "normalised", "band_power", "east_west", "period", "prefilter", "detrend"]
