"""Plot-ready tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import effect_class
from ..operators.regrid import cyclic
from ..operators.stats import mean_interval


def time_series(series: DataFrame) -> DataFrame:
    """label, k, mean, bootstrap interval of the mean and 5 and 95 % quantiles over
    members."""
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.95)))
    stats = series.groupBy("label", "k").agg(F.avg("value").alias("mean"), q[0].alias("q05"), q[1].alias("q95"))
    return stats.join(mean_interval(series, ["label", "k"]), ["label", "k"])


def map_table(maps: DataFrame, significance: DataFrame | None = None) -> DataFrame:
    """lat, lon, value, significant, with the first longitude repeated at the end."""
    if significance is None:
        return cyclic(maps.withColumn("significant", F.lit(None).cast("int")))
    return cyclic(maps.join(significance.select("lat", "lon", "significant"), ["lat", "lon"], "left").select("lat", "lon", "value", "significant"))


def levels(maps: DataFrame, count: int = 13) -> list[float]:
    """Symmetric levels up to the largest absolute value."""
    most = maps.agg(F.max(F.abs("value"))).first()[0] or 0.0
    return [-most + 2 * most * k / (count - 1) for k in range(count)]


def matrix(effects: DataFrame, rejected: DataFrame) -> DataFrame:
    """(variable,) season, region, metric, size of the effect, its class and the
    verdict: any test rejects."""
    keys = [c for c in ("variable", "season", "region") if c in rejected.columns]
    verdict = rejected.groupBy(*keys).agg(F.bool_or("rejected").alias("verdict"))
    return effects.join(verdict, keys).select(*keys, "metric", F.abs("d").alias("effect"), effect_class("d").alias("class"), "verdict")


def score_table(rows: DataFrame, reference: str) -> DataFrame:
    """row, column, value and the column's limits: the largest absolute value of
    rows other than the reference."""
    most = rows.where(F.col("row") != reference).groupBy("column").agg(F.max(F.abs("value")).alias("hi"))
    return rows.join(most, "column", "left").select("row", "column", "value", (-F.col("hi")).alias("lo"), "hi")


def lines(table: DataFrame, x: str, values: list[str], by: str = "dataset") -> DataFrame:
    """Long rows for line, bar and dot charts: dataset, x, metric, value."""
    return table.unpivot([by, x], values, "metric", "value")


def spectrum(power: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """kind, wavenumber, frequency, value within the plot's frame, with the waves'
    curves."""
    frame = F.col("wavenumber").between(-15, 15) & F.col("frequency").between(0, 0.5)
    out = power.where(frame).select(F.lit("power").alias("kind"), F.col("wavenumber").cast("double").alias("wavenumber"), "frequency", F.col("power").alias("value"))
    if curves is None:
        return out
    return out.unionByName(curves.where(frame).select(F.col("wave").alias("kind"), "wavenumber", "frequency", F.col("depth").alias("value")))
