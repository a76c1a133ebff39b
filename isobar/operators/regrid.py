"""Regridding between regular grids by a sparse table of weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def axis_weights(source: DataFrame, target: DataFrame, axis: str) -> DataFrame:
    """target, source, weight along one axis: two neighbours, or one that coincides.
    Targets beyond the source's ends have no row.  An axis has a few thousand
    points at most; pairs meet by the source interval that holds the target."""
    src = source.select(axis).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(axis)
    steps = src.select(F.col(axis).alias("lo"), F.coalesce(F.lead(axis).over(w), F.col(axis)).alias("hi"), F.row_number().over(w).alias("n"))
    # The interval of a target is the last source point not beyond it.
    both = steps.select(F.col("lo").alias("x"), "lo", "hi").unionByName(target.select(F.col(axis).alias("x")).distinct().withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")}))
    run = Window.partitionBy(F.lit(0)).orderBy("x", F.col("lo").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumns({"a": F.last("lo", True).over(run), "b": F.last("hi", True).over(run)}).where("lo IS NULL AND a IS NOT NULL AND x <= b")
    share = F.when(F.col("b") > F.col("a"), (F.col("x") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))).otherwise(F.lit(0.0))
    pairs = F.explode(F.array(F.struct(F.col("a").alias("s"), (1 - share).alias("w")), F.struct(F.col("b").alias("s"), share.alias("w"))))
    out = placed.select("x", pairs.alias("p")).select(F.col("x").alias(f"to_{axis}"), F.col("p.s").alias(axis), F.col("p.w").alias(f"w_{axis}"))
    return out.where(F.col(f"w_{axis}") > 0)


def bilinear(cube: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The cube on the target's grid (columns lat, lon).  The weights are made once
    and serve all keys; a missing contributor makes the result missing, and targets
    outside the source's hull have no row."""
    lat, lon = axis_weights(cube, target, "lat"), axis_weights(cube, target, "lon")
    weighted = cube.join(F.broadcast(lat), "lat").join(F.broadcast(lon), "lon")
    w = F.col("w_lat") * F.col("w_lon")
    sums = weighted.groupBy(*keys, "to_lat", "to_lon").agg(F.sum(w * F.col("value")).alias("v"), F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"), F.count("value").alias("m"))
    # All of a target's neighbours have to be there and valid.
    value = F.when((F.col("n") == F.col("m")) & (F.col("w") > 1 - 1e-9), F.col("v"))
    return sums.select(*keys, F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon"), value.alias("value"))


def cyclic(maps: DataFrame) -> DataFrame:
    """Maps with their first longitude once more, 360 degrees on."""
    first = maps.agg(F.min("lon").alias("lon"))
    again = maps.join(F.broadcast(first), "lon", "left_semi").withColumn("lon", F.col("lon") + 360)
    return maps.unionByName(again)


def spacing(cube: DataFrame, axis: str) -> float | None:
    """Least distance of neighbouring coordinates."""
    w = Window.partitionBy(F.lit(0)).orderBy(axis)
    return cube.select(axis).distinct().select((F.col(axis) - F.lag(axis).over(w)).alias("d")).agg(F.min("d")).first()[0]


def to_coarser(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both cubes on the coarser one's grid."""
    grid = lambda x: x.select("lat", "lon").distinct()
    if (spacing(a, "lat") or 0) < (spacing(b, "lat") or 0):
        return bilinear(a, grid(b), keys), b
    return a, bilinear(b, grid(a), [k for k in keys if k in b.columns])
