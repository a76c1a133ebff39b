"""Checks of cubes.  Each gives violation rows (check, subject, severity, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class InvalidData(ValueError):
    """A cube that can't be used."""


def _rows(df: DataFrame, check: str, subject: Column, severity: str, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), subject.cast("string").alias("subject"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def required_columns(cube: DataFrame) -> None:
    missing = [c for c in ("time", "lat", "lon") if c not in cube.columns]
    if missing:
        raise InvalidData(f"missing coordinates: {', '.join(missing)}")


def monotone(coordinates: DataFrame, axis: str, index: str) -> DataFrame:
    """A coordinate by its index has to rise or fall throughout."""
    w = Window.partitionBy(F.lit(0)).orderBy(index)
    d = coordinates.select((F.col(axis) - F.lag(axis).over(w)).alias("d")).agg(F.bool_and(F.col("d") > 0).alias("up"), F.bool_and(F.col("d") < 0).alias("down"))
    bad = d.where(~(F.coalesce("up", F.lit(True)) | F.coalesce("down", F.lit(True))))
    return _rows(bad, "monotone", F.lit(axis), "error", F.lit("not strictly monotone"))


def normal_time(cube: DataFrame, key: str = "variable") -> DataFrame:
    """Stamps whole days apart are moved to midnight."""
    w = Window.partitionBy(key).orderBy("time")
    minutes = F.expr("timestampdiff(MINUTE, _prev, time)")
    steps = cube.select(key, "time").distinct().withColumn("_prev", F.lag("time").over(w))
    daily = steps.groupBy(key).agg(F.coalesce(F.bool_and(minutes % 1440 == 0), F.lit(False)).alias("_daily"))
    return cube.join(F.broadcast(daily), key).withColumn("time", F.when(F.col("_daily"), F.col("time").cast("date").cast("timestamp_ntz")).otherwise(F.col("time"))).drop("_daily")


def catalogued(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """found: variable, units, long_name.  Unknown variables and other units are
    errors; other long names are repaired."""
    unknown = found.join(catalog, "variable", "left_anti")
    both = found.alias("f").join(catalog.alias("c"), "variable")
    units = both.where(~F.col("f.units").eqNullSafe(F.col("c.units")))
    names = both.where(~F.col("f.long_name").eqNullSafe(F.col("c.long_name")))
    return (
        _rows(unknown, "catalog", F.col("variable"), "error", F.lit("unknown variable"))
        .union(_rows(units, "units", F.col("variable"), "error", F.col("f.units")))
        .union(_rows(names, "long_name", F.col("variable"), "warning", F.col("c.long_name")))
    )


def complete(cube: DataFrame, catalog: DataFrame) -> DataFrame:
    """All missing is fatal; atmospheric variables miss nothing, ocean ones something."""
    n = cube.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("v")).join(catalog.select("variable", "mask"), "variable", "left")
    said = (
        F.when(F.col("v") == 0, "all values are missing").when((F.col("mask") == "atm") & (F.col("v") < F.col("n")), "missing values")
        .when((F.col("mask") == "oce") & (F.col("v") == F.col("n")), "no missing values")
        .when(~F.coalesce(F.col("mask").isin("atm", "oce"), F.lit(False)), "unknown mask")
    )
    return _rows(n.withColumn("said", said).where("said IS NOT NULL"), "spatial", F.col("variable"), "error", F.col("said"))


def gaps(stamps: DataFrame, k: str = "k") -> DataFrame:
    """Steps missing from the regular range, whose step is the first difference."""
    w = Window.partitionBy(F.lit(0)).orderBy(k)
    s = stamps.select(k).distinct()
    e = s.withColumns({"_d": F.col(k) - F.lag(k).over(w), "_n": F.row_number().over(w)}).agg(F.min(k).alias("a"), F.max(k).alias("b"), F.max(F.when(F.col("_n") == 2, F.col("_d"))).alias("d"))
    every = e.where("d IS NOT NULL").select(F.explode(F.sequence("a", "b", "d")).alias(k))
    return _rows(every.join(s, k, "left_anti"), "temporal", F.col(k), "error", F.lit("missing step"))


def plausible(cube: DataFrame, catalog: DataFrame) -> DataFrame:
    """Values beyond the catalogue's bounds; without bounds checked, a warning.  Boundaries
    that aren't null ask for a check that there isn't, which is an error."""
    m = cube.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).join(catalog, "variable")
    low, high = m.where("check_enabled AND lo < min"), m.where("check_enabled AND hi > max")
    asked = m.where("check_enabled AND boundaries IS NOT NULL") if "boundaries" in catalog.columns else m.limit(0)
    return (
        _rows(low, "plausibility", F.col("variable"), "error", F.concat(F.lit("below "), F.col("min")))
        .union(_rows(high, "plausibility", F.col("variable"), "error", F.concat(F.lit("above "), F.col("max"))))
        .union(_rows(m.where("NOT check_enabled"), "plausibility", F.col("variable"), "warning", F.lit("not checked")))
        .union(_rows(asked, "plausibility", F.col("variable"), "error", F.lit("boundaries are not checked")))
    )


def same_grid(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Combinations of columns that only one cube has."""
    x, y = a.select(*columns).distinct(), b.select(*columns).distinct()
    only = x.join(y, columns, "left_anti").withColumn("_s", F.lit("first only")).unionByName(y.join(x, columns, "left_anti").withColumn("_s", F.lit("second only")))
    return _rows(only, "compatible", F.concat_ws(",", *columns), "error", F.col("_s"))


def year_span(cube: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, finish: the first and last year of each."""
    return cube.groupBy(*keys).agg(F.min(F.year("time")).alias("start"), F.max(F.year("time")).alias("finish"))


def year_range(cube: DataFrame, start: int | None, end: int | None, time: str = "time") -> tuple[int, int]:
    """The years asked for, or the data's; within the data and in order."""
    lo, hi = cube.agg(F.min(F.year(time)), F.max(F.year(time))).first()
    start, end = lo if start is None else start, hi if end is None else end
    if start > end:
        raise InvalidData(f"{start} is after {end}")
    if start < lo or end > hi:
        raise InvalidData(f"{start} to {end} is not within {lo} to {hi}")
    return start, end


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, checks)


def raise_errors(found: DataFrame) -> None:
    """All errors at once; of more than a hundred, a hundred and how many more."""
    errors = found.where("severity = 'error'")
    bad = errors.limit(101).collect()
    if bad:
        more = f"; and {errors.count() - 100} more" if len(bad) > 100 else ""
        raise InvalidData("; ".join(f"{r['check']} {r['subject']}: {r['detail']}" for r in bad[:100]) + more)
