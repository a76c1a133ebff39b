"""Storm tracks: points of (dataset, storm, pt) with lat, lon, wind, pres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import KNOTS, basin

STORM = ["dataset", "storm"]


def storm_stats(points: DataFrame, hours: float = 6.0, wind_limit: float = 0.0, by: str = "wind") -> DataFrame:
    """A row a storm: genesis, days, cyclone energy, most intense latitude (by greatest
    wind or least pres), extremes.  Ties in intensity go to the earlier point."""
    intensity = {"wind": -F.col("wind"), "pres": F.col("pres")}[by]
    energy = F.when(F.col("wind") >= wind_limit, 1e-4 * F.pow(KNOTS * F.col("wind"), 2))
    first = F.min_by(F.struct("lat", "lon", "month", "year"), F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("pt")))
    return points.groupBy(*STORM).agg(
        first.alias("g"), F.nullif(F.count("wind") * (hours / 24), F.lit(0.0)).alias("tcd"), F.coalesce(F.sum(energy), F.lit(0.0)).alias("ace"),
        F.min_by(F.abs("lat"), F.when(intensity.isNotNull(), F.struct(intensity, "pt"))).alias("lmi"), F.min("pres").alias("minpres"), F.max("wind").alias("maxwind"), F.count(F.lit(1)).alias("points"),
    ).select(*STORM, F.col("g.lat").alias("gen_lat"), F.col("g.lon").alias("gen_lon"), F.col("g.month").alias("month"), F.col("g.year").alias("year"), "tcd", "ace", "lmi", "minpres", "maxwind", "points")


def quadratic(points: DataFrame, control: str) -> list[float]:
    """Least squares of wind on x = 1010 - min(pres, 1010), highest power first.
    Seven sums come to the driver."""
    import numpy as np

    x = F.lit(1010.0) - F.least("pres", F.lit(1010.0))
    own = points.where((F.col("dataset") == control) & F.col("pres").isNotNull() & F.col("wind").isNotNull())
    s = own.agg(*[F.sum(F.pow(x, F.lit(k))) for k in range(5)], *[F.sum(F.pow(x, F.lit(k)) * F.col("wind")) for k in range(3)]).first()
    a = np.array([[s[i + j] for j in range(3)] for i in range(3)], float)
    return np.linalg.lstsq(a, np.array(s[5:8], float), rcond=None)[0][::-1].tolist()


def pressure_energy(points: DataFrame, coefficients: list[float]) -> DataFrame:
    """storm, pace: cyclone energy of winds worked out from (unclipped) pressure."""
    x = F.lit(1010.0) - F.col("pres")
    wind = coefficients[0] * x * x + coefficients[1] * x + coefficients[2]
    return points.groupBy(*STORM).agg(F.coalesce(F.sum(1e-4 * F.pow(KNOTS * wind, 2)), F.lit(0.0)).alias("pace"))


def by_basin(points: DataFrame, code: int) -> DataFrame:
    """Points of storms that begin in a basin: 20 and 21 are hemispheres, below
    zero all."""
    first = points.groupBy(*STORM).agg(F.min_by(F.struct("lat", "lon"), "pt").alias("g"))
    if code == 20:
        keep = F.col("g.lat") >= 0
    elif code == 21:
        keep = F.col("g.lat") < 0
    else:
        keep = F.lit(True) if code < 0 else basin(F.col("g.lat"), F.col("g.lon")) == code
    return points.join(first.where(keep).select(*STORM), STORM, "left_semi")


def by_time(points: DataFrame, months: tuple[int, int] = (1, 12), years: tuple[int, int] | None = None) -> DataFrame:
    """Points of storms whose first point is in the months and years.  Months that end
    before they begin go over the turn of the year; equal ones are the whole year."""
    first = points.groupBy(*STORM).agg(F.min_by(F.struct("month", "year"), "pt").alias("g"))
    begin, end = months
    inside = F.col("g.month").between(begin, end) if begin < end else (F.col("g.month") >= begin) | (F.col("g.month") <= end)
    keep = inside & (F.lit(True) if years is None else F.col("g.year").between(*years))
    return points.join(first.where(keep).select(*STORM), STORM, "left_semi")


def by_wind(points: DataFrame, least: float) -> DataFrame:
    """Whole storms with a point of that wind at least."""
    return points.withColumn("_m", F.max("wind").over(Window.partitionBy(*STORM))).where(F.col("_m") >= least).drop("_m")


def mask_weak(points: DataFrame, control: str, limit: float = 17.5) -> DataFrame:
    """The control's winds up to the limit become missing."""
    return points.withColumn("wind", F.when((F.col("dataset") == control) & (F.col("wind") <= limit), None).otherwise(F.col("wind")))


def long_enough(points: DataFrame, min_wind: float, min_points: int = 3) -> DataFrame:
    """Storms with more than min_points valid points and the wind reached."""
    w = Window.partitionBy(*STORM)
    valid = F.col("wind").isNotNull() & F.col("lat").isNotNull()
    out = points.withColumns({"_n": F.count_if(valid).over(w), "_m": F.max("wind").over(w)})
    return out.where((F.col("_n") > min_points) & (F.col("_m") >= min_wind)).drop("_n", "_m")


def six_hourly(points: DataFrame, time: str = "ts") -> DataFrame:
    """Points off the six-hour grid become missing."""
    on = (F.hour(time) % 6 == 0) & (F.minute(time) == 0)
    return points.withColumns({c: F.when(on, F.col(c)) for c in ("lat", "lon", "wind", "pres")})


def _years(years: float | dict[str, float]) -> Column:
    """Model years, of all datasets or of each (a setting of a few entries)."""
    if isinstance(years, dict):
        return F.element_at(F.create_map(*[F.lit(x) for pair in years.items() for x in pair]), F.col("dataset"))
    return F.lit(years)


def _totals(storms: DataFrame) -> list[str]:
    """What is summed over storms; pace where it has been worked out."""
    return [c for c in ("tcd", "ace", "pace") if c in storms.columns]


def monthly(storms: DataFrame, years: float | dict[str, float]) -> DataFrame:
    """dataset, month 1 to 12: count, tcd, ace (and pace) a year, and mean lmi; none: zero."""
    every = storms.select("dataset").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    of = _totals(storms)
    sums = storms.groupBy("dataset", "month").agg((F.count(F.lit(1)) / _years(years)).alias("count"), *[(F.sum(c) / _years(years)).alias(c) for c in of], F.avg("lmi").alias("lmi"))
    return every.join(sums, ["dataset", "month"], "left").fillna(0.0, ["count", *of])


def yearly(storms: DataFrame, members: float | dict[str, float] = 1) -> DataFrame:
    """dataset, year: count, tcd, ace (and pace) a member, mean lmi, for the years seen
    between the dataset's first and last."""
    ends = storms.groupBy("dataset").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    every = ends.select("dataset", F.explode(F.sequence("a", "b")).alias("year"))
    sums = storms.groupBy("dataset", "year").agg(
        (F.count(F.lit(1)) / _years(members)).alias("count"), *[(F.sum(c) / _years(members)).alias(c) for c in _totals(storms)], F.avg("lmi").alias("lmi"),
        F.avg(F.abs("gen_lat")).alias("latgen"),
    )
    return every.join(sums, ["dataset", "year"], "left")


def climatology(storms: DataFrame, years: float | dict[str, float]) -> DataFrame:
    """Totals a year and means over storms, by dataset."""
    of = _totals(storms)
    return storms.groupBy("dataset").agg(
        (F.count(F.lit(1)) / _years(years)).alias("uclim_count"), *[(F.sum(c) / _years(years)).alias(f"uclim_{c}") for c in of],
        *[F.avg(c).alias(f"storm_{c}") for c in of], F.avg("lmi").alias("storm_lmi"), F.avg(F.abs("gen_lat")).alias("storm_latgen"),
    )


def yearly_means(storms: DataFrame) -> DataFrame:
    """dataset, uclim_lmi: the mean of the years' mean latitudes of greatest intensity."""
    return yearly(storms).groupBy("dataset").agg(F.avg("lmi").alias("uclim_lmi"))


def model_years(settings: DataFrame, years: int | None = None) -> dict[str, float]:
    """Members times years (asked for, or the dataset's own) of each dataset.  settings
    has a row a dataset: name, members, years."""
    return {r["name"]: float(r["members"] * (years or r["years"])) for r in settings.select("name", "members", "years").collect()}


def cell(step: float) -> list[Column]:
    """Grid indices of a point; longitudes past the last column are in the first."""
    i = ((F.col("lat") + 90) / step).cast("int")
    j = (F.col("lon") / step).cast("int")
    return [i.alias("i"), F.when(j >= int(360 / step), 0).otherwise(j).alias("j")]


def density(points: DataFrame, step: float) -> DataFrame:
    """dataset, i, j: points, and sum, mean, least and most of wind and pressure."""
    on = points.select("dataset", *cell(step), "wind", "pres")
    return on.groupBy("dataset", "i", "j").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("wind").alias("wind_sum"), F.avg("wind").alias("wind_mean"), F.max("wind").alias("wind_max"), F.min("pres").alias("pres_min")
    )


def full_grid(maps: DataFrame, step: float, value: str) -> DataFrame:
    """Every cell of the grid, zero where nothing is."""
    spark = maps.sparkSession
    grid = spark.range(int(180 / step) + 1).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(int(360 / step) - 1))).alias("j"))
    every = maps.select("dataset").distinct().crossJoin(F.broadcast(grid))  # a grid of known size for each of a few datasets
    return every.join(maps.select("dataset", "i", "j", value), ["dataset", "i", "j"], "left").fillna(0, [value])


def histogram2d(points: DataFrame, lat_edges: tuple[float, float, int], lon_edges: tuple[float, float, int]) -> DataFrame:
    """i, j, n over regular bins (from, to, number), the last one closed; points
    outside are dropped."""

    def bin_(x: str, edges: tuple[float, float, int]) -> Column:
        a, b, n = edges
        inside = F.col(x).between(a, b)
        return F.when(inside, F.least(F.floor((F.col(x) - a) / F.lit((b - a) / n)), F.lit(n - 1)).cast("int"))

    on = points.select(bin_("lat", lat_edges).alias("i"), bin_("lon", lon_edges).alias("j"))
    return on.dropna().groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def genesis_over(points: DataFrame, cutoff: float) -> DataFrame:
    """The first point of each storm with wind over the cutoff."""
    return points.where(F.col("wind") > cutoff).groupBy(*STORM).agg(F.min_by(F.struct("lat", "lon"), "pt").alias("g")).select(*STORM, "g.lat", "g.lon")


def spatial_bundle(points: DataFrame, storms: DataFrame, pace: list[float], step: float, years: float | dict[str, float]) -> DataFrame:
    """dataset, i, j: count, gen, tcd, ace, pace a year, minpres, maxwind."""
    x = F.lit(1010.0) - F.col("pres")
    wind = pace[0] * x * x + pace[1] * x + pace[2]
    on = points.select("dataset", *cell(step), "wind", "pres", wind.alias("pw"))
    maps = on.groupBy("dataset", "i", "j").agg(
        (F.count(F.lit(1)) / _years(years)).alias("count"), (F.count("wind") * 0.25 / _years(years)).alias("tcd"), (F.sum(1e-4 * F.pow(KNOTS * F.col("wind"), 2)) / _years(years)).alias("ace"),
        (F.sum(1e-4 * F.pow(KNOTS * F.col("pw"), 2)) / _years(years)).alias("pace"), F.min("pres").alias("minpres"), F.max("wind").alias("maxwind"),
    )
    gen = storms.select("dataset", F.col("gen_lat").alias("lat"), F.col("gen_lon").alias("lon")).select("dataset", *cell(step))
    return maps.join(gen.groupBy("dataset", "i", "j").agg((F.count(F.lit(1)) / _years(years)).alias("gen")), ["dataset", "i", "j"], "left").fillna(0.0, ["gen"])


def stitch(points: DataFrame, gap_seconds: int, key: str = "user_id", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Number a key's points into tracks that end at a longer gap, to the microsecond."""
    w = Window.partitionBy(key).orderBy(time, tie)
    gap = F.expr(f"timestampdiff(MICROSECOND, _prev, {time})") > gap_seconds * 1_000_000
    return points.withColumn("_prev", F.lag(time).over(w)).withColumn("track", F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_prev")
