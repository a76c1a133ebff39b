"""Tropical cyclones from fields to scores: a simulation's storms are found and
tracked, brought together with observed tracks, and compared with them."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import filled_pressure, filled_wind
from ..operators import detect, tracks, validate
from ..sources.files import read_tracks
from . import evaluations
from .config import TCConfig
from .evaluations import Tables


@dataclass
class TrackSet:
    """Tracks of one dataset.  points: storm, pt, year, month, lat, lon, wind (m/s), psl
    (Pa); more columns don't matter.  Null or negative wind or pressure is missing.
    years: those that the tracks cover (None: any).  The wind factor brings winds to ten
    metres; thresholds apply before it."""

    points: DataFrame
    members: int = 1
    years: tuple[int, int] | None = None
    wind_factor: float = 1.0

    @classmethod
    def from_best_track(cls, found: DataFrame, years: tuple[int, int] | None = None) -> TrackSet:
        """Of sources.files.best_track(), at the six-hour steps."""
        on = (F.hour("time") % 6 == 0) & (F.minute("time") == 0)
        kept = found.where(on & F.col("lat").isNotNull() & F.col("lon").isNotNull())
        return cls(kept.select("storm", F.col("step").alias("pt"), F.year("time").alias("year"), F.month("time").alias("month"), "lat", "lon", "wind", "psl"), years=years)


def from_settings(spark: SparkSession, settings: DataFrame) -> dict[str, TrackSet]:
    """Sets of a settings table (see read_config()), whose files are track text.  The table
    has a row a dataset."""
    out = {}
    for r in settings.collect():
        points = read_tracks(spark, r["file"], bool(r["unstructured"])).withColumn("storm", F.struct("file", "storm").cast("string"))
        out[r["name"]] = TrackSet(points, r["members"], wind_factor=r["wind_factor"])
    return out


def settings(spark: SparkSession, sets: dict[str, TrackSet], years: tuple[int, int]) -> DataFrame:
    """name, members, years, wind_factor: a row a dataset."""
    rows = [(name, s.members, years[1] - years[0] + 1, s.wind_factor) for name, s in sets.items()]
    return spark.createDataFrame(rows, "name string, members int, years int, wind_factor double")


def _rows(cube: DataFrame | detect.Reading) -> DataFrame:
    return cube.rows if isinstance(cube, detect.Reading) else cube


def simulated_tracks(cube: DataFrame | detect.Reading, years: tuple[int, int], c: TCConfig, topography: DataFrame | None = None) -> TrackSet:
    """The storms of a cube (variable, realization if there are members, time, lat, lon,
    value; or grids or a reading of them, see detect.tracker_input()), at its six-hour
    steps in the years."""
    over = lambda x, change: x.over(change) if isinstance(x, detect.Reading) else change(x)
    cube = over(cube, lambda x: x.where(F.year("time").between(*years) & (F.hour("time") % 6 == 0) & (F.minute("time") == 0)))
    rows = _rows(cube)
    members = ["realization"] if "realization" in rows.columns else []
    hours = F.floor(F.unix_seconds(F.col("time").cast("timestamp")) / 3600)
    fields = over(detect.tracker_input(cube, [*members, "time"], topography), lambda x: x.withColumn("step", (hours / 6).cast("long")))
    found = evaluations.storm_tracks(fields, c, (*members, "time"))
    storm = F.concat_ws("/", *members, "track")
    points = found.select(storm.alias("storm"), "pt", F.year("time").alias("year"), F.month("time").alias("month"), "time", "lat", "lon", "wind", "psl")
    count = rows.select(*members).distinct().count() if members else 1
    return TrackSet(points, max(count, 1), years)


def prepared(name: str, s: TrackSet, years: tuple[int, int], c: TCConfig, fill: bool = True, basin: int = -1, months: tuple[int, int] = (1, 12), control_limit: float | None = None) -> DataFrame:
    """dataset, storm, pt, lat, lon, wind (m/s), pres (hPa), month, year of whole storms
    that reach the least wind and begin in the basin, months and years.  Missing wind is
    worked out from pressure and the other way round, both have defaults; without
    filling they stay missing.  Points up to the limit's wind are left out of the control."""
    missing = lambda x: F.when(F.coalesce(F.col(x), F.lit(-1.0)) >= 0, F.col(x))
    points = s.points.select(
        F.lit(name).alias("dataset"), F.col("storm").cast("string").alias("storm"), "pt", "lat", "lon", missing("wind").alias("wind"), missing("psl").alias("psl"),
        F.col("month").cast("int").alias("month"), F.col("year").cast("int").alias("year"),
    )
    points = tracks.by_wind(points, c.min_wind)
    points = points.withColumns({"wind": F.col("wind") * s.wind_factor, "pres": F.col("psl") / 100}).drop("psl")
    if fill:
        known = points.withColumns({x: F.coalesce(x, F.lit(-1.0)) for x in ("wind", "pres")})
        points = known.withColumns({"wind": filled_wind("pres", "wind"), "pres": filled_pressure("pres", "wind")})
    if control_limit is not None:
        points = points.where(F.col("wind") > control_limit)
    if basin > 0:
        points = tracks.by_basin(points, basin)
    return tracks.by_time(points, months, years)


def scores(
    sets: dict[str, TrackSet], control: str, years: tuple[int, int], c: TCConfig | None = None, fill: bool = True, basin: int = -1,
    months: tuple[int, int] = (1, 12), control_limit: float | None = None,
) -> Tables:
    """The tables of evaluations.tc(), and "settings" and "points".  The control has to
    cover the years; other sets that don't are left out with a warning.  Model years are a
    set's members times the years asked for."""
    c = c or TCConfig()
    if control not in sets:
        raise KeyError(f"no dataset {control}")
    if c.min_wind < 10:
        raise validate.InvalidData("the least wind is 10 m/s")
    kept = {}
    for name, s in sets.items():
        if s.years is None or (s.years[0] <= years[0] and years[1] <= s.years[1]):
            kept[name] = s
        elif name == control:
            raise validate.InvalidData(f"{control} has {s.years[0]} to {s.years[1]}, not {years[0]} to {years[1]}")
        else:
            warnings.warn(f"{name} has {s.years[0]} to {s.years[1]} and is left out", stacklevel=2)
    spark = sets[control].points.sparkSession
    table = settings(spark, kept, years)
    parts = [prepared(name, s, years, c, fill, basin, months, control_limit if name == control else None) for name, s in kept.items()]
    points = evaluations.checkpointed(evaluations._union(parts))
    found = evaluations.tc(points, control, tracks.model_years(table), replace(c, min_wind=float("-inf")), {n: float(s.members) for n, s in kept.items()})
    return {**found, "settings": table, "points": points}


def from_fields(
    cube: DataFrame | detect.Reading, name: str, references: dict[str, TrackSet], control: str | None = None, start: int | None = None, end: int | None = None,
    wind_factor: float = 1.0, c: TCConfig | None = None, topography: DataFrame | None = None, **more: object,
) -> Tables:
    """A simulation's storms against observed ones, of the years asked for (all that the
    simulation has).  The control is the first reference unless another is named."""
    if not references:
        raise validate.InvalidData("there is no reference")
    if name in references:
        raise validate.InvalidData(f"{name} is a reference's name")
    c = c or TCConfig()
    years = validate.year_range(_rows(cube), start, end)
    own = replace(simulated_tracks(cube, years, c, topography), wind_factor=wind_factor)
    return scores({**references, name: own}, control or next(iter(references)), years, c, **more)
