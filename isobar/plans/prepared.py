"""Prepared observations: modes, components and amplitudes of an observed field, saved
once, and checked against an evaluation's settings before they are used."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import regrid, validate
from ..operators import windows as W
from ..session import checkpointed
from . import evaluations
from .config import ISOConfig

#: Version of what is saved; another one is refused.
VERSION = 1
SEASONS = ("winter", "summer")


@dataclass
class PreparedISO:
    """modes and loads by season; components (season, sample, mode, raw, std); amplitudes;
    the grid (lat, lon) inside the latitudes; settings, and the years of the modes."""

    modes: dict[str, tuple[DataFrame, DataFrame]]
    pcs: DataFrame
    amplitudes: DataFrame
    grid: DataFrame
    config: ISOConfig
    years: tuple[int, int]

    def on_grid(self, sim: DataFrame) -> DataFrame:
        """The simulation inside the latitudes on the prepared grid, which it has to cover."""
        inside = sim.where(F.col("lat").between(*self.config.lat)).select("k", "time", "lat", "lon", "value")
        own = inside.select("lat", "lon").distinct()
        if self.grid.join(own, ["lat", "lon"], "left_anti").limit(1).collect():
            made = regrid.bilinear(sim.select("k", "time", "lat", "lon", "value"), self.grid, ["k", "time"])
            absent = self.grid.join(made.select("lat", "lon").distinct(), ["lat", "lon"], "left_anti").limit(1).collect()
            if absent:
                raise validate.InvalidData(f"the simulation does not cover {absent[0]['lat']}, {absent[0]['lon']} of the prepared grid")
            return made
        return inside.join(self.grid, ["lat", "lon"], "left_semi")


def prepare_iso(obs: DataFrame, path: str, years: tuple[int, int], c: ISOConfig | None = None, fill: bool = True) -> None:
    """Fits an observed field (k, time, lat, lon, value) and saves what evaluations need.
    Gaps in time are filled on the line between (or beyond) a cell's nearest values;
    years are the modes', components are of all steps.  The description is written last:
    a folder without one was not finished, and is refused."""
    c = c or ISOConfig()
    spark = obs.sparkSession
    inside = obs.where(F.col("lat").between(*c.lat)).select("k", "time", "lat", "lon", "value")
    if fill:
        inside = W.interpolate(inside, ["lat", "lon"]).select("k", "time", "lat", "lon", "value")
    field = checkpointed(evaluations.band(inside, c))
    modes = {season: evaluations.iso_modes(field, season, c, years) for season in SEASONS}
    pcs, amplitudes = evaluations.iso_components(field, modes, c)
    named = lambda k: evaluations._union([x[k].withColumn("season", F.lit(s)) for s, x in modes.items()])
    tables = {"modes": named(0), "loads": named(1), "pcs": pcs, "amplitudes": amplitudes, "grid": inside.select("lat", "lon").distinct()}
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    about = json.dumps({"version": VERSION, "config": asdict(c), "years": years})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.parquet(f"{path}/about")


def load_iso(spark: SparkSession, path: str, c: ISOConfig | None = None) -> PreparedISO:
    """What prepare_iso() saved.  Another version, or other settings than those asked for,
    are errors."""
    try:
        about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    except Exception as e:
        raise validate.InvalidData(f"{path} is not a prepared observation") from e
    if about["version"] != VERSION:
        raise validate.InvalidData(f"{path} has version {about['version']}, not {VERSION}")
    saved = ISOConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in about["config"].items()})
    if c is not None:
        other = [k for k, v in asdict(saved).items() if json.dumps(v) != json.dumps(asdict(c)[k])]
        if other:
            raise validate.InvalidData(f"{path} was prepared with other {', '.join(other)}")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    of = lambda name, s: read(name).where(F.col("season") == s).drop("season")
    modes = {s: (of("modes", s), of("loads", s)) for s in SEASONS}
    return PreparedISO(modes, read("pcs"), read("amplitudes"), read("grid"), saved, tuple(about["years"]))
