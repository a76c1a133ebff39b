"""Track text, observation files, configuration and result tables."""

from __future__ import annotations

import ast
import os
import re
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendars import decoded
from ..functions.expr import KNOTS, lon_wrap
from .netcdf import describe, read_netcdf

BLANK = " \t\r"


def write_tracks(points: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Storms (storm, pt, i, j, lon, lat, psl, wind, phis, year, month, day, hour) as
    track text: a header line with the number of points, then the points.  A storm is
    one row of the file's lines, so its lines stay together."""
    fields = ["i", "j", "lon", "lat", "psl", "wind", "phis", "year", "month", "day", "hour"]
    line = F.concat(F.lit("\t"), F.concat_ws("\t", *[F.col(c).cast("string") for c in fields]))
    by = points.groupBy("storm").agg(F.sort_array(F.collect_list(F.struct("pt", "year", "month", "day", "hour", line.alias("line")))).alias("p"))
    first = F.col("p")[0]
    header = F.concat_ws("\t", F.lit("start"), F.size("p").cast("string"), *[first[c].cast("string") for c in ("year", "month", "day", "hour")])
    by.select(F.concat_ws("\n", header, F.array_join(F.transform("p", lambda x: x["line"]), "\n")).alias("value")).write.mode(mode).text(path)


def read_tracks(spark: SparkSession, path: str, unstructured: bool = False) -> DataFrame:
    """file, storm (its number in the file), pt and a point's fields.  Lines are read
    in whole storms: a record starts at each header.  Unstructured files have one
    index column instead of two."""
    lines = spark.read.option("lineSep", "start").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("storm"), "value")
    records = lines.where(F.trim("value") != "").withColumn("row", F.split(F.rtrim(F.regexp_replace("value", r"\s+$", "")), "\n"))
    head = F.split(F.btrim(F.element_at("row", 1), F.lit(BLANK)), r"\s+")
    points = records.select("file", "storm", head[0].cast("int").alias("n"), F.posexplode(F.slice("row", 2, F.size("row"))).alias("pt", "line")).withColumn("f", F.split(F.btrim("line", F.lit(BLANK)), r"\s+"))
    shift = 1 if unstructured else 0
    at = lambda k: F.col("f")[k]
    number = {"lon": 2, "lat": 3, "psl": 4, "wind": 5, "phis": 6}
    last = {"year": 4, "month": 3, "day": 2, "hour": 1}
    return points.select(
        "file", "storm", "pt", "n", at(0).cast("int").alias("i"), (F.lit(None).cast("int") if unstructured else at(1).cast("int")).alias("j"),
        *[at(k - shift).cast("double").alias(c) for c, k in number.items()], *[F.element_at("f", -k).cast("int").alias(c) for c, k in last.items()],
    )


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Detected nodes: header lines 'year month day n hour', each with its points
    below; points carry their header's time.  A file is numbered as a whole, in one
    task for each file."""
    text = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("k", "line"))
    f = text.where(F.trim("line") != "").withColumn("f", F.split(F.btrim("line", F.lit(BLANK)), r"\s+")).withColumn("head", ~F.col("line").rlike(r"^\s"))
    w = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    stamp = F.last(F.when(F.col("head"), F.col("f")), True).over(w)
    points = f.withColumn("h", stamp).where(~F.col("head"))
    return points.select(
        "file", "k", *[F.col("h")[n].cast("int").alias(c) for c, n in (("year", 0), ("month", 1), ("day", 2), ("hour", 4))],
        F.col("f")[0].cast("int").alias("i"), F.col("f")[1].cast("int").alias("j"), *[F.col("f")[n].cast("double").alias(c) for c, n in (("lon", 2), ("lat", 3), ("psl", 4), ("wind", 5))],
    )


def best_track(raw: DataFrame, layout: str = "v4", agency: str = "wmo") -> DataFrame:
    """storm, step, season, time, lat, lon, wind (m/s), psl (Pa), with longitudes from 0
    to 360.  Layouts: plain (wind_kt and pres_hpa); v4 (agency_wind in knots, agency_pres
    in hPa); v3 (lat_agency and lon_agency in hundredths, wind_agency in tenths of a knot,
    pres_agency as it is)."""
    if layout == "v3":
        lat, lon, wind, psl = F.col(f"lat_{agency}") * 0.01, F.col(f"lon_{agency}") * 0.01, F.col(f"wind_{agency}") * 0.1, F.col(f"pres_{agency}").cast("double")
    elif layout == "v4":
        lat, lon, wind, psl = F.col("lat"), F.col("lon"), F.col(f"{agency}_wind"), F.col(f"{agency}_pres") * 100
    elif layout == "plain":
        lat, lon, wind, psl = F.col("lat"), F.col("lon"), F.col("wind_kt"), F.col("pres_hpa") * 100
    else:
        raise ValueError(f"no layout {layout}")
    return raw.select("storm", "step", "season", "time", lat.alias("lat"), lon.alias("_lon"), (wind / KNOTS).alias("wind"), psl.alias("psl")).withColumn("lon", lon_wrap("_lon")).drop("_lon")


def first_match(spark: SparkSession, folder: str, name: str) -> str:
    """The first path in order, in the folder or below, whose own name fits; files and
    tables in folders alike."""
    jvm = spark.sparkContext._jvm
    found = []
    for depth in ("", "*/", "*/*/"):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{depth}{name}")
        found += [str(x.getPath()) for x in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []]
        if found:
            return min(found)
    raise FileNotFoundError(f"{folder}/{name}")


def read_observations(spark: SparkSession, folder: str, variables: list[str], sim_times: DataFrame, realization: int | None = None) -> DataFrame:
    """Per variable the first of data_obs*_{variable}.nc or .parquet in a folder, one
    realization, at the simulation's times, all of which have to be there.  The time of a
    NetCDF file is decoded by its units and calendar."""
    parts = []
    for v in variables:
        path = first_match(spark, folder, f"data_obs*_{v}.{{nc,nc4,parquet}}")
        obs = spark.read.parquet(path) if path.endswith(".parquet") else read_times(spark, path, v)
        if realization is not None and "realization" in obs.columns:
            obs = obs.where(F.col("realization") == realization).drop("realization")
        parts.append(obs.withColumn("variable", F.lit(v)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    absent = sim_times.select("time").distinct().join(out.select("time").distinct(), "time", "left_anti").limit(1).collect()
    if absent:
        raise KeyError(f"the observations have no {absent[0][0]}")
    return out.join(sim_times.select("time").distinct(), "time", "left_semi")


def read_times(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """A variable of a NetCDF file with its time as a timestamp."""
    about = describe(path, "time")
    return read_netcdf(spark, path, variable).withColumn("time", decoded(F.col("time"), about["units"], about.get("calendar"))["time"])


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """file, name, unstructured, members, years, wind_factor of each dataset; lines
    with an exclamation mark are comments."""
    schema = "file string, name string, unstructured boolean, members int, years int, wind_factor double"
    return spark.read.csv(path, schema=schema, header=False, comment="!", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def write_config(settings: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The same, as text that read_config() reads."""
    fields = ["file", "name", "unstructured", "members", "years", "wind_factor"]
    settings.select(F.concat_ws(", ", *[F.col(c).cast("string") for c in fields]).alias("value")).write.mode(mode).text(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of variables from YAML: variable, check_enabled, long_name,
    mask, units, min, max, boundaries (how strictly the limits are meant)."""
    import yaml

    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    number = lambda x: None if x is None else float(x)
    rows = [(v, bool(d.get("check_enabled")), d.get("long_name"), d.get("mask"), d.get("units"), number(d.get("min")), number(d.get("max")), d.get("boundaries")) for v, d in found.items()]
    return spark.createDataFrame(rows, "variable string, check_enabled boolean, long_name string, mask string, units string, min double, max double, boundaries string")


def parse_value(text: str) -> object:
    """A configured value: a number, a fraction such as 1/90, a tuple, a boolean or
    text; nothing is evaluated."""
    text = text.strip()
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        pass
    try:
        return float(Fraction(text.replace(" ", "")))
    except (ValueError, ZeroDivisionError):
        return text


def write_result(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite", kind: str = "parquet") -> None:
    """Results as Parquet (or CSV with a header), partitioned by dataset keys."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path, header=True) if kind == "csv" else writer.parquet(path)


def result_name(kind: str, datasets: list[str] | None = None, years: tuple[int, int] | None = None) -> str:
    """A result's name, with those of its datasets and its years."""
    parts = [kind, *(["-".join(d.replace(" ", "_") for d in datasets)] if datasets else []), *([f"{years[0]}-{years[1]}"] if years else [])]
    return "_".join(parts)


def named_years(name: str) -> tuple[int, int] | None:
    """The years that end a result's name."""
    found = re.search(r"_([0-9]{4})-([0-9]{4})(?:\.[a-z]+)?$", name)
    return (int(found[1]), int(found[2])) if found else None


def result_path(output: str, name: str, single: bool = True) -> str:
    """Where a named result goes: in a folder under its name, or to the file itself
    where the method makes one result only."""
    if os.path.splitext(output)[1]:
        if not single:
            raise ValueError("several results need a folder")
        return output
    return os.path.join(output, name)


