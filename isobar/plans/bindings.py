"""The supplied tables as cubes, series and tracks, in Spark and in SQL.

Prices and event values are divided by seven: means of amounts in cents would
often lie exactly between two roundings, which engines settle differently.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import detect


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as an ensemble: flag is the variable, line number the member."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("variable"), F.col("l_linenumber").alias("realization"), F.col("l_shipdate").alias("time"),
        ((F.col("l_suppkey") % 18) * 10 - 85).cast("double").alias("lat"), ((F.col("l_partkey") % 36) * 10).cast("double").alias("lon"),
        (F.col("l_extendedprice") / 7.0).alias("value"), F.col("l_quantity").alias("quantity"),
    )


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly means on a 6 x 4 grid, every cell populated: k counts months from
    January 1995.  A is the simulation and R the observation."""
    li = table(spark, sf_dir, "lineitem")
    placed = li.select(
        F.col("l_returnflag").alias("variable"), F.col("l_linenumber").alias("realization"),
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("k"),
        ((F.col("l_suppkey") % 6) * 30 - 75).cast("double").alias("lat"), ((F.col("l_partkey") % 4) * 90).cast("double").alias("lon"),
        (F.col("l_extendedprice") / 7.0).alias("value"),
    )
    return placed.groupBy("variable", "realization", "k", "lat", "lon").agg(F.avg("value").alias("value"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem on the coarse grid by day, with the gaps that it has."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("variable"), F.col("l_linenumber").alias("realization"), F.expr("datediff(l_shipdate, date'1995-01-01')").alias("k"),
        ((F.col("l_suppkey") % 6) * 30 - 75).cast("double").alias("lat"), ((F.col("l_partkey") % 4) * 90).cast("double").alias("lon"),
        (F.col("l_extendedprice") / 7.0).alias("value"),
    )


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse grid's R, all members as one observation."""
    return coarse(spark, sf_dir).where("variable = 'R'").groupBy("k", "lat", "lon").agg(F.avg("value").alias("value"))


def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarse(spark, sf_dir).where("variable = 'A'").drop("variable")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as series: variable (event type), k (hour), value."""
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("int")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("variable"), hour.alias("k")).agg(F.avg(F.col("value") / 7.0).alias("value"))


def all_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, value over all event types."""
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("int")
    return table(spark, sf_dir, "events").groupBy(hour.alias("k")).agg(F.avg(F.col("value") / 7.0).alias("value"))


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as storm tracks: a user's events until a gap of over a day."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.expr("timestampdiff(MICROSECOND, prev, ts)")  # whole seconds would leave out a gap's fraction
    e = table(spark, sf_dir, "events").withColumn("prev", F.lag("ts").over(w))
    e = e.withColumn("n", F.sum(F.when(gap > 86400 * 1_000_000, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("user_id", "n").orderBy("ts", "event_id")
    e = e.withColumn("pt", F.row_number().over(own) - 1)
    wind = F.col("value") / 7.0
    return e.select(
        F.when(F.col("user_id") % 2 == 0, "control").otherwise("model").alias("dataset"),
        (F.col("user_id") * 1000 + F.col("n")).cast("long").alias("storm"), F.col("pt").cast("int").alias("pt"), "ts",
        ((F.col("user_id") * 37 + F.col("pt") * 3) % 100 - 50).cast("double").alias("lat"),
        ((F.col("user_id") * 53 + F.col("event_id") * 7) % 360).cast("double").alias("lon"),
        wind.alias("wind"), (F.lit(1010.0) - F.pow(wind, F.lit(1.2)) + F.col("event_id") % 5).alias("pres"),
        F.month("ts").alias("month"), F.year("ts").alias("year"),
    )


def daily(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """lineitem of a return flag as a dense field of days: k counts days from 1995 on,
    value is the day's mean less the cell's, or nothing."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    k = F.expr("datediff(l_shipdate, date'1995-01-01')")
    cells = li.select(k.alias("k"), ((F.col("l_suppkey") % 4) * 10 - 15).cast("double").alias("lat"), ((F.col("l_partkey") % 4) * 90).cast("double").alias("lon"), (F.col("l_extendedprice") / 7.0).alias("v"))
    cells = cells.groupBy("k", "lat", "lon").agg(F.avg("v").alias("v"))
    cells = cells.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("lat", "lon")))
    every = spark.range(2500).select(F.col("id").cast("int").alias("k"), F.explode(F.array(*[F.lit(x) for x in (-15.0, -5.0, 5.0, 15.0)])).alias("lat")).withColumn("lon", F.explode(F.array(*[F.lit(x) for x in (0.0, 90.0, 180.0, 270.0)])))
    time = F.expr("cast(timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(k) as timestamp_ntz)")
    return every.join(cells, ["k", "lat", "lon"], "left").select("k", time.alias("time"), "lat", "lon", F.coalesce("v", F.lit(0.0)).alias("value"))


def hourly_field(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """events of odd or even users as a dense field of hours on a ring of eight
    longitudes and two latitudes; variables are event types, nothing is zero."""
    e = table(spark, sf_dir, "events").where(F.col("user_id") % 2 == odd)
    k = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("int")
    lat = F.when(F.col("event_id") % 2 == 0, -5.0).otherwise(5.0)
    cells = e.groupBy(F.col("event_type").alias("variable"), k.alias("k"), lat.alias("lat"), ((F.col("user_id") % 16 / 2).cast("int") * 45).cast("double").alias("lon")).agg(F.avg(F.col("value") / 7.0).alias("value"))
    steps = spark.range(720).select(F.col("id").cast("int").alias("k"), F.explode(F.array(F.lit(-5.0), F.lit(5.0))).alias("lat")).withColumn("lon", F.explode(F.sequence(F.lit(0), F.lit(315), F.lit(45)).cast("array<double>")))
    kinds = F.explode(F.array(*[F.lit(x) for x in ("click", "purchase", "view")]))
    return steps.withColumn("variable", kinds).join(cells, ["variable", "k", "lat", "lon"], "left").fillna(0.0, ["value"])


def seasonal_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_points() with months made of days, so that there is a seasonal cycle."""
    return track_points(spark, sf_dir).withColumn("month", (F.dayofmonth("ts") % 12 + 1).cast("int"))


def dealt(rows: DataFrame, key: str, most: int = 500) -> DataFrame:
    """Rows dealt out by key over as many tasks as have so many rows each, or over all cores."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / most))
    return rows.repartition(tasks, key)


def made(lat: np.ndarray, lon: np.ndarray, off: Callable[[pa.RecordBatch], tuple[list[np.ndarray], list[np.ndarray]]], fields: Callable[[pa.RecordBatch, np.ndarray], dict[str, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A reader (see detect.Reading) of made grids.  off: what is taken from the latitudes
    and longitudes of each row; fields: of squared distances (grids x places), the variables."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, detect.CELLS // (len(lat) * len(lon)))
        for batch in batches:
            for k in range(0, batch.num_rows, most):
                rows = batch.slice(k, most)
                y, x = (reduce(lambda a, b: a - b[:, None], of, axis[None]) ** 2 for axis, of in zip((lat, lon), off(rows), strict=True))
                grids = {"lat": np.broadcast_to(lat, y.shape), "lon": np.broadcast_to(lon, x.shape)} | fields(rows, (y[:, :, None] + x[:, None]).reshape(len(y), -1))
                for name, values in grids.items():
                    rows = rows.append_column(name, pa.FixedSizeListArray.from_arrays(values.ravel(), values.shape[1]).cast(pa.list_(pa.float64())))
                yield rows

    return read


def storm_fields(spark: SparkSession, sf_dir: str) -> detect.Reading:
    """Suppliers as members of a simulation, a row a time's grid (realization, k, time; the
    variables are made where they are read): each has a storm that lasts three days and
    begins in a month of its own."""
    own = dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s")), "s")
    time = F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' + make_ym_interval(0, cast(s % 12 as int)) + make_dt_interval(0, k * 6) as timestamp_ntz)")
    rows = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).select(F.col("s").alias("realization"), "k", time.alias("time"))

    def off(rows: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
        s, k = rows["realization"].to_numpy(), rows["k"].to_numpy()
        return [np.full(len(k), 8.1), k * 0.5, s % 5], [np.full(len(k), 100.1), k * 0.5]

    def fields(rows: pa.RecordBatch, r2: np.ndarray) -> dict[str, np.ndarray]:
        wind = 5 + (30 - np.abs(rows["k"].to_numpy() - 4.3))[:, None] * np.exp(-r2 / 16)
        return {"psl": 101000 - 3000 * np.exp(-r2 / 4), "uas": 0.6 * wind, "vas": 0.8 * wind, "zg300": 9000 + 30 * np.exp(-r2 / 9), "zg500": np.full(r2.shape, 5000.0)}

    return detect.Reading(rows, made(np.arange(-1.0, 28), np.arange(91.0, 116), off, fields))


CUBE = """cube AS (SELECT l_returnflag AS variable, l_linenumber AS realization, l_shipdate AS time, CAST((l_suppkey % 18) * 10 - 85 AS DOUBLE) AS lat,
 CAST((l_partkey % 36) * 10 AS DOUBLE) AS lon, l_extendedprice / 7.0 AS value, l_quantity AS quantity FROM lineitem)"""
DAYS = """days AS (SELECT l_returnflag AS variable, l_linenumber AS realization, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS k, CAST((l_suppkey % 6) * 30 - 75 AS DOUBLE) AS lat, CAST((l_partkey % 4) * 90 AS DOUBLE) AS lon, l_extendedprice / 7.0 AS value FROM lineitem)"""
COARSE = """coarse AS (SELECT l_returnflag AS variable, l_linenumber AS realization, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS k,
 CAST((l_suppkey % 6) * 30 - 75 AS DOUBLE) AS lat, CAST((l_partkey % 4) * 90 AS DOUBLE) AS lon, avg(l_extendedprice / 7.0) AS value FROM lineitem GROUP BY ALL),
sim AS (SELECT realization, k, lat, lon, value FROM coarse WHERE variable = 'A'),
obs AS (SELECT k, lat, lon, avg(value) AS value FROM coarse WHERE variable = 'R' GROUP BY ALL)"""
HOURLY = """hourly AS (SELECT event_type AS variable, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS k, avg(value / 7.0) AS value FROM events GROUP BY ALL),
hours AS (SELECT CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS k, avg(value / 7.0) AS value FROM events GROUP BY ALL)"""
TRACKS = """e1 AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
e2 AS (SELECT *, sum(CASE WHEN ts - prev > INTERVAL 86400 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e1),
e3 AS (SELECT *, row_number() OVER (PARTITION BY user_id, n ORDER BY ts, event_id) - 1 AS pt FROM e2),
points AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'model' END AS dataset, CAST(user_id * 1000 + n AS BIGINT) AS storm, CAST(pt AS INTEGER) AS pt, ts,
 CAST((user_id * 37 + pt * 3) % 100 - 50 AS DOUBLE) AS lat, CAST((user_id * 53 + event_id * 7) % 360 AS DOUBLE) AS lon, value / 7.0 AS wind,
 1010.0::DOUBLE - pow(value / 7.0, 1.2) + event_id % 5 AS pres, CAST(month(ts) AS INTEGER) AS month, CAST(year(ts) AS INTEGER) AS year FROM e3)"""
STORM_FIELDS = """spots AS (SELECT s_suppkey AS s, k, 8.1::DOUBLE + k * 0.5::DOUBLE + s_suppkey % 5 AS y, 100.1::DOUBLE + k * 0.5::DOUBLE AS x FROM supplier, (SELECT unnest(range(12)) AS k)),
r AS (SELECT *, round(y) AS lat, round(x) AS lon, pow(round(y) - y, 2) + pow(round(x) - x, 2) AS r2 FROM spots),
found AS (SELECT 'model' AS dataset, CAST(s AS VARCHAR) AS storm, k AS pt, lat, lon, 0.9::DOUBLE * (5 + (30 - abs(k - 4.3::DOUBLE)) * exp(-r2 / 16)) AS wind, (101000 - 3000 * exp(-r2 / 4)) / 100 AS pres, s % 12 + 1 AS month FROM r)"""
