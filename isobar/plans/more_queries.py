"""Queries for regridding, validation, EOFs, spectra, sources and streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendars
from ..functions import expr as E
from ..operators import eof, regrid, spectrum, validate
from ..operators import windows as W
from ..session import shared_folder
from ..sources import files, netcdf, netcdf_sink
from ..streaming import events
from . import bindings as B
from ..operators import tracks as T
from .queries import ORACLE_SQL, PCS, PHASE, QUAD, QUERIES, _kernel_sql, _members, _pcs, query  # noqa: F401


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the cluster's shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


TARGET_SQL = "tgt AS (SELECT CAST(la AS DOUBLE) AS lat, CAST(lo AS DOUBLE) AS lon FROM (SELECT unnest(range(-60, 61, 20)) AS la), (SELECT unnest(range(0, 271, 45)) AS lo))"


@query("reg1_bilinear", f"""WITH {B.COARSE}, m AS (SELECT lat, lon, avg(value) AS v FROM obs GROUP BY ALL), {TARGET_SQL},
    q AS (SELECT lat, lon, floor((lat + 75) / 30) * 30 - 75 AS a, floor(lon / 90) * 90 AS b FROM tgt), w AS (SELECT *, (lat - a) / 30 AS u, (lon - b) / 90 AS t FROM q)
    SELECT w.lat, w.lon, round((1-u)*(1-t)*m1.v + CASE WHEN u > 0 THEN u*(1-t)*m2.v ELSE 0 END + CASE WHEN t > 0 THEN (1-u)*t*m3.v ELSE 0 END + CASE WHEN u > 0 AND t > 0 THEN u*t*m4.v ELSE 0 END, 6) AS value
    FROM w JOIN m m1 ON m1.lat = a AND m1.lon = b LEFT JOIN m m2 ON m2.lat = a + 30 AND m2.lon = b LEFT JOIN m m3 ON m3.lat = a AND m3.lon = b + 90 LEFT JOIN m m4 ON m4.lat = a + 30 AND m4.lon = b + 90""", 6)  # fmt: skip
def reg1(spark, d):
    means = B.observed(spark, d).groupBy("lat", "lon").agg(F.avg("value").alias("value"))
    target = spark.range(-60, 61, 20).select(F.col("id").cast("double").alias("lat"), F.explode(F.sequence(F.lit(0), F.lit(270), F.lit(45)).cast("array<double>")).alias("lon"))
    return regrid.bilinear(means, target, [])


@query("reg2_cyclic", f"WITH {B.COARSE}, m AS (SELECT lat, lon, avg(value) AS v FROM obs GROUP BY ALL) SELECT lat, lon, round(v, 6) AS value FROM m UNION ALL SELECT lat, lon + 360, round(v, 6) FROM m WHERE lon = (SELECT min(lon) FROM m)", 6)
def reg2(spark, d):
    return regrid.cyclic(B.observed(spark, d).groupBy("lat", "lon").agg(F.avg("value").alias("value")))


CATALOG = [("A", True, "first", "atm", "usd", 0.0, 1000.0), ("R", True, "second", "oce", "usd", None, None), ("X", False, "third", "atm", "usd", None, None)]


def _catalog(spark):
    return spark.createDataFrame(CATALOG, "variable string, check_enabled boolean, long_name string, mask string, units string, min double, max double")


@query("val4_5_7_report", f"""WITH {B.CUBE}, m AS (SELECT variable, max(value) AS hi, count(*) AS n, count(CASE WHEN variable = 'R' AND lat < 0 THEN NULL ELSE value END) AS v FROM cube GROUP BY variable)
    SELECT 'catalog' AS "check", variable AS subject, 'error' AS severity, 'unknown variable' AS detail FROM m WHERE variable NOT IN ('A', 'R', 'X')
    UNION ALL SELECT 'plausibility', variable, 'error', 'above 1000.0' FROM m WHERE variable = 'A' AND hi > 1000
    UNION ALL SELECT 'long_name', variable, 'warning', 'first' FROM m WHERE variable = 'A'
    UNION ALL SELECT 'spatial', variable, 'error', 'unknown mask' FROM m WHERE variable = 'N'""")  # fmt: skip
def val457(spark, d):
    cube = B.cube(spark, d).withColumn("value", F.when(~((F.col("variable") == "R") & (F.col("lat") < 0)), F.col("value")))
    found = cube.select("variable").distinct().withColumns({"units": F.lit("usd"), "long_name": F.when(F.col("variable") == "R", "second").otherwise("other")})
    catalog = _catalog(spark)
    return validate.report([validate.catalogued(found, catalog), validate.complete(cube, catalog), validate.plausible(cube, catalog)])


@query("val6_gaps", "WITH s AS (SELECT DISTINCT CAST(date_diff('minute', TIMESTAMP '2024-01-01', ts) // 15 AS INTEGER) AS k FROM events) SELECT 'temporal' AS \"check\", CAST(k AS VARCHAR) AS subject, 'error' AS severity, 'missing step' AS detail FROM (SELECT unnest(range((SELECT min(k) FROM s), (SELECT max(k) FROM s) + 1)) AS k) WHERE k NOT IN (SELECT k FROM s)")
def val6(spark, d):
    """Quarters of an hour without an event."""
    k = F.floor(F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts)") / 15).cast("int")
    return validate.gaps(B.table(spark, d, "events").select(k.alias("k")).distinct())


@query("val11_12_compatible", f"WITH {B.CUBE}, a AS (SELECT DISTINCT realization, lat, lon FROM cube WHERE variable = 'A'), r AS (SELECT DISTINCT realization, lat, lon FROM cube WHERE variable = 'R') SELECT 'compatible' AS \"check\", concat(realization, ',', lat, ',', lon) AS subject, 'error' AS severity, 'first only' AS detail FROM (SELECT * FROM a EXCEPT SELECT * FROM r) UNION ALL SELECT 'compatible', concat(realization, ',', lat, ',', lon), 'error', 'second only' FROM (SELECT * FROM r EXCEPT SELECT * FROM a)")
def val11(spark, d):
    c = B.cube(spark, d)
    return validate.same_grid(c.where("variable = 'A'"), c.where("variable = 'R'"), ["realization", "lat", "lon"])


@query("val13_year_range", "SELECT l_returnflag AS variable, CAST(min(year(l_shipdate)) AS INTEGER) AS start, CAST(max(year(l_shipdate)) AS INTEGER) AS finish FROM lineitem GROUP BY l_returnflag")
def val13(spark, d):
    return validate.year_span(B.cube(spark, d), ["variable"])


def _embedded(spark, d, features: int):
    """embeddings as samples x features."""
    e = B.table(spark, d, "embeddings")
    long = e.select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("feature", "value"))
    return long.where(F.col("feature") < features).withColumn("value", F.col("value").cast("double"))


@query("eof4_gram", "WITH v AS (SELECT vec_id, unnest(range(0, 64)) AS f, embedding FROM embeddings), x AS (SELECT vec_id, CAST(f AS INTEGER) AS f, CAST(embedding[f + 1] AS DOUBLE) AS v FROM v) SELECT a.f AS i, b.f AS j, round(sum(a.v * b.v), 6) AS value FROM x a JOIN x b USING (vec_id) GROUP BY ALL")
def eof4_gram(spark, d):
    long = _embedded(spark, d, 64)
    return eof.gram(eof.vectors(long, eof.feature_table(long)), 64)


@query("eof4_fit", digits=5)
def eof4(spark, d):
    return eof.fit(_embedded(spark, d, 64), 3)[0]


@query("eof5_projection", "WITH v AS (SELECT vec_id, unnest(range(0, 64)) AS f, embedding FROM embeddings), x AS (SELECT vec_id, f, CAST(embedding[f + 1] AS DOUBLE) AS v FROM v), l AS (SELECT m AS mode, f, cos((m + 1) * f * 0.1::DOUBLE) AS l FROM (SELECT CAST(unnest([0, 1]) AS INTEGER) AS m), (SELECT unnest(range(0, 64)) AS f)) SELECT vec_id AS sample, mode, round(sum(v * l), 6) AS raw FROM x JOIN l USING (f) GROUP BY ALL")
def eof5(spark, d):
    loads = spark.range(64).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("mode"), F.col("id").cast("int").alias("feature"))
    return eof.project(_embedded(spark, d, 64), loads.withColumn("loading", F.cos((F.col("mode") + 1) * F.col("feature") * F.lit(0.1))))


@query("eof3_delayed_fit", digits=5)
def eof3(spark, d):
    f = B.daily(spark, d, "A").select(F.col("k").alias("sample"), F.concat_ws("/", "lat", "lon").alias("feature"), (F.col("value") * F.sqrt(E.weight())).alias("value"))
    return eof.fit(eof.delayed(f), 2)[0]


@query("eof9_10_matched_modes", digits=4)
def eof9(spark, d):
    half = lambda s: eof.fit(_embedded(spark, d, 64).where(F.col("sample") % 2 == s), 2)[1]
    a, b = half(0), half(1)
    return eof.loading_correlation(eof.match_modes(a, b), b)


@query("spe2_symmetric", f"WITH {B.COARSE} SELECT CAST(k AS INTEGER) AS k, a.lat, a.lon, round(CASE WHEN a.lat < 0 THEN (a.value + b.value) / 2 WHEN a.lat > 0 THEN (a.value - b.value) / 2 ELSE a.value END, 6) AS value FROM obs a JOIN obs b USING (k, lon) WHERE b.lat = -a.lat")
def spe2(spark, d):
    return spectrum.symmetric(B.observed(spark, d), ["k"])


def _dense(spark, d):
    """events on a ring: user mod 8 is the longitude, hours the steps, gaps filled."""
    e = B.table(spark, d, "events")
    k = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("int")
    lat = F.when(F.col("event_id") % 2 == 0, -5.0).otherwise(5.0)
    cells = e.groupBy(k.alias("k"), lat.alias("lat"), ((F.col("user_id") % 8) * 45).cast("double").alias("lon")).agg(F.avg("value").alias("value"))
    full = spark.range(720).select(F.col("id").cast("int").alias("k"), F.explode(F.array(F.lit(-5.0), F.lit(5.0))).alias("lat")).withColumn("lon", F.explode(F.sequence(F.lit(0), F.lit(315), F.lit(45)).cast("array<double>")))
    return full.join(cells, ["k", "lat", "lon"], "left").fillna(0.0, ["value"])


@query("spe6_spacetime_power", digits=6)
def spe6(spark, d):
    field = spectrum.symmetric(spectrum.low_frequency_filter(W.detrend(_dense(spark, d), ["lat", "lon"]), ["lat", "lon"]), ["k"])
    return spectrum.segment_power(field, [])


@query("spe7_normalised", digits=5)
def spe7(spark, d):
    field = spectrum.symmetric(_dense(spark, d), ["k"])
    return spectrum.normalised(spectrum.segment_power(field, []), [])


SPECTRUM_SQL = "spec AS (SELECT event_type AS variable, CAST(user_id % 31 AS INTEGER) - 15 AS wavenumber, (event_id % 49) / 96.0::DOUBLE AS frequency, avg(value) AS power FROM events GROUP BY ALL)"


def _spectrum(spark, d):
    e = B.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("variable"), ((F.col("user_id") % 31).cast("int") - 15).alias("wavenumber"), ((F.col("event_id") % 49) / F.lit(96.0)).alias("frequency")).agg(F.avg("value").alias("power"))


BOX = "frequency BETWEEN 0.02 AND 0.2"


@query("agg25_28_band_scores", f"""WITH {SPECTRUM_SQL} SELECT variable, round(sum(power) FILTER ({BOX} AND wavenumber BETWEEN 0 AND 4), 5) AS power,
    round(sum(power) FILTER ({BOX} AND wavenumber BETWEEN 0 AND 4) / sum(power) FILTER ({BOX} AND wavenumber BETWEEN -4 AND 0), 5) AS ratio,
    round(sum(power / nullif(frequency, 0)) FILTER ({BOX} AND wavenumber BETWEEN 0 AND 4) / sum(power) FILTER ({BOX} AND wavenumber BETWEEN 0 AND 4), 5) AS period FROM spec GROUP BY variable HAVING sum(power) FILTER ({BOX} AND wavenumber BETWEEN 0 AND 4) IS NOT NULL""", 5)  # fmt: skip
def agg25(spark, d):
    s, f = _spectrum(spark, d), (0.02, 0.2)
    out = spectrum.band_power(s, ["variable"], frequency=f).join(spectrum.east_west(s, ["variable"], f), "variable")
    return out.join(spectrum.period(s, ["variable"], frequency=f), "variable")


@query("agg27_eo_ratio", f"WITH {SPECTRUM_SQL}, p AS (SELECT variable, sum(power) AS p FROM spec WHERE {BOX} AND wavenumber BETWEEN 0 AND 4 GROUP BY variable) SELECT p.variable, round(p.p / o.p, 6) AS ratio FROM p, (SELECT p FROM p WHERE variable = 'view') o")
def agg27(spark, d):
    p = spectrum.band_power(_spectrum(spark, d), ["variable"], frequency=(0.02, 0.2))
    ref = p.where("variable = 'view'").select(F.col("power").alias("o"))
    return p.crossJoin(F.broadcast(ref)).select("variable", E.ratio("power", "o").alias("ratio"))  # one row


@query("spe8_dispersion", f"""WITH RECURSIVE k AS (SELECT 20.0::DOUBLE - CAST(i AS DOUBLE) * 40 / 49 AS wavenumber FROM (SELECT unnest(range(0, 50)) AS i)),
    r AS (SELECT wavenumber, depth, sqrt(9.80665::DOUBLE * depth) AS c, wavenumber / 6.37122e6 AS kk, 2 * 7.292e-5 / 6.37122e6 AS b FROM k, (SELECT CAST(unnest([50, 25, 12]) AS DOUBLE) AS depth)),
    ig(n, wavenumber, depth, c, kk, b, pass, f) AS (SELECT n, wavenumber, depth, c, kk, b, 0, sqrt((2 * n + 1) * b * c + pow(kk * c, 2)) FROM r, (SELECT unnest([1, 2]) AS n)
        UNION ALL SELECT n, wavenumber, depth, c, kk, b, pass + 1, sqrt((2 * n + 1) * b * c + pow(kk * c, 2) + 9.80665 * depth * b * kk / f) FROM ig WHERE pass < 5),
    f AS (SELECT wavenumber, depth, 'kelvin' AS wave, kk * c AS f FROM r UNION ALL SELECT wavenumber, depth, 'er', CASE WHEN kk < 0 THEN -b * kk / (kk * kk + 3 * b / c) END FROM r
     UNION ALL SELECT wavenumber, depth, 'ig' || n, f FROM ig WHERE pass = 5
     UNION ALL SELECT wavenumber, depth, 'mrg', CASE WHEN kk <= 0 THEN kk * c * (0.5 - 0.5 * sqrt(1 + 4 * b / (kk * kk * c))) END FROM r UNION ALL SELECT wavenumber, depth, 'eig', CASE WHEN kk > 0 THEN kk * c * (0.5 + 0.5 * sqrt(1 + 4 * b / (kk * kk * c))) END FROM r)
    SELECT round(wavenumber, 6) AS wavenumber, depth, wave, round(f * 86400 / (2 * pi()), 6) AS frequency FROM f WHERE f IS NOT NULL""")  # fmt: skip
def spe8(spark, d):
    return W.dispersion(spark)


@query("eof2_prefilter", digits=5)
def eof2(spark, d):
    cube = _dense(spark, d).withColumn("variable", F.lit("v"))
    return spectrum.prefilter(cube, 24, 120)


@query("win3_lanczos_grouped", f"WITH {B.HOURLY}, h(o, h) AS (VALUES {_kernel_sql()}), m AS (SELECT *, row_number() OVER (ORDER BY k) AS n FROM hours), c AS (SELECT n + o AS n, sum(h * value) AS v FROM m, h GROUP BY ALL) SELECT 'all' AS variable, CAST(m.k AS INTEGER) AS k, round(v, 6) AS filtered FROM c JOIN m USING (n)")
def win3g(spark, d):
    dense = B.all_hours(spark, d).select(F.lit("all").alias("variable"), "k", "value")
    return spectrum.bandpass(dense, ["variable"], W.lanczos(141, 1 / 90, 1 / 25)).withColumnRenamed("value", "filtered")


@query("src4_snk2_track_text", f"WITH {B.TRACKS} SELECT CAST(n AS INTEGER) AS n, CAST(count(*) AS BIGINT) AS storms, round(sum(w), 3) AS wind FROM (SELECT storm, count(*) AS n, sum(wind) AS w FROM points GROUP BY storm) GROUP BY n", 3)
def src4(spark, d):
    p = B.track_points(spark, d).select(
        "storm", "pt", F.lit(0).alias("i"), F.lit(0).alias("j"), "lon", "lat", (F.col("pres") * 100).alias("psl"), "wind", F.lit(0.0).alias("phis"), "year", "month",
        F.dayofmonth("ts").alias("day"), F.hour("ts").alias("hour"),
    )
    path = scratch(spark, "tracks")
    files.write_tracks(p, path)
    back = files.read_tracks(spark, path).groupBy("file", "storm").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("wind").alias("w"))
    return back.groupBy("n").agg(F.count(F.lit(1)).alias("storms"), F.sum("w").alias("wind"))


@query("stream_windowed_mean", "SELECT event_type, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS k, round(avg(value), 5) AS value, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL", 5)
def stream1(spark, d):
    agg = events.windowed_mean(events.event_stream(spark, f"{d}/events.parquet"))
    done = events.drain(agg, scratch(spark, "stream"), scratch(spark, "stream-state"), ["w", "event_type"])
    k = ((F.unix_timestamp("w.start") - 1704067200) / 3600).cast("int")
    return done.select("event_type", k.alias("k"), "value", "n")


@query("stream_sessions", f"WITH {B.TRACKS} SELECT storm // 1000 AS user_id, CAST(count(*) AS BIGINT) AS n, round(max(wind * 7.0), 5) AS most FROM points GROUP BY storm", 5)
def stream2(spark, d):
    agg = events.sessions(events.event_stream(spark, f"{d}/events.parquet"), "86400 seconds")
    return events.drain(agg, scratch(spark, "sessions"), scratch(spark, "sessions-state")).select("user_id", "n", "most")


@query("plt_time_series", digits=3)
def plt1(spark, d):
    from . import plots

    means = B.coarse(spark, d).where("variable = 'A'").groupBy("realization", "k").agg(E.weighted_mean("value", E.weight()).alias("value"))
    return plots.time_series(means.withColumn("label", F.lit("A")))


@query("plt4_matrix", digits=3)
def plt4(spark, d):
    from . import plots
    from .queries import SECTION, S, _score_samples

    s = _score_samples(spark, d)
    return plots.matrix(S.cohen_bootstrap(s, SECTION, 1000), S.rejections(S.all_tests(s, SECTION), ["season", "region"]))


@query("plt2_effect_map", digits=3)
def plt2(spark, d):
    from . import plots
    from .queries import R, S

    m = _members(spark, d)
    p = S.significant(S.with_t_p(S.welch(m, R.CELL, equal=True)))
    return plots.map_table(S.cohen_bootstrap(m, R.CELL, 1000).withColumnRenamed("d", "value"), p)




# --- further operators ----------------------------------------------------------------


@query("fil1_2_select", f"WITH {B.CUBE} SELECT variable, lat, lon, round(avg(value), 6) AS value FROM cube WHERE variable IN ('A', 'N') AND realization = 3 GROUP BY ALL")
def fil1_2(spark, d):
    return B.cube(spark, d).where("variable IN ('A', 'N') AND realization = 3").drop("realization").groupBy("variable", "lat", "lon").agg(F.avg("value").alias("value"))


@query("fil19_coarser_grid", f"""WITH {B.CUBE}, {B.COARSE}, f AS (SELECT CAST(month(time) AS INTEGER) AS k, lat, lon, avg(value) AS value FROM (SELECT time, CAST(floor((lat + 90) / 30) * 30 - 75 AS DOUBLE) AS a, CAST(floor(lon / 90) * 90 AS DOUBLE) AS b, value, 0 AS z FROM cube), (SELECT unnest([0, 15]) AS u) g, (SELECT unnest([0, 45]) AS w) h, LATERAL (SELECT a + u AS lat, b + w AS lon) l WHERE a + u <= 75 GROUP BY ALL)
    SELECT 'fine' AS "from", k, lat, lon, round(value, 6) AS value FROM f WHERE (lat + 75) % 30 = 0 AND lon % 90 = 0
    UNION ALL SELECT 'coarse', CAST(k AS INTEGER), lat, lon, round(value, 6) FROM obs""", 6)  # fmt: skip
def fil19(spark, d):
    """Months on a grid of 15 by 45 degrees meet the coarse grid, and are brought onto it."""
    c = B.cube(spark, d).select(F.month("time").alias("k"), (F.floor((F.col("lat") + 90) / 30) * 30 - 75).cast("double").alias("a"), (F.floor(F.col("lon") / 90) * 90).cast("double").alias("b"), "value")
    spread = c.withColumn("u", F.explode(F.array(F.lit(0), F.lit(15)))).withColumn("w", F.explode(F.array(F.lit(0), F.lit(45)))).where("a + u <= 75")
    fine = spread.groupBy("k", (F.col("a") + F.col("u")).alias("lat"), (F.col("b") + F.col("w")).alias("lon")).agg(F.avg("value").alias("value"))
    a, b = regrid.to_coarser(fine, B.observed(spark, d), ["k"])
    return a.select(F.lit("fine").alias("from"), "k", "lat", "lon", "value").unionByName(b.select(F.lit("coarse").alias("from"), "k", "lat", "lon", "value"))


@query("joi2_climatology_anomaly", f"WITH {B.COARSE} SELECT CAST(k AS INTEGER) AS k, lat, lon, round(value - avg(value) OVER (PARTITION BY lat, lon, k % 12), 6) AS value FROM obs")
def joi2(spark, d):
    return W.climatology_anomaly(B.observed(spark, d), ["lat", "lon"], F.col("k") % 12)


@query("joi6_nearest_index", f"WITH {B.TRACKS} SELECT storm, pt, CAST(least(greatest(ceil((lat + 90) / 2.5 - 0.5), 0), 72) AS INTEGER) AS lat_index FROM points")
def joi6(spark, d):
    from ..operators.detect import nearest_index

    axis = spark.range(73).select(F.col("id").cast("int").alias("i"), (F.col("id") * 2.5 - 90).cast("double").alias("value"))
    return nearest_index(B.track_points(spark, d), axis, "lat").select("storm", "pt", "lat_index")


@query("srt3_first_last_valid", f"WITH {B.HOURLY} SELECT variable, CAST(min(k) FILTER (k % 11 > 4) AS INTEGER) AS first, CAST(max(k) FILTER (k % 11 > 4) AS INTEGER) AS last FROM hourly GROUP BY variable")
def srt3(spark, d):
    gaps = B.hourly(spark, d).withColumn("value", F.when(F.col("k") % 11 > 4, F.col("value")))
    return W.first_last_valid(gaps, ["variable"])


@query("srt4_top_modes", digits=5)
def srt4(spark, d):
    return eof.fit(_embedded(spark, d, 64), 10)[0].orderBy(F.desc("eigval")).limit(2)


@query("agg24_yearly_activity", f"""WITH {B.HOURLY}, {PCS}, y AS (SELECT k // 168 AS y, {PHASE} AS phase, avg(sqrt(pc1*pc1 + pc2*pc2)) AS a, count(*) AS n FROM pcs GROUP BY ALL)
    SELECT phase, round(avg(a), 6) AS amplitude, round(avg(n), 6) AS days FROM y GROUP BY phase""")  # fmt: skip
def agg24(spark, d):
    return W.yearly_activity(_pcs(spark, d), F.floor(F.col("k") / 168))


@query("agg40_mean_with_least_hits", f"WITH {B.TRACKS} SELECT dataset, CAST(trunc((lat + 90) / 10) AS INTEGER) AS i, CAST(trunc(lon / 10) AS INTEGER) % 36 AS j, round(avg(wind), 6) AS wind_mean FROM points GROUP BY ALL HAVING count(*) >= 5")
def agg40(spark, d):
    return T.density(B.track_points(spark, d), 10.0).where("hits >= 5").select("dataset", "i", "j", "wind_mean")


@query("agg46_interannual_std", f"WITH {B.CUBE}, y AS (SELECT variable, year(time) AS y, avg(value) AS v FROM cube GROUP BY ALL) SELECT variable, round(stddev_pop(v), 6) AS spread FROM y GROUP BY variable")
def agg46(spark, d):
    yearly = B.cube(spark, d).groupBy("variable", F.year("time").alias("y")).agg(F.avg("value").alias("v"))
    return yearly.groupBy("variable").agg(F.stddev_pop("v").alias("spread"))


@query("agg48_spread_norm", f"WITH {B.COARSE}, s AS (SELECT lon, stddev_pop(v) AS s FROM (SELECT k, lon, avg(value) AS v FROM obs GROUP BY ALL) GROUP BY lon) SELECT CAST(k AS INTEGER) AS k, lon, round(v / (SELECT avg(s) FROM s), 6) AS value FROM (SELECT k, lon, avg(value) AS v FROM obs GROUP BY ALL)")
def agg48(spark, d):
    m = B.observed(spark, d).groupBy("k", "lon").agg(F.avg("value").alias("v"))
    s = m.groupBy("lon").agg(F.stddev_pop("v").alias("s")).agg(F.avg("s")).first()[0]  # one number
    return m.select("k", "lon", (F.col("v") / F.lit(s)).alias("value"))


@query("src10_best_track", "SELECT CAST(user_id AS BIGINT) AS storm, event_id AS step, CASE WHEN event_id % 360 - 180 < 0 THEN CAST(event_id % 360 - 180 + 360 AS DOUBLE) ELSE CAST(event_id % 360 - 180 AS DOUBLE) END AS lon, round(value / 1.94384449, 6) AS wind, round((1000 - value / 10) * 100, 6) AS psl FROM events")
def src10(spark, d):
    e = B.table(spark, d, "events")
    raw = e.select(
        F.col("user_id").alias("storm"), F.col("event_id").alias("step"), F.year("ts").alias("season"), F.col("ts").alias("time"), F.lit(10.0).alias("lat"),
        (F.col("event_id") % 360 - 180).cast("double").alias("lon"), F.col("value").alias("wind_kt"), (1000 - F.col("value") / 10).alias("pres_hpa"),
    )
    return files.best_track(raw, "plain").select("storm", "step", "lon", "wind", "psl")


@query("val2_monotone", """WITH x AS (SELECT 'lat' AS subject, n_nationkey AS n, CAST(n_nationkey AS DOUBLE) AS v FROM nation UNION ALL SELECT 'lon', n_nationkey, n_nationkey % 3 FROM nation),
    s AS (SELECT subject, sign(v - lag(v) OVER (PARTITION BY subject ORDER BY n)) AS s FROM x)
    SELECT 'monotone' AS "check", subject, 'error' AS severity, 'not strictly monotone' AS detail FROM s WHERE s IS NOT NULL GROUP BY subject HAVING NOT (min(s) = max(s) AND min(s) <> 0)""")  # fmt: skip
def val2(spark, d):
    e = B.table(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("double").alias("lat"), (F.col("n_nationkey") % 3).cast("double").alias("lon"))
    return validate.report([validate.monotone(e, "lat", "n_nationkey"), validate.monotone(e, "lon", "n_nationkey")])


@query("val3_normal_time", "SELECT l_returnflag AS variable, CAST(count(DISTINCT l_shipdate) AS BIGINT) AS days, CAST(max(hour(l_shipdate)) AS INTEGER) AS hours FROM (SELECT l_returnflag, date_trunc('day', l_shipdate) AS l_shipdate FROM lineitem) GROUP BY l_returnflag")
def val3(spark, d):
    noon = B.cube(spark, d).withColumn("time", F.expr("time + interval 12 hours"))
    return validate.normal_time(noon).groupBy("variable").agg(F.count_distinct("time").alias("days"), F.max(F.hour("time")).alias("hours"))


@query("val9_normal_units", "SELECT n_nationkey, regexp_replace('kg m-2 s-' || n_nationkey, '([A-Za-z])(-?[0-9]+)', '\\1**\\2', 'g') AS units FROM nation")
def val9(spark, d):
    return B.table(spark, d, "nation").select("n_nationkey", E.normal_units(F.concat(F.lit("kg m-2 s-"), F.col("n_nationkey").cast("string"))).alias("units"))


@query("spe3_taper", "SELECT CAST(n AS INTEGER) AS k, round(CASE WHEN n < 6 THEN 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n / 9) WHEN n >= 92 THEN 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (n - 86) / 9) ELSE 1 END, 6) AS weight FROM (SELECT unnest(range(0, 96)) AS n)")
def spe3(spark, d):
    return spark.createDataFrame([(k, float(w)) for k, w in enumerate(spectrum.taper(96))], "k int, weight double")


@query("spe9_latitude_mean", f"WITH {SPECTRUM_SQL} SELECT variable, wavenumber, round(frequency, 6) AS frequency, round(avg(power), 6) AS power FROM spec GROUP BY ALL")
def spe9(spark, d):
    return spectrum.latitude_aggregate(_spectrum(spark, d), ["variable"], "mean")


@query("eof14_scaled_loadings", digits=4)
def eof14(spark, d):
    modes, loads = eof.fit(_embedded(spark, d, 64), 2)
    return eof.scaled(loads, modes)


@query("eof8_projection_on_observed", digits=4)
def eof8(spark, d):
    long = _embedded(spark, d, 64)
    modes, loads = eof.fit(long.where("sample % 2 = 0"), 2)
    return eof.standard(eof.project(long.where("sample % 2 = 1"), loads), modes)


@query("plt5_score_table", f"""WITH {B.COARSE}, m AS (SELECT 'member ' || realization AS "row", avg(value) AS mean, stddev_pop(value) AS spread FROM sim GROUP BY realization),
    l AS (SELECT "row", 'mean' AS "column", mean AS value FROM m UNION ALL SELECT "row", 'spread', spread FROM m), h AS (SELECT "column", max(abs(value)) AS hi FROM l WHERE "row" <> 'member 1' GROUP BY "column")
    SELECT "row", l."column", round(value, 6) AS value, round(-hi, 6) AS lo, round(hi, 6) AS hi FROM l JOIN h USING ("column")""")  # fmt: skip
def plt5(spark, d):
    from . import plots

    m = B.simulated(spark, d).groupBy(F.concat(F.lit("member "), F.col("realization").cast("string")).alias("row")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
    return plots.score_table(m.unpivot(["row"], ["mean", "spread"], "column", "value"), "member 1")


@query("plt8_spectrum_with_curves", digits=5)
def plt8(spark, d):
    from . import plots

    return plots.spectrum(_spectrum(spark, d).where("variable = 'view'"), W.dispersion(spark))


@query("plt23_track_lines", f"WITH {B.TRACKS}, s AS (SELECT dataset, storm, arg_min(year, pt) AS year, max(wind) AS w, count(*) * 0.25 AS tcd FROM points GROUP BY ALL), y AS (SELECT dataset, year, CAST(count(*) AS DOUBLE) AS count, sum(tcd) AS tcd FROM s GROUP BY ALL) SELECT dataset, year, 'count' AS metric, round(count, 5) AS value FROM y UNION ALL SELECT dataset, year, 'tcd', round(CAST(tcd AS DOUBLE), 5) FROM y", 5)
def plt23(spark, d):
    from . import plots

    y = T.yearly(T.storm_stats(B.track_points(spark, d))).select("dataset", "year", "count", "tcd")
    return plots.lines(y, "year", ["count", "tcd"])


@query("src6_7_detect_and_stitch", digits=4)
def src67(spark, d):
    """Detection on a made field: suppliers' storms that drift with the hours."""
    from ..operators import detect

    rows = B.dealt(B.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(11))))

    def off(rows):
        s, k = rows["s_suppkey"].to_numpy(), rows["step"].to_numpy()
        return [np.full(len(k), 8.1), k * 0.5, s % 11], [np.full(len(k), 100.1), k]

    def fields(rows, r2):
        return {"psl": 101000 - 3000 * np.exp(-r2 / 4), "thickness": 4000 + 30 * np.exp(-r2 / 9), "wind": 5 + 30 * np.exp(-r2 / 16)}

    grids = detect.Reading(rows, B.made(np.arange(-5.0, 31), np.arange(90.0, 126), off, fields))
    nodes = detect.detect_nodes(grids, ["s_suppkey", "step"])
    place = F.row_number().over(Window.partitionBy("s_suppkey", "step").orderBy("lat", "lon"))  # 36 x 36 at most
    nodes = nodes.withColumn("node", (F.col("s_suppkey").cast("long") * 12 + F.col("step")) * 2000 + place)
    return detect.stitch_nodes(nodes, keys=("s_suppkey",)).select("s_suppkey", "track", "pt", "step", "lat", "lon", "psl", "wind")


# --- evaluations ------------------------------------------------------------------------


def _iso(spark, d):
    from . import evaluations

    return evaluations.iso(B.daily(spark, d, "A"), B.daily(spark, d, "R"), years=(1995, 2001), correct=True)


@query("ev_iso_components", digits=4)
def ev_iso_components(spark, d):
    return _iso(spark, d)["pcs_sim"].select("season", "sample", "mode", F.abs("std").alias("std"))


@query("ev_iso_skill", digits=4)
def ev_iso_skill(spark, d):
    return _iso(spark, d)["skill"]


@query("src14_prepared_observations", digits=4)
def src14(spark, d):
    """Observations prepared and saved, and a simulation evaluated from what was saved."""
    from . import evaluations, prepared

    path = scratch(spark, "prepared")
    prepared.prepare_iso(B.daily(spark, d, "R"), path, (1995, 2001))
    return evaluations.iso(B.daily(spark, d, "A"), prepared.load_iso(spark, path), correct=True)["skill"]


@query("ev_iso_monthly_share", digits=6)
def ev_iso_freq(spark, d):
    t = _iso(spark, d)
    return t["freq_sim"].withColumn("dataset", F.lit("sim")).union(t["freq_obs"].withColumn("dataset", F.lit("obs")))


def _mjo(spark, d):
    from . import evaluations
    from .config import MJOConfig

    return evaluations.mjo(B.hourly_field(spark, d, 1), B.hourly_field(spark, d, 0), MJOConfig(wavenumber=(0, 3), frequency=(1 / 48, 1 / 4), deciding="view"), 24)


@query("ev_mjo_ceof_scores", digits=4)
def ev_mjo_ceof(spark, d):
    return _mjo(spark, d)["ceof_scores"]


@query("ev_mjo_ceof_corr", digits=4)
def ev_mjo_corr(spark, d):
    return _mjo(spark, d)["ceof_corr"]


@query("ev_mjo_lead_lag", digits=4)
def ev_mjo_lead_lag(spark, d):
    return _mjo(spark, d)["lead_lag"]


@query("ev_mjo_activity", digits=4)
def ev_mjo_activity(spark, d):
    return _mjo(spark, d)["activity"]


@query("ev_mjo_power_scores", digits=4)
def ev_mjo_power(spark, d):
    return _mjo(spark, d)["power_scores"]


def _tc(spark, d):
    from . import evaluations
    from .config import TCConfig

    return evaluations.tc(B.seasonal_tracks(spark, d), "control", {"control": 2.0, "model": 4.0}, TCConfig(bin=30.0))


STORMS_SQL = """s AS (SELECT dataset, storm, day(arg_min(ts, pt)) % 12 + 1 AS month, arg_min(year, pt) AS year, arg_min(lat, pt) AS gen_lat, count(*) * 0.25 AS tcd, sum(1e-4 * pow(1.94384449 * wind, 2)) AS ace,
    arg_min(abs(lat), (-wind, pt)) AS lmi, max(wind) AS w FROM points GROUP BY ALL HAVING max(wind) >= 10), n AS (SELECT * FROM (VALUES ('control', 2.0::DOUBLE), ('model', 4.0::DOUBLE)) v(dataset, years))"""


@query("ev_tc_monthly", f"""WITH {B.TRACKS}, {STORMS_SQL}, e AS (SELECT dataset, years, CAST(unnest(range(1, 13)) AS INTEGER) AS month FROM n)
    SELECT e.dataset, e.month, round(count(s.storm) / any_value(years), 5) AS count, round(coalesce(sum(tcd), 0) / any_value(years), 5) AS tcd, round(coalesce(sum(ace), 0) / any_value(years), 5) AS ace, round(avg(lmi), 5) AS lmi
    FROM e LEFT JOIN s ON s.dataset = e.dataset AND s.month = e.month GROUP BY ALL""", 5)  # fmt: skip
def ev_tc_monthly(spark, d):
    return _tc(spark, d)["monthly"].drop("pace")


@query("ev_tc_clim_bias", f"""WITH {B.TRACKS}, {STORMS_SQL}, y AS (SELECT dataset, year, avg(lmi) AS lmi FROM s GROUP BY ALL), l AS (SELECT dataset, avg(lmi) AS uclim_lmi FROM y GROUP BY ALL),
    c AS (SELECT dataset, count(*) / any_value(years) AS uclim_count, sum(tcd) / any_value(years) AS uclim_tcd, sum(ace) / any_value(years) AS uclim_ace FROM s JOIN n USING (dataset) GROUP BY ALL),
    b AS (SELECT * FROM c JOIN l USING (dataset)), o AS (SELECT * FROM b WHERE dataset = 'control')
    SELECT b.dataset, round(b.uclim_count - CASE WHEN b.dataset = 'control' THEN 0 ELSE o.uclim_count END, 5) AS uclim_count, round(b.uclim_tcd - CASE WHEN b.dataset = 'control' THEN 0 ELSE o.uclim_tcd END, 5) AS uclim_tcd,
     round(b.uclim_ace - CASE WHEN b.dataset = 'control' THEN 0 ELSE o.uclim_ace END, 5) AS uclim_ace, round(b.uclim_lmi - CASE WHEN b.dataset = 'control' THEN 0 ELSE o.uclim_lmi END, 5) AS uclim_lmi FROM b, o""", 5)  # fmt: skip
def ev_tc_clim_bias(spark, d):
    return _tc(spark, d)["clim_bias"].drop("uclim_pace")


@query("ev_tc_storm_bias", f"""WITH {B.TRACKS}, {STORMS_SQL}, b AS (SELECT dataset, avg(tcd) AS storm_tcd, avg(ace) AS storm_ace, avg(lmi) AS storm_lmi, avg(abs(gen_lat)) AS storm_latgen FROM s GROUP BY ALL), o AS (SELECT * FROM b WHERE dataset = 'control')
    SELECT b.dataset, round(b.storm_tcd - CASE WHEN b.dataset = 'control' THEN 0 ELSE o.storm_tcd END, 5) AS storm_tcd, round(b.storm_ace - CASE WHEN b.dataset = 'control' THEN 0 ELSE o.storm_ace END, 5) AS storm_ace,
     round(b.storm_lmi - CASE WHEN b.dataset = 'control' THEN 0 ELSE o.storm_lmi END, 5) AS storm_lmi, round(b.storm_latgen - CASE WHEN b.dataset = 'control' THEN 0 ELSE o.storm_latgen END, 5) AS storm_latgen FROM b, o""", 5)  # fmt: skip
def ev_tc_storm_bias(spark, d):
    return _tc(spark, d)["storm_bias"].drop("storm_pace")


PACE_SQL = f"""kept AS (SELECT * FROM points JOIN (SELECT dataset, storm FROM points GROUP BY ALL HAVING max(wind) >= 10) USING (dataset, storm)), {QUAD.replace("FROM points", "FROM kept")},
    pa AS (SELECT dataset, storm, sum(1e-4 * pow(1.94384449 * (c2*(1010-pres)*(1010-pres) + c1*(1010-pres) + c0), 2)) AS pace FROM kept, co GROUP BY ALL), sp AS (SELECT * FROM s JOIN pa USING (dataset, storm))"""


@query("ev_tc_pressure_energy", f"""WITH {B.TRACKS}, {STORMS_SQL}, {PACE_SQL}, e AS (SELECT dataset, years, CAST(unnest(range(1, 13)) AS INTEGER) AS month FROM n),
    m AS (SELECT e.dataset, e.month, coalesce(sum(pace), 0) / any_value(years) AS monthly FROM e LEFT JOIN sp ON sp.dataset = e.dataset AND sp.month = e.month GROUP BY ALL),
    c AS (SELECT dataset, sum(pace) / any_value(years) AS climatology, avg(pace) AS storm FROM sp JOIN n USING (dataset) GROUP BY ALL)
    SELECT m.dataset, m.month, round(monthly, 3) AS monthly, round(climatology, 3) AS climatology, round(storm, 3) AS storm FROM m JOIN c USING (dataset)""", 3)  # fmt: skip
def ev_tc_pace(spark, d):
    """Energy worked out from pressure, by month, a year and a storm."""
    t = _tc(spark, d)
    clim = t["climatology"].select("dataset", F.col("uclim_pace").alias("climatology"), F.col("storm_pace").alias("storm"))
    return t["monthly"].select("dataset", "month", F.col("pace").alias("monthly")).join(clim, "dataset")


@query("ev_tc_from_fields", f"""WITH {B.TRACKS}, {B.STORM_FIELDS}, p AS (SELECT dataset, CAST(storm AS VARCHAR) AS storm, pt, lat, lon, wind, pres, CAST(day(ts) % 12 + 1 AS INTEGER) AS month FROM points WHERE dataset = 'control' UNION ALL SELECT * FROM found),
    kept AS (SELECT * FROM p JOIN (SELECT dataset, storm FROM p GROUP BY ALL HAVING max(wind) >= 10) USING (dataset, storm)), {QUAD.replace("FROM points", "FROM kept")},
    s AS (SELECT dataset, storm, arg_min(month, pt) AS month, count(*) * 0.25 AS tcd, sum(1e-4 * pow(1.94384449 * wind, 2)) AS ace, sum(1e-4 * pow(1.94384449 * (c2*(1010-pres)*(1010-pres) + c1*(1010-pres) + c0), 2)) AS pace,
     arg_min(abs(lat), (-wind, pt)) AS lmi FROM kept, co GROUP BY ALL),
    n AS (SELECT 'control' AS dataset, 1 AS members UNION ALL SELECT 'model', count(DISTINCT s_suppkey) FROM supplier), e AS (SELECT dataset, members, CAST(unnest(range(1, 13)) AS INTEGER) AS month FROM n)
    SELECT e.dataset, e.month, round(count(s.storm) / any_value(members), 5) AS count, round(coalesce(sum(tcd), 0) / any_value(members), 5) AS tcd, round(coalesce(sum(ace), 0) / any_value(members), 4) AS ace,
     round(coalesce(sum(pace), 0) / any_value(members), 3) AS pace, round(avg(lmi), 5) AS lmi FROM e LEFT JOIN s ON s.dataset = e.dataset AND s.month = e.month GROUP BY ALL""")  # fmt: skip
def ev_tc_from_fields(spark, d):
    """Storms of the suppliers' fields, found, tracked and compared with the events' tracks."""
    from . import storms

    own = B.seasonal_tracks(spark, d).where("dataset = 'control'")
    control = storms.TrackSet(own.withColumn("psl", F.col("pres") * 100))
    t = storms.from_fields(B.storm_fields(spark, d), "model", {"control": control}, wind_factor=0.9)["monthly"]
    digits = {"count": 5, "tcd": 5, "ace": 4, "pace": 3, "lmi": 5}
    return t.select("dataset", "month", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query("ev_tc_temporal_correlation", digits=5)
def ev_tc_temporal(spark, d):
    return _tc(spark, d)["temporal_correlation"]


@query("ev_tc_spatial_correlation", digits=5)
def ev_tc_spatial(spark, d):
    return _tc(spark, d)["spatial_correlation"]


@query("src10_best_track_layouts", """WITH e AS (SELECT user_id AS storm, CAST(event_id AS BIGINT) AS step, CAST(value AS DOUBLE) AS v, CAST(event_id % 360 - 180 AS DOUBLE) AS x FROM events)
    SELECT 'v4' AS layout, storm, step, CASE WHEN x < 0 THEN x + 360 ELSE x END AS lon, round(v / 1.94384449, 5) AS wind, round((1010 - v / 7) * 100, 3) AS psl FROM e
    UNION ALL SELECT 'v3', storm, step, CASE WHEN x < 0 THEN x + 360 ELSE x END, round(v * 0.1 / 1.94384449, 5), round(1010 - v / 7, 3) FROM e""", 5)  # fmt: skip
def src10_layouts(spark, d):
    e = B.table(spark, d, "events").select(F.col("user_id").alias("storm"), F.col("event_id").cast("long").alias("step"), F.lit(2024).alias("season"), F.col("ts").alias("time"), "value", (F.col("event_id") % 360 - 180).cast("double").alias("x"))
    v4 = e.select("storm", "step", "season", "time", F.lit(10.0).alias("lat"), F.col("x").alias("lon"), F.col("value").alias("wmo_wind"), (F.lit(1010.0) - F.col("value") / 7).alias("wmo_pres"))
    v3 = e.select("storm", "step", "season", "time", F.lit(1000.0).alias("lat_wmo"), (F.col("x") * 100).alias("lon_wmo"), F.col("value").alias("wind_wmo"), (F.lit(1010.0) - F.col("value") / 7).alias("pres_wmo"))
    both = [files.best_track(raw, layout).select(F.lit(layout).alias("layout"), "storm", "step", F.round("lon", 6).alias("lon"), "wind", F.round("psl", 3).alias("psl")) for layout, raw in (("v4", v4), ("v3", v3))]
    return both[0].unionByName(both[1])


CELLS_SQL = """pts AS (SELECT c_custkey AS id, CAST((c_custkey * 37) % 179 - 89 AS DOUBLE) AS la, CAST((c_custkey * 101) % 360 AS DOUBLE) AS lo FROM customer),
    cells AS (SELECT s_suppkey AS cell, (s_suppkey * 53) % 177 - 88 + 0.25::DOUBLE AS lat, (s_suppkey * 71) % 360 + 0.125::DOUBLE AS lon FROM supplier)"""


@query("joi6_nearest_on_sphere", f"""WITH {CELLS_SQL}, d AS (SELECT id, cell, degrees(2 * asin(sqrt(least(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2), 1)))) AS distance FROM pts, cells)
    SELECT id, arg_min(cell, (distance, cell)) AS cell, round(min(distance), 5) AS distance FROM d GROUP BY id""", 5)  # fmt: skip
def joi6_sphere(spark, d):
    from ..operators import detect

    pts = B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37) % 179 - 89).cast("double").alias("lat"), ((F.col("c_custkey") * 101) % 360).cast("double").alias("lon"))
    cells = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("cell"), ((F.col("s_suppkey") * 53) % 177 - 88 + F.lit(0.25)).alias("lat"), ((F.col("s_suppkey") * 71) % 360 + F.lit(0.125)).alias("lon"))
    return detect.nearest_cell(pts, cells)


@query("src12_config", "SELECT 'tracks-' || s_suppkey AS file, s_name AS name, s_suppkey % 2 = 0 AS unstructured, CAST(s_nationkey % 5 + 1 AS INTEGER) AS members, CAST(s_suppkey % 40 + 1 AS INTEGER) AS years, s_suppkey / 4.0::DOUBLE AS wind_factor FROM supplier")
def src12(spark, d):
    """Settings written and read again."""
    s = B.table(spark, d, "supplier")
    settings = s.select(F.concat(F.lit("tracks-"), F.col("s_suppkey").cast("string")).alias("file"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 2 == 0).alias("unstructured"), (F.col("s_nationkey") % 5 + 1).cast("int").alias("members"), (F.col("s_suppkey") % 40 + 1).cast("int").alias("years"), (F.col("s_suppkey") / 4).alias("wind_factor"))
    path = scratch(spark, "config")
    files.write_config(settings, path)
    return files.read_config(spark, path)


@query("snk1_3_results", f"WITH {B.COARSE} SELECT CAST(k AS INTEGER) AS k, lat, lon, round(value, 6) AS value FROM obs", 6)
def snk13(spark, d):
    """A result written under its datasets and years, as Parquet and as CSV, and read again."""
    o, base = B.observed(spark, d), scratch(spark, "results")
    path = f"{base}/{files.result_name('obs', ['first one', 'second'], (1995, 2001))}"
    files.write_result(o, path)
    files.write_result(o, f"{path}.csv", kind="csv")
    a, b = spark.read.parquet(path), spark.read.csv(f"{path}.csv", header=True, schema=o.schema)
    return a.join(b.withColumnRenamed("value", "again"), ["k", "lat", "lon"]).where(F.abs(F.col("value") - F.col("again")) < 1e-9).drop("again")


@query("src1_snk4_netcdf", f"""WITH {B.COARSE}, m AS (SELECT k, avg(value) AS mean FROM obs GROUP BY k)
    SELECT CAST(k AS DOUBLE) AS k, lat, lon, round(value, 5) AS value, round(mean, 5) AS mean FROM obs JOIN m USING (k) WHERE lat BETWEEN -45 AND 45 AND k BETWEEN 12 AND 35""", 5)  # fmt: skip
def src1_snk4(spark, d):
    """Two variables written as one NetCDF file by all tasks, and a band of two years read
    of it: limits of latitude and step become ranges of the file."""
    o, path = B.observed(spark, d), f"{scratch(spark, 'bundle')}.nc"
    mean = o.groupBy("k").agg(F.avg("value").alias("value"))
    netcdf_sink.write_netcdf({"tas": netcdf_sink.Table(o, ("k", "lat", "lon"), {"units": "K"}), "mean": netcdf_sink.Table(mean, ("k",))}, path)
    read = lambda v: netcdf.read_netcdf(spark, path, v).where("k BETWEEN 12 AND 35")
    cells = read("tas").where("lat BETWEEN -45 AND 45 AND value IS NOT NULL")
    return cells.join(read("mean").withColumnRenamed("value", "mean"), "k")


DAYS_SQL = """SELECT c AS calendar, row_number() OVER (PARTITION BY c ORDER BY y, m, d) - 1 AS n, y AS year, m AS month, d AS day
    FROM (SELECT unnest(['standard', 'noleap', '360_day', 'julian']) AS c), (SELECT unnest(range(1900, 2101)) AS y), (SELECT unnest(range(1, 13)) AS m), (SELECT unnest(range(1, 32)) AS d)
    WHERE CASE WHEN c = '360_day' THEN d <= 30 WHEN m = 2 THEN d <= 28 + CAST(CASE c WHEN 'noleap' THEN false WHEN 'julian' THEN y % 4 = 0 ELSE y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) END AS INTEGER)
               ELSE d <= 30 + CAST(m NOT IN (4, 6, 9, 11) AS INTEGER) END"""


@query("val3_calendars", f"""WITH o AS (SELECT (l_orderkey * 7 + l_linenumber * 10007) % 72360 AS n, count(*) AS rows FROM lineitem GROUP BY 1), c AS ({DAYS_SQL})
    SELECT calendar, CAST(n AS BIGINT) AS n, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CAST(day AS INTEGER) AS day, rows FROM o JOIN c USING (n)""")  # fmt: skip
def val3_calendars(spark, d):
    """Hours since 1900, spread over two centuries, as dates of four calendars."""
    n = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 10007) % 72360).cast("long").alias("n")
    rows = B.table(spark, d, "lineitem").groupBy(n).agg(F.count(F.lit(1)).alias("rows"))
    names = ("standard", "noleap", "360_day", "julian")
    dates = F.explode(F.array(*[F.struct(F.lit(c).alias("calendar"), calendars.decoded(F.col("n") * 24 + 6, "hours since 1900-01-01 00:00:00", c).alias("x")) for c in names])).alias("y")
    return rows.select("n", "rows", dates).select("y.calendar", "n", "y.x.year", "y.x.month", "y.x.day", "rows")


@query("fun5_arc_points", f"""WITH {B.TRACKS}, s AS (SELECT dataset, storm, pt, radians(lat) AS a, radians(lon) AS b, radians(lead(lat) OVER w) AS c, radians(lead(lon) OVER w) AS d FROM points WINDOW w AS (PARTITION BY dataset, storm ORDER BY pt)),
    g AS (SELECT *, 2 * asin(sqrt(least(pow(sin((c - a) / 2), 2) + cos(a) * cos(c) * pow(sin((d - b) / 2), 2), 1))) AS g FROM s WHERE c IS NOT NULL AND (a <> c OR b <> d)),
    u AS (SELECT *, sin((1 - k / 4.0::DOUBLE) * g) / sin(g) AS u, sin(k / 4.0::DOUBLE * g) / sin(g) AS v FROM g, (SELECT unnest(range(5)) AS k)),
    p AS (SELECT *, u * cos(a) * cos(b) + v * cos(c) * cos(d) AS x, u * cos(a) * sin(b) + v * cos(c) * sin(d) AS y, u * sin(a) + v * sin(c) AS z FROM u)
    SELECT dataset, storm, pt, CAST(k AS INTEGER) AS k, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS lat, round((round(degrees(atan2(y, x)), 4) + 360) % 360, 4) AS lon, round(6371.22 * g / 4, 4) AS spacing FROM p""")  # fmt: skip
def fun5_arc(spark, d):
    """Five points along every step of a track."""
    w = Window.partitionBy("dataset", "storm").orderBy("pt")
    s = B.track_points(spark, d).withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 IS NOT NULL AND (lat <> lat2 OR lon <> lon2)")
    ends = [F.col(c) for c in ("lat", "lon", "lat2", "lon2")]
    s = s.select("dataset", "storm", "pt", E.arc_spacing(*ends, 5, 6371.22).alias("spacing"), F.posexplode(E.arc_points(*ends, 5, signed=True)).alias("k", "p"))
    return s.select("dataset", "storm", "pt", "k", F.round("p.lat", 4).alias("lat"), F.round(F.pmod(F.round("p.lon", 4) + 360, F.lit(360.0)), 4).alias("lon"), F.round("spacing", 4).alias("spacing"))
