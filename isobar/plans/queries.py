"""A query for each operator over the supplied tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import reduce as R
from ..operators import stats as S
from ..operators import tracks as T
from ..operators import windows as W
from . import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def month() -> Column:
    """Of a step in months from a January."""
    return F.col("k") % 12 + 1


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few digits: sums depend on their order beyond these.  Zero has
    no sign."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register; the SQL's last select is given as columns with their rounding."""

    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


W_ = "cos(radians(lat))"


def wmean(x: str, w: str = W_) -> str:
    return f"sum({w} * {x}) / nullif(sum(CASE WHEN {x} IS NOT NULL THEN {w} END), 0)"


# --- reductions -------------------------------------------------------------------


@query("agg1_area_mean_annual", f"WITH {B.CUBE} SELECT variable, CAST(realization AS INTEGER) AS realization, CAST(year(time) AS INTEGER) AS year, round({wmean('value')}, 6) AS value FROM cube GROUP BY ALL", 6)
def agg1(spark, d):
    return R.area_mean(B.cube(spark, d).withColumn("year", F.year("time")), ["variable", "realization", "year"])


@query(
    "agg2_resample_mean",
    f"""WITH {B.CUBE}, daily AS (SELECT variable, realization, time, {wmean('value')} AS v FROM cube GROUP BY ALL)
    SELECT variable, CAST(realization AS INTEGER) AS realization, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month, round(avg(v), 6) AS value FROM daily GROUP BY ALL""",
    6,
)
def agg2(spark, d):
    daily = R.area_mean(B.cube(spark, d), ["variable", "realization", "time"])
    return R.resample(daily, ["variable", "realization"], {"year": F.year("time"), "month": F.month("time")})


@query("agg2_empty_bins", f"""WITH {B.DAYS}, s AS (SELECT lat, lon, k, avg(value) AS value FROM days WHERE variable = 'R' GROUP BY ALL), r AS (SELECT lat, lon, unnest(range(min(k), max(k) + 1)) AS k FROM s GROUP BY lat, lon)
    SELECT lat, lon, CAST(k AS INTEGER) AS k, round(value, 6) AS value FROM r LEFT JOIN s USING (lat, lon, k)""", 6)  # fmt: skip
def agg2_bins(spark, d):
    return R.fill_bins(B.days(spark, d).where("variable = 'R'").groupBy("lat", "lon", "k").agg(F.avg("value").alias("value")), ["lat", "lon"])


@query("agg3_monthly_sum", f"WITH {B.CUBE} SELECT variable, CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month, round(coalesce(sum(value), 0), 2) AS value FROM cube GROUP BY ALL", 2)
def agg3(spark, d):
    return R.monthly_sum(B.cube(spark, d), ["variable"], {"year": F.year("time"), "month": F.month("time")})


MAPS = "maps AS (SELECT variable, lat, lon, avg(v) AS v FROM (SELECT variable, realization, lat, lon, avg(value) AS v FROM cube GROUP BY ALL) GROUP BY ALL)"


@query("agg4_mean_map", f"WITH {B.CUBE}, {MAPS} SELECT variable, lat, lon, round(v, 6) AS value FROM maps", 6)
def agg4(spark, d):
    return R.mean_map(B.cube(spark, d), ["variable"])


@query("agg5_difference_map", f"WITH {B.CUBE}, {MAPS} SELECT a.lat, a.lon, round(a.v - r.v, 6) AS value FROM (SELECT * FROM maps WHERE variable = 'A') a JOIN (SELECT * FROM maps WHERE variable = 'R') r USING (lat, lon)", 6)
def agg5(spark, d):
    return R.difference_map(B.cube(spark, d), "A", "R").where("value IS NOT NULL")


@query("fil10_replaced", f"""WITH {B.CUBE}, {MAPS} SELECT a.lat, a.lon, round(CASE WHEN a.lat < -60 THEN 1e-6 ELSE a.v - r.v END, 6) AS value
    FROM (SELECT * FROM maps WHERE variable = 'A') a JOIN (SELECT * FROM maps WHERE variable = 'R') r USING (lat, lon)""")  # fmt: skip
def fil10(spark, d):
    masked = B.cube(spark, d).withColumn("value", F.when(F.col("lat") >= -60, F.col("value")))
    return R.difference_map(masked, "A", "R", substitute=True).join(R.difference_map(B.cube(spark, d), "A", "R").where("value IS NOT NULL").select("lat", "lon"), ["lat", "lon"], "left_semi")


@query("agg6_bias_map", f"""WITH {B.COARSE} SELECT lat, lon, round(s.v - o.v, 6) AS value FROM (SELECT lat, lon, avg(v) AS v FROM (SELECT realization, lat, lon, avg(value) AS v FROM sim GROUP BY ALL) GROUP BY ALL) s
    JOIN (SELECT lat, lon, avg(value) AS v FROM obs GROUP BY ALL) o USING (lat, lon)""", 6)  # fmt: skip
def agg6(spark, d):
    return R.bias_map(B.simulated(spark, d), B.observed(spark, d))


CLIM = "clim AS (SELECT lat, lon, avg(value) AS m, stddev_pop(value) AS s, sqrt(var_pop(value) * count(value) / nullif(count(*) - 1, 0)) AS c FROM obs GROUP BY ALL)"
CRMSE = """sa AS (SELECT *, value - avg(value) OVER (PARTITION BY realization, lat, lon) AS a, count(*) OVER (PARTITION BY realization, lat, lon) AS t FROM sim),
oa AS (SELECT *, value - avg(value) OVER (PARTITION BY lat, lon) AS b FROM obs),
crmse AS (SELECT sa.realization, sa.lat, sa.lon, sqrt(sum((a - b) * (a - b)) / nullif(max(t) - 1, 0)) AS v FROM sa JOIN oa ON sa.k = oa.k AND sa.lat = oa.lat AND sa.lon = oa.lon GROUP BY ALL)"""


@query("agg7_rk_score", f"WITH {B.COARSE}, {CLIM} SELECT CAST(realization AS INTEGER) AS realization, round(sqrt({wmean('exp(-pow((value - m) / nullif(s, 0), 2))')}), 6) AS value FROM sim JOIN clim USING (lat, lon) GROUP BY realization")
def agg7(spark, d):
    return R.rk_score(B.simulated(spark, d), B.observed(spark, d))


@query("agg8_crms", f"WITH {B.COARSE}, {CLIM} SELECT lat, lon, round(c, 6) AS value FROM clim", 6)
def agg8(spark, d):
    return R.crms(B.observed(spark, d), R.CELL)


@query("agg9_crmse", f"WITH {B.COARSE}, {CRMSE} SELECT CAST(realization AS INTEGER) AS realization, lat, lon, round(v, 6) AS value FROM crmse", 6)
def agg9(spark, d):
    return R.crmse(B.simulated(spark, d), B.observed(spark, d))


@query("agg10_bias_score", f"WITH {B.COARSE}, {CLIM} SELECT CAST(realization AS INTEGER) AS realization, round({wmean('exp(-abs(value - m) / nullif(c, 0))')}, 6) AS value FROM sim JOIN clim USING (lat, lon) GROUP BY realization")
def agg10(spark, d):
    return R.bias_score(B.simulated(spark, d), B.observed(spark, d))


@query("agg11_rmse_score", f"WITH {B.COARSE}, {CLIM}, {CRMSE} SELECT CAST(realization AS INTEGER) AS realization, round({wmean('exp(-v / nullif(c, 0))')}, 6) AS value FROM crmse JOIN clim USING (lat, lon) GROUP BY realization")
def agg11(spark, d):
    return R.rmse_score(B.simulated(spark, d), B.observed(spark, d))


@query("agg12_absolute_bias", f"WITH {B.COARSE}, {CLIM}, m AS (SELECT realization, lat, lon, avg(value) AS v FROM sim GROUP BY ALL) SELECT CAST(realization AS INTEGER) AS realization, round({wmean('abs(v - m)')}, 6) AS value FROM m JOIN clim USING (lat, lon) GROUP BY realization".replace("abs(v - m)", "abs(m.v - clim.m)"))
def agg12(spark, d):
    return R.absolute_bias(B.simulated(spark, d), B.observed(spark, d))


@query("agg13_absolute_rmse", f"WITH {B.COARSE}, {CRMSE} SELECT CAST(realization AS INTEGER) AS realization, round({wmean('v')}, 6) AS value FROM crmse GROUP BY realization", 6)
def agg13(spark, d):
    return R.absolute_rmse(B.simulated(spark, d), B.observed(spark, d))


def _pairs(spark, d):
    """Member means against the observed mean, by cell."""
    s = B.simulated(spark, d).groupBy("realization", *R.CELL).agg(F.avg("value").alias("x"))
    return s.join(B.observed(spark, d).groupBy(*R.CELL).agg(F.avg("value").alias("y")), R.CELL)


PAIRS = "pairs AS (SELECT s.realization, lat, lon, x, y FROM (SELECT realization, lat, lon, avg(value) AS x FROM sim GROUP BY ALL) s JOIN (SELECT lat, lon, avg(value) AS y FROM obs GROUP BY ALL) o USING (lat, lon))"
MOMENTS = f"mom AS (SELECT realization, sum({W_}) AS sw, sum({W_}*x)/sum({W_}) AS mx, sum({W_}*y)/sum({W_}) AS my, sum({W_}*x*x)/sum({W_}) AS xx, sum({W_}*y*y)/sum({W_}) AS yy, sum({W_}*x*y)/sum({W_}) AS xy FROM pairs GROUP BY ALL)"


@query("agg14_pattern_correlation", f"WITH {B.COARSE}, {PAIRS}, {MOMENTS} SELECT CAST(realization AS INTEGER) AS realization, round((xy - mx*my) / sqrt((xx - mx*mx) * (yy - my*my)), 5) AS value FROM mom", 5)
def agg14(spark, d):
    return R.pattern_correlation(_pairs(spark, d), ["realization"])


@query("agg14_pattern_correlation_uncentred", f"WITH {B.COARSE}, {PAIRS}, {MOMENTS} SELECT CAST(realization AS INTEGER) AS realization, round(xy / sqrt(xx * yy), 6) AS value FROM mom")
def agg14u(spark, d):
    return R.pattern_correlation(_pairs(spark, d), ["realization"], centred=False)


@query("agg15_weighted_rmse", f"WITH {B.COARSE}, {PAIRS} SELECT CAST(realization AS INTEGER) AS realization, round(sqrt(sum({W_}*(x-y)*(x-y))/sum({W_})), 6) AS value FROM pairs GROUP BY realization", 6)
def agg15(spark, d):
    return R.weighted_rmse(_pairs(spark, d), ["realization"])


@query("agg16_taylor", f"""WITH {B.COARSE}, {PAIRS}, {MOMENTS}, t AS (SELECT realization, (xy - mx*my) / sqrt((xx - mx*mx) * (yy - my*my)) AS r, sqrt((xx - mx*mx) / (yy - my*my)) AS s, mx, my, xx - mx*mx AS vx, yy - my*my AS vy FROM mom)
    SELECT CAST(realization AS INTEGER) AS realization, round(r, 3) AS pattern_cor, round(s, 3) AS ratio, round(100*(mx-my)/my, 3) AS bias, round(mx, 3) AS xmean, round(my, 3) AS ymean, round(sqrt(vx), 3) AS xstd, round(sqrt(vy), 3) AS ystd, round(sqrt(greatest(1 + s*s - 2*s*r, 0)), 3) AS rmse FROM t""", 3)  # fmt: skip
def agg16(spark, d):
    return R.taylor(_pairs(spark, d), ["realization"]).withColumns({"xstd": F.sqrt("xvar"), "ystd": F.sqrt("yvar")}).drop("xvar", "yvar")


SECTIONS = """ms AS (SELECT CASE WHEN m IN (12,1,2) THEN 'DJF' WHEN m IN (3,4,5) THEN 'MAM' WHEN m IN (6,7,8) THEN 'JJA' ELSE 'SON' END AS season, m FROM (SELECT unnest(range(1, 13)) AS m) UNION ALL SELECT 'All', unnest(range(1, 13))),
rg AS (SELECT 'Global' AS region, -90 AS a, 90 AS b, false AS out UNION ALL SELECT 'Tropics', -30, 30, false UNION ALL SELECT 'Extratropics', -30, 30, true),
fs AS (SELECT season, region, s.* FROM sim s JOIN ms ON ms.m = s.k % 12 + 1 JOIN rg ON (s.lat BETWEEN rg.a AND rg.b) <> rg.out),
fo AS (SELECT season, region, s.* FROM obs s JOIN ms ON ms.m = s.k % 12 + 1 JOIN rg ON (s.lat BETWEEN rg.a AND rg.b) <> rg.out)"""


@query("agg19_season_region_scores", f"""WITH {B.COARSE}, {SECTIONS},
    cl AS (SELECT season, region, lat, lon, avg(value) AS m, stddev_pop(value) AS s, sqrt(var_pop(value) * count(*) / nullif(count(*) - 1, 0)) AS c FROM fo GROUP BY ALL),
    a AS (SELECT *, value - avg(value) OVER (PARTITION BY season, region, realization, lat, lon) AS a, count(*) OVER (PARTITION BY season, region, realization, lat, lon) AS t FROM fs),
    b AS (SELECT *, value - avg(value) OVER (PARTITION BY season, region, lat, lon) AS b FROM fo),
    e AS (SELECT a.season, a.region, a.realization, a.lat, a.lon, sqrt(sum((a - b) * (a - b)) / nullif(max(t) - 1, 0)) AS e FROM a JOIN b ON a.season = b.season AND a.region = b.region AND a.k = b.k AND a.lat = b.lat AND a.lon = b.lon GROUP BY ALL),
    m AS (SELECT season, region, realization, lat, lon, avg(value) AS v FROM fs GROUP BY ALL),
    sc AS (SELECT realization, season, region, sqrt({wmean('exp(-pow((v - cl.m) / nullif(s, 0), 2))')}) AS rk, {wmean('exp(-abs(v - cl.m) / nullif(c, 0))')} AS bi, {wmean('exp(-e / nullif(c, 0))')} AS rm FROM m JOIN cl USING (season, region, lat, lon) LEFT JOIN e USING (season, region, realization, lat, lon) GROUP BY ALL)
    SELECT CAST(realization AS INTEGER) AS realization, season, region, metric, round(CASE metric WHEN 'RK08' THEN rk WHEN 'Bias' THEN bi WHEN 'RMSE' THEN rm ELSE (rk + bi + rm) / 3 END, 6) AS score
    FROM sc, (SELECT unnest(['RK08', 'Bias', 'RMSE', 'Combined']) AS metric)""")  # fmt: skip
def agg19(spark, d):
    return R.season_region_scores(B.simulated(spark, d), B.observed(spark, d), month())


@query("agg17_18_ensemble_scores", f"""WITH {B.COARSE}, {CLIM}, {CRMSE}, r AS (SELECT realization, {wmean('exp(-v / nullif(c, 0))')} AS v FROM crmse JOIN clim USING (lat, lon) GROUP BY realization),
    b AS (SELECT realization, {wmean('exp(-abs(value - m) / nullif(c, 0))')} AS v FROM sim JOIN clim USING (lat, lon) GROUP BY realization)
    SELECT round(avg(r.v), 6) AS rmse, round(avg(b.v), 6) AS bias, round(avg((r.v + b.v) / 2), 6) AS combined FROM r JOIN b USING (realization)""")  # fmt: skip
def agg17(spark, d):
    s, o = B.simulated(spark, d), B.observed(spark, d)
    both = R.rmse_score(s, o).withColumnRenamed("value", "r").join(R.bias_score(s, o).withColumnRenamed("value", "b"), "realization")
    return both.agg(F.avg("r").alias("rmse"), F.avg("b").alias("bias"), F.avg((F.col("r") + F.col("b")) / 2).alias("combined"))


# --- filters, sets, scalar functions --------------------------------------------------


@query("fil3_year_slice", f"WITH {B.CUBE} SELECT variable, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS value FROM cube WHERE time >= TIMESTAMP '1996-01-01' AND time < TIMESTAMP '1999-01-01' GROUP BY variable", 6)
def fil3(spark, d):
    cut = B.cube(spark, d).where("time >= timestamp_ntz'1996-01-01' AND time < timestamp_ntz'1999-01-01'")
    return cut.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))


@query("fil4_5_6_season_region", f"""WITH {B.CUBE}, c AS (SELECT *, CASE WHEN month(time) IN (12,1,2) THEN 'DJF' WHEN month(time) IN (3,4,5) THEN 'MAM' WHEN month(time) IN (6,7,8) THEN 'JJA' ELSE 'SON' END AS s, CASE WHEN lat BETWEEN -30 AND 30 THEN 'Tropics' ELSE 'Extratropics' END AS r FROM cube),
    f AS (SELECT season, region, c.* FROM c, (SELECT unnest(['All','DJF','MAM','JJA','SON']) AS season), (SELECT unnest(['Global','Tropics','Extratropics']) AS region) WHERE (season = 'All' OR season = s) AND (region = 'Global' OR region = r))
    SELECT season, region, variable, round({wmean('value')}, 6) AS value, round(stddev_pop(value), 6) AS spread FROM f GROUP BY ALL""", 6)  # fmt: skip
def fil456(spark, d):
    f = R.fan_out(B.cube(spark, d), F.month("time"))
    return f.groupBy("season", "region", "variable").agg(E.weighted_mean("value", E.weight()).alias("value"), F.stddev_pop("value").alias("spread"))


@query("fil7_season_block", f"""WITH {B.CUBE}, b AS (SELECT *, CASE WHEN month(time) = 12 THEN year(time) WHEN month(time) <= 4 THEN year(time) - 1 END AS w, CASE WHEN month(time) BETWEEN 6 AND 10 THEN year(time) END AS s FROM cube)
    SELECT 'winter' AS season, CAST(w AS INTEGER) AS block, CAST(count(DISTINCT time) AS BIGINT) AS days FROM b WHERE w >= 1995 AND w < 2001 GROUP BY w HAVING count(DISTINCT time) >= 90
    UNION ALL SELECT 'summer', CAST(s AS INTEGER), CAST(count(DISTINCT time) AS BIGINT) FROM b WHERE s >= 1995 AND s < 2001 GROUP BY s HAVING count(DISTINCT time) >= 90""")  # fmt: skip
def fil7(spark, d):
    axis = B.cube(spark, d).select("time").distinct()
    days = [W.season_blocks(axis, s, 1995, 2001).groupBy(F.lit(s).alias("season"), "block").agg(F.count(F.lit(1)).alias("days")) for s in W.SEASONS]
    return days[0].union(days[1])


@query("fil8_drop_leap", f"WITH {B.CUBE} SELECT CAST(year(time) AS INTEGER) AS year, CAST(count(*) AS BIGINT) AS n FROM cube WHERE NOT (month(time) = 2 AND day(time) = 29) GROUP BY ALL")
def fil8(spark, d):
    return W.without_leap_days(B.cube(spark, d)).groupBy(F.year("time").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("fil13_14_basin", f"""WITH {B.TRACKS}, g AS (SELECT dataset, storm, arg_min(lat, pt) AS lat, arg_min(lon, pt) AS x FROM points GROUP BY ALL),
    b AS (SELECT *, CASE WHEN abs(lat) > 50 THEN 0 WHEN lat >= 0 THEN CASE WHEN x > 257 AND x <= 359 THEN CASE WHEN lat > -0.58::DOUBLE*x+171.1 THEN 1 ELSE 2 END WHEN x > 220 AND x <= 257 THEN 2 WHEN x > 180 AND x <= 220 THEN 3 WHEN x > 100 AND x <= 180 THEN 4 WHEN x > 30 AND x <= 100 THEN 5 ELSE 0 END
     ELSE CASE WHEN x > 30 AND x <= 135 THEN 6 WHEN x > 135 AND x <= 290 THEN 7 ELSE 0 END END AS basin FROM g)
    SELECT dataset, CAST(basin AS INTEGER) AS basin, CASE basin WHEN 1 THEN 'NATL' WHEN 2 THEN 'EPAC' WHEN 3 THEN 'CPAC' WHEN 4 THEN 'WPAC' WHEN 5 THEN 'NIO' WHEN 6 THEN 'SIO' WHEN 7 THEN 'SPAC' END AS name, CAST(count(*) AS BIGINT) AS storms FROM b GROUP BY ALL""")  # fmt: skip
def fil13(spark, d):
    s = T.storm_stats(B.track_points(spark, d)).withColumn("basin", E.basin("gen_lat", "gen_lon"))
    return s.groupBy("dataset", "basin", E.basin_name("basin").alias("name")).agg(F.count(F.lit(1)).alias("storms"))


@query("fil15_track_wind", f"WITH {B.TRACKS} SELECT dataset, storm, CAST(count(*) AS BIGINT) AS points, round(max(wind), 6) AS wind FROM points GROUP BY dataset, storm HAVING max(wind) >= 40")
def fil15(spark, d):
    return T.by_wind(B.track_points(spark, d), 40.0).groupBy("dataset", "storm").agg(F.count(F.lit(1)).alias("points"), F.max("wind").alias("wind"))


@query("fil12_storm_time", f"WITH {B.TRACKS}, g AS (SELECT dataset, storm, arg_min(day(ts), pt) AS d FROM points GROUP BY ALL) SELECT dataset, CAST(count(*) AS BIGINT) AS storms FROM g WHERE d <= 31 GROUP BY dataset")
def fil12(spark, d):
    kept = T.by_time(B.track_points(spark, d), (1, 1), (2024, 2024))
    return kept.groupBy("dataset").agg(F.count_distinct("storm").alias("storms"))


@query("fil16_17_18_masks", f"""WITH {B.TRACKS}, m AS (SELECT dataset, storm, pt, CASE WHEN (dataset = 'control' AND wind <= 17.5) OR hour(ts) % 6 <> 0 OR minute(ts) <> 0 THEN NULL ELSE wind END AS w, CASE WHEN hour(ts) % 6 <> 0 OR minute(ts) <> 0 THEN NULL ELSE lat END AS lat FROM points),
    q AS (SELECT dataset, storm, count(CASE WHEN w IS NOT NULL AND lat IS NOT NULL THEN 1 END) AS n, max(w) AS x FROM m GROUP BY ALL)
    SELECT dataset, CAST(count(*) AS BIGINT) AS storms FROM q WHERE n > 0 AND x >= 10 GROUP BY dataset""")  # fmt: skip
def fil1618(spark, d):
    p = T.six_hourly(T.mask_weak(B.track_points(spark, d), "control"))
    return T.long_enough(p, 10.0, 0).groupBy("dataset").agg(F.count_distinct("storm").alias("storms"))


@query("fun3_pressure_wind", """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1.0 ELSE 1010 - value / 10 END AS p, CASE WHEN event_id % 4 = 0 THEN -1.0 ELSE value / 8 END AS w FROM events)
    SELECT event_id, round(CASE WHEN p < 0 AND w < 0 THEN 1008.0 WHEN p < 0 THEN 1010 - sign(w / 2.3) * pow(abs(w / 2.3), 1 / 0.76) ELSE p END, 6) AS pres,
           round(CASE WHEN p < 0 AND w < 0 THEN 15.0 WHEN w < 0 THEN 2.3 * sign(1010 - p) * pow(abs(1010 - p), 0.76) ELSE w END, 6) AS wind FROM e""")  # fmt: skip
def fun3(spark, d):
    e = B.table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, -1.0).otherwise(1010 - F.col("value") / 10).alias("p"), F.when(F.col("event_id") % 4 == 0, -1.0).otherwise(F.col("value") / 8).alias("w")
    )
    return e.select("event_id", E.filled_pressure("p", "w").alias("pres"), E.filled_wind("p", "w").alias("wind"))


@query("fun5_great_circle", f"""WITH {B.TRACKS}, s AS (SELECT storm, pt, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM points WINDOW w AS (PARTITION BY dataset, storm ORDER BY pt))
    SELECT storm, pt, round(2 * 6371.22 * asin(sqrt(least(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2), 1))), 5) AS km FROM s WHERE lat2 IS NOT NULL""", 5)  # fmt: skip
def fun5(spark, d):
    w = Window.partitionBy("dataset", "storm").orderBy("pt")
    s = B.track_points(spark, d).withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 IS NOT NULL")
    return s.select("storm", "pt", E.great_circle(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"), 6371.22).alias("km"))


@query("fun15_effect_class", f"""WITH {B.CUBE}, m AS (SELECT lat, lon, avg(value) FILTER (variable = 'A') AS a, avg(value) FILTER (variable = 'R') AS b, var_pop(value) FILTER (variable = 'A') AS va, var_pop(value) FILTER (variable = 'R') AS vb FROM cube GROUP BY ALL),
    x AS (SELECT abs((a - b) / nullif(sqrt((va + vb) / 2), 0)) AS d FROM m)
    SELECT CASE WHEN d < 0.01 THEN 'none' WHEN d < 0.2 THEN 'very small' WHEN d < 0.5 THEN 'small' WHEN d < 0.8 THEN 'medium' WHEN d < 1.2 THEN 'large' WHEN d < 2 THEN 'very large' ELSE 'huge' END AS class, CAST(count(*) AS BIGINT) AS cells FROM x GROUP BY ALL""")  # fmt: skip
def fun15(spark, d):
    return S.cohen(_samples(spark, d), R.CELL).groupBy(E.effect_class("d").alias("class")).agg(F.count(F.lit(1)).alias("cells"))


@query("set1_4_sets", f"""WITH {B.CUBE} SELECT realization, lat, lon, CAST('only A' AS VARCHAR) AS which FROM (SELECT realization, lat, lon FROM cube WHERE variable = 'A' EXCEPT SELECT realization, lat, lon FROM cube WHERE variable = 'R')
    UNION ALL SELECT realization, lat, lon, 'both' FROM (SELECT realization, lat, lon FROM cube WHERE variable = 'A' INTERSECT SELECT realization, lat, lon FROM cube WHERE variable = 'R')""")  # fmt: skip
def set14(spark, d):
    c = B.cube(spark, d)
    a, r = c.where("variable = 'A'").select("realization", "lat", "lon"), c.where("variable = 'R'").select("realization", "lat", "lon")
    return a.subtract(r).withColumn("which", F.lit("only A")).unionByName(a.intersect(r).withColumn("which", F.lit("both")))


@query("joi3_time_match", f"WITH {B.DAYS}, o AS (SELECT * FROM days WHERE variable = 'R'), s AS (SELECT DISTINCT k FROM days WHERE variable = 'A') SELECT k, CAST(count(*) AS BIGINT) AS cells, bool_or(false) AS missing FROM o WHERE k IN (SELECT k FROM s) GROUP BY k UNION ALL SELECT k, 0, true FROM s WHERE k NOT IN (SELECT k FROM o)")
def joi3(spark, d):
    days = B.days(spark, d)
    sim, obs = days.where("variable = 'A'").select("k").distinct(), days.where("variable = 'R'")
    there = obs.join(sim, "k", "left_semi").groupBy("k").agg(F.count(F.lit(1)).alias("cells")).withColumn("missing", F.lit(False))
    return there.unionByName(sim.join(obs, "k", "left_anti").select("k", F.lit(0).cast("long").alias("cells"), F.lit(True).alias("missing")))


@query("joi4_outer_merge", f"WITH {B.DAYS}, a AS (SELECT k, lat, lon, avg(value) AS va FROM days WHERE variable = 'A' GROUP BY ALL), b AS (SELECT k, lat, lon, avg(value) AS vb FROM days WHERE variable = 'R' GROUP BY ALL) SELECT k, lat, lon, round(va, 6) AS va, round(vb, 6) AS vb FROM a FULL JOIN b USING (k, lat, lon)", 6)
def joi4(spark, d):
    of = lambda flag, name: B.days(spark, d).where(F.col("variable") == flag).groupBy("k", "lat", "lon").agg(F.avg("value").alias(name))
    return of("A", "va").join(of("R", "vb"), ["k", "lat", "lon"], "full")


@query("joi12_against_reference", f"""WITH {B.TRACKS}, s AS (SELECT dataset, CAST(count(DISTINCT storm) AS DOUBLE) AS storms, avg(wind) AS wind FROM points GROUP BY dataset)
    SELECT s.dataset, round(CASE WHEN s.dataset = 'control' THEN s.storms ELSE s.storms - c.storms END, 6) AS storms, round(CASE WHEN s.dataset = 'control' THEN s.wind ELSE s.wind - c.wind END, 6) AS wind FROM s, (SELECT * FROM s WHERE dataset = 'control') c""")  # fmt: skip
def joi12(spark, d):
    s = B.track_points(spark, d).groupBy("dataset").agg(F.count_distinct("storm").cast("double").alias("storms"), F.avg("wind").alias("wind"))
    return R.against_reference(s, [], "dataset", "control", ["storms", "wind"])


# --- series -------------------------------------------------------------------------


@query("win1_rolling_anomaly", f"""WITH {B.HOURLY}, r AS (SELECT k, value, row_number() OVER (ORDER BY k) AS n, count(*) OVER () AS c, avg(value) OVER (ORDER BY k ROWS 119 PRECEDING) AS m FROM hours)
    SELECT k, round(value - m, 6) AS value FROM r WHERE n > 120 AND n < c""")  # fmt: skip
def win1(spark, d):
    return W.rolling_anomaly(B.all_hours(spark, d), [])


@query("win2_lagged", f"WITH {B.HOURLY}, l AS (SELECT variable, k, value, lag(value, 5) OVER w AS l5, lag(value, 10) OVER w AS l10 FROM hourly WINDOW w AS (PARTITION BY variable ORDER BY k)) SELECT variable, k, round(value, 6) AS lag_0, round(l5, 6) AS lag_5, round(l10, 6) AS lag_10 FROM l WHERE l10 IS NOT NULL")
def win2(spark, d):
    return W.lagged(B.hourly(spark, d), ["variable"], [0, 5, 10]).drop("value")


def _kernel_sql() -> str:
    return ", ".join(f"({o - 70}, {h!r}::DOUBLE)" for o, h in enumerate(W.lanczos(141, 1 / 90, 1 / 25)))


@query("win3_lanczos", f"WITH {B.HOURLY}, h(o, h) AS (VALUES {_kernel_sql()}), c AS (SELECT variable, k + o AS k, sum(h * value) AS v FROM hourly, h GROUP BY ALL) SELECT variable, CAST(k AS INTEGER) AS k, round(v, 6) AS filtered FROM c JOIN hourly USING (variable, k)")
def win3(spark, d):
    return W.convolve(B.hourly(spark, d), ["variable"], W.lanczos(141, 1 / 90, 1 / 25))


@query("win4_segments", f"WITH {B.HOURLY}, s AS (SELECT CAST(unnest(range(0, (SELECT max(k) FROM hours) // 36 + 1)) AS INTEGER) AS segment) SELECT segment, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS value FROM hours JOIN s ON k BETWEEN segment * 36 AND segment * 36 + 95 WHERE segment * 36 + 95 <= (SELECT max(k) FROM hours) GROUP BY segment")
def win4(spark, d):
    return W.segments(B.all_hours(spark, d)).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))


@query("win5_lead_lag", f"WITH {B.HOURLY} SELECT CAST(lag AS INTEGER) AS lag, round(corr(x.value, y.value), 6) AS r FROM hourly x, hourly y, (SELECT unnest(range(-30, 31)) AS lag) WHERE x.variable = 'click' AND y.variable = 'view' AND y.k = x.k + lag GROUP BY lag")
def win5(spark, d):
    return W.lead_lag(B.hourly(spark, d), "click", "view")


@query("srt5_lead_lag_summary", f"""WITH {B.HOURLY}, c AS (SELECT lag, corr(x.value, y.value) AS r FROM hourly x, hourly y, (SELECT unnest(range(-30, 31)) AS lag) WHERE x.variable = 'click' AND y.variable = 'view' AND y.k = x.k + lag GROUP BY lag)
    SELECT round((abs(max(r)) + abs(min(r))) / 2, 6) AS max_corr, CAST(2 * abs(arg_max(lag, r) - arg_min(lag, r)) AS INTEGER) AS period FROM c""")  # fmt: skip
def srt5(spark, d):
    return W.lead_lag_summary(W.lead_lag(B.hourly(spark, d), "click", "view"))


@query("win7_step", f"WITH {B.HOURLY} SELECT variable, k, round(value - lag(value) OVER (PARTITION BY variable ORDER BY k), 6) AS step FROM hourly")
def win7(spark, d):
    return B.hourly(spark, d).select("variable", "k", (F.col("value") - F.lag("value").over(W.ordered(["variable"]))).alias("step"))


@query("win9_spearman", f"""WITH {B.HOURLY}, p AS (SELECT a.k, a.value AS x, b.value AS y FROM hourly a JOIN hourly b USING (k) WHERE a.variable = 'click' AND b.variable = 'view'),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM p) SELECT round(corr(rx, ry), 6) AS value FROM r""")  # fmt: skip
def win9(spark, d):
    h = B.hourly(spark, d)
    one = h.where("variable = 'click'").select("k", F.col("value").alias("x"))
    return W.spearman(one.join(h.where("variable = 'view'").select("k", F.col("value").alias("y")), "k"), [])


@query("win10_smooth121", f"WITH {B.HOURLY} SELECT variable, k, round((coalesce(lag(value) OVER w, value) + 2 * value + coalesce(lead(value) OVER w, value)) / 4, 6) AS value FROM hourly WINDOW w AS (PARTITION BY variable ORDER BY k)")
def win10(spark, d):
    return W.smooth121(B.hourly(spark, d), ["variable"])


@query("win11_detrend", f"WITH {B.HOURLY}, l AS (SELECT variable, regr_slope(value, k) AS b, avg(k) AS m FROM hourly GROUP BY variable) SELECT variable, k, round(value - b * (k - m), 6) AS value FROM hourly JOIN l USING (variable)")
def win11(spark, d):
    return W.detrend(B.hourly(spark, d), ["variable"])


@query("eof1_harmonics", f"""WITH {B.HOURLY}, c AS (SELECT k % 24 AS d, avg(value) AS c FROM hours GROUP BY ALL), h AS (SELECT unnest([1, 2, 3]) AS h),
    f AS (SELECT h, sum(c * cos(2 * pi() * h * d / 24)) / 12 AS a, sum(c * sin(2 * pi() * h * d / 24)) / 12 AS b FROM c, h GROUP BY h),
    s AS (SELECT d, (SELECT avg(c) FROM c) + sum(a * cos(2 * pi() * h * d / 24) + b * sin(2 * pi() * h * d / 24)) AS s FROM (SELECT DISTINCT d FROM c), f GROUP BY d)
    SELECT k, round(value - s, 6) AS value FROM hours JOIN s ON k % 24 = d""")  # fmt: skip
def eof1(spark, d):
    return W.harmonics(B.all_hours(spark, d), [], 24)


@query("reg3_interpolate", f"""WITH {B.HOURLY}, g AS (SELECT k, CASE WHEN k % 7 IN (0, 1) THEN NULL ELSE value END AS v FROM hours), x AS (SELECT k, v, max(CASE WHEN v IS NOT NULL THEN k END) OVER (ORDER BY k) AS a, min(CASE WHEN v IS NOT NULL THEN k END) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
     min(CASE WHEN v IS NOT NULL THEN k END) OVER () AS f, max(CASE WHEN v IS NOT NULL THEN k END) OVER () AS l FROM g), p AS (SELECT k, v, CASE WHEN a IS NULL THEN f WHEN b IS NULL THEN (SELECT max(k) FROM g WHERE v IS NOT NULL AND k < l) ELSE a END AS a, CASE WHEN a IS NULL THEN (SELECT min(k) FROM g WHERE v IS NOT NULL AND k > f) WHEN b IS NULL THEN l ELSE b END AS b FROM x)
    SELECT p.k, round(coalesce(p.v, ga.v + (gb.v - ga.v) * (p.k - a) / nullif(b - a, 0)), 6) AS value FROM p JOIN g ga ON ga.k = a JOIN g gb ON gb.k = b""")  # fmt: skip
def reg3(spark, d):
    gaps = B.all_hours(spark, d).withColumn("value", F.when(~(F.col("k") % 7).isin(0, 1), F.col("value")))
    return W.interpolate(gaps, [])


def _pcs(spark, d):
    """Two centred series as components."""
    h = B.hourly(spark, d)
    a = h.where("variable = 'click'").select("k", F.col("value").alias("a")).join(h.where("variable = 'view'").select("k", F.col("value").alias("b")), "k")
    w = Window.partitionBy(F.lit(0))
    return a.select("k", (F.col("a") - F.avg("a").over(w)).alias("pc1"), (F.col("b") - F.avg("b").over(w)).alias("pc2"))


PCS = "pcs AS (SELECT k, a.value - avg(a.value) OVER () AS pc1, b.value - avg(b.value) OVER () AS pc2 FROM hourly a JOIN hourly b USING (k) WHERE a.variable = 'click' AND b.variable = 'view')"
PHASE = "CAST(CAST(floor(((degrees(atan2(pc1, pc2)) % 360 + 360) % 360 + 180) / 45) AS BIGINT) % 8 + 1 AS INTEGER)"


@query("eof11_phase", f"WITH {B.HOURLY}, {PCS} SELECT k, {PHASE} AS phase, round(sqrt(pc1*pc1 + pc2*pc2), 6) AS amplitude FROM pcs")
def eof11(spark, d):
    return _pcs(spark, d).select("k", E.phase("pc1", "pc2").alias("phase"), F.sqrt(F.col("pc1") * F.col("pc1") + F.col("pc2") * F.col("pc2")).alias("amplitude"))


@query("agg23_phase_activity", f"""WITH {B.HOURLY}, {PCS}, p AS (SELECT {PHASE} AS phase, sqrt(pc1*pc1 + pc2*pc2) AS amp FROM pcs), q AS (SELECT *, amp > (SELECT avg(amp) FROM p) AS act FROM p)
    SELECT CAST(n AS INTEGER) AS phase, round(coalesce(avg(amp), 0), 6) AS amplitude, round(coalesce(avg(amp) FILTER (act), 0), 6) AS active_amplitude, CAST(count(amp) AS BIGINT) AS days, CAST(count(amp) FILTER (act) AS BIGINT) AS active_days FROM (SELECT unnest(range(1, 9)) AS n) LEFT JOIN q ON phase = n GROUP BY n""")  # fmt: skip
def agg23(spark, d):
    return W.activity(_pcs(spark, d))


LABELS = """amps AS (SELECT k, abs(pc1) AS raw1, abs(pc2) AS raw2, abs(pc1) / stddev_pop(pc1) OVER () AS std1, abs(pc2) / stddev_pop(pc2) OVER () AS std2 FROM pcs),
lab AS (SELECT k, CASE WHEN raw1 > raw2 AND std1 >= 1 THEN 1 WHEN raw2 > raw1 AND std2 >= 1 THEN 2 ELSE 0 END AS label FROM amps),
freq AS (SELECT k % 12 + 1 AS month, avg(CAST(label = 1 AS DOUBLE)) AS f1, avg(CAST(label = 2 AS DOUBLE)) AS f2 FROM lab GROUP BY ALL)"""


def _labelled(spark, d):
    w, p = Window.partitionBy(F.lit(0)), _pcs(spark, d)
    amps = p.select("k", F.abs("pc1").alias("raw1"), F.abs("pc2").alias("raw2"), (F.abs("pc1") / F.stddev_pop("pc1").over(w)).alias("std1"), (F.abs("pc2") / F.stddev_pop("pc2").over(w)).alias("std2"))
    return W.labels(amps)


@query("eof6_labels", f"WITH {B.HOURLY}, {PCS}, {LABELS} SELECT k, CAST(label AS INTEGER) AS label FROM lab")
def eof6(spark, d):
    return _labelled(spark, d).select("k", "label")


@query("agg20_monthly_share", f"WITH {B.HOURLY}, {PCS}, {LABELS} SELECT CAST(month AS INTEGER) AS month, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM freq")
def agg20(spark, d):
    return W.monthly_share(_labelled(spark, d), month())


@query("agg21_taylor_skill", f"WITH {B.HOURLY}, {PCS}, {LABELS}, m AS (SELECT corr(f1, f2) AS r, stddev_pop(f1) / stddev_pop(f2) AS s FROM freq) SELECT round(r, 6) AS r, round(s, 6) AS sigma, round(4 * pow(1 + r, 4) / (pow(s + 1 / s, 2) * 16), 6) AS tss FROM m")
def agg21(spark, d):
    return W.taylor_skill(W.monthly_share(_labelled(spark, d), month()).select(F.col("f1").alias("x"), F.col("f2").alias("y")))


@query("agg22_alpha", f"WITH {B.HOURLY}, {PCS} SELECT round((avg(abs(pc1)) FILTER (k % 2 = 0) + avg(abs(pc2)) FILTER (k % 2 = 0)) / (avg(abs(pc1)) FILTER (k % 2 = 1) + avg(abs(pc2)) FILTER (k % 2 = 1)), 6) AS alpha FROM pcs")
def agg22(spark, d):
    of = lambda p, s: F.avg(F.when(F.col("k") % 2 == s, F.abs(p)))
    return _pcs(spark, d).agg(E.ratio(of("pc1", 0) + of("pc2", 0), of("pc1", 1) + of("pc2", 1)).alias("alpha"))


@query("eof7_adjust", f"WITH {B.HOURLY}, {PCS} SELECT k, round(pc1 / 1.25, 6) AS pc1, round(pc2 / 1.25, 6) AS pc2 FROM pcs")
def eof7(spark, d):
    return _pcs(spark, d).select("k", (F.col("pc1") / 1.25).alias("pc1"), (F.col("pc2") / 1.25).alias("pc2"))


# --- samples ------------------------------------------------------------------------


def _samples(spark, d):
    side = F.when(F.col("variable") == "A", "test").otherwise("ref").alias("side")
    return B.cube(spark, d).where("variable IN ('A', 'R')").select("lat", "lon", side, "value")


AB = "ab AS (SELECT lat, lon, avg(value) FILTER (variable = 'A') AS a, avg(value) FILTER (variable = 'R') AS b, var_pop(value) FILTER (variable = 'A') AS pa, var_pop(value) FILTER (variable = 'R') AS pb, var_samp(value) FILTER (variable = 'A') AS sa, var_samp(value) FILTER (variable = 'R') AS sb, CAST(count(*) FILTER (variable = 'A') AS DOUBLE) AS n, CAST(count(*) FILTER (variable = 'R') AS DOUBLE) AS m FROM cube WHERE variable IN ('A', 'R') GROUP BY ALL)"


@query("sta1_cohen", f"WITH {B.CUBE}, {AB} SELECT lat, lon, round((a - b) / nullif(sqrt((pa + pb) / 2), 0), 6) AS d FROM ab")
def sta1(spark, d):
    return S.cohen(_samples(spark, d), R.CELL)


@query("sta8_welch", f"WITH {B.CUBE}, {AB} SELECT lat, lon, round((a - b) / nullif(sqrt(sa/n + sb/m), 0), 6) AS t, round(pow(sa/n + sb/m, 2) / nullif(pow(sa/n, 2)/nullif(n-1, 0) + pow(sb/m, 2)/nullif(m-1, 0), 0), 5) AS df FROM ab", 5)
def sta8(spark, d):
    return S.welch(_samples(spark, d), R.CELL)


ORACLE_SQL["sta8_welch"] = ORACLE_SQL["sta8_welch"].replace(", 6) AS t", ", 5) AS t")


@query("sta8_student", f"WITH {B.CUBE}, {AB} SELECT lat, lon, round((a - b) / nullif(sqrt((sa*(n-1) + sb*(m-1)) / nullif(n+m-2, 0) * (1/n + 1/m)), 0), 6) AS t, n + m - 2 AS df FROM ab")
def sta8s(spark, d):
    return S.welch(_samples(spark, d), R.CELL, equal=True)


@query("sta7_ks", f"""WITH {B.CUBE}, v AS (SELECT lat, lon, value, count(*) FILTER (variable = 'A') AS a, count(*) FILTER (variable = 'R') AS b FROM cube WHERE variable IN ('A', 'R') GROUP BY ALL),
    c AS (SELECT lat, lon, abs(sum(a) OVER w / nullif(sum(a) OVER p, 0) - sum(b) OVER w / nullif(sum(b) OVER p, 0)) AS g, a, b FROM v WINDOW w AS (PARTITION BY lat, lon ORDER BY value), p AS (PARTITION BY lat, lon))
    SELECT lat, lon, round(max(g), 6) AS d, CAST(sum(a) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS m FROM c GROUP BY ALL""")  # fmt: skip
def sta7(spark, d):
    return S.ks(_samples(spark, d), R.CELL)


@query("sta9_mann_whitney", f"""WITH {B.CUBE}, r AS (SELECT lat, lon, variable, rank() OVER (PARTITION BY lat, lon ORDER BY value) + (count(*) OVER (PARTITION BY lat, lon, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY lat, lon, value) AS t FROM cube WHERE variable IN ('A', 'R'))
    SELECT lat, lon, round(coalesce(sum(r) FILTER (variable = 'A'), 0) - count(*) FILTER (variable = 'A') * (count(*) FILTER (variable = 'A') + 1) / 2, 6) AS u, CAST(count(*) FILTER (variable = 'A') AS BIGINT) AS n, CAST(count(*) FILTER (variable = 'R') AS BIGINT) AS m, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM r GROUP BY ALL""")  # fmt: skip
def sta9(spark, d):
    return S.mann_whitney(_samples(spark, d), R.CELL)


@query("sta13_quantiles", f"WITH {B.CUBE} SELECT variable, CAST(year(time) AS INTEGER) AS year, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.95), 6) AS q95 FROM cube GROUP BY ALL", 6)
def sta13(spark, d):
    q = F.percentile("value", F.array(F.lit(0.05), F.lit(0.95)))
    return B.cube(spark, d).groupBy("variable", F.year("time").alias("year")).agg(F.avg("value").alias("mean"), q[0].alias("q05"), q[1].alias("q95"))


@query("sta14_pearson", f"WITH {B.CUBE} SELECT variable, round(corr(value, quantity), 6) AS r FROM cube GROUP BY variable")
def sta14(spark, d):
    return B.cube(spark, d).groupBy("variable").agg(F.corr("value", "quantity").alias("r"))


def _score_samples(spark, d):
    """Scores of two ensembles, A and N, as samples."""
    parts = []
    for flag, side in (("A", "test"), ("N", "ref")):
        sim = B.coarse(spark, d).where(F.col("variable") == flag).drop("variable")
        s = R.season_region_scores(sim, B.observed(spark, d), month())
        parts.append(s.select("season", "region", "metric", F.lit(side).alias("side"), F.col("score").alias("value")))
    return parts[0].unionByName(parts[1])


SECTION = ["season", "region", "metric"]


@query("sta4_effect_size_scores", digits=4)
def sta4(spark, d):
    return S.cohen_bootstrap(_score_samples(spark, d), SECTION, 2000)


@query("sta10_apply_tests")
def sta10(spark, d):
    return S.rejections(S.all_tests(_score_samples(spark, d), SECTION), ["season", "region"])


@query("sta11_any_test")
def sta11(spark, d):
    each = S.rejections(S.all_tests(_score_samples(spark, d), SECTION), ["season", "region"])
    return each.groupBy("season", "region").agg(F.bool_or("rejected").alias("verdict"))


@query("sta3_effect_size_map", digits=4)
def sta3(spark, d):
    return S.cohen_bootstrap(_members(spark, d), R.CELL, 1000)


def _members(spark, d):
    means = B.coarse(spark, d).where("variable IN ('A', 'R')").groupBy("variable", "realization", *R.CELL).agg(F.avg("value").alias("value"))
    return means.select(*R.CELL, F.when(F.col("variable") == "A", "test").otherwise("ref").alias("side"), "value")


@query("sta5_bootstrap_test", digits=4)
def sta5(spark, d):
    return S.bootstrap_test(_members(spark, d), R.CELL)


@query("sta6_significance_map", digits=6)
def sta6(spark, d):
    return S.significant(S.with_t_p(S.welch(_members(spark, d), R.CELL, equal=True)))


@query("sta12_mean_interval", digits=4)
def sta12(spark, d):
    return S.mean_interval(B.coarse(spark, d).where("variable = 'A'").groupBy("k", "realization").agg(F.avg("value").alias("value")), ["k"])


# --- tracks -------------------------------------------------------------------------


@query("src7_stitch", f"WITH {B.TRACKS} SELECT storm, CAST(count(*) AS BIGINT) AS n, round(max(wind), 6) AS wind, round(sum(1e-4 * pow(1.94384449 * wind, 2)), 6) AS ace FROM points GROUP BY storm")
def src7(spark, d):
    t = T.stitch(B.table(spark, d, "events"), 86400).withColumn("wind", F.col("value") / 7.0)
    return t.groupBy((F.col("user_id") * 1000 + F.col("track")).alias("storm")).agg(F.count(F.lit(1)).alias("n"), F.max("wind").alias("wind"), F.sum(1e-4 * F.pow(E.KNOTS * F.col("wind"), 2)).alias("ace"))


STORMS = """storms AS (SELECT dataset, storm, arg_min(lat, pt) AS gen_lat, arg_min(lon, pt) AS gen_lon, arg_min(month, pt) AS month, arg_min(year, pt) AS year, nullif(count(wind) * 0.25, 0) AS tcd,
 coalesce(sum(1e-4 * pow(1.94384449 * wind, 2)), 0) AS ace, first(abs(lat) ORDER BY wind DESC, pt) AS lmi, min(pres) AS minpres, max(wind) AS maxwind, count(*) AS points FROM points GROUP BY ALL)"""


@query("agg29_34_storm_stats", f"WITH {B.TRACKS}, {STORMS} SELECT dataset, storm, gen_lat, gen_lon, month, year, CAST(tcd AS DOUBLE) AS tcd, round(ace, 6) AS ace, lmi, round(minpres, 6) AS minpres, round(maxwind, 6) AS maxwind, CAST(points AS BIGINT) AS points FROM storms")
def agg29(spark, d):
    return T.storm_stats(B.track_points(spark, d))


QUAD = """ps AS (SELECT 1010 - least(pres, 1010) AS x, wind AS y FROM points WHERE dataset = 'control'),
su AS (SELECT CAST(count(*) AS DOUBLE) AS s0, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2 FROM ps),
de AS (SELECT *, s0*(s2*s4 - s3*s3) - s1*(s1*s4 - s2*s3) + s2*(s1*s3 - s2*s2) AS d FROM su),
co AS (SELECT (t0*(s2*s4 - s3*s3) - s1*(t1*s4 - s3*t2) + s2*(t1*s3 - s2*t2)) / d AS c0, (s0*(t1*s4 - s3*t2) - t0*(s1*s4 - s2*s3) + s2*(s1*t2 - t1*s2)) / d AS c1, (s0*(s2*t2 - t1*s3) - s1*(s1*t2 - t1*s2) + t0*(s1*s3 - s2*s2)) / d AS c2 FROM de)"""


@query("agg33_pressure_energy", f"WITH {B.TRACKS}, {QUAD} SELECT dataset, storm, round(sum(1e-4 * pow(1.94384449 * (c2*(1010-pres)*(1010-pres) + c1*(1010-pres) + c0), 2)), 3) AS pace FROM points, co GROUP BY ALL", 3)
def agg33(spark, d):
    p = B.track_points(spark, d)
    return T.pressure_energy(p, T.quadratic(p, "control"))


@query("sta15_quadratic_fit", f"WITH {B.TRACKS}, {QUAD} SELECT round(c2, 5) AS c2, round(c1, 5) AS c1, round(c0, 5) AS c0 FROM co", 5)
def sta15(spark, d):
    return spark.createDataFrame([tuple(T.quadratic(B.track_points(spark, d), "control"))], "c2 double, c1 double, c0 double")


@query("agg35_monthly_tracks", f"WITH {B.TRACKS}, {STORMS} SELECT dataset, CAST(m AS INTEGER) AS month, round(coalesce(count(storm) / 2.0, 0), 5) AS count, round(coalesce(sum(tcd) / 2, 0), 5) AS tcd, round(coalesce(sum(ace) / 2, 0), 5) AS ace, round(avg(lmi), 5) AS lmi FROM (SELECT DISTINCT dataset FROM storms) CROSS JOIN (SELECT unnest(range(1, 13)) AS m) LEFT JOIN storms USING (dataset) WHERE false GROUP BY ALL".replace("LEFT JOIN storms USING (dataset) WHERE false GROUP BY ALL", "x LEFT JOIN storms s USING (dataset) GROUP BY ALL"), 5)
def agg35(spark, d):
    return T.monthly(T.storm_stats(B.track_points(spark, d)), 2.0)


ORACLE_SQL["agg35_monthly_tracks"] = f"""WITH {B.TRACKS}, {STORMS}, g AS (SELECT dataset, CAST(unnest(range(1, 13)) AS INTEGER) AS month FROM (SELECT DISTINCT dataset FROM storms))
    SELECT g.dataset, g.month, round(count(storm) / 2, 5) AS count, round(coalesce(sum(tcd) / 2, 0), 5) AS tcd, round(coalesce(sum(ace) / 2, 0), 5) AS ace, round(avg(lmi), 5) AS lmi
    FROM g LEFT JOIN storms s ON s.dataset = g.dataset AND s.month = g.month GROUP BY g.dataset, g.month"""


@query("agg36_yearly_tracks", f"WITH {B.TRACKS}, {STORMS} SELECT dataset, year, round(count(*) / 1, 5) AS count, round(sum(tcd), 5) AS tcd, round(sum(ace), 5) AS ace, round(avg(lmi), 5) AS lmi, round(avg(abs(gen_lat)), 5) AS latgen FROM storms GROUP BY ALL", 5)
def agg36(spark, d):
    return T.yearly(T.storm_stats(B.track_points(spark, d)))


@query("agg37_climatology", f"WITH {B.TRACKS}, {STORMS} SELECT dataset, round(count(*) / 4, 5) AS uclim_count, round(sum(tcd) / 4, 5) AS uclim_tcd, round(sum(ace) / 4, 5) AS uclim_ace, round(avg(tcd), 5) AS storm_tcd, round(avg(ace), 5) AS storm_ace, round(avg(lmi), 5) AS storm_lmi, round(avg(abs(gen_lat)), 5) AS storm_latgen FROM storms GROUP BY dataset", 5)
def agg37(spark, d):
    return T.climatology(T.storm_stats(B.track_points(spark, d)), 4.0)


CELLS = "CAST(trunc((lat + 90) / 2.5) AS INTEGER) AS i, CAST(trunc(lon / 2.5) AS INTEGER) % 144 AS j"


@query("agg39_41_density", f"WITH {B.TRACKS} SELECT dataset, {CELLS}, CAST(count(*) AS BIGINT) AS hits, round(sum(wind), 6) AS wind_sum, round(avg(wind), 6) AS wind_mean, round(max(wind), 6) AS wind_max, round(min(pres), 6) AS pres_min FROM points GROUP BY ALL")
def agg39(spark, d):
    return T.density(B.track_points(spark, d), 2.5)


@query("agg39_full_grid", f"WITH {B.TRACKS}, p AS (SELECT dataset, CAST(trunc((lat + 90) / 10) AS INTEGER) AS i, CAST(trunc(lon / 10) AS INTEGER) % 36 AS j FROM points), g AS (SELECT dataset, i, CAST(unnest(range(0, 36)) AS INTEGER) AS j FROM (SELECT dataset, CAST(unnest(range(0, 19)) AS INTEGER) AS i FROM (SELECT DISTINCT dataset FROM points))) SELECT g.dataset, g.i, g.j, CAST(count(p.i) AS BIGINT) AS hits FROM g LEFT JOIN p ON p.dataset = g.dataset AND p.i = g.i AND p.j = g.j GROUP BY ALL")
def agg39g(spark, d):
    return T.full_grid(T.density(B.track_points(spark, d), 10.0), 10.0, "hits")


@query("agg42_spatial_bundle", f"""WITH {B.TRACKS}, {STORMS}, {QUAD}, m AS (SELECT dataset, {CELLS}, count(*) / 3 AS n, count(wind) * 0.25 / 3 AS tcd, sum(1e-4 * pow(1.94384449 * wind, 2)) / 3 AS ace, sum(1e-4 * pow(1.94384449 * (c2*(1010-pres)*(1010-pres) + c1*(1010-pres) + c0), 2)) / 3 AS pace, min(pres) AS minpres, max(wind) AS maxwind FROM points, co GROUP BY ALL),
    g AS (SELECT dataset, CAST(trunc((gen_lat + 90) / 2.5) AS INTEGER) AS i, CAST(trunc(gen_lon / 2.5) AS INTEGER) % 144 AS j, count(*) / 3 AS gen FROM storms GROUP BY ALL)
    SELECT dataset, i, j, round(n, 3) AS count, round(tcd, 3) AS tcd, round(ace, 3) AS ace, round(pace, 3) AS pace, round(minpres, 3) AS minpres, round(maxwind, 3) AS maxwind, round(coalesce(gen, 0), 3) AS gen FROM m LEFT JOIN g USING (dataset, i, j)""", 3)  # fmt: skip
def agg42(spark, d):
    p = B.track_points(spark, d)
    return T.spatial_bundle(p, T.storm_stats(p), T.quadratic(p, "control"), 2.5, 3.0)


@query("agg43_histogram2d", f"WITH {B.TRACKS} SELECT CAST(least(floor((lat + 40) / 4), 19) AS INTEGER) AS i, CAST(least(floor(lon / 12), 24) AS INTEGER) AS j, CAST(count(*) AS BIGINT) AS n FROM points WHERE lat BETWEEN -40 AND 40 AND lon BETWEEN 0 AND 300 GROUP BY ALL")
def agg43(spark, d):
    return T.histogram2d(B.track_points(spark, d), (-40.0, 40.0, 20), (0.0, 300.0, 25))


@query("agg43_genesis_over", f"WITH {B.TRACKS} SELECT dataset, storm, arg_min(lat, pt) AS lat, arg_min(lon, pt) AS lon FROM points WHERE wind > 17 GROUP BY ALL")
def agg43g(spark, d):
    return T.genesis_over(B.track_points(spark, d), 17.0)


@query("agg44_temporal_spearman", f"""WITH {B.TRACKS}, g AS (SELECT dataset, day(ts) % 12 AS m, avg(wind) AS w FROM points GROUP BY ALL), p AS (SELECT a.m, a.w AS x, b.w AS y FROM g a JOIN g b USING (m) WHERE a.dataset = 'control' AND b.dataset = 'model'),
    r AS (SELECT x, y, rank() OVER (ORDER BY x) AS rx, rank() OVER (ORDER BY y) AS ry FROM p) SELECT round(corr(rx, ry), 6) AS spearman, round(corr(x, y), 6) AS pearson FROM r""")  # fmt: skip
def agg44(spark, d):
    g = B.track_points(spark, d).groupBy("dataset", (F.dayofmonth("ts") % 12).alias("m")).agg(F.avg("wind").alias("w"))
    pairs = g.where("dataset = 'control'").select("m", F.col("w").alias("x")).join(g.where("dataset = 'model'").select("m", F.col("w").alias("y")), "m")
    w = Window.partitionBy(F.lit(0))
    ranked = pairs.withColumns({"rx": W.average_rank(F.col("x"), w), "ry": W.average_rank(F.col("y"), w)})
    return ranked.agg(F.corr("rx", "ry").alias("spearman"), F.corr("x", "y").alias("pearson"))


@query("agg45_spatial_correlation", f"""WITH {B.TRACKS}, m AS (SELECT dataset, CAST(trunc((lat + 90) / 30) AS INTEGER) AS i, CAST(trunc(lon / 30) AS INTEGER) % 12 AS j, CAST(count(*) AS DOUBLE) AS hits, sum(wind) AS wind FROM points GROUP BY ALL),
    p AS (SELECT (a.i * 30.0::DOUBLE - 90) AS lat, n AS metric, CASE n WHEN 'hits' THEN a.hits ELSE a.wind END AS x, CASE n WHEN 'hits' THEN b.hits ELSE b.wind END AS y FROM m a JOIN m b USING (i, j) CROSS JOIN (SELECT unnest(['hits', 'wind']) AS n) WHERE a.dataset = 'model' AND b.dataset = 'control'),
    q AS (SELECT metric, sum({W_}) AS sw, sum({W_}*x)/sum({W_}) AS mx, sum({W_}*y)/sum({W_}) AS my, sum({W_}*x*x)/sum({W_}) AS xx, sum({W_}*y*y)/sum({W_}) AS yy, sum({W_}*x*y)/sum({W_}) AS xy FROM p GROUP BY metric)
    SELECT metric, round((xy - mx*my) / sqrt((xx - mx*mx) * (yy - my*my)), 5) AS value FROM q""", 5)  # fmt: skip
def agg45(spark, d):
    m = T.density(B.track_points(spark, d), 30.0).select("dataset", "i", "j", F.col("hits").cast("double").alias("hits"), F.col("wind_sum").alias("wind"))
    long = m.unpivot(["dataset", "i", "j"], ["hits", "wind"], "metric", "v")
    x, y = long.where("dataset = 'model'").select("i", "j", "metric", F.col("v").alias("x")), long.where("dataset = 'control'").select("i", "j", "metric", F.col("v").alias("y"))
    return R.pattern_correlation(x.join(y, ["i", "j", "metric"]).withColumn("lat", F.col("i") * F.lit(30.0) - 90), ["metric"])
