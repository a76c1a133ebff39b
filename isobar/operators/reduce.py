"""Reductions of cubes: means, differences, scores against observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio, regions, seasons, weight, weighted_mean

CELL = ["lat", "lon"]


def area_mean(cube: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Area-weighted mean over the cells of each key."""
    return cube.groupBy(*keys).agg(weighted_mean(value, weight()).alias("value"))


def resample(series: DataFrame, keys: list[str], bins: dict[str, Column], value: str = "value") -> DataFrame:
    """Mean of each key's values in each calendar bin: a mean of area means, not
    the pooled one."""
    named = series.withColumns(bins)
    return named.groupBy(*keys, *bins).agg(F.avg(value).alias("value"))


def monthly_sum(series: DataFrame, keys: list[str], bins: dict[str, Column]) -> DataFrame:
    """Sums by month; nothing adds up to zero."""
    return series.withColumns(bins).groupBy(*keys, *bins).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def fill_bins(series: DataFrame, keys: list[str], k: str = "k") -> DataFrame:
    """Bins between a key's first and last that have no row get a null."""
    ends = series.groupBy(*keys).agg(F.min(k).alias("_a"), F.max(k).alias("_b")) if keys else series.agg(F.min(k).alias("_a"), F.max(k).alias("_b"))
    every = ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias(k))
    return every.join(series, [*keys, k], "left")


def mean_map(cube: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over time, then over members, of each cell."""
    over_time = cube.groupBy(*keys, "realization", *CELL).agg(F.avg("value").alias("value"))
    return over_time.groupBy(*keys, *CELL).agg(F.avg("value").alias("value"))


def difference_map(cube: DataFrame, a: str, b: str, key: str = "variable", substitute: bool = False) -> DataFrame:
    """Mean map of a minus that of b (signed).  With ``substitute`` (ocean and ice
    fields) missing and zero differences become 1e-6."""
    maps = mean_map(cube.where(F.col(key).isin(a, b)), [key])
    of = lambda x: F.max(F.when(F.col(key) == x, F.col("value")))
    out = maps.groupBy(*CELL).agg((of(a) - of(b)).alias("value"))
    return out.withColumn("value", replaced("value", 1e-6)) if substitute else out


def replaced(x: str, by: float) -> Column:
    return F.when(F.col(x).isNull() | (F.col(x) == 0), F.lit(by)).otherwise(F.col(x))


def bias_map(sim: DataFrame, obs: DataFrame) -> DataFrame:
    """Mean map of the simulation minus the mean of the observation."""
    means = sim.groupBy("realization", *CELL).agg(F.avg("value").alias("v")).groupBy(*CELL).agg(F.avg("v").alias("s"))
    return means.join(obs.groupBy(*CELL).agg(F.avg("value").alias("o")), CELL).select(*CELL, (F.col("s") - F.col("o")).alias("value"))


def climate(obs: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Of each cell: mean, population spread, and the root of the squared
    deviations over the length of the axis less one."""
    return obs.groupBy(*keys).agg(
        F.avg("value").alias("o_mean"), F.stddev_pop("value").alias("o_std"),
        F.sqrt(F.var_pop("value") * F.count("value") / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("o_crms"),
    )


def crms(cube: DataFrame, keys: list[str]) -> DataFrame:
    return climate(cube, keys).select(*keys, F.col("o_crms").alias("value"))


def paired_moments(sim: DataFrame, obs: DataFrame, keys: list[Column | str], more: list[str] | None = None) -> DataFrame:
    """Of each member, cell and further key: t rows, n values and their mean; nd
    differences from the observation at the same step, their mean and squared
    deviations.  ``more`` names columns that both sides have besides.  The one join of
    the whole cube; sums are pre-aggregated after it."""
    more = more or []
    both = sim.join(obs.select(*more, "k", *CELL, F.col("value").alias("_o")), [*more, "k", *CELL], "left").withColumn("_d", F.col("value") - F.col("_o"))
    return both.groupBy(*more, "realization", *CELL, *keys).agg(
        F.count(F.lit(1)).alias("t"), F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.count("_d").alias("nd"), F.avg("_d").alias("md"), (F.var_pop("_d") * F.count("_d")).alias("m2"),
    )


def crmse(sim: DataFrame, obs: DataFrame) -> DataFrame:
    """Root of the squared differences of anomalies over length less one, by member
    and cell; each side is centred on its own times before times are matched."""
    own = paired_moments(sim, obs, []).join(obs.groupBy(*CELL).agg(F.avg("value").alias("o_mean")), CELL)
    off = F.col("md") - (F.col("mean") - F.col("o_mean"))
    return own.where("nd > 0").select("realization", *CELL, F.sqrt((F.col("m2") + F.col("nd") * off * off) / F.nullif(F.col("t") - 1, F.lit(0))).alias("value"))


def rk_score(sim: DataFrame, obs: DataFrame) -> DataFrame:
    """Root of the weighted mean of exp(-((x - mean) / spread)^2), by member."""
    z = ratio(F.col("value") - F.col("o_mean"), "o_std")
    hit = sim.join(climate(obs), CELL).withColumn("s", F.exp(-z * z))
    return hit.groupBy("realization").agg(F.sqrt(weighted_mean("s", weight())).alias("value"))


def bias_score(sim: DataFrame, obs: DataFrame) -> DataFrame:
    """Weighted mean of exp(-|x - mean| / crms), by member."""
    z = ratio(F.abs(F.col("value") - F.col("o_mean")), "o_crms")
    return sim.join(climate(obs), CELL).withColumn("s", F.exp(-z)).groupBy("realization").agg(weighted_mean("s", weight()).alias("value"))


def rmse_score(sim: DataFrame, obs: DataFrame) -> DataFrame:
    """Weighted mean of exp(-crmse / crms), by member."""
    s = F.exp(-ratio("value", "o_crms"))
    return crmse(sim, obs).join(climate(obs), CELL).withColumn("s", s).groupBy("realization").agg(weighted_mean("s", weight()).alias("value"))


def absolute_bias(sim: DataFrame, obs: DataFrame) -> DataFrame:
    """Weighted mean of |mean - observed mean|, by member."""
    means = sim.groupBy("realization", *CELL).agg(F.avg("value").alias("m")).join(climate(obs), CELL)
    return means.withColumn("s", F.abs(F.col("m") - F.col("o_mean"))).groupBy("realization").agg(weighted_mean("s", weight()).alias("value"))


def absolute_rmse(sim: DataFrame, obs: DataFrame) -> DataFrame:
    return crmse(sim, obs).groupBy("realization").agg(weighted_mean("value", weight()).alias("value"))


def moments(x: str, y: str, w: Column) -> list[Column]:
    """Weighted sums that correlations and Taylor statistics are made of."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    w = F.when(both, w)
    a, b = F.col(x), F.col(y)
    return [F.sum(v).alias(n) for n, v in (("sw", w), ("sx", w * a), ("sy", w * b), ("sxx", w * a * a), ("syy", w * b * b), ("sxy", w * a * b))]


def correlation(centred: bool = True) -> Column:
    """From moments()."""
    sw, sx, sy = F.col("sw"), F.col("sx"), F.col("sy")
    if not centred:
        return ratio("sxy", F.sqrt(F.col("sxx") * F.col("syy")))
    cov = F.col("sxy") / sw - sx / sw * sy / sw
    return ratio(cov, F.sqrt((F.col("sxx") / sw - F.pow(sx / sw, 2)) * (F.col("syy") / sw - F.pow(sy / sw, 2))))


def pattern_correlation(pairs: DataFrame, keys: list[str], centred: bool = True) -> DataFrame:
    """Area-weighted correlation of columns x and y over the cells of each key."""
    return pairs.groupBy(*keys).agg(*moments("x", "y", weight())).select(*keys, correlation(centred).alias("value"))


def taylor(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pattern correlation, ratio of spreads, percent bias, means, variances and
    normalised error of x (test) against y (control)."""
    m = pairs.groupBy(*keys).agg(*moments("x", "y", weight()))
    sw = F.col("sw")
    mx, my = F.col("sx") / sw, F.col("sy") / sw
    vx, vy = F.col("sxx") / sw - mx * mx, F.col("syy") / sw - my * my
    out = m.select(*keys, correlation().alias("pattern_cor"), F.sqrt(vx / vy).alias("ratio"), (100 * (mx - my) / my).alias("bias"), mx.alias("xmean"), my.alias("ymean"), vx.alias("xvar"), vy.alias("yvar"))
    r, s = F.col("pattern_cor"), F.col("ratio")
    return out.withColumn("rmse", F.sqrt(F.greatest(1 + s * s - 2 * s * r, F.lit(0.0))))


def weighted_rmse(pairs: DataFrame, keys: list[str], skip_zero: bool = False) -> DataFrame:
    w = F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.lit(not skip_zero) | ((F.col("x") != 0) & (F.col("y") != 0))), weight())
    return pairs.groupBy(*keys).agg(F.sqrt(F.sum(w * F.pow(F.col("x") - F.col("y"), 2)) / F.sum(w)).alias("value"))


def fan_out(table: DataFrame, month: Column) -> DataFrame:
    """A row for each season and region a row counts in."""
    return table.withColumn("season", F.explode(seasons(month))).withColumn("region", F.explode(regions()))


def season_region_scores(sim: DataFrame, obs: DataFrame, month: Column, more: list[str] | None = None) -> DataFrame:
    """(``more`` columns of both sides,) season, region, realization, metric, score: RK08 and Bias on time means, RMSE
    on times, and their mean as Combined.  The cube is summed once by calendar month;
    a season is a sum of its months, twelve rows at most."""
    part = [*(more or []), "season", "region"]
    cell = [*part, *CELL]
    s = fan_out(paired_moments(sim, obs, [month.alias("_month")], more), F.col("_month"))
    s = s.groupBy("realization", *cell).agg(
        F.sum("t").alias("t"), (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("m"), F.collect_list(F.when(F.col("nd") > 0, F.struct("nd", "md", "m2"))).alias("months")
    )
    o = obs.groupBy(*(more or []), *CELL, month.alias("_month")).agg(F.count(F.lit(1)).alias("t"), F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2"))
    o = fan_out(o, F.col("_month")).groupBy(*cell).agg(
        F.sum("t").alias("o_t"), F.sum("n").alias("o_n"), (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("o_mean"), F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean", "m2"))).alias("o_months")
    )
    around = lambda months, n, mean, centre: F.aggregate(months, F.lit(0.0), lambda a, x: a + x["m2"] + x[n] * (x[mean] - centre) * (x[mean] - centre))
    o = o.withColumn("_sq", F.when(F.col("o_n") > 0, around("o_months", "n", "mean", F.col("o_mean"))))
    o = o.withColumns({"o_std": F.sqrt(F.col("_sq") / F.nullif(F.col("o_n"), F.lit(0))), "o_crms": F.sqrt(F.col("_sq") / F.nullif(F.col("o_t") - 1, F.lit(0)))})
    means = s.join(o, cell)
    error = around("months", "nd", "md", F.col("m") - F.col("o_mean"))
    means = means.withColumn("crmse", F.when(F.size("months") > 0, F.sqrt(error / F.nullif(F.col("t") - 1, F.lit(0)))))
    z = ratio(F.col("m") - F.col("o_mean"), "o_std")
    scored = means.withColumns({"rk": F.exp(-z * z), "bi": F.exp(-ratio(F.abs(F.col("m") - F.col("o_mean")), "o_crms")), "rm": F.exp(-ratio("crmse", "o_crms"))})
    wide = scored.groupBy("realization", *part).agg(
        F.sqrt(weighted_mean("rk", weight())).alias("RK08"), weighted_mean("bi", weight()).alias("Bias"), weighted_mean("rm", weight()).alias("RMSE")
    )
    wide = wide.withColumn("Combined", (F.col("RK08") + F.col("Bias") + F.col("RMSE")) / 3)
    return wide.unpivot(["realization", *part], ["RK08", "Bias", "RMSE", "Combined"], "metric", "score")


def against_reference(rows: DataFrame, keys: list[str], dataset: str, reference: str, values: list[str]) -> DataFrame:
    """Every dataset's values minus the reference's; the reference's own stay."""
    ref = rows.where(F.col(dataset) == reference).select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    joined = rows.join(ref, keys, "left") if keys else rows.join(F.broadcast(ref), how="left")  # the reference is one row
    return joined.select(dataset, *keys, *[F.when(F.col(dataset) == reference, F.col(v)).otherwise(F.col(v) - F.col(f"_{v}")).alias(v) for v in values])
