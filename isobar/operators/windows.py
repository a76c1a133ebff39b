"""Operators on ordered series: a key, a dense step number k, a value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import ratio
from . import ranges


def ordered(keys: list[str], k: str = "k"):
    return (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(k)


def rolling_anomaly(series: DataFrame, keys: list[str], size: int = 120) -> DataFrame:
    """Value less its trailing mean over ``size`` rows.  The first ``size`` rows and
    the last one are dropped, as the analysis that this step belongs to does.  One
    series without keys is dealt out in stretches."""
    mean_over = lambda run: F.when(F.count("value").over(run) == size, F.avg("value").over(run))
    if not keys:
        rows, total = ranges.numbered(series, "k")
        out = ranges.framed(rows, size - 1, lambda w: {"_mean": mean_over(w.rowsBetween(-(size - 1), 0))})
        return out.where((F.col("_n") > size) & (F.col("_n") < total)).withColumn("value", F.col("value") - F.col("_mean")).drop("_n", "_mean")
    w = ordered(keys)
    run = w.rowsBetween(-(size - 1), 0)
    n, last = F.row_number().over(w), F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = series.withColumns({"_n": n, "_last": last, "_mean": mean_over(run)}).where((F.col("_n") > size) & (F.col("_n") < F.col("_last")))
    return out.withColumn("value", F.col("value") - F.col("_mean")).drop("_n", "_last", "_mean")


def lagged(series: DataFrame, keys: list[str], lags: list[int]) -> DataFrame:
    """lag_0, ...: the value at k - lag; rows with all of them."""
    cols = {f"lag_{x}": F.lag("value", x).over(ordered(keys)) for x in lags}
    return series.withColumns(cols).dropna(subset=list(cols))


def lanczos(size: int, low: float, high: float) -> list[float]:
    """Band-pass weights for offsets -size/2 .. size/2; size is odd."""
    if size % 2 == 0:
        raise ValueError("the window must be odd")
    half = size // 2
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    return [(2 * high * sinc(2 * high * t) - 2 * low * sinc(2 * low * t)) * sinc(t / half) if t else 2 * (high - low) for t in range(-half, half + 1)]


def convolve(series: DataFrame, keys: list[str], weights: list[float]) -> DataFrame:
    """Centred convolution; outside the series values are zero.  One sort by step:
    each step's neighbours are in its window's frame."""
    half = len(weights) // 2
    h = F.array(*[F.lit(x) for x in weights])
    near = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("k", "value"))).over(ordered(keys).rangeBetween(-half, half))
    taps = F.aggregate("_near", F.lit(0.0), lambda a, x: a + x["value"] * F.get(h, F.col("k") - x["k"] + half))
    return series.withColumn("_near", near).select(*keys, "k", F.when(F.size("_near") > 0, taps).alias("filtered"))


def segments(series: DataFrame, size: int = 96, overlap: int = 60) -> DataFrame:
    """segment, and each row once for every segment it is in.  Segments that the
    series does not fill are left out."""
    step = size - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("k") - size + 1) / step)).cast("int")
    last = F.floor(F.col("k") / step).cast("int")
    longest = series.agg(F.max("k").alias("_max"))
    rows = series.withColumn("segment", F.explode(F.sequence(first, last)))
    end = longest.first()["_max"]  # one number
    return rows.where(F.col("segment") * step + size - 1 <= F.lit(end))


#: Steps of a stretch of a long series that one task takes.
STRETCH = 4096


def lead_lag(series: DataFrame, a: str, b: str, most: int = 30) -> DataFrame:
    """lag, r: correlation of a at k with b at k + lag (lag below zero: b leads).  The
    series is cut into stretches that overlap by the lags; products are summed where
    they arise."""
    of = lambda name: F.max(F.when(F.col("variable") == name, F.col("value")))
    both = series.where(F.col("variable").isin(a, b)).groupBy("k").agg(of(a).alias("x"), of(b).alias("y"))
    stretch = lambda k: F.floor(k / F.lit(STRETCH))
    cut = both.withColumn("s", F.explode(F.sequence(stretch(F.col("k") - most), stretch(F.col("k") + most))))
    near = F.collect_list(F.when(F.col("y").isNotNull(), F.struct(F.col("k").alias("at"), "y"))).over(Window.partitionBy("s").orderBy("k").rangeBetween(-most, most))
    pairs = cut.withColumn("near", near).where((F.col("s") == stretch(F.col("k"))) & F.col("x").isNotNull()).select("k", "x", F.explode("near").alias("n"))
    return pairs.groupBy((F.col("n.at") - F.col("k")).cast("int").alias("lag")).agg(F.corr("x", "n.y").alias("r"))


def lead_lag_summary(r: DataFrame) -> DataFrame:
    """max_corr and period of a lead-lag curve, first lags winning ties."""
    m = r.agg(F.max_by("lag", F.struct("r", -F.col("lag"))).alias("hi"), F.min_by("lag", F.struct("r", "lag")).alias("lo"), F.max("r").alias("rmax"), F.min("r").alias("rmin"))
    return m.select(((F.abs("rmax") + F.abs("rmin")) / 2).alias("max_corr"), (2 * F.abs(F.col("hi") - F.col("lo"))).alias("period"))


def average_rank(x: Column, over) -> Column:
    """Ranks from one; ties share their mean."""
    return F.rank().over(over.orderBy(x)) + (F.count(F.lit(1)).over(over.orderBy(x).rangeBetween(0, 0)) - 1) / 2


def spearman(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rank correlation of columns x and y where both are there.  Without keys, ranks
    are those of the values, which the rows then meet."""
    full = pairs.dropna(subset=["x", "y"])
    if not keys:
        rank = lambda c: ranges.average_ranks(full, c).select(c, F.col("rank").alias(f"_{c}"))
        return full.select("x", "y").join(rank("x"), "x").join(rank("y"), "y").agg(F.corr("_x", "_y").alias("value"))
    w = Window.partitionBy(*keys)
    return full.withColumns({"_x": average_rank(F.col("x"), w), "_y": average_rank(F.col("y"), w)}).groupBy(*keys).agg(F.corr("_x", "_y").alias("value"))


def smooth121(series: DataFrame, keys: list[str], passes: int = 1) -> DataFrame:
    """1-2-1 smoothing, the ends repeated."""
    w = ordered(keys)
    for _ in range(passes):
        x = F.col("value")
        series = series.withColumn("value", (F.coalesce(F.lag(x).over(w), x) + 2 * x + F.coalesce(F.lead(x).over(w), x)) / 4)
    return series


def detrend(series: DataFrame, keys: list[str], keep_mean: bool = True) -> DataFrame:
    """Value less its least-squares line; the mean is put back."""
    x, y = F.col("k").cast("double"), F.col("value")
    x = F.when(y.isNotNull(), x)
    if not keys:  # four numbers
        m = series.agg(ratio(F.covar_pop(y, x), F.var_pop(x)).alias("slope"), F.avg(x).alias("x"), F.avg(y).alias("y")).first()
        line = F.lit(m["slope"]).cast("double") * (F.col("k") - F.lit(m["x"]).cast("double"))
        return series.withColumn("value", y - line - (F.lit(0.0) if keep_mean else F.lit(m["y"]).cast("double")))
    w = Window.partitionBy(*keys)
    slope = ratio(F.covar_pop(y, x).over(w), F.var_pop(x).over(w))
    line = slope * (F.col("k") - F.avg(x).over(w))
    return series.withColumn("value", y - line - (F.lit(0.0) if keep_mean else F.avg(y).over(w)))


def harmonics(series: DataFrame, keys: list[str], cycle: int, count: int = 3) -> DataFrame:
    """Value less its mean cycle, of which the mean and the first harmonics are
    kept.  k mod cycle is the place in the cycle."""
    c = series.groupBy(*keys, F.pmod("k", F.lit(cycle)).alias("d")).agg(F.avg("value").alias("c"))
    angle = lambda h: F.lit(2 * math.pi * h / cycle) * F.col("d")
    sums = [F.avg("c").alias("mean")]
    for h in range(1, count + 1):
        sums += [(F.sum(F.col("c") * F.cos(angle(h))) * 2 / F.lit(cycle)).alias(f"a{h}"), (F.sum(F.col("c") * F.sin(angle(h))) * 2 / F.lit(cycle)).alias(f"b{h}")]
    fit = c.groupBy(*keys).agg(*sums) if keys else c.agg(*sums)
    placed = series.withColumn("d", F.pmod("k", F.lit(cycle)))
    joined = placed.join(fit, keys) if keys else placed.crossJoin(F.broadcast(fit))  # one row
    smooth = F.col("mean")
    for h in range(1, count + 1):
        smooth = smooth + F.col(f"a{h}") * F.cos(angle(h)) + F.col(f"b{h}") * F.sin(angle(h))
    return joined.withColumn("value", F.col("value") - smooth).select(*series.columns)


def interpolate(series: DataFrame, keys: list[str]) -> DataFrame:
    """Missing values on the line between (or beyond) the nearest two valid ones."""
    w = ordered(keys)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    valid = F.when(F.col("value").isNotNull(), F.struct(F.col("k").alias("k"), F.col("value").alias("v")))
    s = series.withColumn("_p", valid)
    s = s.withColumns({"_a": F.last("_p", True).over(before), "_b": F.first("_p", True).over(after)})
    # At the ends: the second valid one on the same side.
    s = s.withColumns({"_prev": F.lag("_a").over(w), "_next": F.lead("_b").over(w)})
    firsts = F.first("_p", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lasts = F.last("_p", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"_f": firsts, "_l": lasts})
    second = F.first(F.when(F.col("k") > F.col("_f.k"), F.col("_p")), True).over(everything)
    last2 = F.last(F.when(F.col("k") < F.col("_l.k"), F.col("_p")), True).over(everything)
    s = s.withColumns({"_s": second, "_z": last2})
    line = lambda p, q: F.col(f"{p}.v") + (F.col(f"{q}.v") - F.col(f"{p}.v")) * ratio(F.col("k") - F.col(f"{p}.k"), F.col(f"{q}.k") - F.col(f"{p}.k"))
    value = (
        F.when(F.col("value").isNotNull(), F.col("value"))
        .when(F.col("_a").isNull(), line("_f", "_s")).when(F.col("_b").isNull(), line("_z", "_l")).otherwise(line("_a", "_b"))
    )
    return s.withColumn("value", value).select(*series.columns)


def activity(pcs: DataFrame, threshold: float | None = None) -> DataFrame:
    """phase, mean amplitude, mean amplitude on active days, days, active days, for
    phases 1 to 8.  Active: amplitude over the threshold, by default its mean."""
    from ..functions.expr import phase

    amp = pcs.withColumns({"phase": phase("pc1", "pc2"), "amp": F.sqrt(F.col("pc1") * F.col("pc1") + F.col("pc2") * F.col("pc2"))})
    level = F.lit(threshold) if threshold is not None else F.lit(amp.agg(F.avg("amp")).first()[0])
    active = F.col("amp") > level
    by = amp.groupBy("phase").agg(F.avg("amp").alias("amplitude"), F.avg(F.when(active, F.col("amp"))).alias("active_amplitude"), F.count(F.lit(1)).alias("days"), F.count_if(active).alias("active_days"))
    phases = pcs.sparkSession.range(1, 9).select(F.col("id").cast("int").alias("phase"))
    return phases.join(by, "phase", "left").fillna(0)


def labels(amps: DataFrame) -> DataFrame:
    """1: the first family's raw amplitude is larger and its standard one at least 1;
    2: the other way round; else 0."""
    first = (F.col("raw1") > F.col("raw2")) & (F.col("std1") >= 1)
    second = (F.col("raw2") > F.col("raw1")) & (F.col("std2") >= 1)
    return amps.withColumn("label", F.when(first, 1).when(second, 2).otherwise(0))


def monthly_share(labelled: DataFrame, month: Column) -> DataFrame:
    """Share of each month's days with each label."""
    return labelled.groupBy(month.alias("month")).agg(F.avg((F.col("label") == 1).cast("double")).alias("f1"), F.avg((F.col("label") == 2).cast("double")).alias("f2"))


def taylor_skill(pairs: DataFrame) -> DataFrame:
    """r, sigma, tss of series x against y: 4 (1 + r)^4 / ((s + 1/s)^2 2^4)."""
    m = pairs.agg(F.corr("x", "y").alias("r"), ratio(F.stddev_pop("x"), F.stddev_pop("y")).alias("sigma"))
    s = F.col("sigma")
    return m.withColumn("tss", 4 * F.pow(1 + F.col("r"), 4) / (F.pow(s + ratio(F.lit(1.0), s), 2) * 16))


def dispersion(spark: SparkSession, waves: int = 50, depths: tuple[float, ...] = (50.0, 25.0, 12.0)) -> DataFrame:
    """wave, depth, wavenumber, frequency (cycles a day) of equatorial shallow-water
    waves: Kelvin, equatorial Rossby (n = 1), inertio-gravity (n = 1, 2), mixed
    Rossby-gravity and eastward inertio-gravity (n = 0)."""
    g, radius, omega = 9.80665, 6.37122e6, 7.292e-5
    k = spark.range(waves).select((F.lit(20.0) - F.col("id") * 40 / (waves - 1)).alias("wavenumber"))
    rows = k.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))
    c = F.sqrt(g * F.col("depth"))
    beta = 2 * omega / radius
    kk = F.col("wavenumber") / radius
    kelvin = kk * c
    rossby = F.when(kk < 0, -beta * kk / (kk * kk + 3 * beta / c))

    def ig(n: int) -> Column:
        """The root of its own equation, from five passes after a first guess."""
        fixed = (2 * n + 1) * beta * c + F.pow(kk * c, 2)
        return F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.sqrt(fixed), lambda w, _: F.sqrt(fixed + g * F.col("depth") * beta * kk / w))

    root = F.sqrt(F.pow(kk * c, 2) / 4 + beta * c)
    mixed = F.when(kk <= 0, kk * c / 2 + root)
    east0 = F.when(kk >= 0, kk * c / 2 + root)
    day = 86400 / (2 * math.pi)
    named = {"kelvin": kelvin, "er": rossby, "ig1": ig(1), "ig2": ig(2), "mrg": mixed, "eig": east0}
    wide = rows.select("wavenumber", "depth", *[(x * day).alias(n) for n, x in named.items()])
    return wide.unpivot(["wavenumber", "depth"], list(named), "wave", "frequency").where(F.col("frequency").isNotNull())


#: Months of the seasons whose blocks are analysed; the first of a winter is in the year before.
SEASONS = {"winter": (12, 1, 2, 3, 4), "summer": (6, 7, 8, 9, 10)}


def season_blocks(axis: DataFrame, season: str, start: int, end: int, least: int = 90) -> DataFrame:
    """The rows of a time axis (with time) in the blocks that begin from ``start`` on,
    before ``end``, and have ``least`` rows; and the block's year."""
    months = SEASONS[season]
    block = F.year("time") - F.when(F.month("time") < months[0], 1).otherwise(0)
    rows = axis.where(F.month("time").isin(*months)).withColumn("block", block).where((F.col("block") >= start) & (F.col("block") < end))
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("block"))).where(F.col("_n") >= least).drop("_n")


def without_leap_days(rows: DataFrame, time: str = "time") -> DataFrame:
    return rows.where(~((F.month(time) == 2) & (F.dayofmonth(time) == 29)))


def climatology_anomaly(series: DataFrame, keys: list[str], group: Column) -> DataFrame:
    """Value less the mean of its key's calendar group."""
    w = Window.partitionBy(*keys, group)
    return series.withColumn("value", F.col("value") - F.avg("value").over(w))


def yearly_activity(pcs: DataFrame, year: Column) -> DataFrame:
    """phase, mean over years of the yearly mean amplitude, and mean yearly days."""
    from ..functions.expr import phase

    amp = pcs.select(year.alias("year"), phase("pc1", "pc2").alias("phase"), F.sqrt(F.col("pc1") * F.col("pc1") + F.col("pc2") * F.col("pc2")).alias("amp"))
    by = amp.groupBy("year", "phase").agg(F.avg("amp").alias("amp"), F.count(F.lit(1)).alias("days"))
    return by.groupBy("phase").agg(F.avg("amp").alias("amplitude"), F.avg("days").alias("days"))


def first_last_valid(series: DataFrame, keys: list[str]) -> DataFrame:
    """The first and last step of each key that has a value."""
    valid = F.when(F.col("value").isNotNull(), F.col("k"))
    return series.groupBy(*keys).agg(F.min(valid).alias("first"), F.max(valid).alias("last"))
