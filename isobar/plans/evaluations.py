"""Whole evaluations, as dictionaries of tables: intraseasonal modes, the
Madden-Julian oscillation and tropical cyclones."""

from __future__ import annotations

from functools import reduce as fold
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio, weight
from ..operators import detect, eof, reduce, regrid, spectrum, tracks
from ..operators import windows as W
from ..session import checkpointed
from .config import ISOConfig, MJOConfig, TCConfig

if TYPE_CHECKING:
    from .prepared import PreparedISO

Tables = dict[str, DataFrame]


def _union(parts: list[DataFrame]) -> DataFrame:
    return fold(DataFrame.unionByName, parts)


def biases(rows: DataFrame, keys: list[str], reference: str, values: list[str]) -> DataFrame:
    """The datasets' values, and beside them the differences from the reference's (its own
    values for itself), as value_bias."""
    off = reduce.against_reference(rows, keys, "dataset", reference, values)
    return rows.join(off.select("dataset", *keys, *[F.col(v).alias(f"{v}_bias") for v in values]), ["dataset", *keys])


# --- intraseasonal oscillation ---------------------------------------------------------


def band(cube: DataFrame, c: ISOConfig) -> DataFrame:
    """k, time, lat, lon, value: the band-passed field inside the latitudes."""
    inside = cube.where(F.col("lat").between(*c.lat)).select("k", "time", "lat", "lon", "value")
    return spectrum.bandpass(inside, ["lat", "lon"], W.lanczos(c.window, c.low, c.high))


def _long(field: DataFrame, value: Column) -> DataFrame:
    return field.select(F.col("k").alias("sample"), F.concat_ws("/", "lat", "lon").alias("feature"), value.alias("value"))


def iso_modes(field: DataFrame, season: str, c: ISOConfig, years: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Extended modes of a season's blocks, which are joined before they are delayed;
    values are weighted by the root of the latitude's cosine."""
    days = W.season_blocks(field.select("k", "time").distinct(), season, *years, c.min_block).select(F.col("k").alias("sample"))
    long = _long(field, F.col("value") * F.sqrt(weight())).join(days, "sample", "left_semi")
    return eof.fit(eof.delayed(long, c.lag, c.copies), c.modes)


def iso_components(field: DataFrame, modes: dict[str, tuple[DataFrame, DataFrame]], c: ISOConfig) -> tuple[DataFrame, DataFrame]:
    """pcs (season, sample, mode, raw, std) and the amplitudes of both families; the
    projection's weights are the cosines themselves."""
    late = checkpointed(eof.delayed(_long(field, F.col("value") * weight()), c.lag, c.copies))
    full = late.groupBy("sample").agg(F.count("value").alias("n"))
    whole = late.join(full.where(F.col("n") == full.agg(F.max("n")).first()[0]), "sample", "left_semi")  # samples with all delays
    pcs = {season: eof.standard(eof.project(whole, loads), table) for season, (table, loads) in modes.items()}
    amps = [
        eof.amplitude(p).withColumnRenamed("amplitude", f"raw{n}").join(eof.amplitude(p, "std").withColumnRenamed("amplitude", f"std{n}"), "sample")
        for n, p in ((1, pcs["winter"]), (2, pcs["summer"]))
    ]
    times = field.select(F.col("k").alias("sample"), "time").distinct()
    return _union([p.withColumn("season", F.lit(s)) for s, p in pcs.items()]), amps[0].join(amps[1], "sample").join(times, "sample")


def alpha(sim: DataFrame, obs: DataFrame) -> DataFrame:
    """The simulation's mean raw amplitudes over the observation's: one row."""
    mean = lambda amps, name: amps.agg((F.avg("raw1") + F.avg("raw2")).alias(name))
    return mean(sim, "s").crossJoin(mean(obs, "o")).select(ratio("s", "o").alias("alpha"))  # one row each


def adjusted(amps: DataFrame, by: DataFrame) -> DataFrame:
    """Amplitudes over alpha."""
    scaled = amps.crossJoin(F.broadcast(by))  # one row
    return scaled.withColumns({x: ratio(x, "alpha") for x in ("raw1", "raw2", "std1", "std2")}).drop("alpha")


def iso(
    sim: DataFrame, obs: DataFrame | PreparedISO | None = None, c: ISOConfig | None = None, years: tuple[int, int] | None = None, correct: bool = False,
    component_years: tuple[int, int] | None = None,
) -> Tables:
    """Modes of the observation if there is one, else of the simulation; components,
    labels and monthly shares; with an observation, the ratio of amplitudes (which the
    simulation's are divided by, if asked for) and the skill of the seasonality.
    sim, obs: k, time, lat, lon, value, a field each; obs may be a prepared observation,
    whose modes, settings and years count then.  Years are the modes'; amplitudes, labels
    and shares are of the components' years (all steps, if none are given)."""
    ready = obs if obs is not None and not isinstance(obs, DataFrame) else None
    c = ready.config if ready else c or ISOConfig()
    if ready:
        sim, obs = ready.on_grid(sim), None
    elif obs is not None:
        sim, obs = regrid.to_coarser(sim.select("k", "time", "lat", "lon", "value"), obs.select("k", "time", "lat", "lon", "value"), ["k", "time"])
    fields = {name: checkpointed(band(cube, c)) for name, cube in (("sim", sim), ("obs", obs)) if cube is not None}
    source = fields.get("obs", fields["sim"])
    if years is None and ready is None:
        ends = source.agg(F.year(F.min("time")).alias("a"), F.year(F.max("time")).alias("b")).first()
        years = ends["a"], ends["b"]
    modes = ready.modes if ready else {season: iso_modes(source, season, c, years) for season in ("winter", "summer")}
    tables: Tables = {}
    for season, (table, loads) in modes.items():
        tables |= {f"modes_{season}": table, f"eeof_{season}": eof.scaled(loads, table)}
    month = F.month("time")
    amps: dict[str, DataFrame] = {}
    for name, field in fields.items():
        tables[f"pcs_{name}"], amps[name] = iso_components(field, modes, c)
    if ready:
        tables["pcs_obs"], amps["obs"] = ready.pcs, ready.amplitudes
    for name, found in amps.items():
        own = F.lit(True) if component_years is None else F.year("time").between(*component_years)
        amps[name] = checkpointed(found.where(own))
    if "obs" in amps:
        tables["alpha"] = alpha(amps["sim"], amps["obs"])
        if correct:
            amps["sim"] = adjusted(amps["sim"], tables["alpha"])
    for name in amps:
        tables[f"labels_{name}"] = W.labels(amps[name])
        tables[f"freq_{name}"] = W.monthly_share(tables[f"labels_{name}"], month)
    if "obs" in amps:
        off = lambda name, to: tables[f"freq_{name}"].select("month", (F.col("f2") - F.col("f1")).alias(to))
        tables["skill"] = W.taylor_skill(off("sim", "x").join(off("obs", "y"), "month"))
    return tables


# --- Madden-Julian oscillation ---------------------------------------------------------


def mjo_modes(filtered: DataFrame, modes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """modes, loadings, and the filtered field as samples x features (variable/lon)."""
    long = checkpointed(filtered.select(F.col("k").alias("sample"), F.concat_ws("/", "variable", "lon").alias("feature"), "value"))
    return *eof.fit(long, modes), long


def mjo_set(long: DataFrame, loads: DataFrame, table: DataFrame, c: MJOConfig) -> Tables:
    """Components, lead-lag curve, its summary, and activity by phase of one set."""
    pcs = checkpointed(eof.standard(eof.project(long, loads), table))
    series = pcs.select(F.concat(F.lit("pc"), F.col("mode") + 1).alias("variable"), F.col("sample").alias("k"), F.col("std").alias("value"))
    pair = pcs.groupBy(F.col("sample").alias("k")).agg(F.max(F.when(F.col("mode") == 0, F.col("std"))).alias("pc1"), F.max(F.when(F.col("mode") == 1, F.col("std"))).alias("pc2"))
    curve = W.lead_lag(series, "pc1", "pc2", c.max_lag)
    return {"pcs": pcs, "lead_lag": curve, "summary": W.lead_lag_summary(curve), "activity": W.activity(pair)}


def spectra(cube: DataFrame, cycle: int, c: MJOConfig) -> DataFrame:
    """variable, component, wavenumber, frequency, power: the field without its
    seasonal cycle and trend (the mean stays) and without periods beyond a segment, split
    at the equator."""
    cell = ["variable", "lat", "lon"]
    field = W.detrend(W.harmonics(cube, cell, cycle, c.harmonics), cell)
    field = spectrum.low_frequency_filter(field, cell, c.segment)
    return spectrum.segment_power(spectrum.symmetric(field, ["variable", "k"]), ["variable"], c.segment, c.overlap)


def power_scores(power: DataFrame, reference: str, c: MJOConfig) -> DataFrame:
    """dataset, variable, east-west and east-observed ratios and mean period of the
    symmetric part, with biases; the last ratio's is against one."""
    keys, box = ["dataset", "variable"], {"frequency": c.frequency, "wavenumber": c.wavenumber}
    own = power.where("component = 'symmetric'")
    east = spectrum.band_power(own, keys, **box)
    seen = east.where(F.col("dataset") == reference).select("variable", F.col("power").alias("_o"))
    eo = east.join(seen, "variable").select(*keys, ratio("power", "_o").alias("eo_ratio"))
    ew = spectrum.east_west(own, keys, c.frequency, c.wavenumber).withColumnRenamed("ratio", "ew_ratio")
    rows = ew.join(eo, keys).join(spectrum.period(own, keys, **box), keys)
    return biases(rows, ["variable"], reference, ["ew_ratio", "eo_ratio", "period"])


def mjo(sim: DataFrame, obs: DataFrame, c: MJOConfig | None = None, cycle: int = 365) -> Tables:
    """Combined modes of the observation and of the simulation (matched in order and
    sign by the variable that decides); the sets obs, sim_on_obs and sim_on_sim with
    scores, biases and the correlation of every variable's loadings; spectra over
    their background, with scores and biases.
    sim, obs: variable, k, lat, lon, value, and time where leap days are to go."""
    c = c or MJOConfig()
    cubes = {}
    for name, cube in (("obs", obs), ("sim", sim)):
        cube = W.without_leap_days(cube) if "time" in cube.columns else cube
        cubes[name] = checkpointed(cube.where(F.col("lat").between(*c.lat)).select("variable", "k", "lat", "lon", "value"))
    made = {name: mjo_modes(spectrum.prefilter(cube, cycle, c.rolling), c.modes) for name, cube in cubes.items()}
    (o_table, o_loads, o_long), (s_table, s_loads, s_long) = made["obs"], made["sim"]
    o_loads = o_loads.withColumn("loading", F.when(F.col("mode") == 0, -F.col("loading")).otherwise(F.col("loading")))
    variable = F.split("feature", "/")[0]
    deciding = [x.where(variable == c.deciding) for x in (s_loads, o_loads)]
    order = eof.mode_order(*deciding)
    s_loads, s_table = eof.reordered(s_loads, order), eof.reordered(s_table, order)
    sets = {"obs": (o_long, o_loads, o_table), "sim_on_obs": (s_long, o_loads, o_table), "sim_on_sim": (s_long, s_loads, s_table)}
    found = {name: mjo_set(*x, c) for name, x in sets.items()}
    of = lambda part: _union([x[part].withColumn("dataset", F.lit(name)) for name, x in found.items()])
    by = lambda x: x.withColumn("variable", variable)
    corr = _union([eof.loading_correlation(by(o_loads), by(x[1]), ["variable"]).where("mode_a = mode_b").select(F.lit(name).alias("dataset"), "variable", F.col("mode_a").alias("mode"), F.col("r").alias("ceof_corr")) for name, x in sets.items()])
    share = _union([x[2].select(F.lit(name).alias("dataset"), "mode", (100 * F.col("var_frac")).alias("explained_var")) for name, x in sets.items()])
    power = checkpointed(_union([spectra(cube, cycle, c).withColumn("dataset", F.lit(name)) for name, cube in cubes.items()]))
    return {
        "ceof": _union([x[1].withColumn("dataset", F.lit(name)) for name, x in sets.items()]), "pcs": of("pcs"), "lead_lag": of("lead_lag"),
        "ceof_scores": biases(share, ["mode"], "obs", ["explained_var"]), "ceof_corr": corr,
        "scores": biases(of("summary"), [], "obs", ["max_corr", "period"]),
        "activity": biases(of("activity"), ["phase"], "obs", ["amplitude", "active_amplitude", "days", "active_days"]),
        "power": spectrum.normalised(power, ["dataset", "variable"]), "power_scores": power_scores(power, "obs", c),
    }


# --- tropical cyclones -------------------------------------------------------------------


def storm_tracks(fields: DataFrame | detect.Reading, c: TCConfig | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Tracks (keys, track, pt, step, lat, lon, psl, wind) of the storms of a cube.  fields:
    keys, step, lat, lon, psl, thickness, wind, of cells, grids or a reading
    (see detect.detect_nodes()).  A key named time is a step's time."""
    c = c or TCConfig()
    tile = c.tile or None
    nodes = detect.detect_nodes(fields, [*keys, "step"], c.psl_delta, c.psl_dist, c.z_delta, c.z_dist, c.z_offset, c.merge_dist, tile=tile, step=c.step)
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())  # which stitching writes before it reads them twice
    linked = tuple(k for k in keys if k != "time")
    return detect.stitch_nodes(nodes, c.reach, c.max_gap, c.min_length, c.min_wind, c.max_lat, c.min_strong, linked)


def correlations(rows: DataFrame, keys: list[str], control: str, values: list[str]) -> DataFrame:
    """dataset, metric, keys, x (the dataset's), y (the control's)."""
    long = rows.unpivot(["dataset", *keys], values, "metric", "x")
    own = long.where(F.col("dataset") == control).select(*keys, "metric", F.col("x").alias("y"))
    return long.join(own, [*keys, "metric"], "full" if "i" in keys else "inner")


METRICS = ("count", "tcd", "ace", "pace", "lmi")
MAPS = ("count", "gen", "tcd", "ace", "pace", "minpres", "maxwind")


def tc(points: DataFrame, control: str, years: float | dict[str, float], c: TCConfig | None = None, members: float | dict[str, float] = 1) -> Tables:
    """Monthly, yearly, climatological, storm and spatial metrics of tracks; biases and
    temporal and spatial correlations against the control.  years: model years (members
    times years), of all datasets or of each; yearly totals are a member's."""
    c = c or TCConfig()
    kept = tracks.by_wind(points, c.min_wind)
    fitted = tracks.quadratic(kept, control)
    storms = checkpointed(tracks.storm_stats(kept).join(tracks.pressure_energy(kept, fitted), tracks.STORM))
    monthly, yearly = tracks.monthly(storms, years), tracks.yearly(storms, members)
    clim = tracks.climatology(storms, years).join(tracks.yearly_means(storms), "dataset")
    maps = checkpointed(tracks.spatial_bundle(kept, storms, fitted, c.bin, years))
    by_time = correlations(monthly, ["month"], control, list(METRICS)).dropna(subset=["x", "y"])
    grid = fold(lambda a, v: a.join(tracks.full_grid(maps, c.bin, v), ["dataset", "i", "j"]), MAPS[1:], tracks.full_grid(maps, c.bin, MAPS[0]))
    by_place = correlations(grid.withColumn("lat", F.col("i") * c.bin - 90), ["i", "j", "lat"], control, list(MAPS))
    temporal = W.spearman(by_time, ["dataset", "metric"]).withColumnRenamed("value", "spearman").join(by_time.groupBy("dataset", "metric").agg(F.corr("x", "y").alias("pearson")), ["dataset", "metric"])
    value = [x for x in clim.columns if x != "dataset"]
    return {
        "storms": storms, "monthly": monthly, "yearly": yearly, "climatology": clim, "maps": maps,
        "clim_bias": reduce.against_reference(clim, [], "dataset", control, [x for x in value if x.startswith("uclim")]),
        "storm_bias": reduce.against_reference(clim, [], "dataset", control, [x for x in value if x.startswith("storm")]),
        "temporal_correlation": temporal,
        "spatial_correlation": reduce.pattern_correlation(by_place, ["dataset", "metric"]),
        "map_bias": reduce.against_reference(grid, ["i", "j"], "dataset", control, list(MAPS)),
    }
