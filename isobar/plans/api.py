"""Analyses as objects: datasets in, tables out.  Nothing is computed before a table
is asked for."""

from __future__ import annotations

import functools
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import weight, weighted_mean
from ..operators import reduce, regrid, stats, validate
from ..operators.windows import dispersion
from ..sources.files import result_name, write_result
from . import evaluations, plots, prepared, storms
from .config import ISOConfig, MJOConfig, TCConfig


class SimulationData:
    """A named cube: variable, realization, time (and k), lat, lon, value."""

    def __init__(self, cube: DataFrame, name: str, catalog: DataFrame | None = None):
        validate.required_columns(cube)
        self.cube, self.name, self.catalog = cube, name, catalog

    def check_data(self) -> DataFrame:
        """The violations found; errors raise, all at once."""
        found = []
        if self.catalog is not None:
            found += [validate.complete(self.cube, self.catalog), validate.plausible(self.cube, self.catalog)]
        if "k" in self.cube.columns:
            found.append(validate.gaps(self.cube))
        if not found:
            return self.cube.sparkSession.createDataFrame([], "check string, subject string, severity string, detail string")
        out = validate.report(found)
        validate.raise_errors(out)
        return out


class ObservationData:
    def __init__(self, cube: DataFrame):
        self.cube = cube

    def load_and_process(self, sim: DataFrame, keys: tuple[str, ...] = ("variable", "k")) -> DataFrame:
        """At the simulation's steps, which all have to be there, and on its grid."""
        want = sim.select("k").distinct()
        if want.join(self.cube.select("k").distinct(), "k", "left_anti").limit(1).count():
            raise KeyError("the observations lack some of the simulation's times")
        return regrid.bilinear(self.cube.join(want, "k", "left_semi"), sim.select("lat", "lon").distinct(), list(keys))


class _Registry:
    def __init__(self, datasets: list[SimulationData] | None = None):
        self.datasets: dict[str, SimulationData] = {}
        self.add_datasets(datasets or [])

    def add_datasets(self, datasets: list[SimulationData]) -> None:
        for d in datasets:
            if d.name in self.datasets:
                warnings.warn(f"{d.name} is there already", stacklevel=2)
            else:
                self.datasets[d.name] = d

    def _named(self, names: list[str] | None) -> list[SimulationData]:
        absent = set(names or []) - self.datasets.keys()
        if absent:
            raise KeyError(f"no dataset {', '.join(sorted(absent))}")
        return [self.datasets[n] for n in names or self.datasets]

    def _pair(self, a: str, b: str, variable: str, side: bool = True) -> DataFrame:
        """Both cubes' rows of a variable, at the same times; the first is the reference side."""
        x, y = (d.cube.where(F.col("variable") == variable) for d in self._named([a, b]))
        validate.raise_errors(validate.same_grid(x, y, ["time"]))
        return x.withColumn("side", F.lit("ref")).unionByName(y.withColumn("side", F.lit("test")), allowMissingColumns=True)


#: Bins of time series: what time is cut to, and the bin's number.
BINS = {
    "annual": ("year", lambda t: F.year(t)),
    "monthly": ("month", lambda t: F.year(t) * 12 + F.month(t) - 1),
    "daily": ("day", lambda t: F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date"))),
}


class DataDiagnostics(_Registry):
    def time_series_plot(
        self, variable: str, names: list[str] | None = None, start: int | None = None, end: int | None = None,
        frequency: str = "annual", obs: dict[str, DataFrame] | None = None, members: bool = False,
    ) -> DataFrame:
        """kind, label, realization, k (the year; months or days are counted from year 0 and
        from 1970), start (the bin's first day), mean, q05, q95, lo, hi.  Means over the
        bins of area means: of ensembles over their members, with their spread; of
        observations, and of single members where they are asked for, alone."""
        if frequency not in BINS:
            raise ValueError(f"no frequency {frequency}; there are {', '.join(BINS)}")
        unit, number = BINS[frequency]
        named = self._named(names)
        lo, hi = start, end
        for cube in [d.cube for d in named] + list((obs or {}).values()):
            lo, hi = validate.year_range(cube, lo, hi)

        def binned(cube: DataFrame, label: str, own: list[str]) -> DataFrame:
            found = cube.where((F.col("variable") == variable) & F.year("time").between(lo, hi))
            by_time = found.groupBy(*own, "time").agg(weighted_mean("value", weight()).alias("value"))
            return reduce.resample(by_time, own, {"k": number(F.col("time")), "start": F.trunc("time", unit) if unit != "day" else F.to_date("time")}).withColumn("label", F.lit(label))

        union = lambda parts: functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        each = union([binned(d.cube, d.name, ["realization"]) for d in named])
        starts = each.select("k", "start").distinct()
        out = [plots.time_series(each).join(starts, "k").withColumn("kind", F.lit("ensemble"))]
        if members:
            out.append(each.withColumnRenamed("value", "mean").withColumn("kind", F.lit("member")))
        for name, cube in (obs or {}).items():
            out.append(binned(cube, name, []).withColumnRenamed("value", "mean").withColumn("kind", F.lit("observation")))
        out[0] = out[0].withColumn("realization", F.lit(None).cast(each.schema["realization"].dataType))
        return union(out).select("kind", "label", "realization", "k", "start", "mean", "q05", "q95", "lo", "hi")

    def abs_diff_plot(self, a: str, b: str, variable: str, ocean: bool = False) -> DataFrame:
        rows = self._pair(a, b, variable)
        return plots.map_table(reduce.difference_map(rows, "ref", "test", "side", ocean))

    def eff_size_plot(self, a: str, b: str, variable: str, alpha: float = 0.05, resamples: int = 5000, test: stats.Test | None = None) -> DataFrame:
        """Effect sizes, and where they are significant: by the pooled t-test or a test of
        one's own (see stats.Test)."""
        means = self._pair(a, b, variable).groupBy("side", "realization", "lat", "lon").agg(F.avg("value").alias("value"))
        d = stats.cohen_bootstrap(means.select("lat", "lon", "side", "value"), ["lat", "lon"], resamples).withColumnRenamed("d", "value")
        p = stats.by_test(means, ["lat", "lon"], test) if test else stats.with_t_p(stats.welch(means, ["lat", "lon"], equal=True))
        return plots.map_table(d, stats.significant(p, alpha))

    def bias_plot(self, name: str, variable: str, obs: DataFrame) -> DataFrame:
        sim = self._named([name])[0].cube.where(F.col("variable") == variable)
        return plots.map_table(reduce.bias_map(sim, obs))


class ReplicabilityTest(_Registry):
    def __init__(self, datasets: list[SimulationData] | None = None, obs: DataFrame | None = None, alpha: float = 0.05):
        if not 0 <= alpha <= 1:
            raise ValueError("alpha must be within 0 and 1")
        super().__init__(datasets)
        self.obs, self.alpha = obs, alpha
        self.results: dict[str, tuple[DataFrame, DataFrame]] = {}

    def perform_rep_test(self, names: list[str], resamples: int = 10_000, tests: list[str] | dict[str, stats.Test | None] | None = None) -> None:
        """Scores of both ensembles against the observations, their effect sizes and
        tests, by variable, season, region and metric.  Both have the same times, which
        give the months that seasons are made of.  tests: see stats.all_tests()."""
        a, b = self._named(names)
        validate.raise_errors(validate.same_grid(a.cube, b.cube, ["variable", "lat", "lon"]))
        validate.raise_errors(validate.same_grid(a.cube, b.cube, ["time"]))
        steps = a.cube.select("k", F.month("time").alias("month")).distinct()
        obs = self.obs.select("variable", "k", "lat", "lon", "value").join(steps, "k")
        samples = None
        for d, side in ((a, "ref"), (b, "test")):
            cube = d.cube.select("variable", "realization", "k", "lat", "lon", "value", F.month("time").alias("month"))
            scores = reduce.season_region_scores(cube, obs, F.col("month"), ["variable"])
            scores = scores.select("variable", "season", "region", "metric", F.lit(side).alias("side"), F.col("score").alias("value"))
            samples = scores if samples is None else samples.unionByName(scores)
        keys = ["variable", "season", "region", "metric"]
        self.results[" - ".join(names)] = stats.cohen_bootstrap(samples, keys, resamples), stats.rejections(stats.all_tests(samples, keys, tests), keys[:3], self.alpha)

    def _result(self, names: list[str]) -> tuple[DataFrame, DataFrame]:
        """Names in either order."""
        for key in (" - ".join(names), " - ".join(names[::-1])):
            if key in self.results:
                return self.results[key]
        raise KeyError(f"no test of {' and '.join(names)}")

    def get_eff_sizes(self, names: list[str]) -> DataFrame:
        return self._result(names)[0]

    def get_test_results(self, names: list[str]) -> DataFrame:
        return self._result(names)[1]

    def matrix_plot(self, names: list[str]) -> DataFrame:
        return plots.matrix(*self._result(names))

    def save_data(self, names: list[str], output: str) -> None:
        sizes, rejected = self._result(names)
        write_result(sizes, f"{output}/{result_name('effect_sizes', names)}")
        write_result(rejected, f"{output}/{result_name('test_results', names)}")

    def report(self, *_: object) -> None:
        raise NotImplementedError("reports aren't made")


@dataclass
class Evaluation:
    """Named tables of an evaluation."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def save_data(self, output: str, names: list[str] | None = None, years: tuple[int, int] | None = None) -> None:
        """Every table under its name, the datasets' and the years'."""
        for name, table in self.tables.items():
            write_result(table, f"{output}/{result_name(name, names, years)}")


def _table(rows: DataFrame, columns: list[str], reference: str, by: list[str] | None = None) -> DataFrame:
    """row (dataset), column and value with the column's limits; ``by`` columns go into
    the column's name."""
    long = rows.unpivot(["dataset", *(by or [])], columns, "metric", "value")
    name = F.concat_ws(" ", "metric", *[F.col(c).cast("string") for c in by or []])
    return plots.score_table(long.select(F.col("dataset").alias("row"), name.alias("column"), "value"), reference)


class GeneralEvaluation(Evaluation):
    def scores_table(self, variables: list[str] | None = None) -> DataFrame:
        """Relative bias, relative error and correlation beside a reference row of ones."""
        found = self.tables["scores"] if variables is None else self.tables["scores"].where(F.col("variable").isin(variables))
        means = found.groupBy("variable").agg(*[F.avg(c).alias(c) for c in ("bias", "rmse", "r")])
        ones = means.select("variable", *[F.lit(1.0).alias(c) for c in ("bias", "rmse", "r")]).withColumn("dataset", F.lit("reference"))
        return _table(means.withColumn("dataset", F.lit("simulation")).unionByName(ones), ["bias", "rmse", "r"], "reference", ["variable"])


class ISOEvaluation(Evaluation):
    def eeof_plots(self, season: str) -> DataFrame:
        """mode, copy (delay), lat, lon and scaled loading of a season's modes."""
        part = F.split("feature", "[/@]")
        return self.tables[f"eeof_{season}"].select("mode", part[2].cast("int").alias("copy"), part[0].cast("double").alias("lat"), part[1].cast("double").alias("lon"), F.col("loading").alias("value"))

    def pc_plots(self, years: tuple[int, int], of: str = "sim") -> DataFrame:
        """season, time, mode and standard component in the years."""
        times = self.tables[f"labels_{of}"].select("sample", "time").where(F.year("time").between(*years))
        return self.tables[f"pcs_{of}"].join(times, "sample").select("season", "time", "mode", F.col("std").alias("value"))

    def freq_plot(self) -> DataFrame:
        """dataset, month, metric (f1 winter family, f2 summer family) and share of days."""
        of = [t.withColumn("dataset", F.lit(k[5:])) for k, t in self.tables.items() if k.startswith("freq_")]
        return plots.lines(of[0] if len(of) == 1 else of[0].unionByName(of[1]), "month", ["f1", "f2"])


class MJOEvaluation(Evaluation):
    def ceof_plots(self) -> DataFrame:
        """dataset (obs, sim_on_sim), mode, variable, lon and loading."""
        part = F.split("feature", "/")
        return self.tables["ceof"].where("dataset <> 'sim_on_obs'").select("dataset", "mode", part[0].alias("variable"), part[1].cast("double").alias("lon"), F.col("loading").alias("value"))

    def lead_lag_corr_plot(self) -> DataFrame:
        return self.tables["lead_lag"].select("dataset", "lag", "r")

    def ceof_corr_table(self) -> DataFrame:
        """Correlations with the observation's loadings by variable and mode."""
        return _table(self.tables["ceof_corr"], ["ceof_corr"], "obs", ["variable", "mode"])

    def ceof_bias_table(self) -> DataFrame:
        """Biases of explained variance by mode, of the greatest correlation and the period."""
        modes = _table(self.tables["ceof_scores"], ["explained_var_bias"], "obs", ["mode"])
        return modes.unionByName(_table(self.tables["scores"].withColumn("period_bias", F.col("period_bias").cast("double")), ["max_corr_bias", "period_bias"], "obs"))

    def _activity(self, value: str) -> DataFrame:
        return self.tables["activity"].select("dataset", "phase", F.lit(value).alias("metric"), F.col(value).cast("double").alias("value"))

    def mean_active_amplitude_plot(self) -> DataFrame:
        return self._activity("active_amplitude")

    def active_days_plot(self) -> DataFrame:
        return self._activity("active_days")

    def activity_per_phase_plots(self) -> DataFrame:
        return self._activity("active_amplitude").unionByName(self._activity("active_days"))

    def mean_amplitude_bias_table(self) -> DataFrame:
        return _table(self.tables["activity"], ["active_amplitude_bias"], "obs", ["phase"])

    def active_days_bias_table(self) -> DataFrame:
        return _table(self.tables["activity"], ["active_days_bias"], "obs", ["phase"])

    def activity_per_phase_bias_tables(self) -> DataFrame:
        return self.mean_amplitude_bias_table().unionByName(self.active_days_bias_table().withColumns({c: F.col(c).cast("double") for c in ("value", "lo", "hi")}))

    def power_spectrum_plots(self, variable: str, component: str = "symmetric") -> DataFrame:
        """dataset, kind, wavenumber, frequency, value of a normalised spectrum, with the
        waves' curves."""
        own = self.tables["power"].where((F.col("variable") == variable) & (F.col("component") == component))
        curves = dispersion(own.sparkSession)
        parts = [plots.spectrum(own.where(F.col("dataset") == d), curves).withColumn("dataset", F.lit(d)) for d in ("obs", "sim")]
        return parts[0].unionByName(parts[1])

    def power_bias_table(self) -> DataFrame:
        return _table(self.tables["power_scores"], ["ew_ratio_bias", "eo_ratio_bias", "period_bias"], "obs", ["variable"])


class TCEvaluation(Evaluation):
    def __init__(self, tables: dict[str, DataFrame], control: str):
        super().__init__(tables)
        self.control = control

    def _of(self, name: str) -> DataFrame:
        return _table(self.tables[name], [c for c in self.tables[name].columns if c != "dataset"], self.control)

    def clim_bias_table(self) -> DataFrame:
        return self._of("clim_bias")

    def storm_bias_table(self) -> DataFrame:
        return self._of("storm_bias")

    def temp_corr_table(self) -> DataFrame:
        return plots.score_table(self.tables["temporal_correlation"].select(F.col("dataset").alias("row"), F.col("metric").alias("column"), F.col("spearman").alias("value")), self.control)

    def spatial_corr_table(self) -> DataFrame:
        return plots.score_table(self.tables["spatial_correlation"].select(F.col("dataset").alias("row"), F.col("metric").alias("column"), "value"), self.control)

    def linear_plots(self) -> DataFrame:
        """dataset, cycle (month or year), at, metric, value."""
        value = [c for c in ("count", "tcd", "ace", "pace", "lmi") if c in self.tables["monthly"].columns]
        parts = [plots.lines(self.tables[t], x, value).withColumnRenamed(x, "at").withColumn("cycle", F.lit(x)) for t, x in (("monthly", "month"), ("yearly", "year"))]
        return parts[0].unionByName(parts[1])

    def spatial_plots(self) -> DataFrame:
        """kind (density, bias), dataset, i, j, metric, value; empty cells of densities are
        left out, biases are against the control."""
        density = self.tables["maps"].unpivot(["dataset", "i", "j"], list(evaluations.MAPS), "metric", "value").where("value <> 0").withColumn("kind", F.lit("density"))
        bias = self.tables["map_bias"].where(F.col("dataset") != self.control).unpivot(["dataset", "i", "j"], list(evaluations.MAPS), "metric", "value").withColumn("kind", F.lit("bias"))
        return density.unionByName(bias)


class ScientificEvaluation(_Registry):
    def compute_general_scores(self, name: str, obs: DataFrame, variables: list[str]) -> GeneralEvaluation:
        """Relative bias, relative error and pattern correlation, by variable."""
        cube, out = self._named([name])[0].cube, None
        for v in variables:
            sim, o = cube.where(F.col("variable") == v), obs.where(F.col("variable") == v)
            mean = lambda df, c, v=v: df.agg(F.avg("value").alias(c)).withColumn("variable", F.lit(v))
            means = sim.groupBy("realization", "lat", "lon").agg(F.avg("value").alias("x"))
            pairs = means.join(o.groupBy("lat", "lon").agg(F.avg("value").alias("y")), ["lat", "lon"])
            row = mean(reduce.absolute_bias(sim, o), "bias").join(mean(reduce.absolute_rmse(sim, o), "rmse"), "variable")
            row = row.join(mean(reduce.pattern_correlation(pairs, ["realization"]), "r"), "variable")
            out = row if out is None else out.unionByName(row)
        return GeneralEvaluation({"scores": out})

    def compute_iso_scores(
        self, name: str, config: ISOConfig | None = None, obs: DataFrame | prepared.PreparedISO | None = None, years: tuple[int, int] | None = None, correct: bool = False,
        component_years: tuple[int, int] | None = None,
    ) -> ISOEvaluation:
        """Extended modes of the intraseasonal oscillation, components, labels, monthly
        shares and, with observations (a field, or one prepared), their skill."""
        return ISOEvaluation(evaluations.iso(self._named([name])[0].cube, obs, config, years, correct, component_years))

    def compute_mjo_scores(self, name: str, obs: DataFrame, config: MJOConfig | None = None, cycle: int = 365) -> MJOEvaluation:
        """Combined modes, components, lead-lag curves, activity and spectra, with
        scores and biases."""
        return MJOEvaluation(evaluations.mjo(self._named([name])[0].cube, obs, config, cycle))

    @staticmethod
    def compute_tc_scores(points: DataFrame, control: str, years: float | dict[str, float], config: TCConfig | None = None) -> TCEvaluation:
        """Monthly, yearly, climatological and spatial metrics of tracks, biases and
        correlations against the control."""
        return TCEvaluation(evaluations.tc(points, control, years, config), control)

    def evaluate_storms(
        self, name: str, references: dict[str, storms.TrackSet], control: str | None = None, start: int | None = None, end: int | None = None,
        wind_factor: float = 1.0, config: TCConfig | None = None, topography: DataFrame | None = None,
    ) -> TCEvaluation:
        """The same from the dataset's fields: its storms are found, tracked and compared
        with the references' (see storms.from_fields())."""
        cube = self._named([name])[0].cube
        return TCEvaluation(storms.from_fields(cube, name, references, control, start, end, wind_factor, config, topography), control or next(iter(references)))
