"""Effect sizes and tests of two samples: columns key..., side ('ref' or 'test'), value."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..functions.expr import ratio
from . import ranges


def cohen(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(mean - mean) / root of the mean of the two population variances."""
    of = lambda agg, s: agg(F.when(F.col("side") == s, F.col("value")))
    m = samples.groupBy(*keys).agg(of(F.avg, "test").alias("a"), of(F.avg, "ref").alias("b"), of(F.var_pop, "test").alias("va"), of(F.var_pop, "ref").alias("vb"))
    return m.select(*keys, ratio(F.col("a") - F.col("b"), F.sqrt((F.col("va") + F.col("vb")) / 2)).alias("d"))


def welch(samples: DataFrame, keys: list[str], equal: bool = False) -> DataFrame:
    """t and degrees of freedom, with unequal variances or pooled."""
    of = lambda agg, s: agg(F.when(F.col("side") == s, F.col("value")))
    m = samples.groupBy(*keys).agg(
        of(F.avg, "test").alias("a"), of(F.avg, "ref").alias("b"), of(F.var_samp, "test").alias("va"), of(F.var_samp, "ref").alias("vb"),
        of(F.count, "test").cast("double").alias("n"), of(F.count, "ref").cast("double").alias("m"),
    )
    ea, eb, n1, m1 = F.col("va") / F.col("n"), F.col("vb") / F.col("m"), F.col("n") - 1, F.col("m") - 1
    if equal:
        pooled = (F.col("va") * n1 + F.col("vb") * m1) / F.nullif(n1 + m1, F.lit(0.0))
        t, df = ratio(F.col("a") - F.col("b"), F.sqrt(pooled * (1 / F.col("n") + 1 / F.col("m")))), n1 + m1
    else:
        t, df = ratio(F.col("a") - F.col("b"), F.sqrt(ea + eb)), ratio(F.pow(ea + eb, 2), ratio(ea * ea, n1) + ratio(eb * eb, m1))
    return m.select(*keys, t.alias("t"), df.alias("df"))


def with_t_p(t: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(special.t_two_sided(t.to_numpy(float), df.to_numpy(float)))

    return t.withColumn("p", p("t", "df"))


def _side(s: str):
    return F.when(F.col("side") == s, 1).otherwise(0)


def ks(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Greatest distance of the two empirical distributions.  Equal values are
    taken together before the running sums."""
    v = samples.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.sum(_side("test")).alias("a"), F.sum(_side("ref")).alias("b"))
    if not keys:
        placed, total = ranges.running(v, "value", ["a", "b"])
        gap = F.abs(F.col("a_run") / F.lit(total["a"] or None) - F.col("b_run") / F.lit(total["b"] or None))
        return placed.agg(F.max(gap).alias("d"), F.sum("a").alias("n"), F.sum("b").alias("m"))
    w = Window.partitionBy(*keys)
    run = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(ratio(F.sum("a").over(run), F.sum("a").over(w)) - ratio(F.sum("b").over(run), F.sum("b").over(w)))
    return v.withColumns({"gap": gap}).groupBy(*keys).agg(F.max("gap").alias("d"), F.sum("a").alias("n"), F.sum("b").alias("m"))


def mann_whitney(samples: DataFrame, keys: list[str]) -> DataFrame:
    """u of the test side, both sizes, and the ties' sum of t^3 - t."""
    v = samples.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.sum(_side("test")).alias("a"), F.sum(_side("ref")).alias("b"))
    if keys:
        below = F.coalesce(F.sum("b").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        v, _ = ranges.running(v, "value", ["b"])
        below = F.col("b_run") - F.col("b")
    t = F.col("a") + F.col("b")
    scored = v.withColumns({"u": F.col("a") * (below + F.col("b") / 2), "t": t * t * t - t})
    return scored.groupBy(*keys).agg(F.sum("u").alias("u"), F.sum("a").alias("n"), F.sum("b").alias("m"), F.sum("t").cast("double").alias("ties"))


def _sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    v = pdf.dropna(subset=["value"])
    return v.loc[v.side == "test", "value"].to_numpy(float), v.loc[v.side == "ref", "value"].to_numpy(float)


def _seeded(key: tuple, seed: int) -> np.random.Generator:
    import zlib

    return np.random.default_rng([seed, zlib.crc32(repr(key).encode())])


def cohen_bootstrap(samples: DataFrame, keys: list[str], resamples: int = 5000, seed: int = 1) -> DataFrame:
    """Mean of d over resamples of each side.  A key's samples are an ensemble's
    members, so a group is small."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _sides(pdf)
        d = None
        if len(a) and len(b) and (a.std() or b.std()):
            rng = _seeded(key, seed)
            found = effect_sizes(rng.choice(a, (resamples, len(a))), rng.choice(b, (resamples, len(b))))
            d = None if np.isnan(found).all() else float(np.nanmean(found))
        return pd.DataFrame([[*key, d]])

    kinds = dict(samples.dtypes)
    return samples.groupBy(*keys).applyInPandas(one, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "d double"]))


def effect_sizes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """d of each pair of rows; missing where neither has a spread."""
    spread = np.sqrt((x.var(1) + y.var(1)) / 2)
    ok = spread > 1e-12 * max(np.abs(x).max(), np.abs(y).max())
    return np.where(ok, x.mean(1) - y.mean(1), np.nan) / np.where(ok, spread, 1.0)


def mean_differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x.mean(1) - y.mean(1)


def bootstrap_test(
    samples: DataFrame, keys: list[str], statistic: Callable[[np.ndarray, np.ndarray], np.ndarray] = effect_sizes, resamples: int = 9999, seed: int = 1,
) -> DataFrame:
    """Mean d and population spread sigma of a statistic's resamples (a row each), and
    the two-sided normal p of d / sigma; one where d is zero or there is none."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _sides(pdf)
        if not len(a) or not len(b):
            return pd.DataFrame([[*key, None, None, None]])
        rng = _seeded(key, seed)
        x, y = rng.choice(a, (resamples, len(a))), rng.choice(b, (resamples, len(b)))
        s = statistic(x, y)
        s = s[~np.isnan(s)]
        if not len(s):
            return pd.DataFrame([[*key, None, None, 1.0]])
        d, sigma = float(s.mean()), float(s.std())
        p = 1.0 if d == 0 else 0.0 if sigma == 0 else float(special.normal_two_sided(d / sigma))
        return pd.DataFrame([[*key, d, sigma, p]])

    kinds = dict(samples.dtypes)
    return samples.groupBy(*keys).applyInPandas(one, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "d double, sigma double, p double"]))


def mean_interval(samples: DataFrame, keys: list[str], resamples: int = 1000, seed: int = 1) -> DataFrame:
    """95 % bootstrap interval of the mean of each key's values."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf["value"].dropna().to_numpy(float)
        if not len(v):
            return pd.DataFrame([[*key, None, None]])
        m = _seeded(key, seed).choice(v, (resamples, len(v))).mean(1)
        return pd.DataFrame([[*key, *map(float, np.percentile(m, [2.5, 97.5]))]])

    kinds = dict(samples.dtypes)
    return samples.groupBy(*keys).applyInPandas(one, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "lo double, hi double"]))


#: Takes samples of many keys at once, (keys x values of the test side, keys x values of
#: the reference side) with equal numbers of values, and gives a p-value a key, or an
#: object with these as ``pvalue``.
Test = Callable[[np.ndarray, np.ndarray], object]


def by_test(samples: DataFrame, keys: list[str], test: Test) -> DataFrame:
    """keys, p of a test of one's own.  A key's values are in ascending order, nulls left
    out; a key with an empty side has no p.  The function is sent to the workers once;
    there it gets the keys of a batch, those with equal numbers of values together."""
    own = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("value")).cast("double"))).alias(s)
    rows = samples.groupBy(*keys).agg(own("test"), own("ref"))

    def tested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = np.full(len(frame), np.nan)
            sizes = pd.Series(list(zip(frame["test"].map(len), frame["ref"].map(len), strict=True)), dtype=object)
            for (n, m), at in sizes.groupby(sizes).groups.items():
                if n and m:
                    x, y = (np.stack(frame[side].iloc[at].to_list()).astype(float) for side in ("test", "ref"))
                    found = test(x, y)
                    p[at] = np.broadcast_to(getattr(found, "pvalue", found), len(at))
            yield frame[keys].assign(p=p)

    kinds = dict(samples.dtypes)
    made = rows.mapInPandas(tested, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "p double"]))
    return made.withColumn("p", F.nanvl("p", F.lit(None).cast("double")))


def _t_test(samples: DataFrame, keys: list[str]) -> DataFrame:
    return with_t_p(welch(samples, keys))


def _ks_test(samples: DataFrame, keys: list[str]) -> DataFrame:
    @F.pandas_udf("double")
    def p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(special.ks_two_sided(*(x.to_numpy(float) for x in (d, n, m))))

    return ks(samples, keys).withColumn("p", p("d", "n", "m"))


def _u_test(samples: DataFrame, keys: list[str]) -> DataFrame:
    @F.pandas_udf("double")
    def p(u: pd.Series, n: pd.Series, m: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(special.mann_whitney_two_sided(*(x.to_numpy(float) for x in (u, n, m, t))))

    return mann_whitney(samples, keys).withColumn("p", p("u", "n", "m", "ties"))


#: Tests by name: the built-in ones are functions of samples and keys that give p by key.
BUILT_IN: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {"T-test": _t_test, "KS-test": _ks_test, "U-test": _u_test, "Bootstrap": bootstrap_test}


def all_tests(samples: DataFrame, keys: list[str], tests: list[str] | dict[str, Test | None] | None = None) -> DataFrame:
    """keys, test, p of the tests: names of built-in ones, or names with functions of
    one's own (None: the built-in one of that name); all built-in ones, if none are named."""
    asked = dict.fromkeys(BUILT_IN if tests is None else tests) | (tests if isinstance(tests, dict) else {})
    unknown = [n for n, f in asked.items() if f is None and n not in BUILT_IN]
    if unknown or not asked:
        raise KeyError(f"no test {', '.join(unknown)}")
    made = [(by_test(samples, keys, f) if f else BUILT_IN[n](samples, keys)).select(*keys, F.lit(n).alias("test"), "p") for n, f in asked.items()]
    return reduce(DataFrame.union, made)


def rejections(p_values: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Whether any metric's p is at most alpha, by key and test."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be within 0 and 1")
    return p_values.groupBy(*keys, "test").agg(F.bool_or(F.col("p") <= alpha).alias("rejected"))


def significant(p_values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """1 where p is below alpha."""
    return p_values.withColumn("significant", (F.col("p") < alpha).cast("int"))
