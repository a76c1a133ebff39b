"""Empirical orthogonal functions of samples x features kept long: sample, feature, value.

Only products of the rows with a narrow matrix (features x a few columns) are asked
of Spark, summed by partition and then by strips of features.  Few features take one
such product with the unit matrix; more take a Krylov space of blocks, which ends
when the wanted modes' residuals vanish.  The driver holds features x (the space's
columns), never features squared, whatever the number of samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Features up to which the whole matrix of products is taken at once.
AT_ONCE = 256
#: Columns of a block besides the modes, residual (to the largest eigenvalue), blocks.
SPARE, RESIDUAL, BLOCKS = 8, 1e-10, 60
#: Features of a strip, and parts of a strip that are added up at a time.
STRIP, PARTS = 512, 16


def vectors(long: DataFrame, features: DataFrame) -> DataFrame:
    """sample, x: dense rows in the order of features (feature, j, and perhaps weight);
    incomplete samples are left out."""
    n = features.count()
    value = F.col("value") * F.col("weight") if "weight" in features.columns else F.col("value")
    placed = long.where("value IS NOT NULL").join(features, "feature").select("sample", "j", value.alias("value"))
    rows = placed.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("j", "value"))).alias("x"))
    return rows.where(F.size("x") == n).select("sample", F.col("x.value").alias("x"))


def _sums(rows: DataFrame, n: int, by: np.ndarray) -> DataFrame:
    """strip, part: the rows' products with each other, times ``by`` (n x columns)."""
    broad = rows.sparkSession.sparkContext.broadcast(by)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = broad.value
        total = np.zeros(q.shape)
        for batch in batches:
            x = np.array(batch.column("x").flatten(), float).reshape(len(batch), n)
            total += x.T @ (x @ q)
        strips = range(0, n, STRIP)
        part = TaskContext.get().partitionId() % PARTS
        yield pa.RecordBatch.from_arrays([pa.array([k // STRIP for k in strips], pa.int32()), pa.array([part] * len(strips), pa.int32()), pa.array([total[k : k + STRIP].tobytes() for k in strips])], names=["strip", "part", "sums"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in pdf["sums"])
        return pd.DataFrame({"strip": pdf["strip"].iloc[:1], "part": [0], "sums": [total.tobytes()]})

    schema = "strip int, part int, sums binary"
    return rows.select("x").mapInArrow(products, schema).groupBy("strip", "part").applyInPandas(added, schema).groupBy("strip").applyInPandas(added, schema)


def product(rows: DataFrame, n: int, by: np.ndarray) -> np.ndarray:
    """The same on the driver: n x the columns of ``by``."""
    strips = sorted(_sums(rows, n, by).collect(), key=lambda r: r["strip"])  # n / STRIP rows
    return np.concatenate([np.frombuffer(r["sums"]).reshape(-1, by.shape[1]) for r in strips]) if strips else np.zeros(by.shape)


def gram(rows: DataFrame, n: int) -> DataFrame:
    """i, j, value: sums of products of features."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for strip, sums in zip(batch.column("strip").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                value = np.frombuffer(sums)
                i, j = np.divmod(np.arange(len(value)), n)
                yield pa.RecordBatch.from_arrays([pa.array(i + strip * STRIP, pa.int32()), pa.array(j, pa.int32()), pa.array(value)], names=["i", "j", "value"])

    return _sums(rows, n, np.eye(n)).mapInArrow(spread, "i int, j int, value double")


def feature_table(long: DataFrame) -> DataFrame:
    """feature, j: the features in order, numbered from zero (an axis: one task)."""
    return long.select("feature").distinct().withColumn("j", (F.row_number().over(Window.orderBy("feature")) - 1).cast("int"))


class NotConverged(ArithmeticError):
    """Modes that the passes allowed didn't settle."""


def _leading(rows: DataFrame, n: int, modes: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of the rows' products and their vectors."""
    if n <= AT_ONCE:
        values, vecs = np.linalg.eigh(product(rows, n, np.eye(n)))
        return values[::-1][:modes], vecs[:, ::-1][:, :modes]
    block = np.linalg.qr(np.random.default_rng(17).normal(size=(n, modes + SPARE)))[0]
    basis, applied = np.zeros((n, 0)), np.zeros((n, 0))
    worst = np.inf
    for _ in range(BLOCKS):
        image = product(rows, n, block)
        basis, applied = np.hstack([basis, block]), np.hstack([applied, image])
        small = basis.T @ applied
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1][:modes], y[:, ::-1][:, :modes]
        vecs = basis @ y
        worst = np.linalg.norm(applied @ y - vecs * values, axis=0).max() / max(values[0], 1e-300)
        if worst <= RESIDUAL:
            return values, vecs
        for _ in range(2):  # twice is enough
            image = image - basis @ (basis.T @ image)
        block, r = np.linalg.qr(image)
        block = block[:, np.abs(np.diag(r)) > 1e-12 * np.sqrt((applied * applied).sum())][:, : n - basis.shape[1]]
        if not block.shape[1]:  # the space can't grow: it holds the modes
            return values, vecs
    raise NotConverged(f"after {BLOCKS} passes the modes' residual is {worst:.1e} of the first eigenvalue; {RESIDUAL:.0e} is asked for")


def fit(long: DataFrame, modes: int = 2, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """modes (mode, eigval, var_frac) and loadings (mode, feature, loading).  Not
    centred; the largest loading of a mode is positive; eigenvalues are over the
    samples less one.  weights: feature, weight.  Without a complete sample, or where
    all values are zero, there are no modes."""
    spark = long.sparkSession
    features = checkpointed(feature_table(long))
    placed = features if weights is None else features.join(weights, "feature")
    order = [r["feature"] for r in features.orderBy("j").collect()]
    rows = checkpointed(vectors(long, placed))
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("total")).first()
    values, vecs = _leading(rows, len(order), min(modes, len(order))) if m["n"] and m["total"] else (np.zeros(0), np.zeros((len(order), 0)))
    table, loads = [], []
    for k, value in enumerate(values):
        v = vecs[:, k] * np.sign(vecs[np.abs(vecs[:, k]).argmax(), k])
        table.append((k, float(value / max(m["n"] - 1, 1)), float(value / m["total"])))
        loads += [(k, f, float(x)) for f, x in zip(order, v, strict=True)]
    kind = long.schema["feature"].dataType.simpleString()
    return spark.createDataFrame(table, "mode int, eigval double, var_frac double"), spark.createDataFrame(loads, f"mode int, feature {kind}, loading double")


def project(long: DataFrame, loadings: DataFrame) -> DataFrame:
    """sample, mode, raw: sums of value x loading.  Loadings are features x modes."""
    return long.join(loadings, "feature").groupBy("sample", "mode").agg(F.sum(F.col("value") * F.col("loading")).alias("raw"))


def standard(pcs: DataFrame, modes: DataFrame) -> DataFrame:
    """Components over the roots of their eigenvalues."""
    return pcs.join(F.broadcast(modes.select("mode", "eigval")), "mode").withColumn("std", F.col("raw") / F.sqrt("eigval")).drop("eigval")


def amplitude(pcs: DataFrame, value: str = "raw") -> DataFrame:
    return pcs.groupBy("sample").agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("amplitude"))


def loading_correlation(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """mode_a, mode_b, r over the shared features; of each group of features where
    ``by`` names columns of both."""
    keys = [*(by or []), "feature"]
    x = a.select(F.col("mode").alias("mode_a"), *keys, F.col("loading").alias("x"))
    y = b.select(F.col("mode").alias("mode_b"), *keys, F.col("loading").alias("y"))
    return x.join(y, keys).groupBy(*(by or []), "mode_a", "mode_b").agg(F.corr("x", "y").alias("r"))


def mode_order(new: DataFrame, reference: DataFrame) -> dict[int, tuple[int, float]]:
    """Where each of two modes goes, and its sign, to agree with the reference: swapped if
    the off-diagonal correlations are larger, flipped where the one that stays is negative.
    The tables have the features that decide."""
    r = {(x["mode_a"], x["mode_b"]): x["r"] or 0.0 for x in loading_correlation(new, reference).collect()}  # four rows
    if not r:
        raise ValueError("the two sets of modes share no feature that decides their order")
    at = lambda i, j: r.get((i, j), 0.0)
    swap = abs(at(0, 1)) + abs(at(1, 0)) > abs(at(0, 0)) + abs(at(1, 1))
    to = {0: 1, 1: 0} if swap else {0: 0, 1: 1}
    return {m: (to[m], -1.0 if at(m, to[m]) < 0 else 1.0) for m in (0, 1)}


def reordered(table: DataFrame, order: dict[int, tuple[int, float]]) -> DataFrame:
    """A table with a mode in that order, loadings (if any) with that sign."""
    mode = F.when(F.col("mode") == 0, order[0][0]).when(F.col("mode") == 1, order[1][0]).otherwise(F.col("mode")).cast("int")
    sign = F.when(F.col("mode") == 0, order[0][1]).when(F.col("mode") == 1, order[1][1]).otherwise(1.0)
    new = {"mode": mode, "loading": F.col("loading") * sign}
    return table.select(*[new[c].alias(c) if c in new else c for c in table.columns]) if "loading" in table.columns else table.withColumn("mode", mode)


def match_modes(new: DataFrame, reference: DataFrame, deciding: Column | None = None) -> DataFrame:
    """Two modes' loadings put in the reference's order and sign, by the features that
    decide (all, if there is no condition)."""
    some = (lambda df: df) if deciding is None else (lambda df: df.where(deciding))
    return reordered(new.select("mode", "feature", "loading"), mode_order(some(new), some(reference)))


def scaled(loadings: DataFrame, modes: DataFrame) -> DataFrame:
    """Loadings times the roots of their eigenvalues, for display."""
    return loadings.join(F.broadcast(modes), "mode").select("mode", "feature", (F.col("loading") * F.sqrt("eigval")).alias("loading"))


def delayed(long: DataFrame, delay: int = 5, copies: int = 3) -> DataFrame:
    """Time-delay copies as further features (feature@copy).  Delays are counted in
    samples as they follow each other, whatever gaps are between them, so copies reach
    across the seams of blocks.  The samples are numbered in one task: they are an axis."""
    axis = long.select("sample").distinct().withColumn("_n", F.row_number().over(Window.orderBy("sample")))
    own = long.join(axis, "sample").select("_n", "feature", "value")
    shifted = own.select(F.explode(F.array(*[F.lit(c) for c in range(copies)])).alias("copy"), "*")
    named = shifted.select((F.col("_n") + F.col("copy") * delay).alias("_n"), F.concat_ws("@", F.col("feature").cast("string"), F.col("copy").cast("string")).alias("feature"), "value")
    return named.join(axis, "_n").select("sample", "feature", "value")


def delayed_weights(weights: DataFrame, copies: int = 3) -> DataFrame:
    """Weights of the features of delayed()."""
    name = F.concat_ws("@", F.col("feature").cast("string"), F.col("copy").cast("string"))
    return weights.select(F.explode(F.array(*[F.lit(c) for c in range(copies)])).alias("copy"), "*").select(name.alias("feature"), "weight")
