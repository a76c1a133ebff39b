"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Document statistics are counted from a text's bytes, in Arrow batches.  Cosines
of random projections approximate a Gaussian kernel over the standardized
statistics; each partition sums its part of the normal equations, the few sums
are added and solved.  Scores that a row's own label had no part in (three-fold)
are binned, and the bins' label shares made monotone.

Only ``SAMPLE`` labelled rows outside the held-out fold are learnt from: the one
bound here.  Everything is scored.

Cases: null and empty texts are scored by their (zero) statistics; a document
with several labels counts their mean, null labels not at all; with no usable
label every score is one half; repeated rows score alike; labels, lang, source
and doc_id are never inputs of a score; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, fold

#: Labelled rows learnt from at most (about), cosines, kernel scale, ridge,
#: cross-fitting parts, calibration bins, partitions that sum.
SAMPLE, COSINES, SCALE, RIDGE, PARTS, BINS, SUMMERS = 40_000, 192, 0.15, 0.02, 3, 1000, 8
#: Range of raw scores that the bins cover; scores beyond count at its ends.
LOW, HIGH = -0.5, 1.5


#: Bytes that are counted, a statistic each; capitals and the others are ASCII.
COUNTED = (bytes(range(65, 91)), b"0123456789", b"#*$%&<>", b"|", b"!", b".,;:?")
SPACE = b" \t\n\r\x0b\x0c"
STATISTICS = 14


def statistics(text: str) -> list[float]:
    """What a score sees of a text: a few passes over its bytes, and its distinct
    words and lines."""
    raw = text.encode()
    split = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(b" ")]
    count = lambda some: len(raw) - len(raw.translate(None, some))
    n_words, n_lines = max(len(split), 1), max(len(lines), 1)
    dense = max(len(text) - count(SPACE), 1)
    return [
        np.log1p(len(text)), np.log1p(len(split)), dense / n_words, *[count(some) / dense for some in COUNTED],
        len(set(split)) / n_words, 1 - len(set(lines)) / n_lines, n_lines / n_words, (len(raw) - len(text)) / dense, raw.count(b".") / n_words,
    ]


def _matrix_of(texts: pa.Array) -> np.ndarray:
    """The statistics of a column of texts; one text at a time is made a string."""
    return np.array([statistics(text.as_py() or "") for text in texts], np.float64).reshape(-1, STATISTICS)


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # one column a part, and one of all rows
    at: np.ndarray  # calibration: raw scores, and their label share
    share: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(7)
        z = np.clip((x - self.mean) / self.spread, -5, 5)
        w, b = rng.normal(size=(x.shape[1], COSINES)) * SCALE, rng.uniform(0, 2 * np.pi, COSINES)
        return np.hstack([np.sqrt(2 / COSINES) * np.cos(z @ w + b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray, column: int = -1) -> np.ndarray:
        return self.features(x) @ self.weights[:, column]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score, with a trace of the raw one so that order is kept
        where the calibration is flat."""
        raw = self.raw(x)
        return 0.999 * np.interp(raw, self.at, self.share) + 0.001 / (1 + np.exp(-np.clip(raw, -9, 9)))


def monotone(share: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest non-decreasing values: neighbours out of order are pooled."""
    pools: list[list[float]] = []
    for s, w in zip(share, weight, strict=True):
        pools.append([s * w, w, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            for k, v in enumerate(pools.pop()):
                pools[-1][k] += v
    return np.repeat([s / w for s, w, _ in pools], [int(n) for *_, n in pools])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.array(batch.column("x").flatten()).reshape(len(batch), -1)


def labelled(docs: DataFrame, labels: DataFrame, label: str, divisor: int, bound: int) -> DataFrame:
    """doc_id, x, y, part of about ``bound`` labelled documents outside the fold."""
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~fold("doc_id", divisor))
    y = y.groupBy("doc_id").agg(F.avg(label).alias("y"))
    y = Written(y.sample(min(1.0, bound / max(y.count(), 1)), 5), "labels").df
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    # y is about ``bound`` rows of 16 bytes
    some = docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select("text", "y", part.alias("part"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(_matrix_of(batch.column(0))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, batch.column(1), batch.column(2)], names=["x", "y", "part"])

    return some.mapInArrow(seen, "x array<double>, y double, part int")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 5, bound: int = SAMPLE) -> Model | None:
    """None if no document outside the held-out fold has a label."""
    rows = Written(labelled(docs, labels, label, divisor, bound), "labelled")
    n = STATISTICS
    column = [F.col("x")[k] for k in range(n)]
    m = rows.df.agg(F.count(F.lit(1)), *[F.avg(c) for c in column], *[F.stddev_pop(c) for c in column]).first()
    if not m[0]:
        rows.drop()
        return None
    model = Model(np.array(m[1 : n + 1]), np.array(m[n + 1 :]) + 1e-6, np.zeros((COSINES + 1, PARTS + 1)), np.zeros(1), np.zeros(1))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, COSINES + 1, COSINES + 2))
        for batch in batches:
            p, y, part = model.features(_matrix(batch)), np.array(batch.column("y")), np.array(batch.column("part"))
            for k in range(PARTS):
                own = part == k
                sums[k] += p[own].T @ np.hstack([p[own], y[own, None]])
        yield pa.RecordBatch.from_arrays([pa.array(list(range(PARTS)), pa.int32()), pa.array(sums.reshape(PARTS, -1).tolist())], names=["part", "sums"])

    summed = np.zeros((PARTS, COSINES + 1, COSINES + 2))
    # SUMMERS x PARTS rows of a fixed length
    for row in rows.df.coalesce(SUMMERS).mapInArrow(equations, "part int, sums array<double>").collect():
        summed[row["part"]] += np.array(row["sums"]).reshape(COSINES + 1, -1)
    for k in range(PARTS + 1):
        s = summed.sum(0) - (summed[k] if k < PARTS else 0)
        model.weights[:, k] = np.linalg.solve(s[:, :-1] + RIDGE * np.eye(COSINES + 1), s[:, -1])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, y = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            p, part = model.features(_matrix(batch)), np.array(batch.column("part"))
            raw = np.einsum("ij,ji->i", p, model.weights[:, part])
            at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
            n += np.bincount(at, minlength=BINS)
            y += np.bincount(at, np.array(batch.column("y")), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(n), pa.array(y)], names=["bin", "n", "y"])

    found = rows.df.coalesce(SUMMERS).mapInArrow(bins, "bin long, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).where("n > 0").orderBy("bin").toPandas()
    rows.drop()
    model.at = (found["bin"].to_numpy() + 0.5) / BINS * (HIGH - LOW) + LOW
    model.share = monotone((found["y"] / found["n"]).to_numpy(), found["n"].to_numpy())
    return model


def score(model: Model | None, column: str = "text") -> Column:
    """The score of a text column."""
    if model is None:
        return F.lit(0.5)
    given = model

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(given.score(_matrix_of(texts)), pa.float64())

    return scored(F.col(column))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 5, limit: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    scored = docs.select("doc_id", fold("doc_id", divisor).alias("held_out"), score(fit(docs, labels, label, divisor)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 5, limit: float = 0.3) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    model = fit(docs, labels, label, divisor)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), score(model).alias("score"))
    return held.where(F.col("score") >= limit).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
