"""Running sums and ranks of one long series, by all tasks.

A window without keys sorts everything in one task.  Here the order's values are split
into ranges at their approximate quantiles, every range is summed, and what stands
before a range is added to the sums inside it; frames that reach over a seam get the
rows before it as copies.  The driver holds a number a range, ``RANGES`` of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

RANGES = 64
#: Rows of a stretch of a numbered series, at least.
STRETCH = 100_000


def with_range(df: DataFrame, column: str) -> DataFrame:
    """The rows with ``_range``, which grows with the column; equal values share one."""
    at = df.agg(F.percentile_approx(column, [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or []
    ends = F.array(*[F.lit(x) for x in sorted(set(at))]) if at else F.array().cast("array<double>")
    return df.withColumn("_range", F.size(F.filter(ends, lambda x: x < F.col(column))))


def running(df: DataFrame, column: str, sums: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """``{name}_run``: sums up to and with each row in the column's order, whose values
    differ; and the totals."""
    placed = with_range(df, column)
    parts = sorted(placed.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums]).collect(), key=lambda r: r["_range"])
    own = Window.partitionBy("_range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    out, totals = {}, {}
    for c in sums:
        total, before = 0, []
        for r in parts:
            before += [F.lit(r["_range"]), F.lit(total)]
            total += r[c] or 0
        totals[c] = total
        out[f"{c}_run"] = F.sum(c).over(own) + (F.create_map(*before)[F.col("_range")] if before else F.lit(0))
    return placed.withColumns(out).drop("_range"), totals


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """column, n, rank: each value with its rows and their common rank, from one."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    made, _ = running(counted, column, ["n"])
    return made.select(column, "n", (F.col("n_run") - (F.col("n") - 1) / 2).alias("rank"))


def numbered(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """``_n``: the rows' numbers from one in the column's order, whose values differ; and
    how many there are."""
    made, total = running(df.withColumn("_n", F.lit(1).cast("long")), column, ["_n"])
    return made.drop("_n").withColumnRenamed("_n_run", "_n"), int(total["_n"])


def framed(df: DataFrame, before: int, over: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Rows of numbered() with columns that ``over(window)`` makes from windows ordered by
    number whose frames reach at most so many rows back."""
    size = max(STRETCH, 8 * before)
    stretch = F.expr(f"(_n - 1) div {size}")
    here = F.struct(stretch.alias("stretch"), F.lit(True).alias("own"))
    copy = F.when(F.pmod(F.col("_n") - 1, F.lit(size)) >= size - before, F.struct((stretch + 1).alias("stretch"), F.lit(False).alias("own")))
    placed = df.withColumn("_at", F.explode(F.filter(F.array(here, copy), lambda x: x.isNotNull())))
    placed = placed.select("*", F.col("_at.stretch").alias("_stretch"), F.col("_at.own").alias("_own")).drop("_at")
    return placed.withColumns(over(Window.partitionBy("_stretch").orderBy("_n"))).where("_own").drop("_stretch", "_own")
