"""Connected components of a graph kept as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written


def stars(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link but the roots themselves; root is
    the smallest node of the component.

    Rounds of two steps: every node's larger neighbours, then its smaller ones,
    are linked to the smallest neighbour.  Minima are pre-aggregated and written, so
    that an exchange stands on both sides of the join in which a hub's links meet its
    one minimum, and Spark splits it where it is skewed.
    A round is written to the shared folder, and the rounds end when one leaves
    the links as they were.  Self-links are ignored; no link gives no row.
    """
    now = Written(links.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while before != (before := _mark(now.df)):
        both = now.df.union(now.df.select("b", "a")).toDF("u", "v")
        least = Written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least.df, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = Written(large, "large")
        own = Written(large.df.groupBy("a").agg(F.min("b").alias("m")), "own")
        turned = large.df.join(own.df, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own.df.toDF("a", "b")).distinct()
        after = Written(turned, "links")
        for done in (now, least, large, own):
            done.drop()
        now = after
    return now.df.toDF("node", "root")


def _mark(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
