"""Small shared pieces: text expressions, tables in the shared folder, joins
whose small side is measured before it is broadcast."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: White space of the contracts, as a Java and Python regular expression.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a table may be broadcast; rows here are a few numbers wide,
#: so this is a few tens of MB at most.  Beyond it a salted join is used.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column, spaces: str = SPACES) -> Column:
    """Runs of characters other than white space, in order."""
    return F.array_remove(F.split(text, spaces, -1), "")


def fold(column: str, divisor: int) -> Column:
    """True where the row belongs to the held-out fold: crc32 of the id's
    decimal text leaves no remainder.  A null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor == 0, F.lit(False))


class Written:
    """A table written once to the shared folder and read from there, so that a
    lost executor costs no recomputation.  ``drop`` removes it; what a returned
    DataFrame still reads goes when the process ends."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        atexit.register(self.drop)

    def drop(self) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(self.path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is over; the folder is the cluster's to clean
            pass
        atexit.unregister(self.drop)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind: they go when a query has ended,
    not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def collected(spark: SparkSession) -> None:
    """The driver gives back what queries that have ended left in its memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def if_small(small: DataFrame, size: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, marked for broadcast if its measured size (by default its rows) is
    within the limit; else as it is, for a join that Spark splits where it is
    skewed.  ``small`` is written already, or cheap."""
    return F.broadcast(small) if (small.count() if size is None else size) <= limit else small


def join_measured(big: DataFrame, small: DataFrame, key: str, how: str = "left", salts: int = 64) -> DataFrame:
    """Join on one key where ``big`` may hold a third of its rows under one key.

    ``small`` (one row a key, already written or cheap) is counted: up to
    BROADCAST_ROWS it is broadcast.  Beyond that both sides are salted, so the
    rows of a hot key spread over ``salts`` tasks.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c != key]), F.lit(salts)).cast("int")
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(spread, [key, "_salt"], how).drop("_salt")
