"""Streams of timed values: windowed means and sessions, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A table of events, one file or a folder of them, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return stream.parquet(path)
    folder, _, name = path.rpartition("/")
    return stream.option("pathGlobFilter", name).parquet(folder)


def windowed_mean(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Mean by key in tumbling windows; rows of windows that the watermark has passed are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), key).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, gap: str = "24 hours", late: str = "24 hours", key: str = "user_id") -> DataFrame:
    """Runs of a key's events that are at most the gap apart."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


def drain(aggregated: DataFrame, out: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is now; its result, as written.

    With keys (of which ``w`` is the window) a batch writes only the groups that it
    changed, under its own number, so that a batch that runs again leaves the same; the
    last version of each group is the result.  State and rows behind the watermark are
    dropped.  Without keys every batch writes all groups anew, and state is kept: this is
    for sessions, which can't be updated."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}" if keys else out)

    mode = "update" if keys else "complete"
    run = aggregated.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    spark = aggregated.sparkSession
    if not keys:
        return spark.read.schema(aggregated.schema).parquet(out)
    rest = [c for c in aggregated.columns if c not in keys]
    written = spark.read.schema(StructType([*aggregated.schema, StructField("batch", IntegerType())])).parquet(out)
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*aggregated.columns)
