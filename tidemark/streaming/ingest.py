"""Streams: ingest in micro-batches and rollups that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.model import Measurement
from tidemark.operators.maintenance import last_write_wins


def files(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, so many per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, folder: str, checkpoint: str, every: str | None = None, day: str | None = None) -> StreamingQuery:
    """Append a stream to a folder, a batch every so often, or all there is and then stop (every=None).

    The checkpoint is the log that recovery needs: restarted with it, the stream goes on where it stopped and writes nothing twice.
    """
    if day:
        stream = stream.withColumn("day", F.to_date(day))
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.partitionBy("day") if day else writer
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def rollup(stream: DataFrame, time: str, every: str, dimensions: tuple[str, ...], field: str, tiebreak: tuple[str, ...] = (), late: str = "1 hour") -> DataFrame:
    """A running rollup: sum, least, largest, number, first and last value and their times per dimensions and bucket.

    Late points count while their bucket is within `late` of the newest time, then they are dropped and the bucket's
    state is freed. Least and largest leave NaN out, as those of a batch rollup do. Each bucket's state is a fixed number of values, whatever its points are.
    """
    moment = F.col(time).cast("timestamp")
    marked = stream.withColumn("event_time", moment).withWatermark("event_time", late)
    v, at = F.col(field).cast("double"), F.struct("event_time", *tiebreak)
    plain = F.when(~F.isnan(v), v)
    grouped = marked.groupBy(*dimensions, F.window("event_time", every).alias("w")).agg(
        F.sum(v).alias("sum"), F.min(plain).alias("min"), F.max(plain).alias("max"), F.count(v).alias("count"), F.min_by(v, at).alias("first"), F.max_by(v, at).alias("last"),
        F.min("event_time").cast("timestamp_ntz").alias("first_ts"), F.max("event_time").cast("timestamp_ntz").alias("last_ts"),
    )
    return grouped.withColumn("bucket", F.col("w.start").cast("timestamp_ntz")).withColumn("avg", F.col("sum") / F.nullif("count", F.lit(0))).drop("w")


def keep_latest(rolled: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Run a rollup to the end of what there is, writing each batch's changed buckets under table/batch=n.

    A batch that is repeated after a failure overwrites its own folder. `latest` reads the result.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={n}")

    return rolled.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str, dimensions: tuple[str, ...]) -> DataFrame:
    """The newest state of each bucket."""
    df = spark.read.parquet(table)
    rest = [c for c in df.columns if c not in (*dimensions, "bucket", "batch")]
    picked = df.groupBy(*dimensions, "bucket").agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return picked.select(*dimensions, "bucket", *(F.col(f"row.{c}").alias(c) for c in rest))


def ingest_last_write_wins(stream: DataFrame, folder: str, checkpoint: str, roles: dict) -> StreamingQuery:
    """Append a stream with each batch's duplicates settled (the last written stays); reads settle those of different batches.

    Spark's own stream deduplication keeps the first instead. roles: the arguments of Measurement besides its source.
    """

    def write(batch: DataFrame, n: int) -> None:
        last_write_wins(Measurement(batch, **roles)).write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
