"""Rollups: summaries by dimensions and time that can be made from finer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.model import Measurement
from tidemark.operators.buckets import bucket_start

#: Columns of a rollup besides dimensions and bucket.
SUMMARY = ("sum", "min", "max", "avg", "count", "first_ts", "last_ts")


def _summary(m: Measurement, field: str) -> list:
    v = F.col(field).cast("double")
    plain = F.when(~F.isnan(v), v)
    return [F.sum(v).alias("sum"), F.min(plain).alias("min"), F.max(plain).alias("max"), F.avg(v).alias("avg"), F.count(v).alias("count"), F.min(m.time).alias("first_ts"), F.max(m.time).alias("last_ts")]


def rollup(m: Measurement, every: str, dimensions: tuple[str, ...] = (), field: str | None = None) -> DataFrame:
    """One row per dimensions and bucket: sum, least, largest, mean and number of values, first and last time."""
    return m.source.groupBy(*dimensions, bucket_start(F.col(m.time), every).alias("bucket")).agg(*_summary(m, m.field(field)))


def coarser(rolled: DataFrame, every: str, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """A rollup made from a finer one, without reading points. Means are made from sums and numbers, never from means."""
    total = F.sum("sum")
    return rolled.groupBy(*dimensions, bucket_start(F.col("bucket"), every).alias("bucket")).agg(
        total.alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), (total / F.nullif(F.sum("count"), F.lit(0))).alias("avg"),
        F.sum("count").alias("count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )


def merged(old: DataFrame, new: DataFrame, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """Rollups of disjoint points with equal buckets, merged."""
    both = old.select(*dimensions, "bucket", *SUMMARY).unionByName(new.select(*dimensions, "bucket", *SUMMARY))
    total = F.sum("sum")
    return both.groupBy(*dimensions, "bucket").agg(
        total.alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), (total / F.nullif(F.sum("count"), F.lit(0))).alias("avg"),
        F.sum("count").alias("count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
    )


def by_hierarchy(m: Measurement, dimensions: tuple[str, ...], field: str | None = None) -> DataFrame:
    """Summaries for each prefix of the dimensions, down to the grand total; `level` has a bit set for each one left out."""
    f = m.field(field)
    return m.source.rollup(*dimensions).agg(F.grouping_id().cast("long").alias("level"), F.sum(f).alias("sum"), F.count(f).alias("count"), F.avg(f).alias("avg"))


def trend(rolled: DataFrame, value: str, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """A rollup with the change of a column against the bucket before it, per dimensions."""
    w = Window.partitionBy(*(dimensions or [F.lit(0)])).orderBy("bucket")
    return rolled.withColumn("previous", F.lag(value).over(w)).withColumn("delta", F.col(value) - F.col("previous"))


def blocks(m: Measurement, every: str = "30 seconds", field: str | None = None) -> DataFrame:
    """Points packed by series and bucket: an array of (offset_us, value) in order of time, and how many there are."""
    f, start = m.field(field), bucket_start(F.col(m.time), every)
    offset = F.unix_micros(F.col(m.time).cast("timestamp")) - F.unix_micros(F.col("bucket").cast("timestamp"))
    points = m.source.withColumn("bucket", start).withColumn("offset_us", offset)
    packed = F.array_sort(F.collect_list(F.struct("offset_us", *m.tiebreak, F.col(f).alias("value"))))
    out = points.groupBy(*m.tags, "bucket").agg(packed.alias("packed"), F.count("*").alias("points"))
    return out.withColumn("packed", F.transform("packed", lambda p: F.struct(p.offset_us.alias("offset_us"), p.value.alias("value"))))


def unblocked(packed: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """The points of blocks: tags, ts, value."""
    p = packed.select(*tags, "bucket", F.explode("packed").alias("p"))
    return p.select(*tags, F.timestamp_micros(F.unix_micros(F.col("bucket").cast("timestamp")) + F.col("p.offset_us")).cast("timestamp_ntz").alias("ts"), F.col("p.value").alias("value"))
